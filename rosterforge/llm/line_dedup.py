"""Near-duplicate lines by an exact set-similarity join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from rosterforge.llm.shared import WordHashes, connected_components, in_blocks, mix, staged

BUCKETS = 1 << 18  # of the table of token counts, whatever the vocabulary
PIECE = 512
BLOCK_ROWS = 1024
PAIRS, TOKENS = 1 << 19, 1 << 21  # pairs and tokens that a task compares at a time
LAST = (1 << 63) - 1


def _line_words(texts: list[str | None]) -> tuple[list[bytes], list[int], list[int]]:
    """All words of the texts, words per line, lines per text; lines end at \\n, words at ASCII white space."""
    words, sizes, lines = [], [], []
    for text in texts:
        parts = text.encode("utf-8", "surrogatepass").lower().split(b"\n") if text is not None else []
        for part in parts:
            found = part.split()
            words += found
            sizes.append(len(found))
        lines.append(len(parts))
    return words, sizes, lines


def token_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Occurrences by token hash modulo BUCKETS over all texts: a table of fixed size, summed in each task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, hashes = np.zeros(BUCKETS, np.int64), WordHashes()
        for batch in batches:
            for value in batch.column("text"):
                body = value.as_py()
                if body:
                    at = hashes.of(body.encode("utf-8", "surrogatepass").lower().split()) % np.uint64(BUCKETS)
                    total += np.bincount(at.astype(np.int64), minlength=BUCKETS) if len(at) > BUCKETS // 8 else 0
                    if len(at) <= BUCKETS // 8:
                        np.add.at(total, at.astype(np.int64), 1)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": filled, "n": total[filled]})

    summed = docs.select(F.col(text).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(BUCKETS, np.uint32)
    counts[summed["bucket"].to_numpy()] = np.minimum(summed["n"].to_numpy(), (1 << 32) - 1)
    return counts


def _ordered_sets(words: list[bytes], sizes: list[int], counts: np.ndarray, hashes: WordHashes):
    """Distinct tokens of each line, rarest first: (tokens, their line, their place, distinct tokens per line)."""
    ids, line = hashes.of(words), np.repeat(np.arange(len(sizes)), sizes)
    seen = counts[(ids % np.uint64(BUCKETS)).astype(np.int64)]
    order = np.lexsort((ids, seen, line))
    ids, line, seen = ids[order], line[order], seen[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (line[1:] != line[:-1])
    ids, line, seen = ids[new], line[new], seen[new]
    n = np.bincount(line, minlength=len(sizes))
    place = np.arange(len(ids)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(ids) else np.empty(0, np.int64)
    return ids, line, place, n, seen


def _grouped(values: np.ndarray, line: np.ndarray, rows: int, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(line, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _class_of(ids: np.ndarray, line: np.ndarray, rows: int) -> np.ndarray:
    total = np.zeros(rows, np.uint64)
    np.add.at(total, line, mix(ids))
    twist = np.zeros(rows, np.uint64)
    np.bitwise_xor.at(twist, line, ids)
    return mix(total + mix(twist ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64)


def prefix_length(n: np.ndarray, tenths: int) -> np.ndarray:
    return n + (-n * tenths) // 10 + 1


def _parity(ids: np.ndarray, line: np.ndarray, n: np.ndarray) -> pa.Array:
    """Parity bits per line, as many as a power of two from 256 on that is no less than its tokens, in 64-bit words."""
    words = np.maximum(4, 1 << np.ceil(np.log2(np.maximum(n, 1) / 64)).clip(0).astype(np.int64))
    ends = np.cumsum(words)
    bit = (mix(ids) % (64 * words[line]).astype(np.uint64)).astype(np.int64)
    flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    np.bitwise_xor.at(flat, (ends - words)[line] + bit // 64, np.uint64(1) << (bit % 64).astype(np.uint64))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.view(np.int64)))


def _lines(docs: DataFrame, counts, tenths: int) -> DataFrame:
    """(doc, line, c, n, prefix, places, bits) per line with words; the last three only where the task sees the set first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table, seen_sets = WordHashes(), counts.value, set()
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                piece = batch.slice(at, PIECE)
                words, sizes, lines = _line_words(piece.column("text").to_pylist())
                if not words:
                    continue
                ids, line, place, n, seen = _ordered_sets(words, sizes, table, hashes)
                c = _class_of(ids, line, len(sizes))
                if len(seen_sets) > 2_000_000:
                    seen_sets.clear()
                fresh = np.array([not (k in seen_sets or seen_sets.add(k)) for k in c.tolist()], bool)
                use = (place < prefix_length(n, tenths)[line]) & (seen > 1) & fresh[line]
                asks = np.bincount(line[use], minlength=len(sizes)) > 0
                bits = _parity(ids, line, n)
                doc, row = (np.repeat(piece.column(k).to_numpy(zero_copy_only=False), lines) for k in ("doc", "row"))
                number = np.concatenate([np.arange(k) for k in lines]) if lines else np.empty(0, np.int64)
                made = pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(number, pa.int64()), pa.array(c), pa.array(n, pa.int64()), _grouped(ids[use].view(np.int64), line[use], len(sizes), pa.int64()),
                                                   _grouped(place[use], line[use], len(sizes), pa.int64()), pc.if_else(pa.array(asks), bits, pa.scalar(None, bits.type))], ["doc", "row", "line", "c", "n", "prefix", "places", "bits"])
                yield made.filter(pa.array(n > 0))
    return docs.select("doc", "row", "text").mapInArrow(run, "doc long, row long, line long, c long, n long, prefix array<long>, places array<long>, bits array<long>")


def _line_sets(docs: DataFrame) -> DataFrame:
    """(c, tokens) of the lines numbered in ``wanted``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, flat = WordHashes(), np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                parts = text.encode("utf-8", "surrogatepass").lower().split(b"\n")
                chosen = [parts[k].split() for k in wanted if k < len(parts)]
                words, sizes = [w for part in chosen for w in part], [len(part) for part in chosen]
                ids, line, _, _, _ = _ordered_sets(words, sizes, flat, hashes)
                yield pa.RecordBatch.from_arrays([pa.array(_class_of(ids, line, len(sizes))), _grouped(ids.view(np.int64), line, len(sizes), pa.int64())], ["c", "tokens"])
    return docs.mapInArrow(run, "c long, tokens array<long>")


def _whole_cells(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole cells of ``in_blocks`` and where each cell begins, closed by the number of rows."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        table = pa.Table.from_batches([*kept, batch])
        at = np.stack([table.column(c).to_numpy() for c in (key, "i", "j")])
        ends = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1
        if len(ends):
            yield table.slice(0, int(ends[-1])), np.concatenate([[0], ends])
        kept = table.slice(int(ends[-1]) if len(ends) else 0).combine_chunks().to_batches()
    if kept:
        table = pa.Table.from_batches(kept)
        yield table, np.array([0, table.num_rows])


def _listed(table: pa.Table, name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(all values, begin of each row's values) of a list column."""
    column = table.column(name).combine_chunks()
    sizes = pc.list_value_length(column).to_numpy().astype(np.int64)
    return column.flatten().to_numpy().view(kind), np.cumsum(sizes) - sizes


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of each span, one after the other."""
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


def _chunks(weight: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges whose weights sum to about ``most``."""
    total = np.cumsum(weight)
    cuts = np.unique(np.searchsorted(total, np.arange(most, int(total[-1]) if len(total) else 0, most), "left") + 1)
    edges = np.unique(np.concatenate([[0], cuts, [len(weight)]]))
    yield from zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def _lowest(rows: int, i: np.ndarray, j: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches over the links (i, j) and over those that ``low`` stands for."""
    i, j = np.concatenate([i, np.arange(rows)]), np.concatenate([j, low])
    while True:
        before = low.copy()
        both = np.minimum(low[i], low[j])
        np.minimum.at(low, i, both)
        np.minimum.at(low, j, both)
        low = low[low]
        if (before == low).all():
            return low


def _likely(tenths: int):
    """(a, b): each line class of a cell and the first one it reaches over pairs that sizes, places and parity bits let through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_cells(batches, "token"):
            ids, n, place, side = (table.column(c).to_numpy() for c in ("id", "n", "place", "side"))
            bits, begin = _listed(table, "bits", np.uint64)
            words = np.diff(np.append(begin, len(bits)))
            rows = len(ids)
            later = np.repeat(starts[1:], np.diff(starts)) - np.arange(rows) - 1
            low = np.arange(rows)
            for lo, hi in _chunks(later, PAIRS):
                i = np.repeat(np.arange(lo, hi), later[lo:hi])
                j = _spans(np.arange(lo, hi) + 1, later[lo:hi])
                both = n[i] + n[j]
                room = np.minimum(n[i] - place[i], n[j] - place[j])
                ok = ((side[i] == 0) | (side[i] != side[j])) & (room * (10 + tenths) >= both * tenths) & (np.minimum(n[i], n[j]) * 10 >= np.maximum(n[i], n[j]) * tenths)
                i, j, both = i[ok], j[ok], both[ok]
                apart = np.zeros(len(i), np.int64)
                width = np.minimum(words[i], words[j])
                for w in np.unique(width).tolist():
                    of = np.flatnonzero(width == w)
                    for a, b in _chunks(np.maximum(words[i[of]], words[j[of]]), TOKENS):
                        part = of[a:b]
                        apart[part] = np.bitwise_count(_folded(bits, begin, words, i[part], w) ^ _folded(bits, begin, words, j[part], w)).sum(axis=1, dtype=np.int64)
                met = apart * (10 + tenths) <= both * (10 - tenths)
                low = _lowest(rows, i[met], j[met], low)
            tied = low != np.arange(rows)
            yield pa.RecordBatch.from_arrays([pa.array(ids[tied]), pa.array(ids[low[tied]])], ["a", "b"])
    return run


def _folded(bits: np.ndarray, begin: np.ndarray, words: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """Parity bits of ``rows`` in ``width`` words: the halves of a longer sketch add up to the shorter one."""
    out = np.empty((len(rows), width), np.uint64)
    for w in np.unique(words[rows]).tolist():
        at = np.flatnonzero(words[rows] == w)
        out[at] = np.bitwise_xor.reduce(bits[begin[rows[at]][:, None] + np.arange(w)].reshape(len(at), w // width, width), axis=1)
    return out


def _overlaps(tokens: np.ndarray, begin: np.ndarray, n: np.ndarray, kinds: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Tokens that the sets i and j share; ``tokens`` are numbered from 0 to ``kinds`` and ascend in each set."""
    out = np.zeros(len(i), np.int64)
    for lo, hi in _chunks(n[i] + n[j], TOKENS):
        a, b, pair = i[lo:hi], j[lo:hi], np.arange(hi - lo)
        ours = tokens[_spans(begin[a], n[a])] + np.repeat(pair, n[a]) * kinds
        theirs = tokens[_spans(begin[b], n[b])] + np.repeat(pair, n[b]) * kinds
        at = np.minimum(np.searchsorted(ours, theirs), len(ours) - 1)
        out[lo:hi] = np.bincount(np.repeat(pair, n[b])[ours[at] == theirs], minlength=hi - lo)
    return out


def _later(tenths: int):
    """(c): line classes of a cell similar to one whose first line comes earlier. A class is done with the first it finds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_cells(batches, "cluster"):
            cell = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            order = np.lexsort((*(table.column(k).to_numpy() for k in ("fl", "fr", "fd")), cell))
            ids, side = table.column("id").to_numpy()[order], table.column("side").to_numpy()[order]
            values, begin = _listed(table, "tokens", np.uint64)
            n = np.diff(np.append(begin, len(values)))[order]
            begin = begin[order]
            names, tokens = np.unique(values, return_inverse=True)
            first = starts[cell]  # rows of a cell stay together when ordered
            earlier = np.arange(len(ids)) - first
            found = np.zeros(len(ids), bool)
            done, step, left = 0, 1, np.flatnonzero(earlier > 0)
            while len(left):
                size = np.minimum(step, earlier[left] - done)
                for lo, hi in _chunks(size, PAIRS):
                    j = np.repeat(left[lo:hi], size[lo:hi])
                    i = _spans(first[left[lo:hi]] + done, size[lo:hi])
                    ok = ((side[i] == 0) | (side[i] != side[j])) & (np.minimum(n[i], n[j]) * 10 >= np.maximum(n[i], n[j]) * tenths)
                    i, j = i[ok], j[ok]
                    shared = _overlaps(tokens, begin, n, len(names), i, j)
                    found[j[shared * 10 >= (n[i] + n[j] - shared) * tenths]] = True
                done, step = done + step, 2 * step
                left = left[~found[left] & (earlier[left] > done)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[found])], ["c"])
    return run


def repeated_lines(docs: DataFrame, tenths: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, row, n_lines, removed) per row, ``row`` a hash of key and text: numbers of the lines similar to an earlier one, Jaccard of word sets * 10 >= ``tenths``.

    Lines with equal sets are one class, met by the class's first line in the order (key, row, line). Tokens are ordered by
    rarity, read from a table of counts of fixed size (a shared cell only makes the order less sharp, any order is
    exact); a token that occurs once joins with nothing and is left out. Prefixes meet by token, in blocks, under the length
    and positional filters and parity bits, which never part similar sets; what these let through forms clusters, where
    whole sets are compared, in blocks as well. Pairs are never written. A line goes if an earlier line of any document is
    similar to it, removed itself or not.

    Null texts have no lines. Lines without words stay. Rows with a null key come last in the order. Rows that share
    a key, or have none, are told apart by their text; rows that repeat key and text are decided alike. An empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc"), F.col(text).alias("text")).withColumn("row", F.xxhash64("id", "text"))
    counts = docs.sparkSession.sparkContext.broadcast(token_counts(rows))
    lines = staged(_lines(rows, counts, tenths))
    classes = staged(lines.groupBy("c").agg(F.min(F.struct("doc", "row", "line")).alias("first")))
    heads = lines.where("size(prefix) > 0").select(F.col("c").alias("id"), "n", "bits", "prefix", "places").dropDuplicates(["id"])
    heads = staged(heads)
    keyed = heads.select("id", F.explode(F.arrays_zip("prefix", "places")).alias("p")).select("id", F.col("p.prefix").alias("token"), F.col("p.places").alias("place"))
    likely = in_blocks(keyed, "token", BLOCK_ROWS, heads.select("id", "n", "bits")).mapInArrow(_likely(tenths), "a long, b long").distinct()
    clusters = staged(connected_components(likely).withColumnRenamed("component", "cluster"))
    asked = clusters.select(F.col("id").alias("c")).join(classes, "c").groupBy("first.doc", "first.row").agg(F.collect_list("first.line").alias("wanted"))
    sets = _line_sets(rows.where("text IS NOT NULL").join(asked, ["doc", "row"]).select("text", "wanted")).dropDuplicates(["c"])
    sets = staged(sets.join(classes, "c").select(F.col("c").alias("id"), "tokens", F.col("first.doc").alias("fd"), F.col("first.row").alias("fr"), F.col("first.line").alias("fl")))
    later = in_blocks(clusters, "cluster", BLOCK_ROWS, sets).mapInArrow(_later(tenths), "c long").distinct()
    fate = classes.join(later.withColumn("later", F.lit(True)), "c", "left").select("c", F.col("first.doc").alias("fd"), F.col("first.row").alias("fr"), F.col("first.line").alias("fl"), F.coalesce("later", F.lit(False)).alias("later"))
    gone = lines.select("doc", "row", "line", "c").join(fate, "c").where("later OR doc <> fd OR row <> fr OR line <> fl").groupBy("doc", "row").agg(F.array_sort(F.collect_set("line")).alias("removed"))
    size = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"))) + 1).cast("long")
    return rows.select("id", "doc", "row", size.alias("n_lines")).join(gone, ["doc", "row"], "left").select(F.col("id").alias(key), "row", "n_lines", F.coalesce("removed", F.array().cast("array<long>")).alias("removed"))


def without_lines(docs: DataFrame, removed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the lines named in ``removed`` (key, row, removed) taken out of the text."""
    named = removed.select(F.col(key).alias("__key"), F.col("row").alias("__row"), F.col("removed").alias("__gone")).where("size(__gone) > 0").dropDuplicates(["__key", "__row"])
    parts = F.split(F.col(text), "\n")
    kept = F.array_except(F.sequence(F.lit(0).cast("long"), F.size(parts).cast("long") - 1), F.col("__gone"))
    cut = F.when(F.col("__gone").isNotNull() & F.col(text).isNotNull(), F.array_join(F.transform(kept, lambda i: F.get(parts, i.cast("int"))), "\n")).otherwise(F.col(text))
    return docs.join(named, F.col(key).eqNullSafe(F.col("__key")) & (F.xxhash64(F.col(key), F.col(text)) == F.col("__row")), "left").withColumn(text, cut).select(*docs.columns)


def op7(spark, sf_dir: str) -> DataFrame:
    out = repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed_lines"))


OP7_SQL = r"""
WITH l AS (SELECT doc_id, (i - 1)::BIGINT AS line, list_sort(list_distinct(regexp_extract_all(translate(ls[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'))) AS w
    FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
c AS (SELECT w, min(row(doc_id, line)) AS f, row_number() OVER (ORDER BY w) AS c, len(w) AS n FROM l WHERE len(w) > 0 GROUP BY w),
t AS (SELECT c, n, unnest(w) AS t FROM c),
q AS (SELECT t, count(*) AS k FROM t GROUP BY t),
r AS (SELECT c, n, t, row_number() OVER (PARTITION BY c ORDER BY k, t) AS i FROM t JOIN q USING (t)),
p AS (SELECT DISTINCT a.c AS a, b.c AS b FROM r a JOIN r b ON a.t = b.t AND a.c < b.c WHERE a.i <= a.n - ceil(0.8 * a.n) + 1 AND b.i <= b.n - ceil(0.8 * b.n) + 1 AND 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)),
e AS (SELECT x.f AS fa, y.f AS fb, x.w AS wa, y.w AS wb FROM p JOIN c x ON x.c = p.a JOIN c y ON y.c = p.b WHERE 18 * len(list_intersect(x.w, y.w)) >= 8 * (x.n + y.n)),
d AS (SELECT DISTINCT CASE WHEN fa < fb THEN wb ELSE wa END AS w FROM e),
g AS (SELECT l.doc_id, l.line FROM l JOIN c ON c.w = l.w LEFT JOIN d ON d.w = l.w WHERE d.w IS NOT NULL OR row(l.doc_id, l.line) <> c.f),
h AS (SELECT doc_id, count(*) AS n, string_agg(line::VARCHAR, ',' ORDER BY line) AS told FROM g GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed, coalesce(told, '') AS removed_lines
FROM documents LEFT JOIN h USING (doc_id)
"""
