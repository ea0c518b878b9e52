"""N-gram Jaccard join by parity sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rosterforge.llm.shared import WordHashes, connected_components, in_blocks, mix, shingle_set, space_words, staged, whole_cells

BAND_RATIO = 1.25
BLOCK_ROWS = 1024
SKETCH_WORDS = 16  # 1,024 parity bits for the check of candidates
SMALL_CELL = 8  # rows of the cells that are judged side by side
WIDE_WORDS = 1024  # at most 65,536 parity bits for the check before sets are compared
WIDE_HELD = 1 << 20  # sketch words that are compared at once


def band_starts(largest: int) -> list[int]:
    """Smallest set size of each band up to the one that holds ``largest``."""
    starts = [1]
    while starts[-1] <= largest:
        starts.append(max(starts[-1] + 1, int(starts[-1] * BAND_RATIO)))
    return starts


def sketch_shape(band_end: int, percent: int) -> tuple[int, int]:
    """(words of a band's sketch, most empty words for which it is safe to leave empty words out).

    Sets of at most U = ``band_end`` - 1 tokens with a Jaccard of percent/100 differ in at most
    d = 2U(100 - percent) / (100 + percent) tokens. Each differing token changes one sketch word, so of d + 1 + spare
    words at least 1 + spare agree; if one side has at most ``spare`` empty words, one that agrees is not empty.
    No words where d is 0: only equal sets qualify there.
    """
    differing = 2 * (band_end - 1) * (100 - percent) // (100 + percent)
    spare = 3 + differing // 8
    return (differing + 1 + spare, spare) if differing else (0, 0)


def sketch_keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Join keys of one set: each word of its parity sketch, in its own size band and in those of larger partners."""
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64)
    starts = band_starts(n * 100 // percent)
    keys = []
    for band in range(int(np.searchsorted(starts, n, "right")) - 1, len(starts) - 1):
        width, spare = sketch_shape(starts[band + 1], percent)
        if not width:
            continue
        place = (mix(tokens ^ np.uint64(0xA5A5A5A5)) % np.uint64(width)).astype(np.int64)
        words = np.zeros(width, np.uint64)
        np.bitwise_xor.at(words, place, tokens)
        filled = np.bincount(place, minlength=width) > 0
        if width - int(filled.sum()) > spare:
            filled[:] = True
        at = np.flatnonzero(filled).astype(np.uint64)
        keys.append(mix(words[filled] ^ mix(at + np.uint64(band << 32))))
    return np.concatenate(keys) if keys else np.empty(0, np.uint64)


def parity_bits(tokens: np.ndarray) -> np.ndarray:
    """Each token flips one of the bits: the Hamming distance of two sketches is at most the symmetric difference."""
    bits = np.bincount((mix(tokens) % np.uint64(64 * SKETCH_WORDS)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _sets(docs: DataFrame, size: int) -> Iterator:
    """Batches of at most 1,024 rows as (ids, shingle sets); the hash table lives as long as the task."""
    hashes = WordHashes()
    for batch in docs:
        for at in range(0, batch.num_rows, 1024):
            piece = batch.slice(at, 1024)
            yield piece.column("id"), [shingle_set(space_words(t.as_py()), size, hashes) for t in piece.column("text")]


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    return (int(np.bitwise_xor.reduce(tokens)), int(mix(tokens).sum(dtype=np.uint64))) if len(tokens) else (0, 0)


def _described(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, n, x, s, bits, keys) per row: size, two digests, parity bits and sketch keys of the set, made in one pass.

    A task writes keys for the first row with an id that it sees of equal sets; the others share its fate by digest.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for ids, sets in _sets(batches, size):
            digests = [_digest(s) for s in sets]
            fresh = []
            for named, mark in zip(ids.is_valid().to_pylist(), digests, strict=True):
                fresh.append(named and mark not in seen)
                if named:
                    seen.add(mark)
            if len(seen) > 200_000:
                seen.clear()
            marks = np.array(digests, np.uint64).view(np.int64).reshape(-1, 2)
            bits = _lists([parity_bits(s).view(np.uint64) for s in sets])
            keys = _lists([sketch_keys(s, percent) if f else s[:0] for s, f in zip(sets, fresh, strict=True)])
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1]), bits, keys], ["id", "n", "x", "s", "bits", "keys"])
    return docs.select("id", "text").mapInArrow(run, "id long, n long, x long, s long, bits array<long>, keys array<long>")


def _tokens(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets(batches, size):
            yield pa.RecordBatch.from_arrays([ids, _lists(sets)], ["id", "tokens"])
    return docs.select("id", "text").mapInArrow(run, "id long, tokens array<long>")


def wide_words(n: int) -> int:
    """Words of the wide sketch of a set: a power of two with at least one bit per token, WIDE_WORDS at most."""
    return min(WIDE_WORDS, 1 << max(0, (n - 1).bit_length() - 6))


def wide_sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity bits as many as the set asks for; one of half the words is the exclusive or of its halves."""
    bits = 64 * wide_words(len(tokens))
    flips = np.bincount((mix(tokens) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.uint64)


def _still_near(pairs: np.ndarray, n: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The pairs that sketches of the width of the smaller set let through too.

    1,024 bits tell nothing about sets of some 2,300 tokens and more at 0.8: unrelated ones differ in half the bits.
    """
    words = np.array([wide_words(int(k)) for k in n], np.int64)
    width = np.minimum(words[pairs[0]], words[pairs[1]])
    stays = np.ones(pairs.shape[1], bool)
    for w in np.unique(width[width > SKETCH_WORDS // 2]).tolist():
        at = np.flatnonzero(width == w)
        used = np.unique(pairs[:, at])
        place = np.zeros(len(n), np.int64)
        place[used] = np.arange(len(used))
        rows = np.stack([np.bitwise_xor.reduce(wide_sketch(sets[p]).reshape(-1, w), axis=0) for p in used.tolist()])
        for lo in range(0, len(at), step := max(1, WIDE_HELD // w)):
            part = at[lo:lo + step]
            i, j = pairs[:, part]
            apart = np.bitwise_count(rows[place[i]] ^ rows[place[j]]).sum(axis=1, dtype=np.int64)
            stays[part] = apart * (100 + percent) <= (n[i] + n[j]) * (100 - percent)
    return pairs[:, stays]


def _near_pairs(table: pa.Table, percent: int):
    """Pairs of a cell that sizes and parity bits let through: places, nearest first."""
    n, side = (table.column(c).to_numpy() for c in ("n", "side"))
    bits = _bits(table)
    a, b = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
    found = []
    for at in range(0, len(a), 64):
        p = a[at:at + 64]
        apart = np.bitwise_count(bits[p, None, :] ^ bits[None, b, :]).sum(axis=2, dtype=np.int64)
        ok = apart * (100 + percent) <= (n[p, None] + n[None, b]) * (100 - percent)
        if (side == 0).all():
            ok &= p[:, None] < b[None, :]
        i, j = np.nonzero(ok)
        found.append(np.stack([apart[i, j], p[i], b[j]]))
    met = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
    return met[1:, np.argsort(met[0], kind="stable")]


def _bits(table: pa.Table) -> np.ndarray:
    return table.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(table.num_rows, SKETCH_WORDS)


def _small_pairs(table: pa.Table, starts: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that parity bits let through in cells of up to SMALL_CELL rows, taken side by side."""
    n, bits, found = table.column("n").to_numpy(), _bits(table), [np.empty((2, 0), np.int64)]
    for size in range(2, SMALL_CELL + 1):
        at = starts[sizes == size]
        for p in range(size if len(at) else 0):
            for q in range(p + 1, size):
                apart = np.bitwise_count(bits[at + p] ^ bits[at + q]).sum(axis=1, dtype=np.int64)
                first = at[apart * (100 + percent) <= (n[at + p] + n[at + q]) * (100 - percent)]
                found.append(np.stack([first + p, first + q]))
    return tuple(np.concatenate(found, axis=1))


def _forest(percent: int, key: str, exact: bool):
    """A spanning forest of the pairs of each cell that the parity bits let through and, if ``exact``, whose sets qualify.

    Sets are compared only for pairs that no earlier link of the cell joins; at most one edge per row leaves, except
    that small cells leave every pair let through, once per batch, where sets are not compared.
    """
    def opened(batches: Iterator[pa.RecordBatch], out: tuple[list[int], list[int]]) -> Iterator[pa.Table]:
        for whole, ends in whole_cells(batches, key):
            starts, sizes = np.array(ends[:-1], np.int64), np.diff(ends)
            large = (sizes > SMALL_CELL) | ((sizes > 1) & np.logical_or.reduceat(whole.column("side").to_numpy() != 0, starts))
            i, j = _small_pairs(whole, starts[~large], sizes[~large], percent)
            if exact:
                large[np.searchsorted(starts, i, "right") - 1] = True
            else:
                ids = whole.column("id").to_numpy()
                met = np.unique(np.stack([ids[i], ids[j]]), axis=1)
                for side, new in zip(out, met.tolist(), strict=True):
                    side += new
                yield whole.slice(0, 0)  # nothing to compare, so that what was found can leave
            yield from (whole.slice(starts[cell], sizes[cell]) for cell in np.flatnonzero(large).tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list[int], list[int]] = ([], [])
        for table in opened(batches, out):
            ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
            root = list(range(len(ids)))
            pairs = _near_pairs(table, percent)
            sets: list[np.ndarray] = []
            if exact and pairs.shape[1]:
                column = table.column("tokens").combine_chunks()
                at, flat = column.offsets.to_numpy(), column.values.to_numpy()
                sets = [flat[lo:hi] for lo, hi in zip(at[:-1], at[1:], strict=True)]
                pairs = _still_near(pairs, n, sets, percent)

            def find(c: int) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            for i, j in pairs.T.tolist():
                x, y = find(i), find(j)
                if x == y:
                    continue
                if exact:
                    shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if shared * 100 < int(n[i] + n[j] - shared) * percent:
                        continue
                root[y] = x
                out[0].append(int(ids[i]))
                out[1].append(int(ids[j]))
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])
                for side in out:
                    side.clear()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])
    return run


def near_duplicate_groups(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) per row: sets of ``size``-word shingles link when Jaccard * 100 >= ``percent``.

    Equal sets become one class. Each class meets others on the words of its parity sketch, per size band, which by
    pigeonhole finds every qualifying pair. Whoever shares a word is compared by parity bits, in blocks; what these let
    through forms clusters, in which wider parity bits, as many as a set asks for, and then the sets themselves are
    compared, in blocks as well. Only a forest of links leaves a task, so the pairs of a group are never written and no
    link between groups is missed.

    Null and empty texts have no shingles and link with nothing. Rows with a null key keep a null component. Rows that
    repeat a key give one row each and one text's links hold for all of them. An empty table gives no rows.
    """
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    made = staged(_described(docs, size, percent))
    known = made.where("id IS NOT NULL AND n > 0").select("id", "n", "bits").dropDuplicates(["id"])
    shared = Window.partitionBy("k")
    rows = made.where("id IS NOT NULL").select("id", F.explode("keys").alias("k"))
    live = staged(rows.withColumn("lo", F.min("id").over(shared)).withColumn("hi", F.max("id").over(shared)).where("lo <> hi").select("k", "id"))
    # Buckets compare parity bits alone. What they let through forms clusters, close to the true groups.
    met = staged(in_blocks(live, "k", BLOCK_ROWS, known).mapInArrow(_forest(percent, "k", False), "a long, b long").distinct())
    clusters = staged(connected_components(met).withColumnRenamed("component", "cluster"))
    sets = staged(_tokens(docs.join(clusters.select("id"), "id", "left_semi"), size).dropDuplicates(["id"]).join(known, "id"))
    linked = staged(in_blocks(clusters, "cluster", BLOCK_ROWS, sets).mapInArrow(_forest(percent, "cluster", True), "a long, b long"))
    groups = connected_components(linked)
    # Equal sets are one class; its component is the smallest id that any member reaches.
    classes = made.where("id IS NOT NULL AND n > 0").join(groups, "id", "left").groupBy("n", "x", "s").agg(F.min("id").alias("rep"), F.min(F.coalesce("component", "id")).alias("component"), F.max("component").alias("group"))
    lowest = classes.groupBy(F.coalesce("group", "rep").alias("of")).agg(F.min("component").alias("component_id"))
    named = classes.withColumn("of", F.coalesce("group", "rep")).join(lowest, "of").select("n", "x", "s", "component_id")
    few = named.join(made.where("n > 0").groupBy("n", "x", "s").agg(F.count("*").alias("rows"), F.min("id").alias("rep")), ["n", "x", "s"]).where("rows > 1 OR component_id <> rep").drop("rows", "rep")
    out = made.drop("bits", "keys").join(few, ["n", "x", "s"], "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def op6(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 3, 90)


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + least(3, len(w)) - 1], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, bit_xor(('0x' || substr(g, 1, 15))::BIGINT) AS x, sum(('0x' || substr(g, 16, 10))::BIGINT) AS s FROM g GROUP BY doc_id),
c AS (SELECT n, x, s, min(doc_id) AS rep FROM n GROUP BY n, x, s),
r AS (SELECT c.rep, g.g, c.n, row_number() OVER (PARTITION BY c.rep ORDER BY f.f, g.g) AS i FROM c JOIN g ON g.doc_id = c.rep JOIN (SELECT g, count(*) AS f FROM g JOIN c ON c.rep = g.doc_id GROUP BY g) f ON f.g = g.g),
p AS (SELECT DISTINCT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb FROM r a JOIN r b ON a.g = b.g AND a.rep < b.rep
    WHERE a.i <= a.n - ceil(0.9 * a.n) + 1 AND b.i <= b.n - ceil(0.9 * b.n) + 1 AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)),
e AS (SELECT a, b FROM p JOIN r x ON x.rep = a JOIN r y ON y.rep = b AND y.g = x.g GROUP BY a, b, na, nb HAVING 100 * count(*) >= 90 * (na + nb - count(*))),
t AS (SELECT a AS v, b AS u FROM e UNION SELECT b, a FROM e),
reach AS (SELECT rep AS v, rep AS u FROM c UNION SELECT reach.v, t.u FROM reach JOIN t ON t.v = reach.u),
k AS (SELECT v, min(u) AS component FROM reach GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(k.component, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.n = n.n AND c.x = n.x AND c.s = n.s LEFT JOIN k ON k.v = c.rep
"""
