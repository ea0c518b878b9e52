"""Repeated passages by recompression of word sequences.

Words are compressed in rounds: maximal runs of a word get a name, then adjacent pairs of symbols that a hash puts left
and right, again and again. Names are hashes of what they stand for, so equal passages are compressed alike in every
document except near their edges. For each symbol the span of words is kept that decides it. A window names the widest
symbol decided inside the window itself; equal windows therefore name the same symbol, wherever they stand.

Symbols are met across the cluster first: a window whose symbol no other text holds is not repeated. Only the windows
under shared symbols are then compared word by word, as two hashes of 122 bits together.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from rosterforge.llm.shared import WordHashes, mix, shared_folder, staged

WINDOW = 13
ROUNDS = 5
FAR = 1 << 40
NAME_BITS = np.uint64(58)
PAIR_LEFT, PAIR_RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
# Characters that one batch of texts and one cell of names stand for; both numbers grow with the table.
BATCH_CHARS, CELL_CHARS = 4_000_000, 24_000_000


class Symbols:
    """Symbols in text order: names, spans of words, the spans that decide them, and their text."""

    def __init__(self, name, start, stop, lo, hi, text):
        self.name, self.start, self.stop, self.lo, self.hi, self.text = name, start, stop, lo, hi, text

    def __len__(self) -> int:
        return len(self.name)

    def named_runs(self) -> tuple["Symbols", np.ndarray]:
        """Maximal runs as one symbol each, with the mask of runs longer than one. Both neighbours decide a run's ends."""
        first = np.concatenate([[True], (self.name[1:] != self.name[:-1]) | (self.text[1:] != self.text[:-1])])
        at = np.flatnonzero(first)
        last = np.concatenate([at[1:], [len(self)]]) - 1
        size = last - at + 1
        name = np.where(size > 1, mix(self.name[at] * PAIR_LEFT + size.astype(np.uint64)), self.name[at])
        text = self.text[at]
        before = np.concatenate([[False], text[1:] == text[:-1]])
        after = np.concatenate([text[1:] == text[:-1], [False]])
        lo = np.where(before, self.lo[np.maximum(at - 1, 0)], -FAR)
        hi = np.where(after, self.hi[np.minimum(last + 1, len(self) - 1)], FAR)
        return Symbols(name, self.start[at], self.stop[last], lo, hi, text), size > 1

    def named_pairs(self, turn: int) -> tuple["Symbols", np.ndarray]:
        """Pairs of a left and a right symbol as one symbol each, with their mask.

        A pair decides itself. A left symbol that stays alone is decided by its right neighbour too, a right one by its left.
        """
        left = mix(self.name ^ np.uint64(turn + 1)) & np.uint64(1) == 0
        near = self.text[1:] == self.text[:-1]
        opens = np.concatenate([left[:-1] & ~left[1:] & near, [False]])
        closes = np.concatenate([[False], opens[:-1]])
        lo = np.where(left | closes, self.lo, np.minimum(self.lo, np.where(np.concatenate([[False], near]), np.concatenate([[0], self.lo[:-1]]), -FAR)))
        hi = np.where(~left | opens, self.hi, np.maximum(self.hi, np.where(np.concatenate([near, [False]]), np.concatenate([self.hi[1:], [0]]), FAR)))
        keep = np.flatnonzero(~closes)
        paired = opens[keep]
        other = np.minimum(keep + 1, len(self) - 1)
        name = np.where(paired, mix(self.name[keep] * PAIR_LEFT + self.name[other] * PAIR_RIGHT), self.name[keep])
        stop = np.where(paired, self.stop[other], self.stop[keep])
        lo, hi = np.where(paired, np.minimum(lo[keep], lo[other]), lo[keep]), np.where(paired, np.maximum(hi[keep], hi[other]), hi[keep])
        return Symbols(name, self.start[keep], stop, lo, hi, self.text[keep]), paired


def window_symbols(ids: np.ndarray, text: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each place the widest symbol (6 bits of width, 58 of name) decided by the ``window`` words from there; ties by name.

    ``ids`` are hashes of words, ``text`` the number of their text, in order. Places whose window leaves the text mean nothing.
    """
    n = len(ids)
    best = np.zeros((window, n), np.uint64)

    def offer(s: Symbols, which: np.ndarray) -> None:
        which = which & (s.hi - s.lo <= window)
        at, wide = s.lo[which], (s.hi - s.lo)[which]
        key = (s.stop - s.start)[which].astype(np.uint64) << NAME_BITS | mix(s.name[which]) >> np.uint64(6)
        np.maximum.at(best, (wide - 1, at), key)

    places = np.arange(n)
    best[0] = np.uint64(1) << NAME_BITS | mix(ids) >> np.uint64(6)
    symbols, named = Symbols(ids, places, places + 1, places, places + 1, text).named_runs()
    offer(symbols, named)
    for turn in range(ROUNDS):
        symbols, named = symbols.named_pairs(turn)
        offer(symbols, named)
    # A symbol that w words decide lies in the windows from window - w places before them.
    widest = best[0]
    for w in range(1, window):
        widest[:-1] = np.maximum(widest[:-1], widest[1:])
        widest = np.maximum(widest, best[w])
    return widest


def window_hashes(ids: np.ndarray, window: int = WINDOW) -> np.ndarray:
    acc = np.full(max(0, len(ids) - window + 1), window, np.uint64)
    for i in range(window):
        acc = acc * PAIR_RIGHT + ids[i:i + len(acc)]
        acc ^= acc >> np.uint64(31)
    return np.concatenate([acc, np.zeros(len(ids) - len(acc), np.uint64)])


class Batch:
    """The texts of one batch as word hashes, and the places where windows start."""

    def __init__(self, table: pa.Table, hashes: WordHashes):
        self.words = [t.as_buffer().to_pybytes().split() for t in table.column("said").combine_chunks()]
        self.known = pc.is_valid(table.column("doc")).to_numpy()
        self.doc = pc.fill_null(table.column("doc"), 0).to_numpy()
        sizes = np.array([len(w) for w in self.words], np.int64)
        self.first = np.cumsum(sizes) - sizes
        self.ids = np.concatenate([hashes.of(w) for w in self.words]) if len(sizes) else np.empty(0, np.uint64)
        self.text = np.repeat(np.arange(len(sizes)), sizes)
        left = np.repeat(self.first + sizes, sizes) - np.arange(len(self.ids))
        self.starts = np.flatnonzero(left >= WINDOW)
        self.symbols = window_symbols(self.ids, self.text)[self.starts] if len(self.starts) else np.empty(0, np.uint64)

    def hashes(self) -> np.ndarray:
        """A hash of the words of every window."""
        return window_hashes(self.ids)[self.starts]


def _raw(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def _by_cell(cells: np.ndarray, batch: int, *columns: np.ndarray) -> pa.Table:
    """One row per cell: cell, batch and each column's values of that cell as bytes."""
    order = np.argsort(cells, kind="stable")
    cuts = np.flatnonzero(np.diff(cells[order])) + 1
    parts = [np.split(c[order], cuts) if len(c) else [] for c in columns]
    found = cells[order][np.concatenate([[0], cuts]).astype(np.int64)] if len(cells) else np.empty(0, np.int64)
    arrays = [pa.array(found.astype(np.int64)), pa.array(np.full(len(found), batch, np.int64))]
    return pa.table([*arrays, *[pa.array([_raw(v) for v in p], pa.binary()) for p in parts]], ["cell", "b", *"pqrs"[:len(columns)]])


def _joined(table: pa.Table, column: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of bytes, and the number of each one's row."""
    raw = table.column(column).to_pylist()
    sizes = [len(r) // np.dtype(kind).itemsize for r in raw]
    return np.frombuffer(bytearray().join(raw), kind) if raw else np.empty(0, kind), np.repeat(np.arange(len(raw)), sizes)


def batches_of_texts(docs: DataFrame, key: str, text: str) -> tuple[str, DataFrame, int]:
    """(name of texts, rows, cells): every distinct text once, in batches, and which row holds which text.

    ``texts`` (b, row, doc, said) is a bucketed table in the shared folder, so that later passes over the batches move
    no text again; ``doc`` is the least key of the text's rows. Texts that more than a thousandth of the rows repeat, a
    thousand at most, are merged before the shuffle.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("said")).withColumn("row", F.unhex(F.md5(F.coalesce("said", F.lit("")))))
    size = F.length("said").cast("long")
    counts = staged(rows.groupBy("row").agg(F.count("*").alias("n"), F.min("doc").alias("doc"), F.max(size).alias("chars")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars")).first()
    batches, cells = 1 + total["chars"] // BATCH_CHARS, 1 + total["chars"] // CELL_CHARS
    crowded = F.broadcast(counts.where(F.col("n") * 1000 > total["n"]).select("row"))
    spoken = rows.where("said IS NOT NULL")
    few = spoken.join(crowded, "row", "left_anti")
    many = spoken.join(crowded, "row", "left_semi").groupBy("row").agg(F.min("doc").alias("doc"), F.first("said").alias("said"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = few.unionByName(many.select(*few.columns)).withColumn("b", F.pmod(F.xxhash64("row"), F.lit(batches)).cast("long"))
    texts = dealt.repartition(buckets, "b").groupBy("b", "row").agg(F.min("doc").alias("doc"), F.first("said").alias("said"))
    name = f"texts_{uuid.uuid4().hex}"
    texts.write.option("path", shared_folder(spark)).option("compression", "zstd").bucketBy(buckets, "b").saveAsTable(name)
    return name, rows.select("doc", "row"), cells


def shared_symbols(texts: DataFrame, cells: int) -> DataFrame:
    """(b, p): the window symbols of each batch that stand in another text too, as bytes.

    A batch sends each of its symbols once, so a passage in a third of all texts is one name a batch.
    """
    def send(table: pa.Table) -> pa.Table:
        batch = Batch(table.filter(pc.is_valid(table.column("doc"))), WordHashes())
        text = batch.text[batch.starts]
        new = np.concatenate([[True], (batch.symbols[1:] != batch.symbols[:-1]) | (text[1:] != text[:-1])])[:len(text)]
        symbols, text = batch.symbols[new], text[new]
        order = np.argsort(symbols, kind="stable")
        symbols, text = symbols[order], text[order]
        at = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]])[:len(symbols)])
        several = text[at] != text[np.concatenate([at[1:], [len(text)]])[:len(at)] - 1]
        names = symbols[at]
        return _by_cell((names % np.uint64(cells)).astype(np.int64), table.column("b")[0].as_py(), names, several.astype(np.uint8))

    def meet(table: pa.Table) -> pa.Table:
        names, who = _joined(table, "p", np.uint64)
        several, _ = _joined(table, "q", np.uint8)
        order = np.argsort(names, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], names[order][1:] != names[order][:-1]]))
        size = np.diff(np.concatenate([at, [len(names)]]))
        common = np.repeat((size > 1) | (np.maximum.reduceat(several[order], at) > 0), size)
        kept = np.sort(order[common])
        parts = np.split(names[kept], np.searchsorted(who[kept], np.arange(1, table.num_rows)))
        return pa.table([table.column("b"), pa.array([_raw(p) for p in parts], pa.binary())], ["b", "p"])

    sent = texts.groupBy("b").applyInArrow(send, "cell long, b long, p binary, q binary")
    return staged(sent.groupBy("cell").applyInArrow(meet, "b long, p binary"))


def repeated_windows(texts: DataFrame, symbols: DataFrame, cells: int) -> DataFrame:
    """(b, p, q, r): symbol and hash of windows of each batch that a smaller document holds too, and that document."""
    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        kinds = ["cell", "b", *"pqrs"]
        if not table.num_rows or not answers.num_rows:
            return pa.table([pa.array([], pa.int64())] * 2 + [pa.array([], pa.binary())] * 4, kinds)
        batch = Batch(table.filter(pc.is_valid(table.column("doc"))), WordHashes())
        names = np.sort(_joined(answers, "p", np.uint64)[0])
        spot = np.minimum(np.searchsorted(names, batch.symbols), max(0, len(names) - 1))
        asked = names[spot] == batch.symbols if len(names) else np.zeros(len(batch.symbols), bool)
        symbols, hashes, doc = batch.symbols[asked], batch.hashes()[asked], batch.doc[batch.text[batch.starts[asked]]]
        order = np.lexsort((doc, hashes, symbols))
        symbols, hashes, doc = symbols[order], hashes[order], doc[order]
        new = np.concatenate([[True], (symbols[1:] != symbols[:-1]) | (hashes[1:] != hashes[:-1])])[:len(symbols)]
        at = np.flatnonzero(new)
        last = np.concatenate([at[1:], [len(doc)]])[:len(at)] - 1
        return _by_cell((hashes[at] % np.uint64(cells)).astype(np.int64), table.column("b")[0].as_py(), symbols[at], hashes[at], doc[at], doc[last])

    def meet(table: pa.Table) -> pa.Table:
        (symbols, who), hashes = _joined(table, "p", np.uint64), _joined(table, "q", np.uint64)[0]
        least, most = _joined(table, "r", np.int64)[0], _joined(table, "s", np.int64)[0]
        order = np.lexsort((hashes, symbols))
        s, h = symbols[order], hashes[order]
        at = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (h[1:] != h[:-1])]))
        first = np.empty(len(s), np.int64)
        first[order] = np.repeat(np.minimum.reduceat(least[order], at), np.diff(np.concatenate([at, [len(s)]])))
        kept = np.flatnonzero(first < most)
        cuts = np.searchsorted(who[kept], np.arange(1, table.num_rows))
        return pa.table([table.column("b"), *[pa.array([_raw(v) for v in np.split(c[kept], cuts)], pa.binary()) for c in (symbols, hashes, first)]], ["b", *"pqr"])

    sent = texts.groupBy("b").cogroup(symbols.groupBy("b")).applyInArrow(send, "cell long, b long, p binary, q binary, r binary, s binary")
    return staged(sent.groupBy("cell").applyInArrow(meet, "b long, p binary, q binary, r binary"))


CUT = "row binary, least long, n_words long, spans array<struct<start:long,stop:long>>, kept string, whole string, kept_digest string, whole_digest string"
CUT_KINDS = pa.schema([("row", pa.binary()), ("least", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                       ("kept", pa.string()), ("whole", pa.string()), ("kept_digest", pa.string()), ("whole_digest", pa.string())])


def cut_texts(texts: DataFrame, windows: DataFrame, digests: bool) -> DataFrame:
    """Per distinct text: its least document, words, the covered spans of words there, and what is left."""
    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        batch = Batch(table, WordHashes())
        edge = np.zeros(len(batch.ids) + 1, np.int64)
        symbols, hashes, least = (_joined(answers, c, k)[0] for c, k in (("p", np.uint64), ("q", np.uint64), ("r", np.int64)))
        if len(symbols):
            order = np.lexsort((hashes, symbols))
            symbols, hashes, least = symbols[order], hashes[order], least[order]
            keys = mix(symbols) + hashes
            order = np.argsort(keys, kind="stable")
            asked, said = batch.symbols, batch.hashes()
            spot = order[np.minimum(np.searchsorted(keys, mix(asked) + said, sorter=order), len(keys) - 1)]
            text = batch.text[batch.starts]
            hit = (symbols[spot] == asked) & (hashes[spot] == said) & batch.known[text] & (least[spot] < batch.doc[text])
            np.add.at(edge, batch.starts[hit], 1)
            np.add.at(edge, batch.starts[hit] + WINDOW, -1)
        gone = np.cumsum(edge[:-1]) > 0
        out = []
        for row, doc, words, first in zip(table.column("row").to_pylist(), table.column("doc").to_pylist(), batch.words, batch.first, strict=True):
            mine = gone[first:first + len(words)]
            turns = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8)))
            whole = b" ".join(words)
            kept = b" ".join([words[i] for i in np.flatnonzero(~mine).tolist()]) if len(turns) else whole
            out.append({"row": row, "least": doc, "n_words": len(words), "spans": [{"start": a, "stop": b} for a, b in turns.reshape(-1, 2).tolist()],
                        "kept": None if digests else kept.decode(), "whole": None if digests else whole.decode(),
                        "kept_digest": hashlib.sha256(kept).hexdigest(), "whole_digest": hashlib.sha256(whole).hexdigest()})
        return pa.Table.from_pylist(out, CUT_KINDS)

    return texts.groupBy("b").cogroup(windows.groupBy("b")).applyInArrow(cut, CUT)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """Per row of ``docs``: key, row, n_words, n_removed, spans (start, stop) of removed words, kept, kept_digest.

    A word goes if one of the windows of 13 words that cover it also starts in a document with a smaller key. Words are
    what ASCII white space separates, unchanged. ``kept`` is the words left joined by one space (none are kept with
    ``digests``), ``kept_digest`` its SHA-256. Keys are integers. Copies of one text are judged once; every copy but the one with the least key goes as a
    whole if it has 13 words. Null and empty texts have no words. A null key is no smaller and no larger than any: such rows
    stay whole and remove nothing. Rows that share a key do not remove each other's words. An empty table gives no rows.
    """
    spark = docs.sparkSession
    name, rows, cells = batches_of_texts(docs, key, text)
    texts = spark.table(name)
    told = staged(cut_texts(texts, repeated_windows(texts, shared_symbols(texts, cells), cells), digests))
    spark.sql(f"DROP TABLE {name}")
    first = F.col("doc").isNull() | (F.col("doc") <= F.col("least"))
    copy = ~first & (F.col("n_words") >= WINDOW)
    none, whole = F.array().cast("array<struct<start:long,stop:long>>"), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("stop")))
    keeps = F.col("doc") == F.col("least")
    spans = F.when(copy, whole).when(keeps, F.coalesce("spans", none)).otherwise(none)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    out = rows.join(told, "row", "left").withColumn("removes", F.coalesce(copy, F.lit(False))).withColumn("keeps", F.coalesce(keeps, F.lit(False)))
    out = out.select(F.col("doc").alias(key), "row", F.coalesce("n_words", F.lit(0).cast("long")).alias("n_words"), spans.alias("spans"),
                     F.when(F.col("removes") | F.col("n_words").isNull(), "").when(F.col("keeps"), F.col("kept")).otherwise(F.col("whole")).alias("kept"),
                     F.when(F.col("removes"), nothing).when(F.col("keeps"), F.col("kept_digest")).otherwise(F.coalesce("whole_digest", nothing)).alias("kept_digest"))
    return out.select(key, "row", "n_words", removed.alias("n_removed"), "spans", "kept", "kept_digest")


def op11(spark, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True).select("doc_id", "n_words", "n_removed", F.col("kept_digest").alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13)),
m AS (SELECT g, min(doc_id) AS f FROM g GROUP BY g),
h AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS p FROM g JOIN m USING (g) WHERE doc_id > f),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d) ANTI JOIN h USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
