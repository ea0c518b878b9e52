"""Periodic runs of words by tiles per period octave.

An octave holds the periods from P to 2P (the first one those below 16). A document is laid out in overlapping tiles of
5P words, one before and four after each boundary at a multiple of P. Every run of three periods holds a whole aligned
block of P words and that block again one period later, so some tile sees it. Tiles are solved alone, with Z-functions
from their boundary in both directions; the fragments they find are shuffled by document and period and stitched.
"""

from __future__ import annotations

import functools
import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rosterforge.llm.shared import staged

LEAST, TIMES = 24, 3
FIRST_BLOCK = 8
BATCH_WORDS = 1_000_000
TILED = "key string, row binary, n_words long, found array<struct<period:long,start:long,stop:long>>, said string, digest string"
RUNS = "array<struct<start:long,period:long,length:long>>"


class _Numbers(dict):
    """Small numbers of words, as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = len(self)
        return value


def z_function(s: list[int]) -> list[int]:
    """For each place the length of the longest common prefix of ``s`` and its rest from there."""
    n = len(s)
    z = [0] * n
    lo = hi = 0
    for i in range(1, n):
        k = min(z[i - lo], hi - i) if i < hi else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    if n:
        z[0] = n
    return z


@functools.lru_cache(1 << 16)
def prime_factors(n: int) -> tuple[int, ...]:
    out, r = [], 2
    while r * r <= n:
        if n % r == 0:
            out.append(r)
            while n % r == 0:
                n //= r
        r += 1
    return (*out, n) if n > 1 else tuple(out)


def solve_tile(words: np.ndarray, at: int, block: int, periods: list[int]) -> Iterator[tuple[int, int, int]]:
    """(period, start, stop) of the stretches with one of ``periods`` that hold the block at ``at``, cut at the tile's ends.

    Periods whose first words are themselves a repeated shorter block are left out: the shorter period tells them.
    """
    lo, near, far = max(0, at - block), min(len(words), at + 2 * block), min(len(words), at + 4 * block)
    ahead = z_function(words[at:far].tolist())
    before = words[lo:at][::-1].tolist()
    behind = z_function([*before, -1, *words[lo:near][::-1].tolist()])
    for q in periods:
        if ahead[q] < block or any(ahead[q // r] >= q - q // r for r in prime_factors(q)):
            continue
        back = behind[len(before) + 1 + near - at - q]
        yield q, at - back, at + q + ahead[q]


def stitched(pieces: list[tuple[int, int]], period: int) -> list[tuple[int, int]]:
    """Intervals of one period as maximal stretches: those that share at least a period are one."""
    out: list[list[int]] = []
    for start, stop in sorted(pieces):
        if out and start <= out[-1][1] - period:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def fragments_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(period, start, stop) of every text (numbers of words), stitched as far as tiles of one text were solved here.

    Blocks of P words are named by doubling. A tile is solved if its aligned block's name comes again P to 2P words
    later; names only choose tiles and periods, the Z-functions compare the words.
    """
    found: list[dict[int, list[tuple[int, int]]]] = [defaultdict(list) for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    names = np.concatenate(texts).astype(np.uint64) if texts else np.empty(0, np.uint64)
    block = 1
    while len(names):
        if block >= FIRST_BLOCK:
            rest = sizes[owner] - place
            whole = np.flatnonzero(rest >= block)
            hits = []
            for back in (block, 0) if block == FIRST_BLOCK else (block,):
                i = whole[place[whole] >= back]
                anchor = i - place[i] % block - back
                same = (names[i] == names[anchor]) & (i > anchor)
                hits.append(np.stack([anchor[same], i[same] - anchor[same]]))
            anchors, periods = np.concatenate(hits, axis=1)
            order = np.lexsort((periods, anchors))
            anchors, periods = anchors[order], periods[order]
            cuts = np.flatnonzero(np.diff(anchors)) + 1
            for a, qs in zip(np.split(anchors, cuts), np.split(periods, cuts), strict=True):
                if len(a):
                    who = int(owner[a[0]])
                    for q, start, stop in solve_tile(texts[who], int(place[a[0]]), block, qs.tolist()):
                        found[who][q].append((start, stop))
        # The next block: twice as long, only in texts that can hold three periods of it.
        follow = np.minimum(np.arange(len(names)) + block, len(names) - 1)
        names = names * np.uint64(0x9E3779B97F4A7C15) + names[follow] * np.uint64(0xC2B2AE3D27D4EB4F)
        names ^= names >> np.uint64(29)
        names *= np.uint64(0xBF58476D1CE4E5B9)
        block *= 2
        stay = sizes[owner] >= max(LEAST, TIMES * block)
        names, owner, place = names[stay], owner[stay], place[stay]
    return [[(q, a, b) for q, pieces in f.items() for a, b in stitched(pieces, q)] for f in found]


def tile_fragments(docs: DataFrame, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """Staged rows (key, row, n_words, found, said, digest): per document the fragments of its tiles and its words.

    ``row`` tells key and text apart from all others. ``said`` is the words joined by one space; with ``digests``,
    documents without fragments keep only the SHA-256 of that.
    """
    named = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("said"))
    named = named.select("key", F.unhex(F.md5(F.concat_ws(":", F.coalesce("key", F.lit("-")), F.coalesce("said", F.lit(""))))).alias("row"), "said")
    kinds = pa.schema([("key", pa.string()), ("row", pa.binary()), ("n_words", pa.int64()),
                       ("found", pa.list_(pa.struct([("period", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())]))), ("said", pa.string()), ("digest", pa.string())])

    def solve(keys: list, rows: list, spoken: list[list[bytes]]) -> pa.RecordBatch:
        numbers = _Numbers()
        found = fragments_of([np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in spoken])
        out = []
        for k, r, w, f in zip(keys, rows, spoken, found, strict=True):
            joined = b" ".join(w)
            kept = f or not digests
            out.append({"key": k, "row": r, "n_words": len(w), "found": [{"period": q, "start": a, "stop": b} for q, a, b in f],
                        "said": joined.decode("utf-8", "replace") if kept else None, "digest": hashlib.sha256(joined).hexdigest()})
        return pa.RecordBatch.from_pylist(out, kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows, spoken, size = [], [], [], 0
            for k, r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = t.as_buffer().to_pybytes().split() if t.is_valid else []
                keys.append(k)
                rows.append(r)
                spoken.append(words)
                size += len(words)
                if size > BATCH_WORDS:
                    yield solve(keys, rows, spoken)
                    keys, rows, spoken, size = [], [], [], 0
            if keys:
                yield solve(keys, rows, spoken)

    return staged(named.mapInArrow(run, TILED))


def stitched_runs(tiled: DataFrame) -> DataFrame:
    """(row, start, length, period) of every run, from the fragments of ``tile_fragments`` shuffled by row and period.

    Equal fragments of repeated rows become one before the shuffle.
    """
    pieces = tiled.select("row", F.explode("found").alias("f")).select("row", "f.*").groupBy("row", "period", "start", "stop").agg(F.count("*").alias("copies"))
    ordered = Window.partitionBy("row", "period").orderBy("start", "stop")
    reach = F.max("stop").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    begun = pieces.withColumn("begins", F.when(F.col("start") <= reach - F.col("period"), 0).otherwise(1))
    whole = begun.withColumn("part", F.sum("begins").over(ordered)).groupBy("row", "period", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    length = F.col("stop") - F.col("start")
    return whole.where(length >= F.greatest(F.lit(LEAST), TIMES * F.col("period"))).select("row", "start", length.alias("length"), "period")


def collapsed(tiled: DataFrame, runs: DataFrame) -> DataFrame:
    """(key, row, n_words, runs, said, digest): every run cut to its first period.

    ``runs`` is a list by start, then period. ``said`` is the kept words joined by one space, or null where
    ``tile_fragments`` kept none; ``digest`` is its SHA-256. Only texts with fragments cross the cluster, each once
    however often its row is repeated; the answers then join the rows.
    """
    lists = runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    texts = tiled.where("size(found) > 0").groupBy("row").agg(F.first("said").alias("said")).join(lists, "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = []
            for said, told in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = said.encode().split()
                edge = np.zeros(len(words) + 1, np.int64)
                for r in told:
                    edge[r["start"] + r["period"]] += 1
                    edge[r["start"] + r["length"]] -= 1
                kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                cut.append(b" ".join([words[i] for i in kept.tolist()]))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array([c.decode() for c in cut], pa.string()), pa.array([hashlib.sha256(c).hexdigest() for c in cut], pa.string())],
                ["row", "runs", "cut", "cut_digest"])

    cuts = texts.select("row", "said", "runs").mapInArrow(run, f"row binary, runs {RUNS}, cut string, cut_digest string")
    none = F.array().cast(RUNS)
    return tiled.select("key", "row", "n_words", "said", "digest").join(cuts, "row", "left").select(
        "key", "row", "n_words", F.coalesce("runs", none).alias("runs"), F.when(F.col("said").isNotNull(), F.coalesce("cut", "said")).alias("said"), F.coalesce("cut_digest", "digest").alias("digest"))


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """Per row of ``docs``: key (as string), row, n_words, runs, said, digest; see ``collapsed``.

    A run is a stretch of words with smallest period q, at least 24 words and three periods long, that no neighbour
    extends. Words are what ASCII white space separates. Null and empty texts have no words and no runs. Repeated rows
    each give a row; rows with a null key are treated like others. An empty table gives no rows; other columns are ignored.
    """
    tiled = tile_fragments(docs, key, text, digests)
    return collapsed(tiled, stitched_runs(tiled))


def with_planted_periods(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) where a tenth of the keys, by checksum, repeat a block of their words up to the end of the text."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    asked = docs.select(F.col(key), F.col(text), g.alias("__g"), F.when(h % 10 == 0, words).alias("__w")).withColumn("__n", F.size("__w"))
    planted = asked.where("__n > 0").withColumn("__a", (F.col("__g") % F.col("__n")).cast("int"))
    planted = planted.withColumn("__p", (1 + F.floor((F.col("__n") - F.col("__a")) / (3 + F.col("__g") % 8))).cast("int"))
    rest = F.col("__n") - F.col("__a")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("__w", F.col("__a") + 1, F.col("__p")), F.ceil(rest / F.col("__p")).cast("int"))), F.lit(1), rest)
    changed = F.array_join(F.concat(F.slice("__w", F.lit(1), F.col("__a")), tail), " ")
    return planted.select(key, changed.alias(text)).unionByName(asked.where("coalesce(__n, -1) <= 0").select(key, text))


def op13(spark, sf_dir: str) -> DataFrame:
    docs = with_planted_periods(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    told = periodic_runs(docs, digests=True)

    def better(a, b):
        """The run with the larger exponent as a fraction; the earlier one in the list at a tie."""
        return F.when(a["period"].isNull() | (b["length"].cast("decimal(19,0)") * a["period"].cast("decimal(19,0)") > a["length"].cast("decimal(19,0)") * b["period"].cast("decimal(19,0)")), b).otherwise(a)

    nothing = F.lit(None).cast("struct<start:bigint,period:bigint,length:bigint>")
    best = F.aggregate("runs", nothing, better)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return told.withColumn("best", best).select(
        F.col("key").cast("long").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.col("digest").alias("collapsed_sha256"))
