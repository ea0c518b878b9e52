"""Helpers of the corpus operators: staged tables, word hashes, connected components."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@functools.cache
def _private_folder() -> str:
    return tempfile.mkdtemp(prefix="rosterforge-llm-")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that every executor sees, below ``spark.checkpoint.dir``.

    Only a local session that names none gets a private folder; a cluster without the setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _private_folder()
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


class WordHashes(dict):
    """64-bit hashes of words (bytes), kept for the next use while the table is small."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def space_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    v = values.astype(np.uint64, copy=True)
    v ^= v >> np.uint64(30)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v


def shingle_set(words: list[bytes], size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; fewer words are one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    ids = hashes.of(words)
    width = min(size, len(ids))
    rows = len(ids) - width + 1
    acc = np.full(rows, width, np.uint64)
    for i in range(width):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + ids[i:i + rows])
    return np.unique(acc)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id in ``edges``: the component is the smallest id reachable.

    Alternating large-star and small-star rounds on the edge table; each round is two grouped minima
    and joins, staged in the shared folder. No list of neighbours is ever gathered.
    """
    pairs = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        pairs = staged(small.select("e.*").where("u <> v").distinct())
        mark = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    roots = pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def in_blocks(rows: DataFrame, key: str, block_rows: int, carried: DataFrame | None = None) -> DataFrame:
    """Deal the rows of each ``key`` so that all pairs meet while no task holds more than two blocks.

    A key with more than ``block_rows`` rows is cut into blocks by a hash of ``id``; each row goes to every cell (i, j) of
    its block. ``side`` is 0 within one block, else it tells the two blocks apart. Keys with one row are left out.
    ``carried`` (one row per ``id``) joins after the dealing, so that its columns cross the cluster once.
    """
    crowds = rows.groupBy(key).agg(F.count("*").alias("__rows")).where("__rows > 1").select(key, F.ceil(F.col("__rows") / block_rows).cast("int").alias("__blocks"))
    own = F.pmod(F.xxhash64("id", F.lit(1)), "__blocks").cast("int")
    dealt = rows.join(crowds, key).withColumn("__own", own).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    placed = dealt.withColumn("i", F.least("__own", "__other")).withColumn("j", F.greatest("__own", "__other")).withColumn("side", F.signum(F.col("__own") - F.col("__other")).cast("int"))
    placed = placed.drop("__own", "__other", "__blocks")
    if carried is not None:
        placed = placed.join(carried, "id")
    return placed.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def whole_cells(batches: Iterable[pa.RecordBatch], key: str):
    """(table, ends): rows of whole cells of ``in_blocks`` and where each begins and the last one ends."""
    kept: list[pa.RecordBatch] = []

    def cuts(table: pa.Table) -> list[int]:
        at = np.stack([table.column(c).to_numpy() for c in (key, "i", "j")])
        return [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), table.num_rows]

    for batch in batches:
        table = pa.Table.from_batches([*kept, batch])
        ends = cuts(table)
        if len(ends) > 2:
            yield table.slice(0, ends[-2]), ends[:-1]
        kept = table.slice(ends[-2]).combine_chunks().to_batches()
    if kept:
        yield (table := pa.Table.from_batches(kept)), [0, table.num_rows]


def cells_of(batches: Iterable[pa.RecordBatch], key: str):
    """Tables of the cells of ``in_blocks``, in the order they come; a cell may run over several batches."""
    for table, ends in whole_cells(batches, key):
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            yield table.slice(lo, hi - lo)
