"""Near-duplicate vectors by randomised-rotation binary codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rosterforge.llm.shared import cells_of, connected_components, in_blocks, staged

BANDS, BAND_BITS = 32, 12
BLOCK_ROWS = 1024
BOUND = 4.5  # standard deviations of an estimate


def rotations(width: int, seed: int = 4) -> np.ndarray:
    """Stacked random orthogonal matrices with at least BANDS * BAND_BITS rows, the same in every task."""
    rng = np.random.default_rng(seed + width)
    count = -(-BANDS * BAND_BITS // width)
    return np.concatenate([np.linalg.qr(rng.standard_normal((width, width)))[0].T for _ in range(count)])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(-1, width)


def _units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the sign code of the rotated unit vector and the key of each band of bits."""
    turned: dict[int, np.ndarray] = {}
    for batch in batches:
        widths = np.array([len(v) for v in batch.column("vector")])
        for width in np.unique(widths).tolist():
            part = batch.filter(pa.array(widths == width))
            turn = turned.setdefault(width, rotations(width))
            bits = (_units(_matrix(part.column("vector"), width)) @ turn.T >= 0)[:, :BANDS * BAND_BITS]
            bands = bits.reshape(-1, BANDS, BAND_BITS) @ (1 << np.arange(BAND_BITS))
            packed = np.packbits(bits, axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.astype(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "label", "n", "vector")), pa.array([row.tobytes() for row in packed], pa.binary()), lists],
                                             ["id", "label", "n", "vector", "code", "bands"])


def _links_of_cell(ids, n, side, vectors, codes, band, threshold, turn):
    """Links of one cell: (ids, their linked vectors, smallest id joined inside the cell)."""
    units = _units(vectors)
    width = units.shape[1]
    a, b = (np.flatnonzero(side <= 0), np.flatnonzero(side >= 0))
    rotated = units @ turn[:width].T
    signs = np.where(rotated >= 0, 1.0, -1.0).astype(np.float32)
    factor = (np.abs(rotated).sum(axis=1) / np.sqrt(width))  # inner product of a vector and its own code
    estimate = (signs[a] / np.sqrt(width)) @ rotated[b].T.astype(np.float32) / factor[a, None]
    error = BOUND * np.sqrt(np.maximum(0, 1 - factor[a] ** 2) / factor[a] ** 2 / max(1, width - 1))
    met = estimate + error[:, None] >= threshold
    if (side == 0).all():
        met |= met.T
        np.fill_diagonal(met, False)
    # A pair that meets in several bands counts in the first one.
    if band and met.any():
        keys = (np.unpackbits(codes, axis=1)[:, :BANDS * BAND_BITS].reshape(len(ids), BANDS, BAND_BITS)[:, :band] @ (1 << np.arange(BAND_BITS))).astype(np.int16)
        for earlier in range(band):
            if np.count_nonzero(met) * 16 <= met.size:
                i, j = np.nonzero(met)
                met[i, j] = (keys[a[i], earlier:] != keys[b[j], earlier:]).all(axis=1)
                break
            met &= keys[a, earlier][:, None] != keys[b, earlier][None, :]
    i, j = np.nonzero(met)
    if len(i) * 16 > met.size:
        met &= units[a] @ units[b].T >= threshold
    else:
        met[i, j] = np.einsum("ij,ij->i", units[a[i]], units[b[j]]) >= threshold
    links, low = np.zeros(len(ids), np.int64), ids.copy()
    links[a] += met @ n[b]
    if not (side == 0).all():
        links[b] += met.T @ n[a]
    i, j = np.nonzero(met)
    i, j = a[i], b[j]
    while len(i):
        before = low.copy()
        both = np.minimum(low[i], low[j])
        np.minimum.at(low, i, both)
        np.minimum.at(low, j, both)
        if (before == low).all():
            break
    at = np.flatnonzero(links)
    return ids[at], links[at], low[at]


def _met(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned: dict[int, np.ndarray] = {}
        found: list[list[np.ndarray]] = [[], [], []]

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in found], ["id", "links", "low"])
            for x in found:
                x.clear()
            return made

        for table in cells_of(batches, "cell"):
            if table.num_rows < 2:
                continue
            ids, n, side, band = (table.column(c).to_numpy() for c in ("id", "n", "side", "band"))
            vectors = table.column("vector").combine_chunks()
            width = len(vectors[0])
            turn = turned.setdefault(width, rotations(width))
            code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            for out, part in zip(found, _links_of_cell(ids, n, side, _matrix(vectors, width), code, int(band[0]), threshold, turn), strict=True):
                out.append(part)
            if len(found[0]) >= 2048:
                yield batch_of()
        yield batch_of()
    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept) per row: links between vectors of one label with cosine >= ``threshold``.

    Equal vectors are one class. Each class's unit vector is rotated and reduced to signs; bands of sign bits say
    which classes meet (a pair at the threshold 0.93 meets nowhere with probability 4e-4, at 0.96 with 4e-6). Where they
    meet, a code's inner product with the rotated vector, divided by the correction factor (computed again in each cell, not stored), estimates the
    cosine without bias; only pairs whose upper bound reaches the threshold are computed in double precision, which decides.
    Crowded buckets are cut into blocks that meet pairwise, so a task holds two blocks. Only counts and one
    edge per row and cell leave a task.

    Null labels and keys, null, empty or zero vectors and those with null, NaN or infinite components link with nothing;
    vectors of different lengths never link. Rows that repeat a key are vectors of their own with a shared total.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    able = rows.where(F.col("label").isNotNull() & F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)).where(F.coalesce(sound, F.lit(False))).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    classed = staged(able.withColumn("sum", F.sha2(F.array_join("vector", ",").cast("binary"), 256)))
    classes = classed.groupBy("label", "sum").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    heads = classes.join(classed.select(F.col("id").alias("rep"), "label", "sum", "vector").dropDuplicates(["rep", "label", "sum"]), ["rep", "label", "sum"])
    # A class is known by its own number: one key may stand for several vectors.
    heads = heads.select(F.xxhash64("label", "sum").alias("id"), F.xxhash64("label").alias("label"), "n", "vector")
    coded = staged(heads.mapInArrow(_coded, "id long, label long, n long, vector array<double>, code binary, bands array<int>"))
    spread = coded.select("id", "n", "vector", "code", "label", F.posexplode("bands").alias("band", "bits")) \
        .withColumn("cell", F.xxhash64("label", F.size("vector"), "band", "bits")).drop("label", "bits")
    met = staged(in_blocks(spread, "cell", BLOCK_ROWS).mapInArrow(_met(threshold), "id long, links long, low long"))
    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    joined = connected_components(met.select(F.col("id").alias("a"), F.col("low").alias("b")))
    members = classed.withColumn("class", F.xxhash64("label", "sum"))
    numbered = classes.select(F.xxhash64("label", "sum").alias("class"), "rep", "n").join(joined.toDF("class", "group"), "class", "left").withColumn("group", F.coalesce("group", "class"))
    lowest = numbered.groupBy("group").agg(F.min("rep").alias("component_id"))
    known = numbered.join(lowest, "group").join(links.withColumnRenamed("id", "class"), "class", "left").select("class", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    told = members.join(known, "class").select("id", "n_links", "component_id")
    rest = rows.where(~(F.col("label").isNotNull() & F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & F.coalesce(sound, F.lit(False)))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return told.unionByName(rest).select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op4(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP4_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS v, vec_id AS u FROM embeddings UNION SELECT reach.v, e.b FROM reach JOIN e ON e.a = reach.u),
k AS (SELECT v, min(u) AS component FROM reach GROUP BY v),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, k.component AS component_id, vec_id = k.component AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN k ON k.v = vec_id
"""
