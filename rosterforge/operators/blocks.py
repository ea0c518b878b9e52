"""Exact top-k by inner product with pivot bounds.

A cell holds at most ``|q| * radius`` more inner product with a query than its pivot does. Pivots are
stored vectors, so the k-th best pivot is a score that k rows reach; cells whose bound is below it are
never visited. The others are visited best bound first, and the score to reach rises on the way.

Cells are packed into bins of ``RESIDENT_ROWS`` rows. Rows and queries meet on a grid of (query
slice, bin): the base is copied once per slice, and there are as many slices as keep the cluster busy,
however many queries come. A query is copied once per bin that its bounds cannot exclude.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterforge.functions.ranking import top_k_per_key
from rosterforge.operators.cells import BLOCK_SCORES, RESIDENT_ROWS, SLACK, STREAM_ROWS, Cells, common_size, homes, local_topk, pivot_cells, sound, stream_parts, stream_past, vector_matrix

EVERY = "\u0001every"


def packed_bins(cells: Cells, resident_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First bin and number of bins of every cell: near cells share a bin, a large cell is spread over several."""
    left = set(range(len(cells.rows)))
    first, spread = np.zeros(len(cells.rows), "int64"), np.ones(len(cells.rows), "int64")
    at, filled, now = 0, 0, 0
    while left:
        left.discard(now)
        if filled and filled + cells.rows[now] > resident_rows:
            at, filled = at + 1, 0
        first[now], spread[now] = at, max(1, -(-int(cells.rows[now]) // resident_rows))
        filled += cells.rows[now]
        if spread[now] > 1:
            at, filled = at + int(spread[now]), 0
        if left:
            rest = np.array(sorted(left))
            now = int(rest[((cells.pivots[rest] - cells.pivots[now]) ** 2).sum(axis=1).argmin()])
    return first, spread


def blocked_topk(queries: DataFrame, base: DataFrame, k: int, query_id: str, query_vec: str, base_id: str, base_vec: str,
                 pools: DataFrame | None = None, resident_rows: int = RESIDENT_ROWS) -> DataFrame:
    """Exact top-k by inner product: ``q, id, score, rank``; ties go to the lower id.

    ``queries`` may carry a group ``qg`` and ``base`` a group ``bg``; ``pools`` (qg, bg) names the
    groups that meet, and the base group ``EVERY`` holds all rows. Base rows whose vector is null, holds nulls or non-finite values, or has
    another length than most are no candidates; such queries have no hits.
    """
    spark = base.sparkSession
    kinds = T.StructType([
        T.StructField("q", queries.schema[query_id].dataType), T.StructField("id", base.schema[base_id].dataType),
        T.StructField("score", T.DoubleType())])
    nothing = spark.createDataFrame([], T.StructType([*kinds.fields, T.StructField("rank", T.IntegerType())]))
    size, rows = common_size(base, base_vec)
    if k <= 0 or size <= 0:
        return nothing
    asked = queries.where(sound(query_vec, size))
    stored = base.where(sound(base_vec, size))
    cells = pivot_cells(stored, base_id, base_vec, size, rows)
    if not len(cells.pivots):
        return nothing
    first, spread = packed_bins(cells, resident_rows)
    bins = int((first + spread).max())
    # The best pivots bound a query's k-th score only where every row is a candidate.
    bounded = pools is None and len(cells.pivots) >= k
    slices = max(1, -(-2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // bins)) if pools is None else 1

    def bounds(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Most that each cell can hold for a query, and the score to reach."""
        near = vectors @ cells.pivots.T
        reach = np.sort(near, axis=1)[:, -k] if bounded else np.full(len(vectors), -np.inf)
        reach = reach - SLACK * (1 + np.abs(reach))
        length = np.sqrt((vectors * vectors).sum(axis=1))
        most = near + length[:, None] * cells.radius[None, :]
        return most + SLACK * (1 + np.abs(most)), reach

    visit_kinds = T.StructType([T.StructField("id", queries.schema[query_id].dataType), T.StructField("grp", T.StringType()),
                                T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("bin", T.LongType())])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in stream_parts(batches):
            most, reach = bounds(vector_matrix(part.column(2)))
            alive = (most >= reach[:, None]) & (cells.rows > 0)[None, :]
            open_ = np.zeros((part.num_rows, bins), bool)
            for c in range(len(first)):
                open_[:, first[c]:first[c] + spread[c]] |= alive[:, c][:, None]
            who, where = np.nonzero(open_)
            # A query is copied per open bin, so the copies leave in parts too.
            for lo in range(0, len(who), STREAM_ROWS):
                copied = pa.array(who[lo:lo + STREAM_ROWS])
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(copied) for i in range(3)), pa.array(where[lo:lo + STREAM_ROWS], pa.int64())], visit_kinds.fieldNames())

    q = asked.select(F.col(query_id).alias("id"), (F.col("qg").cast("string") if "qg" in queries.columns else F.lit("all")).alias("grp"),
                     F.transform(query_vec, lambda x: x.cast("double")).alias("vector")).mapInArrow(visits, visit_kinds)
    q = q.select("id", "grp", "vector", "bin", F.pmod(F.xxhash64("id"), F.lit(slices)).alias("slice"))
    if pools is None:
        b = homes(stored, base_id, base_vec, cells).withColumn("grp", F.lit("all"))
    else:
        both = F.explode(F.array(F.col("bg").cast("string"), F.lit(EVERY)))
        b = homes(stored, base_id, base_vec, cells, "bg").withColumn("bg", both).join(pools.select(F.col("qg").cast("string").alias("grp"), "bg"), "bg")
    place = F.lit(first.tolist())[F.col("cell")] + F.pmod(F.xxhash64("id"), F.lit(spread.tolist())[F.col("cell")])
    b = b.select("id", "grp", "vector", "cell", place.alias("bin")).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    absent = F.lit(None)
    met = b.select(F.xxhash64("grp").alias("pool"), "bin", "slice", F.lit(0).alias("kind"), "cell", "vector", F.col("id").alias("base"), absent.cast(kinds["q"].dataType).alias("asked")).unionByName(
        q.select(F.xxhash64("grp").alias("pool"), "bin", "slice", F.lit(1).alias("kind"), absent.cast("int").alias("cell"), "vector", absent.cast(kinds["id"].dataType).alias("base"), F.col("id").alias("asked")))

    def start(residents: pa.Table):
        residents = residents.sort_by([("cell", "ascending"), ("base", "ascending")])
        ids = residents.column("base").combine_chunks()
        vectors = vector_matrix(residents.column("vector"))
        cell = residents.column("cell").to_numpy()
        names, starts = np.unique(cell, return_index=True)
        stops = np.concatenate([starts[1:], [len(cell)]])

        def handle(part: pa.Table) -> pa.RecordBatch | None:
            wanted = vector_matrix(part.column("vector"))
            most, reach = bounds(wanted)
            best = np.full((len(wanted), k), -np.inf)
            spots = np.full((len(wanted), k), -1)
            # Cells in the order of their best bound; a query skips a cell whose bound its k-th score has passed.
            for c in np.argsort(-most[:, names].max(axis=0), kind="stable"):
                lo, end = starts[c], stops[c]
                while lo < end:
                    open_ = np.flatnonzero(most[:, names[c]] >= np.maximum(reach, best[:, -1]))
                    if not len(open_):
                        break
                    # As many rows of the cell at once as their scores have room for.
                    hi = min(end, lo + max(1, BLOCK_SCORES // len(open_)))
                    scores = wanted[open_] @ vectors[lo:hi].T
                    depth = min(k, hi - lo)
                    rows, cols = local_topk(scores, depth)
                    new = scores[rows, cols].reshape(len(open_), depth), (lo + cols).reshape(len(open_), depth)
                    both = np.concatenate([best[open_], new[0]], axis=1), np.concatenate([spots[open_], new[1]], axis=1)
                    # Equal scores: the lower id, known by its rank among the residents; empty places come last.
                    order = np.lexsort((np.where(both[1] < 0, len(rank), rank[both[1]]), -both[0]), axis=1)[:, :k]
                    best[open_], spots[open_] = np.take_along_axis(both[0], order, 1), np.take_along_axis(both[1], order, 1)
                    lo = hi
            who, deep = np.nonzero(spots >= 0)
            return pa.RecordBatch.from_arrays([part.column("asked").combine_chunks().take(pa.array(who)), ids.take(pa.array(spots[who, deep])), pa.array(best[who, deep])], kinds.fieldNames())

        rank = np.empty(len(ids), "int64")
        rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        return handle

    hits = stream_past(met, ["pool", "bin", "slice"], kinds, start)
    return top_k_per_key(hits, ["q"], [F.desc("score"), F.asc("id")], k)
