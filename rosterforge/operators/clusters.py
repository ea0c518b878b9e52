"""k-means and density clustering of stored vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterforge.operators.cells import SLACK, Cells, common_size, pivot_cells, sound, stream_parts, vector_matrix
from rosterforge.session import durable_checkpoint, file_system, staging_dir

SEED = 42
MAX_COMPONENTS = 50
NOISE = -1
# Points of a group of cells, groups that a small table is cut into, copies of points that leave a task at once.
HOME_ROWS, HOME_GROUPS, PLACED_ROWS = 4096, 16, 16_384
# Points of another chunk that meet a chunk at once.
MET_ROWS = 1024


def reduce_features(df: DataFrame, vec: str = "vector") -> DataFrame:
    """Standardise and project on min(50, n - 1, d) principal components, when at least two."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector

    rows = df.withColumn("_v", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    scaled = StandardScaler(withMean=True, withStd=True, inputCol="_v", outputCol="_s").fit(rows).transform(rows)
    shape = df.agg(F.count("*").alias("n"), F.max(F.size(vec)).alias("d")).first()
    components = min(MAX_COMPONENTS, shape["n"] - 1, shape["d"])
    if components >= 2:
        scaled = PCA(k=components, inputCol="_s", outputCol="features").fit(scaled).transform(scaled)
    else:
        scaled = scaled.withColumnRenamed("_s", "features")
    return scaled.drop("_v", "_s")


def cluster_vectors(df: DataFrame, k: int, vec: str = "vector") -> DataFrame:
    """Seeded k-means on reduced features; k never exceeds the row count."""
    from pyspark.ml.clustering import KMeans

    reduced = reduce_features(df, vec).cache()
    k = min(k, reduced.count())
    if k < 2:
        return reduced.drop("features").withColumn("cluster", F.lit(0)).withColumn("cluster_name", F.lit("cluster_000"))
    model = KMeans(k=k, seed=SEED, featuresCol="features", predictionCol="cluster").fit(reduced)
    out = model.transform(reduced).drop("features")
    return out.withColumn("cluster_name", F.format_string("cluster_%03d", "cluster"))


def cluster_counts(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("cluster_name").agg(F.count("*").alias("n"))


def _within(q: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    squared = (q * q).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (q @ b.T)
    return squared <= eps * eps


def _components(points: DataFrame, edges: DataFrame, id_col: str) -> DataFrame:
    """Smallest reachable id per vertex by label spreading with pointer jumps."""
    both = durable_checkpoint(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = durable_checkpoint(points.select(F.col(id_col).alias("u"), F.col(id_col).alias("label")))
    while True:
        spread = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("seen"))
        stepped = labels.join(spread, "u", "left").select("u", "label", F.least("label", "seen").alias("next"))
        jump = labels.select(F.col("u").alias("next"), F.col("label").alias("jumped"))
        moved = durable_checkpoint(stepped.join(jump, "next", "left").select(
            "u", "label", F.least("next", F.coalesce("jumped", "next")).alias("next")))
        changed = not moved.where(F.col("label") != F.col("next")).isEmpty()
        labels = moved.select("u", F.col("next").alias("label"))
        if not changed:
            return labels.select(F.col("u").alias(id_col), "label")


def cell_groups(cells: Cells) -> np.ndarray:
    """The group of each cell: a cell and those nearest to it, as long as they hold a share of the points, ``HOME_ROWS`` at most."""
    room = min(HOME_ROWS, -(-int(cells.rows.sum()) // HOME_GROUPS))
    apart = cells.distances(cells.pivots)
    group = np.full(len(cells.rows), -1, "int64")
    for number, first in enumerate(np.argsort(-cells.rows, kind="stable")):
        if group[first] >= 0:
            continue
        free = np.flatnonzero(group < 0)
        free = free[np.argsort(np.where(free == first, -1.0, apart[first][free]), kind="stable")]
        taken = np.cumsum(cells.rows[free]) <= room
        taken[0] = True
        group[free[:int(taken.argmin()) or len(free)] if not taken.all() else free] = number
    return np.unique(group, return_inverse=True)[1]


def open_groups(vectors: np.ndarray, cells: Cells, group: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """The own group of each vector, and vectors x groups: whether the group may hold one within ``eps``."""
    order = np.argsort(group, kind="stable")
    begins = np.flatnonzero(np.diff(group[order], prepend=-1))
    far = cells.distances(vectors)
    own = far.argmin(axis=1)
    least = far[np.arange(len(own)), own][:, None]
    room = eps * (1 + SLACK) + SLACK
    open_ = (far - cells.radius[None, :] <= room) & (far - least <= 2 * room) & (cells.rows > 0)[None, :]
    open_[np.arange(len(own)), own] = True
    return group[own], np.logical_or.reduceat(open_[:, order], begins, axis=1)


def near_cells(points: DataFrame, cells: Cells, eps: float) -> DataFrame:
    """(cell, home, id, vector): every point in the group of its own cell and, as a guest, in each group that may hold neighbours.

    A cell is ruled out if the point lies further than ``eps`` beyond its radius, or if the point is so
    much nearer to its own pivot that no point of the cell can be within ``eps``; a group is, if all its cells
    are. So a point is copied once per group at most, and where nothing is ruled out the copies are as many as
    blocks of residents need. They leave the task in parts of about ``PLACED_ROWS``. ``cell`` is the group.
    """
    kinds = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("home", T.BooleanType()), *points.schema.fields])
    group = cell_groups(cells)
    step = max(1, PLACED_ROWS // (int(group.max()) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                own, open_ = open_groups(vector_matrix(batch.column(1)), cells, group, eps)
                who, cell = np.nonzero(open_)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(own[who] == cell), *(c.take(pa.array(who)) for c in batch.columns)], kinds.fieldNames())

    return points.mapInArrow(run, kinds)


class Chunks:
    """Points in files of about HOME_ROWS rows below a shared folder, those of a group of cells together.

    Tasks read the chunks that they compare, so vectors are dealt out and written once, however many points meet.
    """

    def __init__(self, points: DataFrame, cells: Cells, eps: float):
        self.spark, self.cells, self.eps, self.group = points.sparkSession, cells, eps, cell_groups(cells)
        self.folder = staging_dir(self.spark, "chunks")
        blocks = np.maximum(1, -(-np.bincount(self.group, cells.rows).astype("int64") // HOME_ROWS))
        self.first = np.concatenate([[0], np.cumsum(blocks)])
        self.kind = points.schema["id"].dataType
        kinds = T.StructType([T.StructField("group", T.IntegerType()), *points.schema.fields])
        cells, group = self.cells, self.group

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in stream_parts(batches):
                own = group[cells.distances(vector_matrix(part.column(1))).argmin(axis=1)]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *part.columns], kinds.fieldNames())

        place = lambda name, values: F.get(F.array(*[F.lit(int(v)) for v in values]), F.col(name))
        chunk = place("group", self.first[:-1]) + F.pmod(F.xxhash64("id", F.lit(3)), place("group", blocks)).cast("int")
        self.keep("points", points.mapInArrow(run, kinds).select(chunk.alias("chunk"), "id", "vector"))

    def keep(self, name: str, rows: DataFrame) -> None:
        """Write rows by their ``chunk``."""
        rows.repartition("chunk").write.partitionBy("chunk").parquet(f"{self.folder}/{name}")

    def each(self, kinds: T.StructType, work: Callable[[int, Callable[[str, int], pa.Table | None]], Iterator[list]]) -> DataFrame:
        """What ``work`` yields for every chunk, each in its own task; it is given the chunk and what reads one by name."""
        folder, many = self.folder, int(self.first[-1])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, root = file_system(folder)

            def read(name: str, chunk: int) -> pa.Table | None:
                place = f"{root}/{name}/chunk={chunk}"
                if system.get_file_info(place).type == fs.FileType.NotFound:
                    return None
                files = sorted(f.path for f in system.get_file_info(fs.FileSelector(place)) if f.base_name[0] not in "_.")
                table = pa.concat_tables([pq.ParquetFile(system.open_input_file(f)).read() for f in files])
                return table.sort_by("pos") if "pos" in table.column_names else table

            for batch in batches:
                for chunk in batch.column(0).to_pylist():
                    for columns in work(chunk, read):
                        yield pa.RecordBatch.from_arrays(columns, kinds.fieldNames())

        return self.spark.range(0, many, 1, many).mapInArrow(run, kinds)

    def meets(self) -> Callable:
        """A function of (vectors, wanted) for the tasks: (chunk, places of the vectors) of each chunk of a group that may hold neighbours."""
        cells, group, eps, first = self.cells, self.group, self.eps, self.first

        def open_(vectors: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
            near = open_groups(vectors, cells, group, eps)[1]
            for number in np.flatnonzero(near[wanted].any(axis=0)).tolist():
                who = np.flatnonzero(near[:, number] & wanted)
                for chunk in range(first[number], first[number + 1]):
                    yield chunk, who

        return open_


def _local_components(near: np.ndarray) -> np.ndarray:
    """Per row the first row that it reaches; each row is met once."""
    label = np.full(len(near), -1, "int64")
    for start in range(len(near)):
        if label[start] < 0:
            front = np.array([start])
            while len(front):
                label[front] = start
                front = np.flatnonzero(near[front].any(axis=0) & (label < 0))
    return label


def _grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that puts equal values together, where each begins in it, and the values."""
    order = np.argsort(values, kind="stable")
    begins = np.flatnonzero(np.diff(values[order], prepend=values[order[:1]] - 1)) if len(values) else np.empty(0, "int64")
    return order, begins, values[order][begins]


def density_clusters(df: DataFrame, eps: float, min_samples: int, id_col: str = "id", vec: str = "vector") -> DataFrame:
    """Density clusters: ``id, cluster, is_core``; the label is the smallest core id, noise is -1.

    Points are written once, in chunks by their group of pivot cells. A task holds a chunk and reads, one after
    another, the chunks of the groups that may hold neighbours, so no vector is shuffled to meet others. Core points are
    joined inside each chunk first; only links between these local components leave a task, and fewer than
    ``min_samples`` for any other point. Ids of any type that orders; noise is -1 in that type. Points whose vector is null, holds nulls or non-finite
    values, or has another length than most are noise.
    """
    kind = df.schema[id_col].dataType
    size, rows = common_size(df, vec)
    every = df.select(F.col(id_col).alias("id"))
    noise = F.lit(NOISE).cast(kind)
    if not size:
        return every.select(F.col("id").alias(id_col), noise.alias("cluster"), F.lit(False).alias("is_core"))
    points = df.where(sound(vec, size)).select(F.col(id_col).alias("id"), F.transform(vec, lambda x: x.cast("double")).alias("vector"))
    cells = pivot_cells(points, "id", "vector", size, rows)
    chunks = Chunks(points, cells, eps)
    meets, first = chunks.meets(), F.min("label").alias("label")
    number = T.StructField("chunk", T.IntegerType())
    place, flag = T.StructField("pos", T.IntegerType()), T.StructField("is_core", T.BooleanType())

    def pieces(vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        return ((lo, vectors[lo:lo + MET_ROWS]) for lo in range(0, len(vectors), MET_ROWS))

    def count(chunk: int, read: Callable) -> Iterator[list]:
        if (mine := read("points", chunk)) is None:
            return
        vectors = vector_matrix(mine.column("vector"))
        n = np.zeros(len(vectors), "int64")
        for other, who in meets(vectors, np.ones(len(vectors), bool)):
            if (theirs := read("points", other)) is not None:
                some = vectors[who]
                for _, piece in pieces(vector_matrix(theirs.column("vector"))):
                    n[who] += _within(some, piece, eps).sum(axis=1)
        yield [pa.array(np.full(len(n), chunk), pa.int32()), pa.array(np.arange(len(n)), pa.int32()), mine.column("id").combine_chunks(), pa.array(n)]

    def label(chunk: int, read: Callable) -> Iterator[list]:
        if (mine := read("points", chunk)) is None:
            return
        core = read("flags", chunk).column("is_core").to_numpy(zero_copy_only=False).astype(bool)
        ids, at = mine.column("id").combine_chunks(), np.flatnonzero(core)
        at = at[pc.sort_indices(ids.take(pa.array(at))).to_numpy()]
        vectors = vector_matrix(mine.column("vector"))[at]
        near = np.empty((len(at), len(at)), bool)
        for lo, piece in pieces(vectors):
            near[:, lo:lo + MET_ROWS] = _within(vectors, piece, eps)
        told = np.full(len(core), -1, "int64")
        told[at] = at[_local_components(near | near.T)]
        yield [pa.array(np.full(len(core), chunk), pa.int32()), pa.array(np.arange(len(core)), pa.int32()), ids, pa.array(core), ids.take(pa.array(told, mask=told < 0))]

    def link(chunk: int, read: Callable) -> Iterator[list]:
        """Links of local components with those of later chunks, and of points that are not core with local components."""
        if (mine := read("points", chunk)) is None:
            return
        marks = read("marks", chunk)
        vectors, core = vector_matrix(mine.column("vector")), marks.column("is_core").to_numpy(zero_copy_only=False)
        codes, names = coded(marks.column("label"))
        ids = marks.column("id").combine_chunks()
        # A core point stands for its local component, any other for itself.
        stands = np.where(core, codes, len(names) + np.arange(len(core)))
        for other, who in meets(vectors, np.ones(len(vectors), bool)):
            who = who if other > chunk else who[~core[who]]
            if not len(who) or (theirs := read("points", other)) is None:
                continue
            told = read("marks", other)
            cores = np.flatnonzero(told.column("is_core").to_numpy(zero_copy_only=False))
            their_codes, their_names = coded(told.column("label"))
            order, begins, standing = _grouped(stands[who])
            some = vectors[who][order]
            for lo, piece in pieces(vector_matrix(theirs.column("vector"))[cores]):
                sides, cuts, parts = _grouped(their_codes[cores[lo:lo + MET_ROWS]])
                near = np.logical_or.reduceat(_within(some, piece[sides], eps), begins, axis=0)
                a, b = np.nonzero(np.logical_or.reduceat(near, cuts, axis=1))
                u, v, own = standing[a], parts[b], standing[a] < len(names)
                for joined, taken, left in ((True, own, names.take(pa.array(u[own]))), (False, ~own, ids.take(pa.array(u[~own] - len(names))))):
                    if len(left):
                        yield [left, their_names.take(pa.array(v[taken])), pa.array(np.full(len(left), joined))]

    def coded(labels: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
        """Places in the distinct labels, -1 for none, and these."""
        names = pc.unique(labels.drop_null())
        names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
        return pc.fill_null(pc.index_in(labels, names), -1).to_numpy().astype("int64"), names

    counted = durable_checkpoint(chunks.each(T.StructType([number, place, T.StructField("id", kind), T.StructField("n", T.LongType())]), count))
    flags = durable_checkpoint(counted.groupBy("id").agg((F.sum("n") >= min_samples).alias("is_core")))
    chunks.keep("flags", counted.join(flags, "id", "left").select("chunk", "pos", F.coalesce("is_core", F.lit(False)).alias("is_core")))
    chunks.keep("marks", chunks.each(T.StructType([number, place, T.StructField("id", kind), flag, T.StructField("label", kind)]), label))
    marks = df.sparkSession.read.schema(T.StructType([T.StructField("id", kind), flag, T.StructField("label", kind)])).parquet(f"{chunks.folder}/marks")
    linked = durable_checkpoint(chunks.each(T.StructType([T.StructField("u", kind), T.StructField("v", kind), flag]), link).distinct())
    named = marks.where("is_core").groupBy("id", "label").agg(F.count("*"))
    # Rows that share an id are one point: it joins the local components that they are in.
    several = named.groupBy("id").agg(F.min("label").alias("u"), F.max("label").alias("last")).where("u < last").select("id", "u")
    links = linked.where("is_core").select("u", "v").unionByName(named.join(several, "id").select("u", F.col("label").alias("v")).where("u < v")).distinct()
    components = _components(named.select(F.col("label").alias("id")).distinct(), links, "id").select(F.col("id").alias("local"), "label")
    labels = named.withColumnRenamed("label", "local").join(components, "local").groupBy("id").agg(first)
    border = linked.where("NOT is_core").join(components, F.col("v") == F.col("local")).groupBy(F.col("u").alias("id")).agg(first)
    found = labels.unionByName(border)
    return every.join(flags, "id", "left").join(found, "id", "left").select(
        F.col("id").alias(id_col), F.coalesce("label", noise).alias("cluster"), F.coalesce("is_core", F.lit(False)).alias("is_core"))
