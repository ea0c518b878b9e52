"""Sinks: contract appends, table counts, vector tables and split datasets with a manifest."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterforge.operators.ingest import CONTRACTS
from rosterforge.session import spread
from rosterforge.sources.readers import path_missing, scan_csv_contract


def write_documents(df: DataFrame, folder: str, text: str = "text") -> int:
    """One ``.txt`` file per row, its text and a line end, in a folder per task; the number of files.

    Rows are dealt out first, so one row group does not write a table's files one after another, and a
    folder per task lets Spark list them side by side. Files are opened by the tasks themselves: Spark's own
    writer starts a process or two per file where Hadoop's native library is absent. Names follow
    from task and row, so a repeated task writes the same files. A null is an empty line.
    """
    system, root = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
    system.create_dir(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
        place, number = f"{root}/part={TaskContext.get().partitionId()}", 0
        for batch in batches:
            for value in batch.column(0):
                if not number:
                    system.create_dir(place)
                with system.open_output_stream(f"{place}/{number:09d}.txt", compression=None) as out:
                    out.write((value.as_py() or "").encode() + b"\n")
                number += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([number], pa.int64())})

    return spread(df.select(text)).mapInArrow(run, "files long").agg(F.sum("files")).first()[0] or 0


def append_table(df: DataFrame, path: str, contract: str, fmt: str = "parquet") -> None:
    """Append contract columns; an empty batch writes nothing. CSV parts carry their header."""
    rows = df.select(*[F.col(c).cast("string").alias(c) for c in CONTRACTS[contract]])
    if rows.isEmpty():
        return
    writer = rows.write.mode("append")
    if fmt == "csv":
        writer.csv(path, header=True, quote='"', escape='"')
    else:
        writer.format(fmt).save(path)


def read_table(spark: SparkSession, path: str, contract: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "csv":
        return scan_csv_contract(spark, path, contract)
    return spark.read.format(fmt).load(path)


def table_counts(spark: SparkSession, tables: Mapping[str, str], fmt: str = "parquet") -> DataFrame:
    """Rows per contract table, zero when the table is absent."""
    out = None
    for name, path in tables.items():
        try:
            rows = read_table(spark, path, name, fmt)
            if fmt == "csv":
                rows.inputFiles()
            counted = rows.agg(F.count("*").alias("n"))
        except AnalysisException as error:
            if not path_missing(error):
                raise
            counted = spark.range(1).select(F.lit(0).cast("long").alias("n"))
        counted = counted.select(F.lit(name).alias("table"), "n")
        out = counted if out is None else out.unionByName(counted)
    return out


def write_table_counts(counts: DataFrame, path: str) -> None:
    """One JSON line per table in a summary folder; the summary holds one row per table."""
    counts.coalesce(1).write.mode("overwrite").json(path)


def write_vector_index(df: DataFrame, path: str) -> None:
    """Vectors beside their metadata; an empty or ragged index is refused before anything is written."""
    facts = df.agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("lo"), F.max(F.size("vector")).alias("hi"),
                   F.count_if(F.col("vector").isNull()).alias("bare")).first()
    if facts["n"] == 0:
        raise ValueError("cannot write an empty vector index")
    if facts["bare"] or facts["lo"] != facts["hi"]:
        raise ValueError("vectors must exist and have one width")
    df.write.mode("overwrite").parquet(path)


def index_integrity(vectors: DataFrame, metadata: DataFrame, key: str = "id") -> DataFrame:
    """Counts of vectors, metadata rows and rows missing on either side."""
    v = vectors.select(key).withColumn("_v", F.lit(1))
    m = metadata.select(key).withColumn("_m", F.lit(1))
    return v.join(m, key, "full_outer").agg(
        F.count("_v").alias("vectors"), F.count("_m").alias("metadata"),
        F.count_if(F.col("_m").isNull()).alias("without_metadata"), F.count_if(F.col("_v").isNull()).alias("without_vector"))


def write_split_dataset(df: DataFrame, path: str, settings: Mapping[str, object]) -> None:
    """Rows partitioned by split, one JSON record per row and the settings with the counts."""
    df.write.mode("overwrite").partitionBy("split").parquet(f"{path}/data")
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(f"{path}/manifest")
    shown = F.to_json(F.create_map(*[F.lit(str(x)) for pair in settings.items() for x in pair])) if settings else F.lit("{}")
    counts = df.groupBy("split").agg(F.count("*").alias("n")).withColumn("settings", shown)
    counts.coalesce(1).write.mode("overwrite").json(f"{path}/settings")
