"""Scans: text folders, keyed JSON, contract CSV, class folders, label lines, vector tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from string import ascii_letters, digits
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterforge.functions.strings import clean_text
from rosterforge.operators.ingest import CONTRACTS
from rosterforge.session import file_system, spread
from rosterforge.sources.json_ranges import json_members

IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp")
# Rows that a listing task passes on at once, and bytes of texts that a reading task does.
LISTED_ROWS, READ_BYTES = 1024, 4_194_304
_PLAIN = frozenset(ascii_letters + digits + "_-!.~'()*,;:$&+=@/")
WRAPPERS = ("pokemon", "sprites", "records")


def path_missing(error: AnalysisException) -> bool:
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def scan_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per ``*.txt`` file: source, filename, stem and cleaned text.

    Tasks list the folders and read the files that they find, so the driver knows folders and no file. As in Spark's
    own reader, files lie in the folder itself or, where there are some, in its partition folders; names that begin
    with a dot or an underscore and empty files are passed over. A pattern, and a place that only Spark opens, is
    left to that reader.
    """
    rows = _found_documents(spark, path)
    if rows is None:
        raw = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
        rows = raw.select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_name").alias("filename"), "value")
    return rows.select("source", "filename", F.regexp_replace("filename", "\\.txt$", "").alias("stem"), clean_text("value").alias("text"))


def shown_path(path: str) -> str:
    """A path as Spark shows it: what a URI does not allow is percent-encoded, other letters stay."""
    return "".join(c if c in _PLAIN or (ord(c) > 159 and not c.isspace()) else quote(c, safe="") for c in path)


def _listed(folders: DataFrame) -> DataFrame:
    """(root, path, folder, partitioned) of what lies in the folders of a file system: folders and ``*.txt`` files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root, path, partitioned in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                system, _ = file_system(root)
                met = [f for f in system.get_file_info(fs.FileSelector(path)) if f.base_name[0] != "." and (f.base_name[0] != "_" or "=" in f.base_name)]
                met = [f for f in met if f.type == fs.FileType.Directory or (f.size and f.base_name.endswith(".txt"))]
                for lo in range(0, len(met), LISTED_ROWS):
                    some = met[lo:lo + LISTED_ROWS]
                    inside = [f.type == fs.FileType.Directory for f in some]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([root] * len(some)), pa.array([f.path for f in some]), pa.array(inside),
                        pa.array([partitioned or (d and "=" in f.base_name) for f, d in zip(some, inside, strict=True)])], ["root", "path", "folder", "partitioned"])

    return folders.mapInArrow(run, "root string, path string, folder boolean, partitioned boolean")


def _found_documents(spark: SparkSession, path: str) -> DataFrame | None:
    """(source, filename, value) of the files below a folder; none where tasks cannot open it by themselves."""
    if any(c in path for c in "*?[]{}"):
        return None
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    try:
        system, top = file_system(root)
        if system.get_file_info(top).type != fs.FileType.Directory:
            return None
    except (OSError, ValueError):
        return None
    kinds = "root string, path string, partitioned boolean"
    level, held = [(root, top, False)], [(root, top, False)]
    while level:
        folders = spark.createDataFrame(level, kinds).repartition(min(len(level), 1024))
        level = [tuple(r) for r in _listed(folders).where("folder").select("root", "path", "partitioned").collect()]
        held += level
    inner = [f for f in held if f[2]]
    files = _listed(spark.createDataFrame(held, kinds).repartition(min(len(held), 1024))).where("NOT folder AND partitioned") if inner else None
    if files is None or files.isEmpty():
        files = _listed(spark.createDataFrame(held[:1], kinds)).where("NOT folder")
    scheme = root.partition(":")[0] + ":" + ("" if root.startswith("file:") else "//" + root.partition("://")[2].partition("/")[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(some: list[tuple[str, bytes]]) -> pa.RecordBatch:
            names = [shown_path(p) for p, _ in some]
            return pa.RecordBatch.from_arrays(
                [pa.array([scheme + n for n in names]), pa.array([n.rpartition("/")[2] for n in names]), pa.array([v for _, v in some], pa.binary())], ["source", "filename", "value"])

        some: list[tuple[str, bytes]] = []
        size = 0
        system, _ = file_system(root)
        for batch in batches:
            for place in batch.column(0).to_pylist():
                with system.open_input_stream(place, compression=None) as file:
                    some.append((place, file.read()))
                size += len(some[-1][1])
                if size > READ_BYTES or len(some) >= LISTED_ROWS:
                    yield told(some)
                    some, size = [], 0
        if some:
            yield told(some)

    read = spread(files.select("path")).mapInArrow(run, "source string, filename string, value binary")
    return read.withColumn("value", F.col("value").cast("string"))


def scan_keyed_json(spark: SparkSession, path: str, value_schema: T.StructType, key_col: str = "key",
                    wrappers: Sequence[str] = WRAPPERS) -> DataFrame:
    """Records given as an array, or as an object keyed by name whose values are one or many.

    Adds ``key_col`` (null for arrays) and ``pos`` within the file. A missing path is an empty
    table; known wrapper keys are unwrapped. A large file is cut into byte ranges that many tasks read.
    """
    item = value_schema.simpleString()
    rows = json_members(spark, path, wrappers)
    entry = F.get(F.map_entries(F.from_json(F.concat(F.lit("{"), "member", F.lit("}")), "map<string,string>")), F.lit(0))
    entries = rows.select("listed", "pos", "member", F.when(~F.col("listed"), entry).alias("e"))
    one = F.array(F.from_json(F.when(F.col("listed"), F.col("member")).otherwise(F.col("e.value")), item))
    many = F.when(~F.col("listed") & F.trim("e.value").startswith("["), F.from_json("e.value", f"array<{item}>")).otherwise(one)
    return entries.select(F.col("e.key").alias(key_col), "pos", F.explode(many).alias("r")).select(key_col, "pos", "r.*")


def contract_schema(contract: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in CONTRACTS[contract]])


def scan_csv_contract(spark: SparkSession, path: str, contract: str) -> DataFrame:
    """Header CSV against a fixed column contract; every value is text."""
    return spark.read.csv(path, header=True, schema=contract_schema(contract), enforceSchema=False,
                          quote='"', escape='"', multiLine=True)


def source_id(path: Column) -> Column:
    """Stable 16-digit id of a lower-cased slash path."""
    return F.substring(F.sha1(F.lower(F.translate(path, "\\", "/"))), 1, 16)


def labelled_paths(files: DataFrame, root: str, exts: Sequence[str] = IMAGE_EXTENSIONS, path: str = "path") -> DataFrame:
    """Label (first folder under ``root``), path and source id of files with a wanted extension."""
    slashed = F.translate(path, "\\", "/")
    pattern = f"(?:^|/){root.strip('/')}/([^/]+)/.*\\.([^./]+)$"
    label, ext = F.regexp_extract(slashed, pattern, 1), F.lower(F.regexp_extract(slashed, pattern, 2))
    return files.where((label != "") & ext.isin(*[e.lstrip(".").lower() for e in exts])).select(
        label.alias("label"), F.col(path).alias("path"), source_id(F.col(path)).alias("source_id"))


def scan_labelled_files(spark: SparkSession, root: str, exts: Sequence[str] = IMAGE_EXTENSIONS) -> DataFrame:
    """Class-folder listing; file contents are never read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return labelled_paths(listing.select("path"), root.rstrip("/").rsplit("/", 1)[-1], exts)


def scan_box_labels(lines: DataFrame, value: str = "value", stem: str = "stem") -> DataFrame:
    """Label lines ``class xc yc w h``; lines without exactly five tokens are dropped."""
    tokens = F.split(F.trim(F.regexp_replace(value, "(?U)\\s+", " ")), " ")
    parts = lines.select(stem, tokens.alias("t")).where(F.size("t") == 5)

    def number(i: int) -> Column:
        return F.element_at("t", i).try_cast("double")

    return parts.select(stem, number(1).cast("int").alias("class_id"), *[
        number(i + 2).alias(c) for i, c in enumerate(("xc", "yc", "w", "h"))])


def load_vector_index(spark: SparkSession, path: str) -> DataFrame:
    """Vectors beside their metadata; a row missing either half is an error."""
    index = spark.read.parquet(path)
    sizes = index.agg(F.min(F.size("vector")).alias("lo"), F.max(F.size("vector")).alias("hi"),
                      F.count_if(F.col("vector").isNull()).alias("bare"), F.count("*").alias("n")).first()
    if sizes["n"] == 0 or sizes["bare"] or sizes["lo"] != sizes["hi"]:
        raise ValueError(f"vector index is invalid: {sizes.asDict()}")
    return index
