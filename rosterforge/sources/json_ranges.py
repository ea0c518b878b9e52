"""Large JSON arrays and objects read in byte ranges, so that one file is the work of many tasks.

A range cannot be understood alone: it may begin inside a string or deep inside a record. Each range therefore leaves
one small row that holds for both beginnings (outside or inside a string): how its quotes and brackets change the state,
and how many commas stand at each depth. Running sums over these rows tell every range where it begins, and a second
pass cuts the members that start in it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PIECE_BYTES = 4 << 20  # read at once; a task holds some forty times this while it works
TASK_BYTES = 128 << 20
SPACE = b" \t\r\n"
_WAY = "struct<delta: long, low: long, commas: array<long>, keys: array<struct<name: long, depth: long, at: long, kind: long, outer: long, inner: long>>>"
_STATES = f"path string, lo long, hi long, quotes long, opening long, outside {_WAY}, inside {_WAY}"


def _located(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a URI or a local path."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


class _Bytes:
    """Random reads of one file on any file system that pyarrow knows."""

    def __init__(self, path: str):
        fs, inner = _located(path)
        self.size, self.file = fs.get_file_info(inner).size, fs.open_input_file(inner)

    def read(self, lo: int, hi: int) -> bytes:
        self.file.seek(lo)
        return self.file.read(max(0, min(hi, self.size) - lo))

    def first_solid(self, at: int) -> int:
        """The first byte from ``at`` on that is no white space, 0 at the end."""
        while at < self.size:
            left = self.read(at, at + 4096).lstrip(SPACE)
            if left:
                return left[0]
            at += 4096
        return 0

    def escaped(self, at: int) -> bool:
        """Whether an odd run of backslashes ends before ``at``."""
        run = 0
        while at > 0:
            part = self.read(max(0, at - 4096), at)
            here = len(part) - len(part.rstrip(b"\\"))
            run += here
            if here < len(part):
                break
            at -= len(part)
        return run % 2 == 1


def _marks(data: bytes, escaped: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, whether each is a quote that opens or closes a string, running number of such quotes)."""
    b = np.frombuffer(data, np.uint8)
    at = np.arange(len(b))
    solid = np.maximum.accumulate(np.where(b != 92, at, -1 - int(escaped))) if len(b) else at
    run = np.concatenate([[int(escaped)], (at - solid)[:-1]]) if len(b) else at
    quote = (b == 34) & (run % 2 == 0)
    return b, quote, np.cumsum(quote)


def _levels(b: np.ndarray, quotes: np.ndarray, inside: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes outside strings, depth after each byte)."""
    plain = (quotes + inside) % 2 == 0
    step = np.where(plain & ((b == 91) | (b == 123)), 1, 0) - np.where(plain & ((b == 93) | (b == 125)), 1, 0)
    return plain, depth + np.cumsum(step)


def _state(file: _Bytes, lo: int, hi: int, names: Sequence[str]) -> tuple:
    data, escaped = file.read(lo, hi), file.escaped(lo)
    b, quote, quotes = _marks(data, escaped)
    seen = file.first_solid(lo) if data.strip(SPACE) else 0
    longer = data + file.read(lo + len(data), lo + len(data) + max((len(n) for n in names), default=0) + 2)
    found = []
    for place, name in enumerate(names):
        word, at = f'"{name}"'.encode(), -1
        while 0 <= (at := longer.find(word, at + 1)) < len(data):
            if quote[at]:
                found.append((at, place, len(word)))
    ways = []
    for inside in (0, 1):
        plain, depth = _levels(b, quotes, inside, 0)
        low = int(depth.min(initial=0))
        commas = np.bincount(depth[plain & (b == 44)] - low)
        keys: dict[int, tuple] = {}
        for at, place, width in sorted(found):
            d = int(depth[at])
            # A key opens a string here; those less deep than others are the only ones that can be at the top.
            if (quotes[at] + inside) % 2 != 1 or (place in keys and keys[place][1] <= d):
                continue
            colon = lo + at + width
            if file.first_solid(colon) != 58:
                continue
            while file.read(colon, colon + 1) != b":":
                colon += 1
            before = depth[:at][(plain & (b == 44))[:at]]
            keys[place] = (place, d, lo + at, file.first_solid(colon + 1), int((before == d).sum()), int((before == d + 1).sum()))
        ways.append({"delta": int(depth[-1]) if len(b) else 0, "low": low, "commas": commas.tolist(),
                     "keys": [dict(zip(("name", "depth", "at", "kind", "outer", "inner"), k, strict=True)) for k in keys.values()]})
    return int(quotes[-1]) if len(b) else 0, seen, *ways


class _Ranges(InputPartition):
    """Byte ranges (path, lo, hi) that one task reads: a part of a large file or several small files."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


class JsonRanges(DataSource):
    """``spark.read.format("json_ranges")``: one row per byte range of each file, for ``json_members``.

    Options: path (file or folder), names (comma-separated keys to look for), piece_bytes, task_bytes.
    """

    @classmethod
    def name(cls) -> str:
        return "json_ranges"

    def schema(self) -> str:
        return _STATES

    def reader(self, schema) -> DataSourceReader:
        return _RangesReader(self.options)


class _RangesReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.names = options["path"], [n for n in options.get("names", "").split(",") if n]
        self.piece, self.task = int(options.get("piece_bytes", PIECE_BYTES)), int(options.get("task_bytes", TASK_BYTES))

    def partitions(self) -> list[_Ranges]:
        fs, inner = _located(self.path)
        info = fs.get_file_info(inner)
        listed = fs.get_file_info(pafs.FileSelector(inner)) if info.type == pafs.FileType.Directory else [info]
        files = [i for i in listed if i.type == pafs.FileType.File and not i.base_name.startswith(("_", "."))]
        if closed := [i.path for i in files if i.base_name.endswith((".gz", ".bz2", ".zst", ".lz4", ".snappy"))]:
            raise ValueError(f"compressed files have no byte ranges to read: {closed[:5]}")
        # What stands before the inner path, such as a scheme with its host, goes before each file again.
        head = self.path.rstrip("/").removesuffix(inner.rstrip("/")) if "://" in self.path else ""
        task = max(self.piece, self.task // self.piece * self.piece)
        packed: list[list[tuple[str, int, int]]] = []
        held = task
        for i in files:
            for lo in range(0, i.size, task):
                hi = min(lo + task, i.size)
                if held + hi - lo > task:
                    packed.append([])
                    held = 0
                packed[-1].append((head + i.path, lo, hi))
                held += hi - lo
        return [_Ranges(ranges) for ranges in packed]

    def read(self, partition: _Ranges | None) -> Iterator[tuple]:
        if partition is None:  # nothing is there to read
            return
        for path, start, end in partition.ranges:
            file = _Bytes(path)
            for lo in range(start, end, self.piece):
                hi = min(lo + self.piece, end)
                yield (path, lo, hi, *_state(file, lo, hi, self.names))


def _cut(file: _Bytes, lo: int, hi: int, inside: bool, depth: int, level: int, outer: int | None, first: int, members: int) -> Iterator[tuple[int, str]]:
    """(number, text) of each member whose opening bracket or comma lies in the range; the last one is read to its end."""
    data = file.read(lo, hi)
    reach, width = hi, max(hi - lo, 4096)
    marks = _marks(data, file.escaped(lo))
    b, _, quotes = marks
    plain, deep = _levels(b, quotes, int(inside), depth)
    comma = plain & (b == 44)
    opens = plain & ((b == 91) | (b == 123)) & (deep == level)
    starts = np.flatnonzero((comma & (deep == level)) | opens)
    if outer is not None:
        body = outer + np.cumsum(comma & (deep == level - 1))
        kept = (body[starts] == first)
    else:
        kept = np.ones(len(starts), bool)
    number = members + np.cumsum(comma & (deep == level))
    stops = np.flatnonzero((comma & (deep == level)) | (plain & ((b == 93) | (b == 125)) & (deep == level - 1)))
    for place in starts[kept]:
        at = np.searchsorted(stops, place, "right")
        if at < len(stops):
            yield int(number[place]), data[place + 1:stops[at]].decode("utf-8", "replace")
            continue
        # The member runs on: further ranges are read until it closes.
        parts, in_string, d = [data[place + 1:]], (int(quotes[-1]) + int(inside)) % 2, int(deep[-1])
        while reach < file.size:
            more = file.read(reach, reach + width)
            mb, _, mq = _marks(more, file.escaped(reach))
            mplain, mdeep = _levels(mb, mq, in_string, d)
            ends = np.flatnonzero((mplain & (mb == 44) & (mdeep == level)) | (mplain & ((mb == 93) | (mb == 125)) & (mdeep == level - 1)))
            if len(ends):
                parts.append(more[:ends[0]])
                break
            parts.append(more)
            in_string, d, reach = (in_string + int(mq[-1])) % 2, int(mdeep[-1]), reach + len(more)
        yield int(number[place]), b"".join(parts).decode("utf-8", "replace")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            found = [m for m in _cut(_Bytes(r["path"]), r["lo"], r["hi"], r["begins"], r["depth"], r["level"], r["outer"], r["body"], r["before"]) if m[1].strip()]
            yield pa.RecordBatch.from_arrays([
                pa.array([r["path"]] * len(found), pa.string()), pa.array([r["listed"]] * len(found), pa.bool_()),
                pa.array([n for n, _ in found], pa.int64()), pa.array([t for _, t in found], pa.string())], ["path", "listed", "pos", "member"])


def json_members(spark: SparkSession, path: str, wrappers: Sequence[str] = (), piece_bytes: int = PIECE_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(path, listed, pos, member) per member of the array or object in each file; ``listed`` tells an array's element from ``"key": value``.

    The first of ``wrappers`` that a top-level object holds and that is not null stands for the file if it is an array.
    A task holds one range (some forty times ``piece_bytes``, 160 MB as set) and the member that leaves it. Files without
    an array or object, and a missing path, give no rows. Text is UTF-8; compressed files are an error.
    """
    spark.dataSource.register(JsonRanges)
    states = spark.read.format("json_ranges").option("names", ",".join(wrappers)).option("piece_bytes", piece_bytes).option("task_bytes", task_bytes).load(path)
    order = Window.partitionBy("path").orderBy("lo")
    past = order.rowsBetween(Window.unboundedPreceding, -1)

    def before(c) -> Column:
        return F.coalesce(F.sum(c).over(past), F.lit(0).cast("long"))

    known = states.withColumn("begins", before("quotes") % 2 == 1).withColumn("way", F.when(F.col("begins"), F.col("inside")).otherwise(F.col("outside")))
    known = known.withColumn("depth", before("way.delta")).withColumn("opening", F.first(F.when(F.col("opening") != 0, F.col("opening")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))

    def at_level(level: int) -> Column:
        return F.coalesce(F.get("way.commas", (F.lit(level) - F.col("depth") - F.col("way.low")).cast("int")), F.lit(0).cast("long"))

    known = known.withColumn("c1", before(at_level(1))).withColumn("c2", before(at_level(2)))
    whole = Window.partitionBy("path")
    tops = F.filter("way.keys", lambda k: (F.col("depth") + k["depth"] == 1) & (k["kind"] != 110))
    tops = F.transform(tops, lambda k: F.struct(k["name"].alias("name"), k["at"].alias("at"), k["kind"].alias("kind"), (F.col("c1") + k["outer"]).alias("body"), (F.col("c2") + k["inner"]).alias("inner")))
    known = known.withColumn("told", F.min(F.when(F.col("opening") == 123, F.array_min(tops))).over(whole))
    known = known.withColumn("body", F.when(F.col("told.kind") == 91, F.col("told.body")))
    ready = known.where("opening IN (91, 123)").select(
        "path", "lo", "hi", "begins", "depth", F.when(F.col("body").isNull(), 1).otherwise(2).alias("level"), F.when(F.col("body").isNotNull(), F.col("c1")).alias("outer"),
        "body", F.when(F.col("body").isNull(), F.col("c1")).otherwise(F.col("c2") - F.col("told.inner")).alias("before"), (F.col("body").isNotNull() | (F.col("opening") == 91)).alias("listed"))
    # A given number of partitions: adaptive execution would merge these small rows, each of which stands for a range.
    dealt = ready.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "lo")
    return dealt.mapInArrow(_members, "path string, listed boolean, pos long, member string")
