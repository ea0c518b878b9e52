"""WARC archives: written whole, normalised to one gzip member per record, read back by offset."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from rosterforge.llm.shared import shared_folder, staged

CHUNK = 1 << 20
DATE = "2024-01-01T00:00:00Z"
RECORD_KIND = "archive string, start long, length long, record string"
READ_KIND = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a shared folder's file, whatever its scheme; executors have no JVM to ask."""
    return fs.FileSystem.from_uri(uri) if "://" in uri else fs.FileSystem.from_uri("file://" + uri.removeprefix("file:"))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def unnumbered_id(digest: str, url: str) -> str:
    """Record id of a page without a number."""
    name = f"payload:{digest}:{url}".encode("utf-8", "surrogatepass")
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(uuid.NAMESPACE_URL.bytes + name).digest()[:16], version=5)}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record that keeps the HTTP head only and names the response."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = "".join(c for c in (url or "") if c not in "\r\n")
    digest = digest_of(payload)
    named = record_id(page_id) if page_id is not None else unnumbered_id(digest, target)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {named}", f"WARC-Date: {DATE}",
             f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    block = head
    if refers_to is None:
        block += payload
    else:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers_of(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode("utf-8", "surrogatepass").partition(":") for line in lines[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


class Inflating(io.RawIOBase):
    """Bytes of a gzip file read as one stream, members following one another included."""

    def __init__(self, source):
        self.source, self.inflate, self.rest = source, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while True:
            if self.inflate.eof:
                self.rest, self.inflate = self.inflate.unused_data + self.rest, zlib.decompressobj(31)
            data = self.rest or self.source.read(CHUNK)
            if not data:
                return 0
            out = self.inflate.decompress(data, len(into))
            self.rest = self.inflate.unconsumed_tail
            if out:
                into[:len(out)] = out
                return len(out)


def split_records(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of each record in an inflated archive."""
    while True:
        first = stream.readline()
        if not first:
            return
        if not first.strip():
            continue
        lines = [first]
        while (line := stream.readline()).strip():
            lines.append(line)
        headers = headers_of(lines)
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("archive ends inside a record")
        yield headers, b"".join(lines) + b"\r\n" + block + b"\r\n\r\n"


def write_monolithic(records: DataFrame, folder: str) -> DataFrame:
    """Write each partition of (page_id, url, payload, refers_to) as one archive that is a single gzip stream; staged names.

    A file carries a name of its own attempt and only names that reach the staged table are read, so retried and
    speculative tasks do no harm.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name = None, f"{folder}/{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            for page, url, payload, refers in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                if out is None:
                    system, path = opened(name)
                    system.create_dir(path.rpartition("/")[0])
                    raw = system.open_output_stream(path, compression=None)
                    out = gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=3, mtime=0)
                out.write(record_bytes(page.as_py(), url.as_py(), payload.as_py() or b"", refers.as_py()))
        if out is not None:
            out.close()
            raw.close()
            yield pa.RecordBatch.from_pydict({"archive": [name]})
    return staged(records.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "archive string"))


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Inflate each archive once, rewrite every record as a gzip member of its own, and index it; staged index.

    Beside each new archive lies its index as lines ``start length record-id page-id``; the same rows are returned.
    Any whole-file archive works, in one or many members. One record is held at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                system, path = opened(name)
                made = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                _, target = opened(made)
                system.create_dir(target.rpartition("/")[0])
                rows = {"archive": [], "start": [], "length": [], "record": []}
                at, lines = 0, []
                with system.open_input_stream(path, compression=None) as source, system.open_output_stream(target, compression=None) as out:
                    for headers, record in split_records(io.BufferedReader(Inflating(source), CHUNK)):
                        member = gzip.compress(record, 3, mtime=0)
                        out.write(member)
                        for k, v in zip(rows, (made, at, len(member), headers["warc-record-id"]), strict=True):
                            rows[k].append(v)
                        lines.append(f"{at} {len(member)} {headers['warc-record-id']} {headers.get('x-page-id', '')}\n")
                        at += len(member)
                with system.open_output_stream(target + ".idx", compression=None) as index:
                    index.write("".join(lines).encode())
                yield pa.RecordBatch.from_pydict(rows, pa.schema([("archive", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("record", pa.string())]))
    return staged(archives.repartition(F.col("archive")).mapInArrow(run, RECORD_KIND))


def read_records(index: DataFrame) -> DataFrame:
    """Fetch every indexed record by its offset and parse it; a response's payload is measured and its digest checked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            out = []
            for archive, start, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "start", "length")), strict=True):
                if archive != name:
                    system, path = opened(archive)
                    name, source = archive, system.open_input_file(path)
                head, _, block = gzip.decompress(source.read_at(length, start)).partition(b"\r\n\r\n")
                headers = headers_of(head.split(b"\r\n"))
                block = block[:int(headers["content-length"])]
                http, _, payload = block.partition(b"\r\n\r\n")
                told = int(headers_of(http.split(b"\r\n"))["content-length"])
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                if headers["warc-type"] == "response" and (digest_of(payload) != digest or len(payload) != told):
                    raise ValueError(f"damaged record {headers['warc-record-id']}")
                page, refers = headers.get("x-page-id"), headers.get("x-refers-to-page")
                out.append((int(page) if page else None, headers["warc-target-uri"], headers["warc-type"], int(refers) if refers else None, told, digest))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            names = [k.split()[0] for k in READ_KIND.split(", ")]
            kinds = [pa.int64() if k.endswith("long") else pa.string() for k in READ_KIND.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
    return index.repartition(F.col("archive"), F.floor(F.col("start") / (32 << 20))).sortWithinPartitions("archive", "start").mapInArrow(run, READ_KIND)


def archive_pages(pages: DataFrame, smallest: int = 0, folder: str | None = None) -> DataFrame:
    """The offset index of normalised archives of ``pages`` (page_id, url, html), one record per row.

    Of records with equal payloads of at least ``smallest`` bytes the one with the smallest page_id is the response and
    the others revisit it. Payloads meet by digest only, and only where a digest repeats; the first page of each is
    replicated over salts, so a payload that holds a third of the rows is dealt over many tasks.

    A null html is an empty payload. A null url is written as an empty one. A row with a null page_id gets a
    record without a page number, named by digest and url; it revisits a numbered page of equal payload and is a response
    where none has a number. Rows that repeat a page_id give a record each. An empty table writes no archive and gives an empty index.
    """
    folder = folder or shared_folder(pages.sparkSession)
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    keyed = rows.withColumn("sha", F.sha1("payload")).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(16)).cast("int"))
    repeated = keyed.where(F.length("payload") >= smallest).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL") \
        .select("sha", "first", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    decided = keyed.select("page_id", "sha", "salt").join(repeated, ["sha", "salt"]).where("page_id IS NULL OR page_id <> first").select("page_id", "sha", F.col("first").alias("refers_to")).distinct()
    met = F.col("k.page_id").eqNullSafe(F.col("d.page_id")) & (F.col("k.sha") == F.col("d.sha"))
    records = keyed.alias("k").join(decided.alias("d"), met, "left").select("k.page_id", "url", "payload", "refers_to")
    return normalise(write_monolithic(records, f"{folder}/whole"), f"{folder}/members")


def op3(spark, sf_dir: str) -> DataFrame:
    """Bytes and digests of the pages' records as read back from the archives."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return read_records(archive_pages(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH RECURSIVE p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM p),
d AS (SELECT sha, 0 AS i, '' AS told FROM (SELECT DISTINCT sha FROM p) UNION ALL
    SELECT sha, i + 1, told || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(sha, i * 5 // 4 + 1, 3))::INT >> (7 - (i * 5) % 4)) & 31) + 1)::INT, 1) FROM d WHERE i < 31),
e AS (SELECT sha, told || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha, 39, 2))::INT & 31) + 1)::INT, 1) AS payload_digest FROM d WHERE i = 31)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f JOIN e USING (sha)
"""
