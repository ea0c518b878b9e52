"""Batch side of incremental processing: known keys, prefixes, content hashes, latest rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterforge.functions.strings import iso_date

# Upload rules.
MIN_UPLOAD_BYTES = 1024
ALLOWED_UPLOAD_TYPES = ("image/jpeg", "image/png", "image/webp")
DEFAULT_FORMATS = ("M-A", "M-B")


def known_keys(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-empty values of ``col``."""
    return df.where(F.col(col).isNotNull() & (F.col(col) != "")).select(col).distinct()


def known_dates(df: DataFrame, col: str = "date") -> DataFrame:
    return known_keys(df.select(iso_date(col).alias("known_date")), "known_date")


def select_new_until_known(df: DataFrame, order: str, dates: DataFrame, ids: DataFrame,
                           formats: Iterable[str] = DEFAULT_FORMATS, strict: bool = True) -> DataFrame:
    """Rows before the first known date, with unknown ids and an allowed format.

    ``dates`` holds one column ``known_date`` and ``ids`` one column ``known_id``. The stop
    position is one ``min`` over a semi join, read as a scalar subquery, so no row is ever
    ordered globally. ``strict=False`` ignores dates and goes by id alone.
    """
    listed = df.withColumn("_date", iso_date("date"))
    if strict:
        stop = (
            listed.join(dates.withColumnRenamed("known_date", "_date"), "_date", "left_semi")
            .agg(F.min(order).alias("stop")).scalar()
        )
        kept = listed.where(stop.isNull() | (F.col(order) < stop))
        kept = kept.withColumn("stopped", stop.isNotNull())
    else:
        kept = listed.withColumn("stopped", F.lit(False))
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    return (
        kept.where((key != "") & F.col("format").isin(list(formats)))
        .join(ids, key == F.col("known_id"), "left_anti")
        .drop("_date")
    )


def content_hash(content: Column | str) -> Column:
    return F.sha1(F.col(content) if isinstance(content, str) else content)


def dedupe_by_content_hash(uploads: DataFrame, state: DataFrame, content: str, order: str,
                           boxes: str | None = None, expected: int = 6) -> DataFrame:
    """Mark every upload ``new``, ``seen`` or ``incomplete``.

    ``state`` has one column ``sha1``. The first upload of a hash is found by an aggregate, so
    a blob uploaded a billion times is one row per task before the shuffle; the join back is
    an equi-join adaptive execution can split.
    """
    hashed = uploads.withColumn("sha1", content_hash(content))
    firsts = hashed.groupBy("sha1").agg(F.min(order).alias("_first"))
    known = state.select("sha1").distinct().withColumn("_known", F.lit(True))
    firsts = firsts.join(known, "sha1", "left")
    incomplete = (F.col(boxes) != expected) if boxes else F.lit(False)
    status = (
        F.when(F.col("_known"), "seen")
        .when(incomplete, "incomplete")
        .when(F.col(order) == F.col("_first"), "new")
        .otherwise("seen")
    )
    return hashed.join(firsts, "sha1").withColumn("status", status).drop("_first", "_known")


def upload_counts(marked: DataFrame) -> DataFrame:
    return marked.agg(
        F.count("*").alias("input_count"),
        F.count_if(F.col("status") == "new").alias("new_count"),
        F.count_if(F.col("status") == "seen").alias("skipped_existing"),
        F.count_if(F.col("status") == "incomplete").alias("skipped_incomplete"),
    )


def mark_processed(uploads: DataFrame, state: DataFrame, content: str, source: str) -> DataFrame:
    """State rows to append for hashes not yet known; the first source in order is kept."""
    fresh = uploads.groupBy(content_hash(content).alias("sha1")).agg(F.min(source).alias("source"))
    return fresh.join(state.select("sha1"), "sha1", "left_anti").withColumn(
        "status", F.lit("marked_existing_without_processing"))


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` per key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, "r.*")


def latest_prediction(predictions: DataFrame, uploads: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Latest prediction per key, cleared when a later upload has none yet."""
    last_upload = uploads.groupBy(*keys).agg(F.max(ts).alias("_uploaded"))
    latest = latest_by(predictions, keys, [ts]).join(last_upload, list(keys), "full_outer")
    has = F.col(ts).isNotNull() & (F.col("_uploaded").isNull() | (F.col(ts) >= F.col("_uploaded")))
    rest = [c for c in predictions.columns if c not in keys]
    return latest.select(*keys, has.alias("has_prediction"),
                         *[F.when(has, F.col(c)).alias(c) for c in rest])


def image_signature_ok(header_hex: Column) -> Column:
    """Whether upper-case hex of the first 16 bytes is a JPEG, PNG or WEBP header."""
    return (
        header_hex.startswith("FFD8FF")
        | header_hex.startswith("89504E470D0A1A0A")
        | (header_hex.startswith("52494646") & (F.substring(header_hex, 17, 8) == "57454250"))
    )


def validate_uploads(uploads: DataFrame, content: str = "content", name: str = "filename",
                     mime: str = "mime", size: str = "length") -> DataFrame:
    """Add ``ok`` and ``reason``; the first failing rule names the reason."""
    header = F.hex(F.substring(F.col(content), 1, 16))
    reason = (
        F.when(F.col(name).isNull() | (F.col(name) == ""), "file required")
        .when(F.col(mime).isNull() | ~F.col(mime).isin(*ALLOWED_UPLOAD_TYPES), "unsupported type")
        .when(header.isNull() | ~image_signature_ok(header), "invalid image")
        .when(F.col(size) < MIN_UPLOAD_BYTES, "too small")
    )
    return uploads.withColumn("ok", reason.isNull()).withColumn("reason", F.coalesce(reason, F.lit("")))
