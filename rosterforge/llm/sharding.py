"""Uniform shards by a two-pass external shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

RESULT = ("shard", "slot")


def shuffle_into_shards(docs: DataFrame, shards: int = 8, seed: int = 17, bucket_bytes: int = 16 << 20,
                        key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` in random order, dealt over ``shards``: all columns plus ``shard`` and ``slot``.

    Pass one scatters rows by a seeded hash of key and text into buckets of about ``bucket_bytes``
    (their number follows the measured size of the input), one partition per bucket. Pass two orders each
    bucket by the same key, shuffles it with Spark's seeded Fisher-Yates and numbers its rows. Buckets
    follow one another; position p of the whole goes to shard p mod ``shards``, slot p div ``shards``, so row
    counts differ by one at most. The same input and seed give the same shards, whatever the cluster.

    Null keys and texts hash as such and stay; empty texts are rows like others; repeated rows each get a place;
    an empty table gives an empty result; input columns named like the result's are replaced.
    """
    docs = docs.drop(*RESULT)
    crc = F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))
    total = docs.agg(F.sum(F.octet_length(F.coalesce(text, F.lit(""))) + F.lit(64))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    scatter = F.pmod(F.xxhash64(F.lit(seed), F.col(key), crc), F.lit(buckets)).cast("int")

    counts = docs.groupBy(scatter.alias("bucket")).agg(F.count("*").alias("rows"))
    starts = counts.select("bucket", (F.sum("rows").over(Window.orderBy("bucket")) - F.col("rows")).alias("start"))

    scattered = docs.select(scatter.alias("bucket"), F.struct(
        F.struct(F.xxhash64(F.lit(seed + 1), F.col(key), crc).alias("h"), F.col(key).cast("string").alias("k"), crc.alias("c")).alias("order"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).alias("item")).repartitionById(buckets, "bucket")
    ordered = F.array_sort(F.collect_list("item"), lambda a, b: F.when(a["order"] < b["order"], -1).when(a["order"] > b["order"], 1).otherwise(0))
    mixed = scattered.groupBy("bucket").agg(F.shuffle(ordered, F.lit(seed)).alias("items"))
    placed = mixed.join(starts, "bucket").select("start", F.posexplode("items").alias("pos", "item"))
    at = F.col("start") + F.col("pos")
    return placed.select("item.row.*", (at % shards).cast("int").alias("shard"), F.expr(f"(start + pos) div {int(shards)}").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document; a null text counts as no bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    body = F.coalesce("text", F.lit(""))
    return shuffle_into_shards(docs).select(
        "doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
