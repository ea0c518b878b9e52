"""Streams that end when the landed input is read (``availableNow``) and resume on restart."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rosterforge.operators import ingest, incremental
from rosterforge.session import dealt_by_rows
from rosterforge.sources.readers import path_missing

STATE_BUCKETS = 64
# Listed rows per task that sorts a batch's payloads.
BATCH_ROWS = 32_768
# Shape of a landed tournament payload.
PAYLOAD = (
    "id string, date string, format string, name string, players int, isOnline boolean, decklists boolean, game string, "
    "organizer string, url string, page bigint, pos bigint, "
    "standings array<struct<player string, name string, country string, placing int, wins int, losses int, ties int, "
    "score double, dropRound int, decklist array<struct<name string, ability string, item string, tera string, "
    "attacks array<string>>>>>, "
    "pairings array<struct<match string, phase string, round string, table string, player1 string, player2 string, winner string>>")


def stored(spark: SparkSession, path: str, contract: str) -> DataFrame:
    """A stored contract table with the stamp of each row's ``batch``, empty when nothing was written yet."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*ingest.CONTRACTS[contract], "batch")])
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if path_missing(error):
            return spark.createDataFrame([], schema)
        raise


def batch_stamp(batch: DataFrame) -> str:
    """A name that depends on what the batch landed, so that a replayed batch has the same one."""
    facts = batch.agg(F.count("*").alias("n"), F.sum(F.xxhash64("id", "page", "pos").cast("decimal(38,0)")).alias("h")).first()
    return f"b{facts['n']}x{int(facts['h'] or 0) % (1 << 64):016x}"


def write_batch(rows: DataFrame, path: str, contract: str, stamp: str) -> None:
    """Write a batch's rows as their own partition, in place of what an earlier try left there."""
    shaped = rows.select(*[F.col(c).cast("string").alias(c) for c in ingest.CONTRACTS[contract]], F.lit(stamp).alias("batch"))
    if not shaped.isEmpty():
        shaped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def ingest_batch(batch: DataFrame, target: str, formats: Iterable[str] = incremental.DEFAULT_FORMATS,
                 strict: bool = True) -> None:
    """Select new tournaments of one landed batch, flatten them and write the four tables.

    Ids are chosen from the listing alone, which is read once. Payloads follow by a semi join on the id:
    only those of a wanted format are shuffled, once, and the four tables are written from what it kept.
    Each table takes the rows as one partition per batch, so neither standings, teamlists nor
    matches are read, and a batch that died half way replaces what it left. Its own earlier try does
    not count as known.
    """
    spark = batch.sparkSession
    formats = list(formats)
    listing = batch.select("id", "date", "format", "page", "pos").persist()
    chosen = new = None
    try:
        stamp = batch_stamp(listing)
        held = stored(spark, f"{target}/tournaments", "tournaments").where(F.col("batch") != stamp)
        dates = incremental.known_dates(held)
        ids = incremental.known_keys(held, "tournament_id").withColumnRenamed("tournament_id", "known_id")
        listed = listing.select("id", "date", "format", F.struct("page", "pos").alias("_order"))
        first = listed.groupBy("id").agg(F.min_by(F.struct("id", "date", "format", "_order"), "_order").alias("r")).select("r.*")
        chosen = incremental.select_new_until_known(first, "_order", dates, ids, formats, strict).select(
            F.col("id").alias("_id"), F.col("_order").alias("_first")).persist()
        # No row of an id comes before its first one, so this is equality; said this way, rows meet by id alone and stay there.
        own = (F.col("id") == F.col("_id")) & (F.struct("page", "pos") <= F.col("_first"))
        wanted = batch.where(F.col("format").isin(formats))
        landed = dealt_by_rows(wanted, listing.count(), BATCH_ROWS, "id").join(chosen, own, "left_semi")
        new = landed.groupBy("id").agg(F.first(F.struct(*batch.columns)).alias("r")).select("r.*").persist()
        for contract, rows in (
            ("standings", ingest.flatten_standings(new)), ("teamlists", ingest.flatten_teamlists(new)),
            ("matches", ingest.flatten_matches(new)), ("tournaments", ingest.flatten_tournaments(new)),
        ):
            write_batch(rows, f"{target}/{contract}", contract, stamp)
    finally:
        for held_rows in (listing, chosen, new):
            if held_rows is not None:
                held_rows.unpersist()


def ingest_stream(spark: SparkSession, landing: str, target: str, checkpoint: str,
                  formats: Iterable[str] = incremental.DEFAULT_FORMATS, strict: bool = True) -> StreamingQuery:
    """Ingest landed JSON payload pages; one run takes everything that has landed and stops.

    All pages of a run form one batch, newest first by (page, pos), as one crawl does: ids taken
    earlier in the run count as known, and its own dates never stop it.
    """
    pages = spark.readStream.schema(PAYLOAD).json(landing)
    return (
        pages.writeStream.foreachBatch(lambda df, _epoch: ingest_batch(df, target, formats, strict))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def dedupe_stream(stream: DataFrame, content: str, ttl: str | None = None, event_time: str | None = None) -> DataFrame:
    """First row per content hash; exact with unbounded state, or bounded by a time to live."""
    hashed = stream.withColumn("sha1", incremental.content_hash(content))
    if ttl is None:
        return hashed.dropDuplicates(["sha1"])
    timed = hashed.withColumn("_at", F.col(event_time).cast("timestamp")).withWatermark("_at", ttl)
    return timed.dropDuplicatesWithinWatermark(["sha1"]).drop("_at")


def latest_stream(stream: DataFrame, keys: Iterable[str], order: Iterable[str]) -> DataFrame:
    """Latest row per key, for update or complete mode."""
    return incremental.latest_by(stream, list(keys), list(order))


def run_to_end(stream: DataFrame, path: str, checkpoint: str, options: Mapping[str, str] | None = None) -> None:
    """Append a stream to Parquet until its landed input is exhausted."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    for key, value in (options or {}).items():
        writer = writer.option(key, value)
    writer.trigger(availableNow=True).start().awaitTermination()


def keep_latest(stream: DataFrame, keys: Iterable[str], order: Iterable[str], path: str, checkpoint: str,
                buckets: int = STATE_BUCKETS) -> None:
    """Keep one latest row per key in a Parquet table of ``buckets`` by key hash, versioned per batch.

    A batch reads and rewrites only the buckets its keys fall in, as a new version of each. A replayed
    batch starts from the versions before it and replaces its own, so a lost executor or a restart
    never doubles a row. The version before is kept for that; older ones of the touched buckets go.
    """
    keys, order = list(keys), list(order)

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        fresh = incremental.latest_by(batch, keys, order).withColumn("bucket", bucket).persist()
        try:
            touched = [r[0] for r in fresh.select("bucket").distinct().collect()]
            if not touched:
                return
            old: list = []
            try:
                versions = spark.read.parquet(path).where(F.col("bucket").isin(touched))
                found = versions.select("bucket", "epoch").distinct().where(F.col("epoch") < epoch).collect()
                last = {b: max(r["epoch"] for r in found if r["bucket"] == b) for b in {r["bucket"] for r in found}}
                old = [(r["bucket"], r["epoch"]) for r in found if r["epoch"] < last[r["bucket"]]]
                if last:
                    wanted = F.create_map(*[F.lit(x) for pair in last.items() for x in pair])
                    held = versions.where(F.col("epoch") == wanted[F.col("bucket")]).drop("epoch")
                    fresh_rows = incremental.latest_by(held.unionByName(fresh.select(*held.columns)), keys, order)
                else:
                    fresh_rows = fresh
            except AnalysisException as error:
                if not path_missing(error):
                    raise
                fresh_rows = fresh
            stamped = fresh_rows.withColumn("epoch", F.lit(epoch).cast("long")).repartition("bucket")
            stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "epoch").parquet(path)
            drop_folders(spark, [f"{path}/bucket={b}/epoch={e}" for b, e in old])
        finally:
            fresh.unpersist()

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drop_folders(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def latest_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of every bucket."""
    versions = spark.read.parquet(path)
    newest = versions.groupBy("bucket").agg(F.max("epoch").alias("epoch"))
    return versions.join(newest, ["bucket", "epoch"], "left_semi").drop("bucket", "epoch")
