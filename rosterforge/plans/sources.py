"""Sources, sinks and streams: tables are written to a shared staging folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterforge.operators import ingest
from rosterforge.plans.registry import query
from rosterforge.plans.standins import (
    SQL_FILES, SQL_TEAMLISTS, SQL_TOURNAMENTS, files, payloads, table, tournaments,
)
from rosterforge.plans.text import SQL_DOCS, raw_docs
from rosterforge.session import staging_dir
from rosterforge.sources import readers, writers
from rosterforge.streaming import flows


@query("scan_documents", f"WITH {SQL_DOCS} SELECT md5(text) AS h, length(text) AS n FROM docs")
def scan_documents(spark, sf):
    folder = staging_dir(spark, "documents")
    writers.write_documents(raw_docs(spark, sf), folder)
    return readers.scan_documents(spark, folder).select(F.md5("text").alias("h"), F.length("text").alias("n"))


@query("scan_keyed_json", """SELECT c_custkey AS id, 'C' || c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_nationkey % 2 = 0
UNION ALL SELECT c_custkey, NULL, c_name, c_mktsegment FROM customer WHERE c_nationkey % 2 = 1""")
def scan_keyed_json(spark, sf):
    folder = staging_dir(spark, "keyed")
    c = table(spark, sf, "customer")
    record = F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    keyed = c.where("c_nationkey % 2 = 0").groupBy("c_nationkey").agg(F.to_json(F.map_from_entries(F.collect_list(
        F.struct(F.concat(F.lit("C"), F.col("c_custkey").cast("string")), F.array(record))))).alias("value"))
    listed = c.where("c_nationkey % 2 = 1").groupBy("c_nationkey").agg(F.to_json(F.collect_list(record)).alias("j"))
    listed = listed.select("c_nationkey", F.when(F.col("c_nationkey") % 4 == 1, F.col("j")).otherwise(
        F.concat(F.lit('{"records":'), "j", F.lit("}"))).alias("value"))
    keyed.unionByName(listed).select("value").write.option("maxRecordsPerFile", 1).text(folder)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("segment", T.StringType())])
    return readers.scan_keyed_json(spark, folder, schema).drop("pos")


_TEXT_T = f"""WITH {SQL_TOURNAMENTS} SELECT date, CAST(decklists AS VARCHAR) AS decklists, format, game, CAST(is_online AS VARCHAR) AS is_online, name,
  CAST(organizer AS VARCHAR) AS organizer, CAST(players AS VARCHAR) AS players, CAST(id AS VARCHAR) AS tournament_id, url FROM tournaments"""


@query("scan_csv_contract", _TEXT_T)
def scan_csv_contract(spark, sf):
    folder = staging_dir(spark, "contract")
    writers.append_table(ingest.flatten_tournaments(tournaments(spark, sf)), folder, "tournaments", "csv")
    return readers.scan_csv_contract(spark, folder, "tournaments")


@query("scan_labelled_files", f"""WITH {SQL_FILES} SELECT split_part(path, '/', 2) AS label, path, substr(sha1(lower(path)), 1, 16) AS source_id FROM files WHERE ends_with(path, '.jpg')""")
def scan_labelled_files(spark, sf):
    return readers.labelled_paths(files(spark, sf), "data")


@query("scan_box_labels", """SELECT l_orderkey AS stem, l_linenumber AS class_id, l_discount AS xc, l_tax AS yc, l_quantity AS w, l_partkey::DOUBLE AS h
FROM lineitem WHERE l_suppkey % 5 <> 0""")
def scan_box_labels(spark, sf):
    li = table(spark, sf, "lineitem")
    parts = [F.col(c).cast("string") for c in ("l_discount", "l_tax", "l_quantity", "l_partkey")]
    line = F.concat(F.lit(" "), F.concat_ws("  ", F.concat(F.col("l_linenumber").cast("string"), F.lit(".0")), *parts), F.lit("\t"))
    broken = F.when(F.col("l_suppkey") % 5 == 0, F.concat(line, F.lit(" extra"))).otherwise(line)
    return readers.scan_box_labels(li.select(F.col("l_orderkey").alias("stem"), broken.alias("value")))


@query("append_table", f"""WITH {SQL_TOURNAMENTS}, two AS (SELECT * FROM tournaments UNION ALL SELECT * FROM tournaments WHERE is_online)
SELECT format, count(*) AS n FROM two GROUP BY 1""")
def append_table(spark, sf):
    folder = staging_dir(spark, "append")
    rows = ingest.flatten_tournaments(tournaments(spark, sf))
    for part in (rows, rows.where("is_online"), rows.where("1 = 0")):
        writers.append_table(part, folder, "tournaments")
    return writers.read_table(spark, folder, "tournaments").groupBy("format").agg(F.count("*").alias("n"))


@query("write_table_counts", f"""WITH {SQL_TOURNAMENTS} SELECT 'tournaments' AS "table", count(*) AS n FROM tournaments
UNION ALL SELECT 'standings', 0 UNION ALL SELECT 'matches', 0""")
def write_table_counts(spark, sf):
    folder = staging_dir(spark, "counts")
    writers.append_table(ingest.flatten_tournaments(tournaments(spark, sf)), f"{folder}/tournaments", "tournaments")
    counts = writers.table_counts(spark, {c: f"{folder}/{c}" for c in ("tournaments", "standings", "matches")})
    writers.write_table_counts(counts, f"{folder}/summary")
    return spark.read.json(f"{folder}/summary").select("table", "n")


@query("write_vector_index", "SELECT vec_id AS id, label, len(embedding) AS dims, CAST(round(embedding[1]::DOUBLE * 1000000) AS BIGINT) AS first FROM embeddings")
def write_vector_index(spark, sf):
    folder = staging_dir(spark, "vectors")
    writers.write_vector_index(table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"), folder)
    index = readers.load_vector_index(spark, folder)
    return index.select("id", "label", F.size("vector").alias("dims"),
                        F.round(F.get("vector", F.lit(0)).cast("double") * 1000000).cast("long").alias("first"))


@query("index_integrity", """SELECT (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM labels) AS metadata,
  (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)) AS without_metadata,
  (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS without_vector""")
def index_integrity(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    return writers.index_integrity(v, table(spark, sf, "labels").select(F.col("doc_id").alias("id")))


@query("write_split_dataset", """SELECT CASE WHEN n_chars % 4 = 0 THEN 'val' ELSE 'train' END AS split, count(*) AS n, count(*) AS manifest FROM documents GROUP BY 1""")
def write_split_dataset(spark, sf):
    folder = staging_dir(spark, "split")
    rows = table(spark, sf, "documents").select("doc_id", "lang", F.when(F.col("n_chars") % 4 == 0, "val").otherwise("train").alias("split"))
    writers.write_split_dataset(rows, folder, {"seed": 42, "ratio": 0.25})
    counts = spark.read.parquet(f"{folder}/data").groupBy("split").agg(F.count("*").alias("n"))
    manifest = spark.read.text(f"{folder}/manifest").select(F.get_json_object("value", "$.split").alias("split"))
    return counts.join(manifest.groupBy("split").agg(F.count("*").alias("manifest")), "split").select("split", "n", "manifest")


# --- streams ---------------------------------------------------------------------------------

@query("incremental_ingest", f"""WITH {SQL_TEAMLISTS}, {SQL_TOURNAMENTS}, t AS (SELECT CAST(id AS VARCHAR) AS id FROM tournaments WHERE format IN ('1-URGENT', '2-HIGH'))
SELECT 'tournaments' AS "table", count(*) AS n FROM t UNION ALL SELECT 'teamlists', count(*) FROM teamlists WHERE tournament_id IN (SELECT id FROM t)
UNION ALL SELECT 'standings', count(*) FROM (SELECT DISTINCT tournament_id, player_id FROM teamlists WHERE tournament_id IN (SELECT id FROM t))
UNION ALL SELECT 'matches', count(*) FROM (SELECT DISTINCT tournament_id, player_id FROM teamlists WHERE tournament_id IN (SELECT id FROM t))""")
def incremental_ingest(spark, sf):
    """Lands every payload, ingests twice over one checkpoint and counts the four tables."""
    folder = staging_dir(spark, "ingest")
    landed = payloads(spark, sf).withColumn("page", F.col("id").cast("long")).withColumn("pos", F.lit(0))
    landed.write.json(f"{folder}/landing", compression="gzip")
    for _ in range(2):
        flows.ingest_stream(spark, f"{folder}/landing", f"{folder}/tables", f"{folder}/ckpt", ("1-URGENT", "2-HIGH")).awaitTermination()
    return writers.table_counts(spark, {c: f"{folder}/tables/{c}" for c in ingest.CONTRACTS})


def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("dedupe_stream", "SELECT DISTINCT sha1(event_type || props) AS sha1 FROM events")
def dedupe_stream(spark, sf):
    folder = staging_dir(spark, "dedupe")
    rows = _event_stream(spark, sf).withColumn("content", F.concat("event_type", "props"))
    flows.run_to_end(flows.dedupe_stream(rows, "content").select("sha1"), f"{folder}/out", f"{folder}/ckpt")
    return spark.read.parquet(f"{folder}/out")


@query("latest_stream", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def latest_stream(spark, sf):
    folder = staging_dir(spark, "latest")
    rows = _event_stream(spark, sf).select("user_id", "event_id", "event_type")
    flows.keep_latest(rows, ["user_id"], ["event_id"], f"{folder}/out", f"{folder}/ckpt")
    return flows.latest_table(spark, f"{folder}/out").select("user_id", "event_id")
