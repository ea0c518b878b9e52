"""Incremental selection, content-hash state and latest rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterforge.operators import incremental as ops
from rosterforge.plans.registry import query
from rosterforge.plans.standins import SQL_TOURNAMENTS, table, tournaments

_FORMATS = ("1-URGENT", "2-HIGH")


@query("distinct_known_keys", f"""WITH {SQL_TOURNAMENTS}
SELECT DISTINCT substr(date, 1, 10) AS known_date FROM tournaments WHERE is_online""")
def distinct_known_keys(spark, sf):
    return ops.known_dates(tournaments(spark, sf).where("isOnline"))


def _known(spark, sf):
    """What earlier runs stored: very large closed tournaments, and every pending one by id."""
    all_rows = tournaments(spark, sf)
    dates = ops.known_dates(all_rows.where((F.col("players") >= 499) & ~F.col("isOnline")))
    ids = all_rows.where(~F.col("decklists")).select(F.col("id").cast("string").alias("known_id"))
    return dates, ids


SQL_KNOWN = SQL_TOURNAMENTS + """,
dates AS (SELECT DISTINCT substr(date, 1, 10) AS d FROM tournaments WHERE players >= 499 AND NOT is_online),
ids AS (SELECT id FROM tournaments WHERE NOT decklists),
stop AS (SELECT min(id) AS s FROM tournaments WHERE substr(date, 1, 10) IN (SELECT d FROM dates))"""


@query("select_new_until_known", f"""WITH {SQL_KNOWN}
SELECT id, format, (SELECT s FROM stop) IS NOT NULL AS stopped FROM tournaments
WHERE ((SELECT s FROM stop) IS NULL OR id < (SELECT s FROM stop))
  AND format IN ('1-URGENT', '2-HIGH') AND id NOT IN (SELECT id FROM ids)""")
def select_new_until_known(spark, sf):
    dates, ids = _known(spark, sf)
    new = ops.select_new_until_known(tournaments(spark, sf), "id", dates, ids, _FORMATS)
    return new.select("id", "format", "stopped")


@query("select_new_by_id", f"""WITH {SQL_KNOWN}
SELECT id, format, FALSE AS stopped FROM tournaments
WHERE format IN ('1-URGENT', '2-HIGH') AND id NOT IN (SELECT id FROM ids)""")
def select_new_by_id(spark, sf):
    dates, ids = _known(spark, sf)
    new = ops.select_new_until_known(tournaments(spark, sf), "id", dates, ids, _FORMATS, strict=False)
    return new.select("id", "format", "stopped")


def _uploads(spark, sf):
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", F.concat("event_type", "props").alias("content"),
                    F.when(k % 9 == 0, 5).otherwise(6).alias("boxes"), "event_type", k.alias("k"))


def _state(uploads):
    return uploads.where("k < 10 AND event_type = 'view'").select(ops.content_hash("content").alias("sha1")).distinct()


SQL_UPLOADS = """u AS (SELECT event_id, event_type || props AS content, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
  event_type FROM events),
h AS (SELECT event_id, sha1(content) AS sha1, CASE WHEN k % 9 = 0 THEN 5 ELSE 6 END AS boxes, k, event_type FROM u),
state AS (SELECT DISTINCT sha1 FROM h WHERE k < 10 AND event_type = 'view'),
marked AS (SELECT event_id, sha1, CASE WHEN sha1 IN (SELECT sha1 FROM state) THEN 'seen'
  WHEN boxes <> 6 THEN 'incomplete'
  WHEN row_number() OVER (PARTITION BY sha1 ORDER BY event_id) = 1 THEN 'new' ELSE 'seen' END AS status FROM h)"""


@query("dedupe_by_content_hash", f"WITH {SQL_UPLOADS} SELECT event_id, sha1, status FROM marked")
def dedupe_by_content_hash(spark, sf):
    uploads = _uploads(spark, sf)
    marked = ops.dedupe_by_content_hash(uploads, _state(uploads), "content", "event_id", "boxes")
    return marked.select("event_id", "sha1", "status")


@query("upload_counts", f"""WITH {SQL_UPLOADS} SELECT count(*) AS input_count,
  count(*) FILTER (WHERE status = 'new') AS new_count, count(*) FILTER (WHERE status = 'seen') AS skipped_existing,
  count(*) FILTER (WHERE status = 'incomplete') AS skipped_incomplete FROM marked""")
def upload_counts(spark, sf):
    uploads = _uploads(spark, sf)
    return ops.upload_counts(
        ops.dedupe_by_content_hash(uploads, _state(uploads), "content", "event_id", "boxes"))


@query("mark_processed", f"""WITH {SQL_UPLOADS}
SELECT sha1, min(event_id) AS source, 'marked_existing_without_processing' AS status FROM h
WHERE sha1 NOT IN (SELECT sha1 FROM state) GROUP BY 1""")
def mark_processed(spark, sf):
    uploads = _uploads(spark, sf)
    return ops.mark_processed(uploads, _state(uploads), "content", "event_id")


@query("latest_record", """SELECT user_id, event_id, event_type FROM (SELECT *,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_record(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    return ops.latest_by(e, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("latest_prediction", """WITH p AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1),
u AS (SELECT user_id, max(event_id) AS uploaded FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT user_id, event_id IS NOT NULL AND (uploaded IS NULL OR event_id >= uploaded) AS has_prediction,
  CASE WHEN uploaded IS NULL OR event_id >= uploaded THEN event_id END AS event_id
FROM p FULL JOIN u USING (user_id)""")
def latest_prediction(spark, sf):
    e = table(spark, sf, "events")
    return ops.latest_prediction(e.where("event_type = 'click'").select("user_id", "event_id"),
                                 e.where("event_type = 'view'"), ["user_id"], "event_id")


@query("validate_uploads", """WITH u AS (SELECT page_id, 'p' || page_id AS filename,
  CASE WHEN page_id % 5 = 0 THEN 'text/html' WHEN page_id % 2 = 0 THEN 'image/png' ELSE 'image/jpeg' END AS mime,
  CASE WHEN page_id % 3 = 0 THEN 'RIFFxxxxWEBP' || html WHEN page_id % 7 = 0 THEN 'RIFFWEBP' || html ELSE html END AS content
  FROM pages)
SELECT page_id, reason = '' AS ok, reason FROM (SELECT page_id, CASE WHEN mime = 'text/html' THEN 'unsupported type'
  WHEN NOT (starts_with(content, 'RIFF') AND substr(content, 9, 4) = 'WEBP') THEN 'invalid image'
  WHEN strlen(content) < 1024 THEN 'too small' ELSE '' END AS reason FROM u)""")
def validate_uploads(spark, sf):
    key = F.col("page_id")
    mime = F.when(key % 5 == 0, "text/html").when(key % 2 == 0, "image/png").otherwise("image/jpeg")
    prefix = F.when(key % 3 == 0, "RIFFxxxxWEBP").when(key % 7 == 0, "RIFFWEBP").otherwise("")
    content = F.encode(F.concat(prefix, F.col("html")), "UTF-8")
    uploads = table(spark, sf, "pages").select(
        "page_id", F.concat(F.lit("p"), key.cast("string")).alias("filename"), mime.alias("mime"),
        content.alias("content"), F.octet_length(content).alias("length"))
    return ops.validate_uploads(uploads).select("page_id", "ok", "reason")
