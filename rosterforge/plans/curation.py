"""Detection records and dataset curation over line items (boxes), events (metrics) and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterforge.functions import boxes as X
from rosterforge.operators import clusters, curation as ops
from rosterforge.plans.registry import query
from rosterforge.plans.standins import SQL_TAGS, TAGS, table, tag_at


def boxes(spark, sf):
    """Line items as boxes; sixteen orders share an image."""
    li = table(spark, sf, "lineitem")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return li.select(
        F.floor(F.col("l_orderkey") / 16).alias("image"), (p * 100000 + s * 10 + F.col("l_linenumber")).alias("pos"),
        (p % 200).alias("x"), ((p * 7 + s * 13) % 400).alias("y"), (s % 60 + 20).alias("width"), (p % 50 + 20).alias("height"),
        ((p * 31 + s * 17) % 1000 / 1000).alias("score"), F.col("l_returnflag").alias("source"),
        F.lit(400).alias("image_width"), F.lit(480).alias("image_height"))


SQL_BOXES = """boxes AS (SELECT l_orderkey // 16 AS image, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS pos, l_partkey % 200 AS x,
  (l_partkey * 7 + l_suppkey * 13) % 400 AS y, l_suppkey % 60 + 20 AS w, l_partkey % 50 + 20 AS h,
  (l_partkey * 31 + l_suppkey * 17) % 1000 / 1000.0::DOUBLE AS score, l_returnflag AS src FROM lineitem)"""
_BOX = "STRUCT(x BIGINT, y BIGINT, w BIGINT, h BIGINT, src VARCHAR, pos BIGINT)[]"
_SHARED = "(greatest(0, least(o.x + o.w, n.x + n.w) - greatest(o.x, n.x)) * greatest(0, least(o.y + o.h, n.y + n.h) - greatest(o.y, n.y)))"
_RATIO = f"{_SHARED}::DOUBLE / greatest(1, least(o.w * o.h, n.w * n.h)) > 0.55::DOUBLE"
_IOU = f"{_SHARED}::DOUBLE / greatest(1, o.w * o.h + n.w * n.h - {_SHARED}) > 0.82::DOUBLE AND o.src = n.src"


def _sql_suppress(clash: str) -> str:
    return f"""WITH {SQL_BOXES}, l AS (SELECT image, list({{'x': x, 'y': y, 'w': w, 'h': h, 'src': src, 'pos': pos}} ORDER BY score DESC, pos) AS a FROM boxes GROUP BY 1),
k AS (SELECT image, unnest(list_reduce(a, lambda acc, n: CASE WHEN len(list_filter(acc, lambda o: {clash})) > 0 THEN acc ELSE list_append(acc, n) END, []::{_BOX})) AS b FROM l)
SELECT image, b.pos AS pos, b.x AS x, b.y AS y FROM k"""


@query("box_geometry", f"""WITH {SQL_BOXES}, c AS (SELECT image, pos, x - 5 AS x, y, w, h, greatest(0, least(x - 5, 199)) AS cx, least(y, 299) AS cy,
  pos % 7 AS r FROM boxes),
d AS (SELECT *, greatest(1, least(w, 200 - cx)) AS cw, greatest(1, least(h, 300 - cy)) AS ch, greatest(0, x - 3) AS ex, greatest(0, least(y - 3, 299)) AS ey FROM c)
SELECT image, pos, cx, cy, cw, ch, cw * ch AS area, least(199, ex) AS ex, ey, greatest(1, least(w + 6, 200 - least(199, ex))) AS ew,
  CAST(floor((greatest(0, least(cx + cw, 120) - greatest(cx, 20)) * greatest(0, least(cy + ch, 190) - greatest(cy, 40)))::DOUBLE
    / greatest(1, cw * ch + 15000 - greatest(0, least(cx + cw, 120) - greatest(cx, 20)) * greatest(0, least(cy + ch, 190) - greatest(cy, 40))) * 100000) AS BIGINT) AS iou_e5,
  CAST(floor((greatest(0, least(cx + cw, 120) - greatest(cx, 20)) * greatest(0, least(cy + ch, 190) - greatest(cy, 40)))::DOUBLE / greatest(1, least(cw * ch, 15000)) * 100000) AS BIGINT) AS ratio_e5,
  greatest(cx + cw, 120) - least(cx, 20) AS uw, greatest(cy + ch, 190) - least(cy, 40) AS uh,
  CAST(round_even(r / 14.0::DOUBLE * 640, 0) AS BIGINT) AS rel_x, '2 ' || printf('%.6f', (cx + cw / 2.0::DOUBLE) / 1000) || ' ' || printf('%.6f', (cy + ch / 2.0::DOUBLE) / 500)
    || ' ' || printf('%.6f', cw / 1000.0::DOUBLE) || ' ' || printf('%.6f', ch / 500.0::DOUBLE) AS line FROM d""")
def box_geometry(spark, sf):
    b = boxes(spark, sf)
    raw = X.box(F.col("x") - 5, F.col("y"), F.col("width"), F.col("height"))
    W, H = F.lit(200), F.lit(300)
    fixed = X.box(F.lit(20), F.lit(40), F.lit(100), F.lit(150))
    rows = b.select("image", "pos", X.clamp(raw, W, H).alias("c"), X.expand(raw, F.lit(3), F.lit(3), W, H).alias("e"), fixed.alias("f"),
                    X.from_relative(F.col("pos") % 7 / 14, F.lit(0.1), F.lit(0.2), F.lit(0.2), F.lit(640), F.lit(480)).alias("r"))
    c = F.col("c")
    u = X.union(c, F.col("f"))
    return rows.select(
        "image", "pos", c["x"].alias("cx"), c["y"].alias("cy"), c["width"].alias("cw"), c["height"].alias("ch"), X.area(c).alias("area"),
        F.col("e.x").alias("ex"), F.col("e.y").alias("ey"), F.col("e.width").alias("ew"),
        F.floor(X.iou(c, F.col("f")) * 100000).alias("iou_e5"), F.floor(X.overlap_ratio(c, F.col("f")) * 100000).alias("ratio_e5"),
        u["width"].alias("uw"), u["height"].alias("uh"), F.col("r.x").alias("rel_x"),
        X.label_line(2, X.to_label(c, F.lit(1000), F.lit(500))).alias("line"))


@query("suppress_overlaps", _sql_suppress(_RATIO))
def suppress_overlaps(spark, sf):
    return ops.suppress_overlaps(boxes(spark, sf)).select("image", "pos", "x", "y")


@query("suppress_overlaps_iou", _sql_suppress(_IOU))
def suppress_overlaps_iou(spark, sf):
    return ops.suppress_overlaps(boxes(spark, sf), metric="iou").select("image", "pos", "x", "y")


@query("rows_by_proximity", f"""WITH {SQL_BOXES}, s AS (SELECT image, count(*) AS n, greatest(24.0::DOUBLE, (list_sort(list(h)))[count(*) // 2 + 1] * 0.55::DOUBLE) AS thr FROM boxes GROUP BY 1),
l AS (SELECT b.image, any_value(thr) AS thr, list({{'c': y + h / 2.0::DOUBLE, 's': score, 'pos': pos}} ORDER BY y + h / 2.0::DOUBLE, pos) AS a FROM boxes b JOIN s USING (image) WHERE n > 6 GROUP BY 1),
g AS (SELECT image, list_reduce(a, lambda acc, n: CASE WHEN len(acc) > 0 AND abs(acc[-1].t / acc[-1].k - n.c) <= thr
    THEN list_append(acc[1:-2], {{'t': acc[-1].t + n.c, 'k': acc[-1].k + 1, 's': greatest(acc[-1].s, n.s), 'pos': CASE WHEN n.s > acc[-1].s THEN n.pos ELSE acc[-1].pos END}})
    ELSE list_append(acc, {{'t': n.c, 'k': 1, 's': n.s, 'pos': n.pos}}) END, []::STRUCT(t DOUBLE, k BIGINT, s DOUBLE, pos BIGINT)[]) AS rows FROM l),
u AS (SELECT image, unnest(rows) AS r, generate_subscripts(rows, 1) AS i FROM g),
t AS (SELECT image, r.pos AS pos, row_number() OVER (PARTITION BY image ORDER BY r.s DESC, i) AS k FROM u)
SELECT image, pos FROM t WHERE k <= 6 UNION ALL SELECT b.image, pos FROM boxes b JOIN s USING (image) WHERE n <= 6""")
def rows_by_proximity(spark, sf):
    b = boxes(spark, sf).withColumnRenamed("score", "confidence")
    return ops.rows_by_proximity(b, 6).select("image", "pos")


@query("column_group", f"""WITH {SQL_BOXES}, t AS (SELECT * FROM (SELECT *, w * h AS area, row_number() OVER (PARTITION BY image ORDER BY w * h DESC, pos) AS r FROM boxes) WHERE r <= 18),
m AS (SELECT a.image, a.r AS seed, b.* EXCLUDE (image) FROM t a JOIN t b ON a.image = b.image AND abs((b.x + b.w / 2.0::DOUBLE) - (a.x + a.w / 2.0::DOUBLE)) / 400 <= 0.18::DOUBLE
  AND b.w / a.w::DOUBLE BETWEEN 0.45::DOUBLE AND 1.85::DOUBLE),
g AS (SELECT image, seed, row_number() OVER (PARTITION BY image ORDER BY count(*) DESC, sum(area) DESC, seed) AS k FROM m GROUP BY 1, 2)
SELECT image, pos, "row" FROM (SELECT m.image, m.pos, row_number() OVER (PARTITION BY m.image ORDER BY m.y, m.r) AS "row" FROM m JOIN g ON g.image = m.image AND g.seed = m.seed AND k = 1) WHERE "row" <= 6""")
def column_group(spark, sf):
    return ops.column_group(boxes(spark, sf)).select("image", "pos", "row")


_MERGE = """abs(o.y + o.h / 2.0::DOUBLE - n.y - n.h / 2.0::DOUBLE) <= greatest(o.h, n.h) * 0.65::DOUBLE
  AND greatest(0, least(o.x + o.w, n.x + n.w) - greatest(o.x, n.x)) / greatest(1, least(o.w, n.w))::DOUBLE >= 0.35::DOUBLE"""


@query("merge_boxes", f"""WITH {SQL_BOXES}, l AS (SELECT image, list({{'x': x, 'y': y, 'w': w, 'h': h}} ORDER BY y, x, w, h) AS a FROM boxes GROUP BY 1),
k AS (SELECT image, unnest(list_reduce(a, lambda acc, n: CASE WHEN len(list_filter(acc, lambda o: {_MERGE})) = 0 THEN list_append(acc, n)
  ELSE list_transform(acc, lambda o, i: CASE WHEN i = list_position(list_transform(acc, lambda o: {_MERGE}), true) THEN {{'x': least(o.x, n.x), 'y': least(o.y, n.y),
    'w': greatest(o.x + o.w, n.x + n.w) - least(o.x, n.x), 'h': greatest(o.y + o.h, n.y + n.h) - least(o.y, n.y)}} ELSE o END) END,
  []::STRUCT(x BIGINT, y BIGINT, w BIGINT, h BIGINT)[])) AS b FROM l)
SELECT image, b.x AS x, b.y AS y, b.w AS width, b.h AS height FROM k""")
def merge_boxes(spark, sf):
    return ops.merge_boxes(boxes(spark, sf))


@query("merge_boxes_page", f"""WITH {SQL_BOXES}, l AS (SELECT image, list({{'x': x, 'y': y, 'w': w, 'h': h}} ORDER BY y, x, w, h) AS a FROM boxes GROUP BY 1),
k AS (SELECT image, unnest(list_reduce(a, lambda acc, n: CASE WHEN len(list_filter(acc, lambda o: {_MERGE})) = 0 THEN list_append(acc, n)
  ELSE list_transform(acc, lambda o, i: CASE WHEN i = list_position(list_transform(acc, lambda o: {_MERGE}), true) THEN {{'x': least(o.x, n.x), 'y': least(o.y, n.y),
    'w': greatest(o.x + o.w, n.x + n.w) - least(o.x, n.x), 'h': greatest(o.y + o.h, n.y + n.h) - least(o.y, n.y)}} ELSE o END) END,
  []::STRUCT(x BIGINT, y BIGINT, w BIGINT, h BIGINT)[])) AS b FROM l)
SELECT b.x AS x, b.y + image * 1000 AS y, b.w AS width, b.h AS height FROM k""")
def merge_boxes_page(spark, sf):
    """All boxes of the table on one long page: its bands are walked apart."""
    page = boxes(spark, sf).withColumn("y", F.col("y") + F.col("image") * 1000).withColumn("image", F.lit("page"))
    return ops.merge_boxes(page).drop("image")


@query("split_tall_boxes", """WITH b AS (SELECT l_orderkey AS image, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS pos, (l_partkey * 7 + l_suppkey * 13) % 400 AS y, l_partkey % 50 + 20 AS h FROM lineitem),
m AS (SELECT image, count(*) AS n, (list_sort(list(h)))[count(*) // 2 + 1] AS med FROM b GROUP BY 1),
j AS (SELECT b.*, med, n BETWEEN 2 AND 5 AND h >= med * 1.65::DOUBLE AS tall, y + med + greatest(4, CAST(round_even(med * 0.08::DOUBLE, 0) AS BIGINT)) AS y2 FROM b JOIN m USING (image)),
k AS (SELECT *, least(med, greatest(1, y + h - y2)) AS h2 FROM j)
SELECT image, pos, y, CASE WHEN tall AND y2 + h2 <= 480 THEN least(med, h) ELSE h END AS height FROM k
UNION ALL SELECT image, pos, y2, h2 FROM k WHERE tall AND y2 + h2 <= 480""")
def split_tall_boxes(spark, sf):
    li = table(spark, sf, "lineitem")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    rows = li.select(F.col("l_orderkey").alias("image"), (p * 100000 + s * 10 + F.col("l_linenumber")).alias("pos"),
                     ((p * 7 + s * 13) % 400).alias("y"), (p % 50 + 20).alias("height"), F.lit(480).alias("image_height"))
    return ops.split_tall_boxes(rows).select("image", "pos", "y", "height")


SQL_RUNS = """above AS (SELECT event_id, event_id - row_number() OVER (ORDER BY event_id) AS g FROM events WHERE value > 20),
runs AS (SELECT min(event_id) AS s, max(event_id) AS e FROM above GROUP BY g)"""


def _runs(spark, sf, min_len=1):
    e = table(spark, sf, "events").select(F.lit(0).alias("series"), F.col("event_id").alias("idx"), "value")
    return ops.runs_above_threshold(e, 20.0, min_len)


@query("runs_above_threshold", f"""WITH {SQL_RUNS} SELECT s AS start, e AS "end" FROM runs WHERE e - s + 1 >= 2""")
def runs_above_threshold(spark, sf):
    return _runs(spark, sf, 2).select("start", "end")


_RUN = "STRUCT(s BIGINT, e BIGINT, o BOOLEAN)[]"


def _sql_merge(extra: str, opened: str) -> str:
    return f"""WITH {SQL_RUNS}, l AS (SELECT list({{'s': s, 'e': e}} ORDER BY s) AS a FROM runs),
k AS (SELECT unnest(list_reduce(a, lambda acc, n: CASE WHEN len(acc) > 0 AND n.s - acc[-1].e <= 3 AND n.e - acc[-1].s + 1 <= 12 {extra}
  THEN list_append(acc[1:-2], {{'s': acc[-1].s, 'e': n.e, 'o': {opened}}}) ELSE list_append(acc, {{'s': n.s, 'e': n.e, 'o': true}}) END, []::{_RUN})) AS r FROM l)
SELECT r.s AS start, r.e AS "end" FROM k"""


@query("merge_runs", _sql_merge("", "true"))
def merge_runs(spark, sf):
    return ops.merge_runs(_runs(spark, sf), 3, 12).select("start", "end")


@query("merge_partial_runs", _sql_merge("AND acc[-1].o AND (acc[-1].e - acc[-1].s + 1 < 2 OR n.e - n.s + 1 < 2)", "false"))
def merge_partial_runs(spark, sf):
    return ops.merge_runs(_runs(spark, sf), 3, 12, min_len=2).select("start", "end")


@query("spacing_metrics", f"""WITH {SQL_BOXES}, g AS (SELECT image, x + w / 2.0::DOUBLE AS cx, (y + h / 2.0::DOUBLE) AS cy,
  (y + h / 2.0::DOUBLE) - lag(y + h / 2.0::DOUBLE) OVER (PARTITION BY image ORDER BY y, pos) AS gap FROM boxes),
m AS (SELECT image, count(*) AS boxes, (max(cx) - min(cx)) / 400 AS d, avg(gap) AS mean FROM g GROUP BY 1),
v AS (SELECT g.image, max(abs(gap - mean)) / any_value(CASE WHEN mean > 0 THEN mean END) AS sv FROM g JOIN m USING (image) GROUP BY 1)
SELECT image, boxes, CAST(round(CASE WHEN boxes < 2 THEN 0 ELSE d END * 100000) AS BIGINT) AS drift,
 CAST(round(CASE WHEN boxes < 3 OR NOT mean > 0 THEN 0 ELSE sv END * 100000) AS BIGINT) AS spacing FROM m JOIN v USING (image)""")
def spacing_metrics(spark, sf):
    out = ops.spacing_metrics(boxes(spark, sf))
    return out.select("image", "boxes", F.round(F.col("centre_drift") * 100000).cast("long").alias("drift"),
                      F.round(F.col("spacing_variation") * 100000).cast("long").alias("spacing"))


# --- quality ---------------------------------------------------------------------------------

def metrics(spark, sf):
    e = table(spark, sf, "events")
    k, u = F.col("event_id"), F.col("user_id")
    return e.select(
        k, (k % 3 + 4).alias("card_count"), (k * 7 % 120).cast("double").alias("sharpness"), (u % 20 / 100).alias("card_area_ratio"),
        (k % 30 / 100).alias("centre_drift"), (u % 45 / 100).alias("spacing_variation"), (k % 25 / 100).alias("overexposed"), (u % 40 / 100).alias("underexposed"),
        (600 + k % 600).alias("image_width"), (u * 11 % 1500).alias("image_height"), "event_type", "user_id")


SQL_METRICS = """m AS (SELECT event_id AS k, user_id AS u, event_id % 3 + 4 AS cards, (event_id * 7 % 120)::DOUBLE AS sharp, user_id % 20 / 100.0::DOUBLE AS area,
  event_id % 30 / 100.0::DOUBLE AS drift, user_id % 45 / 100.0::DOUBLE AS spacing, event_id % 25 / 100.0::DOUBLE AS ov, user_id % 40 / 100.0::DOUBLE AS un,
  600 + event_id % 600 AS iw, user_id * 11 % 1500 AS ih, event_type FROM events),
gate AS (SELECT *, list_filter([CASE WHEN cards <> 6 THEN 'found ' || cards || ' of 6 cards' END, CASE WHEN sharp < 45 THEN 'too blurry' END, CASE WHEN area < 0.08 THEN 'cards too small' END,
  CASE WHEN drift > 0.22 THEN 'too angled' END, CASE WHEN spacing > 0.38 THEN 'uneven spacing' END, CASE WHEN ov > 0.18 THEN 'too much glare' END], lambda x: x IS NOT NULL) AS issues, un > 0.35 AS dark FROM m),
grade AS (SELECT *, CASE WHEN ih = 0 OR least(iw, ih) < 720 THEN 2 WHEN least(iw, ih) < 1000 THEN 1 ELSE 0 END + CASE WHEN cards <> 6 THEN 2 ELSE 0 END
  + CASE WHEN event_type = 'error' THEN 1 WHEN sharp < 45 THEN 3 WHEN sharp < 85 THEN 1 ELSE 0 END + CASE WHEN area < 0.08 THEN 2 WHEN area < 0.12 THEN 1 ELSE 0 END
  + CASE WHEN greatest(ov, un) > 0.18 THEN 3 WHEN greatest(ov, un) > 0.06 THEN 1 ELSE 0 END + CASE WHEN drift > 0.22 THEN 2 WHEN drift > 0.12 THEN 1 ELSE 0 END
  + CASE WHEN spacing > 0.38 THEN 2 WHEN spacing > 0.22 THEN 1 ELSE 0 END + CASE WHEN len(issues) > 0 THEN 4 ELSE 0 END AS issue_score FROM gate)"""


@query("quality_gate", f"""WITH {SQL_METRICS} SELECT k AS event_id, array_to_string(issues, '|') AS issues, CASE WHEN dark THEN 'dark image' ELSE '' END AS warnings,
  CASE WHEN len(issues) > 0 THEN 'bad' WHEN dark THEN 'warning' ELSE 'good' END AS quality_level, len(issues) = 0 AS can_analyze FROM gate""")
def quality_gate(spark, sf):
    return ops.quality_gate(metrics(spark, sf)).select(
        "event_id", F.array_join("issues", "|").alias("issues"), F.array_join("warnings", "|").alias("warnings"), "quality_level", "can_analyze")


def _graded(spark, sf):
    rows = ops.quality_gate(metrics(spark, sf))
    text = F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("sharpness").cast("string"))
    return ops.quality_grade(rows.withColumn("sharpness", text))


@query("quality_grade", f"""WITH {SQL_METRICS} SELECT k AS event_id, issue_score, CASE WHEN issue_score >= 5 THEN 'retake' WHEN issue_score >= 2 THEN 'usable_needs_improvement'
  ELSE 'best_candidate' END AS grade FROM grade""")
def quality_grade(spark, sf):
    return _graded(spark, sf).select("event_id", "issue_score", "grade")


def _objects(spark, sf):
    b = boxes(spark, sf)
    label = F.when(F.col("pos") % 3 == 0, "sprite").when(F.col("pos") % 3 == 1, "type_icon").otherwise("other")
    return b.withColumn("label", label).withColumn("image", F.col("image") * 4 + F.col("pos") % 4).withColumn("image_width", F.lit(120)).withColumn("image_height", F.lit(80))


SQL_NOTES = SQL_BOXES + """,
o AS (SELECT image * 4 + pos % 4 AS image, pos, ['sprite', 'type_icon', 'other'][pos % 3 + 1] AS label, w / 120.0::DOUBLE AS wr, h / 80.0::DOUBLE AS hr, w * h / 9600.0::DOUBLE AS ar, w / h::DOUBLE AS asp FROM boxes),
noted AS (SELECT *, list_filter([CASE WHEN label = 'sprite' AND (wr < 0.08 OR hr < 0.18) THEN 'sprite_box_too_small' END, CASE WHEN label = 'sprite' AND (wr > 0.74 OR hr > 1) THEN 'sprite_box_too_large' END,
  CASE WHEN label = 'sprite' AND ar < 0.025 THEN 'sprite_area_tiny' END, CASE WHEN label = 'type_icon' AND (wr < 0.08 OR hr < 0.16) THEN 'type_icon_too_small' END,
  CASE WHEN label = 'type_icon' AND (wr > 0.36 OR hr > 0.72) THEN 'type_icon_too_large' END, CASE WHEN label = 'type_icon' AND (asp < 0.45 OR asp > 1.8) THEN 'type_icon_bad_aspect' END], lambda x: x IS NOT NULL) AS notes FROM o)"""


@query("object_quality_notes", f"WITH {SQL_NOTES} SELECT image, pos, array_to_string(notes, ',') AS notes FROM noted")
def object_quality_notes(spark, sf):
    return ops.quality_notes(_objects(spark, sf)).select("image", "pos", F.array_join("notes", ",").alias("notes"))


@query("route_review", f"""WITH {SQL_NOTES}, f AS (SELECT image, list_sort(list_distinct(list_concat(flatten(list(notes)),
  list_filter([CASE WHEN NOT bool_or(label = 'sprite') THEN 'missing_sprite' END, CASE WHEN NOT bool_or(label = 'type_icon') THEN 'missing_type_icon' END], lambda x: x IS NOT NULL)))) AS n FROM noted GROUP BY 1)
SELECT image, array_to_string(n, ',') AS notes, CASE WHEN len(n) > 0 THEN 'review' ELSE 'dataset' END AS route FROM f""")
def route_review(spark, sf):
    return ops.route_review(ops.quality_notes(_objects(spark, sf))).withColumn("notes", F.array_join("notes", ","))


# --- slots, images, runs ---------------------------------------------------------------------

def slots(spark, sf):
    li = table(spark, sf, "lineitem")
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    none = F.array().cast("array<string>")
    return li.select(
        F.col("l_orderkey").alias("image"), (p * 100000 + s * 10 + n).alias("pos"), F.when(s % 17 == 0, "").otherwise(F.concat(F.lit("E"), p.cast("string"))).alias("name"),
        F.when(p % 19 != 0, (p * 3 + s) % 60 / 100).alias("confidence"), F.when(s % 13 != 0, (p + s * 5) % 90 / 1000).alias("gap"),
        F.when(p % 5 == 0, "a/Camera1.png").when(p % 5 == 1, "x/debug-1.png").when(p % 5 == 2, "Menu_CP_1.png").when(p % 5 == 3, "plain.png").alias("reference"),
        F.when(s % 4 == 0, "reference_index").otherwise("nearest").alias("source"),
        F.when(n != 1, F.array(F.upper(tag_at(p % 5)), tag_at(s % 5))).otherwise(none).alias("detected_types"),
        F.when(n != 2, F.array(tag_at(s % 5), tag_at((p + n) % 5))).otherwise(none).alias("reference_types"))


SQL_SLOTS = f"""s0 AS (SELECT l_orderkey AS image, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS pos, l_suppkey % 17 = 0 AS unnamed,
  CASE WHEN l_partkey % 19 <> 0 THEN (l_partkey * 3 + l_suppkey) % 60 / 100.0::DOUBLE END AS c, CASE WHEN l_suppkey % 13 <> 0 THEN (l_partkey + l_suppkey * 5) % 90 / 1000.0::DOUBLE END AS g,
  l_partkey % 5 AS rk, l_suppkey % 4 = 0 AS refsrc, l_linenumber AS n,
  list_sort(list_distinct([{SQL_TAGS}[l_partkey % 5 + 1], {SQL_TAGS}[l_suppkey % 5 + 1]])) AS det, list_sort(list_distinct([{SQL_TAGS}[l_suppkey % 5 + 1], {SQL_TAGS}[(l_partkey + l_linenumber) % 5 + 1]])) AS ref FROM lineitem),
slots AS (SELECT *, CASE WHEN c IS NOT NULL AND g IS NOT NULL THEN CASE WHEN c >= 0.35 AND g >= 0.05 THEN 'accept_fast_path' WHEN c >= 0.28 AND g >= 0.025 THEN 'accept_with_review_or_type_check'
    ELSE 'needs_type_or_manual_review' END WHEN c >= 0.35 THEN 'accept_but_gap_unknown' ELSE 'needs_review' END AS decision FROM s0)"""


@query("slot_decision", f"""WITH {SQL_SLOTS} SELECT image, pos, decision, CASE WHEN rk IN (0, 1) THEN 'camera_or_custom_reference' WHEN rk = 2 OR refsrc THEN 'clear_reference'
  WHEN rk = 3 THEN 'reference_image_unknown_type' ELSE 'unknown' END AS reference_kind,
  CASE WHEN n = 1 THEN 'not_detected' WHEN n = 2 THEN 'reference_missing' WHEN det = ref THEN 'match' WHEN list_has_any(det, ref) THEN 'partial' ELSE 'mismatch' END AS tag_agreement FROM slots""")
def slot_decision(spark, sf):
    return ops.slot_decision(slots(spark, sf)).select("image", "pos", "decision", "reference_kind", "tag_agreement")


def _images(spark, sf):
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "failed").otherwise("success")
    return o.select(F.col("o_orderkey").alias("image"), status.alias("status"), F.round(F.col("o_totalprice") * 100).cast("long").alias("elapsed"),
                    (F.col("o_orderkey") % 9).alias("issue_score"))


def _summaries(spark, sf):
    rows = ops.image_summary(ops.slot_decision(slots(spark, sf)), _images(spark, sf))
    grade = F.when(F.col("issue_score") >= 5, "retake").when(F.col("issue_score") >= 2, "usable_needs_improvement").otherwise("best_candidate")
    return rows.withColumn("grade", grade).withColumn("elapsed_ms", F.col("elapsed").cast("string"))


SQL_IMAGES = SQL_SLOTS + """,
ic AS (SELECT image, count(*) AS slots, count(*) FILTER (WHERE decision LIKE 'accept_fast%' OR decision LIKE 'accept_but%') AS accepted,
  count(*) FILTER (WHERE NOT (decision LIKE 'accept_fast%' OR decision LIKE 'accept_but%') AND NOT unnamed) AS review,
  count(*) FILTER (WHERE NOT (decision LIKE 'accept_fast%' OR decision LIKE 'accept_but%') AND unnamed) AS missing FROM slots GROUP BY 1),
im AS (SELECT o_orderkey AS image, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'success' END AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS elapsed, o_orderkey % 9 AS issue_score,
  coalesce(slots, 0) AS slots, coalesce(accepted, 0) AS accepted, coalesce(review, 0) AS review, coalesce(missing, 0) AS missing FROM orders LEFT JOIN ic ON image = o_orderkey),
dc AS (SELECT image, string_agg(decision || '=' || n, ',' ORDER BY decision) AS decisions FROM (SELECT image, decision, count(*) AS n FROM slots GROUP BY 1, 2) GROUP BY 1)"""


@query("image_summary", f"""WITH {SQL_IMAGES} SELECT im.image, im.status, im.slots, accepted, review, missing, coalesce(decisions, '') AS decisions,
  CASE WHEN im.status <> 'success' THEN 'failed or skipped' WHEN im.slots < 6 THEN 'fewer slots than expected' WHEN missing > 0 THEN 'slots without a name'
   WHEN review > accepted THEN 'most slots need review' WHEN accepted >= 4 THEN 'most slots accepted' ELSE 'mixed result' END AS note FROM im LEFT JOIN dc ON dc.image = im.image""")
def image_summary(spark, sf):
    rows = _summaries(spark, sf)
    pairs = F.array_sort(F.transform(F.map_entries("decisions"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return rows.select("image", "status", "slots", "accepted", "review", "missing", F.array_join(pairs, ",").alias("decisions"), "note")


@query("run_summary", f"""WITH {SQL_IMAGES}, g AS (SELECT *, CASE WHEN issue_score >= 5 THEN 'retake' WHEN issue_score >= 2 THEN 'usable_needs_improvement' ELSE 'best_candidate' END AS grade FROM im)
SELECT 'total' AS section, 'images' AS key, count(*)::DOUBLE AS value FROM im UNION ALL SELECT 'total', 'succeeded', (count(*) FILTER (WHERE status = 'success'))::DOUBLE FROM im
UNION ALL SELECT 'total', 'failed_or_skipped', (count(*) FILTER (WHERE status <> 'success'))::DOUBLE FROM im UNION ALL SELECT 'total', 'slots', sum(slots)::DOUBLE FROM im
UNION ALL SELECT 'total', 'accepted', sum(accepted)::DOUBLE FROM im UNION ALL SELECT 'total', 'review', sum(review)::DOUBLE FROM im UNION ALL SELECT 'total', 'missing', sum(missing)::DOUBLE FROM im
UNION ALL SELECT 'total', 'mean_elapsed_ms', round_even(sum(elapsed)::DOUBLE / count(*), 2) FROM im
UNION ALL SELECT 'decision', decision, count(*)::DOUBLE FROM slots WHERE image IN (SELECT o_orderkey FROM orders) GROUP BY 2 UNION ALL SELECT 'grade', grade, count(*)::DOUBLE FROM g GROUP BY 2
UNION ALL (SELECT 'slowest', CAST(image AS VARCHAR), elapsed::DOUBLE FROM im ORDER BY elapsed DESC, CAST(image AS VARCHAR) LIMIT 10)
UNION ALL (SELECT 'retake', CAST(image AS VARCHAR), issue_score::DOUBLE FROM g WHERE grade <> 'best_candidate' ORDER BY image LIMIT 10)""")
def run_summary(spark, sf):
    return ops.run_summary(_summaries(spark, sf))


@query("review_sheet", """WITH b AS (SELECT l_orderkey AS image, l_partkey AS p, l_suppkey AS s, l_linenumber AS n FROM lineitem)
SELECT 'img' || image || '.png' AS image, n AS slot, 'E' || p AS prediction, s % 8 * 125 AS similarity_e3, 'L' || p || ':' || printf('%.3f', s % 8 * 0.125::DOUBLE) || ' | L' || s || ':' || printf('%.3f', n * 0.0625::DOUBLE) AS top5,
  't' || s AS tag_prediction, '' AS tag_top5, '' AS notes FROM b""")
def review_sheet(spark, sf):
    li = table(spark, sf, "lineitem")
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    hit = lambda label, score: F.struct(F.concat(F.lit("L"), label.cast("string")).alias("label"), score.alias("similarity"))
    slot = F.struct(n.alias("position"), F.concat(F.lit("E"), p.cast("string")).alias("prediction"), F.array(hit(p, s % 8 * 0.125), hit(s, n * 0.0625)).alias("hits"),
                    F.concat(F.lit("t"), s.cast("string")).alias("tag_prediction"), F.array().cast("array<struct<label:string,similarity:double>>").alias("tag_hits"))
    rows = li.groupBy(F.concat(F.lit("up/img"), F.col("l_orderkey").cast("string"), F.lit(".png")).alias("image")).agg(F.collect_list(slot).alias("slots"))
    out = ops.review_sheet(rows)
    return out.select("image", "slot", "prediction", F.round(F.col("similarity") * 1000).cast("long").alias("similarity_e3"), "top5", "tag_prediction", "tag_top5", "notes")


# --- files -----------------------------------------------------------------------------------

def _crops(spark, sf):
    d = table(spark, sf, "documents")
    kind = F.col("n_chars") % 5
    prefix = (F.when(kind == 0, "Opponent-slot-").when(kind == 1, "opponent-pokemon-").when(kind == 2, "opponent-type-cluster-")
              .when(kind == 3, "opponent-type-icon-").otherwise("other-"))
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("/"), "lang", F.lit("/"), prefix, (F.col("n_chars") % 7).cast("string"), F.lit(".JPG"))
    return d.select("doc_id", path.alias("path"), F.sha1("source").alias("content_hash"))


SQL_CROPS = """f AS (SELECT doc_id, ['Opponent-slot-', 'opponent-pokemon-', 'opponent-type-cluster-', 'opponent-type-icon-', 'other-'][n_chars % 5 + 1] || (n_chars % 7) AS stem,
  lang, n_chars % 5 AS k, substr(sha1(source), 1, 10) AS h FROM documents),
r AS (SELECT *, 'd' || doc_id || '/' || lang || '/' || stem || '.JPG' AS path, ['slot', 'entity', 'type_combo', 'single_type', NULL][k + 1] AS queue FROM f),
t AS (SELECT *, queue || '__' || lang || '__' || stem || '__' || h AS base FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY substr(md5(path), 1, 2), path) AS i FROM t)"""


@query("route_by_prefix", f"WITH {SQL_CROPS} SELECT doc_id, queue, base || CASE WHEN i > 1 THEN '__' || i ELSE '' END || '.jpg' AS target_name FROM n")
def route_by_prefix(spark, sf):
    return ops.route_by_prefix(_crops(spark, sf)).select("doc_id", "queue", "target_name")


@query("queue_counts", f"WITH {SQL_CROPS} SELECT coalesce(queue, 'skipped') AS queue, count(*) AS n FROM t GROUP BY 1")
def queue_counts(spark, sf):
    return ops.queue_counts(ops.route_by_prefix(_crops(spark, sf)))


@query("parse_name_tags", f"""WITH p AS (SELECT p_partkey, {SQL_TAGS}[p_partkey % 18 + 1] AS a, {SQL_TAGS}[p_size % 18 + 1] AS b, p_size % 4 AS k, lower(split_part(p_name, ' ', 1)) AS c FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN a || ',' || b WHEN 1 THEN a WHEN 2 THEN 'poison,' || a ELSE a || ',' || b END AS tags FROM p""")
def parse_name_tags(spark, sf):
    a, b, k = tag_at(F.col("p_partkey") % 18), tag_at(F.col("p_size") % 18), F.col("p_size") % 4
    stem = (F.when(k == 0, F.concat(a, F.lit("_"), b, F.lit("_camera-12"))).when(k == 1, F.concat(F.upper(a), F.lit("__camera_"), b))
            .when(k == 2, F.concat(F.lit("posion-"), a, F.lit("_7"))).otherwise(F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("_"), a, F.lit("-"), b, F.lit("_"), a)))
    tags = ops.parse_name_tags(stem, TAGS, {"posion": "poison"})
    return table(spark, sf, "part").select("p_partkey", F.array_join(tags, ",").alias("tags"))


@query("train_val_split", """WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY md5('7|' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN r <= greatest(1, least(n - 1, CAST(round_even(n * 0.2::DOUBLE, 0) AS BIGINT))) THEN 'val' ELSE 'train' END AS split FROM k""")
def train_val_split(spark, sf):
    return ops.train_val_split(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.2, 7)


def _combined(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("stem"), F.when(F.col("n_chars") % 5 == 0, "val").otherwise("train").alias("split"))
    p = table(spark, sf, "pages").select(F.col("page_id").alias("stem"), F.when(F.length("html") % 4 == 0, "val").otherwise("train").alias("split"))
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("stem"))
    return ops.combine_datasets({"doc": d, "page": p}, {"doc": labels, "page": labels})


SQL_COMBINED = """c AS (SELECT 'doc' AS tag, doc_id AS stem, CASE WHEN n_chars % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
  UNION ALL SELECT 'page', page_id, CASE WHEN length(html) % 4 = 0 THEN 'val' ELSE 'train' END FROM pages WHERE page_id IN (SELECT doc_id FROM labels))"""


@query("combine_datasets", f"WITH {SQL_COMBINED} SELECT tag, stem, split, tag || '__' || stem AS name FROM c")
def combine_datasets(spark, sf):
    return _combined(spark, sf).select("tag", "stem", "split", "name")


@query("combined_counts", f"WITH {SQL_COMBINED} SELECT tag, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val FROM c GROUP BY 1")
def combined_counts(spark, sf):
    return ops.combined_counts(_combined(spark, sf))


@query("label_audit", """SELECT coalesce(d.doc_id, l.doc_id) AS stem, CASE WHEN d.doc_id IS NULL THEN 'missing_image' WHEN n_chars % 7 = 0 THEN 'skipped_unreadable'
  WHEN l.doc_id IS NULL THEN 'missing_label' ELSE 'cleaned' END AS status, coalesce(CAST(quality AS VARCHAR), '') AS label_text
FROM (SELECT CASE WHEN lang = 'en' THEN -doc_id - 1 ELSE doc_id END AS doc_id, n_chars FROM documents) d FULL JOIN labels l ON l.doc_id = d.doc_id""")
def label_audit(spark, sf):
    # English documents get a key that no label has.
    stem = F.when(F.col("lang") == "en", -F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    images = table(spark, sf, "documents").select(stem.alias("stem"), (F.col("n_chars") % 7 != 0).alias("readable"))
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("stem"), F.col("quality").cast("string").alias("text"))
    return ops.label_audit(images, labels)


# --- clusters --------------------------------------------------------------------------------

@query("cluster_vectors")
def cluster_vectors(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return clusters.cluster_vectors(e, 10).select("vec_id", "cluster", "cluster_name")


EPS, MIN_SAMPLES = 1.15, 3


@query("density_clusters", f"""WITH RECURSIVE e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
near AS (SELECT a.id AS a, b.id AS b FROM e a, e b WHERE list_distance(a.v, b.v) <= {EPS}),
core AS (SELECT a AS id FROM near GROUP BY 1 HAVING count(*) >= {MIN_SAMPLES}),
link AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
lab AS (SELECT a AS id, min(b) AS cluster FROM reach GROUP BY 1),
border AS (SELECT n.a AS id, min(lab.cluster) AS cluster FROM near n JOIN lab ON lab.id = n.b WHERE n.a NOT IN (SELECT id FROM core) GROUP BY 1)
SELECT e.id AS vec_id, coalesce(lab.cluster, border.cluster, -1) AS cluster, lab.id IS NOT NULL AS is_core FROM e LEFT JOIN lab ON lab.id = e.id LEFT JOIN border ON border.id = e.id""")
def density_clusters(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return clusters.density_clusters(e, EPS, MIN_SAMPLES, "vec_id")
