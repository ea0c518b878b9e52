"""Usage analytics over the team-list stand-in."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterforge.operators import usage as ops
from rosterforge.plans.registry import query
from rosterforge.plans.standins import (
    SQL_FILES, SQL_SLOTTED, SQL_TEAMLISTS, files, slotted_teamlists, table, teamlists,
)

K = 6


def _joined(array: str, *fields: str):
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", *[s[f].cast("string") for f in fields])), "|")


SQL_STACKED = "stacked AS (" + " UNION ALL ".join(
    f"SELECT entity, move_{i} AS move FROM teamlists WHERE move_{i} IS NOT NULL" for i in range(1, 5)) + ")"


def _sql_topk(source: str, value: str, k: int) -> str:
    return (f"SELECT entity, {value}, n, rank FROM (SELECT entity, {value}, count(*) AS n, "
            f"row_number() OVER (PARTITION BY entity ORDER BY count(*) DESC, {value}) AS rank "
            f"FROM {source} WHERE {value} IS NOT NULL GROUP BY 1, 2) WHERE rank <= {k}")


@query("usage_summary", f"""WITH {SQL_TEAMLISTS}, {SQL_STACKED},
m AS ({_sql_topk('stacked', 'move', K)}), i AS ({_sql_topk('teamlists', 'item', K)}),
ms AS (SELECT entity, string_agg(move || ':' || n, '|' ORDER BY rank) AS top_moves FROM m GROUP BY 1),
its AS (SELECT entity, string_agg(item || ':' || n, '|' ORDER BY rank) AS top_items FROM i GROUP BY 1),
t AS (SELECT entity, count(*) AS appearances, CAST(sum(wins) AS BIGINT) AS wins,
  CAST(sum(losses) AS BIGINT) AS losses FROM teamlists GROUP BY 1)
SELECT entity, appearances, wins, losses, wins + losses AS games,
  CASE WHEN wins + losses = 0 THEN 0 ELSE CAST(floor(wins * 1000000.0 / (wins + losses)) AS BIGINT) END AS win_rate_ppm,
  top_moves, top_items FROM t LEFT JOIN ms USING (entity) LEFT JOIN its USING (entity)""")
def usage_summary(spark, sf):
    s = ops.usage_summary(teamlists(spark, sf), K)
    ppm = F.coalesce(F.try_divide(F.col("wins") * 1000000.0, F.col("games")), F.lit(0.0))
    return s.select("entity", "appearances", "wins", "losses", "games",
                    F.floor(ppm).alias("win_rate_ppm"),
                    _joined("top_moves", "move", "count").alias("top_moves"),
                    _joined("top_items", "item", "count").alias("top_items"))


@query("top_items_per_entity", f"WITH {SQL_TEAMLISTS} {_sql_topk('teamlists', 'item', 4)}")
def top_items_per_entity(spark, sf):
    return ops.top_items_per_entity(teamlists(spark, sf), 4)


@query("top_moves_per_entity", f"WITH {SQL_TEAMLISTS}, {SQL_STACKED} {_sql_topk('stacked', 'move', 6)}")
def top_moves_per_entity(spark, sf):
    return ops.top_moves_per_entity(teamlists(spark, sf), 6)


@query("top_teams_per_entity", f"""WITH {SQL_SLOTTED},
best AS (SELECT * FROM (SELECT entity, tournament_id, player_id, min("placing") AS "placing",
    row_number() OVER (PARTITION BY entity ORDER BY min("placing"), tournament_id, player_id) AS rank
  FROM slotted GROUP BY 1, 2, 3) WHERE rank <= 3),
mem AS (SELECT tournament_id, player_id, string_agg(entity, ',' ORDER BY team_slot) AS members
  FROM slotted GROUP BY 1, 2)
SELECT entity, rank, tournament_id, player_id, "placing", members
FROM best JOIN mem USING (tournament_id, player_id)""")
def top_teams_per_entity(spark, sf):
    teams = ops.top_teams_per_entity(slotted_teamlists(spark, sf), 3)
    return teams.withColumn("members", F.array_join("members", ","))


@query("usage_lookup", f"""WITH {SQL_TEAMLISTS},
u AS (SELECT entity, count(*) AS appearances, CAST(sum(wins) AS BIGINT) AS wins,
  CAST(sum(losses) AS BIGINT) AS losses FROM teamlists GROUP BY 1),
names AS (SELECT p_partkey AS id, '  e' || (p_partkey * 2) || ' ' AS name FROM part)
SELECT id, coalesce(appearances, 0) AS appearances, coalesce(wins, 0) AS wins,
  coalesce(losses, 0) AS losses, entity IS NOT NULL AS found
FROM names LEFT JOIN u ON lower(trim(name)) = lower(trim(entity))""")
def usage_lookup(spark, sf):
    u = ops.usage_summary(teamlists(spark, sf)).select("entity", "appearances", "wins", "losses")
    names = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("  e"), (F.col("p_partkey") * 2).cast("string"), F.lit(" ")).alias("name"))
    return ops.usage_lookup(names, u).drop("name")


def _formats(spark, sf):
    p = table(spark, sf, "part")
    fmt = F.concat(F.lit("gen"), (F.col("p_size") % 9).cast("string"), F.lower("p_type"),
                   F.when(F.col("p_size") % 4 == 0, "ubers").otherwise(""))
    return p.select(fmt.alias("format"), F.col("p_brand").alias("entity"), "p_name", "p_size", "p_type")


SQL_FORMATS = """parts AS (SELECT 'gen' || (p_size % 9) || lower(p_type)
  || CASE WHEN p_size % 4 = 0 THEN 'ubers' ELSE '' END AS format, p_brand AS entity, p_name, p_size, p_type FROM part)"""


@query("usage_threshold_filter", f"""WITH {SQL_FORMATS},
f AS (SELECT format, count(*) AS n, count(*) * 5 AS battles FROM parts GROUP BY 1),
u AS (SELECT format, entity, count(*) AS c FROM parts GROUP BY 1, 2),
w AS (SELECT u.format, u.entity, c, n, battles, CAST(c AS DOUBLE) / n AS weighted FROM u JOIN f USING (format))
SELECT format, entity, c, battles FROM w
WHERE battles >= 100 AND weighted >= CASE WHEN battles < 400 THEN 0.05
   WHEN regexp_matches(format, 'uber|anythinggoes|doublesou|gen1nu|gen1pu') THEN 0.03 ELSE 0.01 END
 AND NOT EXISTS (SELECT 1 FROM parts p WHERE p.p_name = 'small ring' AND p.format = w.format AND p.entity = w.entity)""")
def usage_threshold_filter(spark, sf):
    parts = _formats(spark, sf)
    formats = parts.groupBy("format").agg(F.count("*").alias("n"), (F.count("*") * 5).alias("battles"))
    usage = parts.groupBy("format", "entity").agg(F.count("*").alias("c")).join(
        formats.select("format", "n"), "format")
    usage = usage.select("format", "entity", "c", (F.col("c").cast("double") / F.col("n")).alias("weighted"))
    curated = parts.where(F.col("p_name") == "small ring").select("format", "entity").distinct()
    kept = ops.usage_threshold_filter(usage, formats.drop("n"), curated)
    return kept.select("format", "entity", "c", "battles")


_SETS = {
    "spreads": ("CASE WHEN p_size % 2 = 0 THEN 'Adamant' ELSE 'Jolly' END || ':' || (p_size % 8) || '/252/0/4/0/' || (p_size % 5)"),
    "items": "CASE WHEN p_size % 3 = 0 THEN 'Nothing' ELSE p_type END",
    "abilities": "CASE WHEN p_size % 5 < 2 THEN 'No Ability' ELSE split_part(p_name, ' ', 1) END",
    "moves": "CASE WHEN p_size % 6 = 0 THEN 'Nothing' ELSE split_part(p_name, ' ', 2) || (p_size % 3) END",
}


@query("representative_set", "WITH " + ", ".join(
    f"{n} AS (SELECT p_brand AS entity, {e} AS k, count(*) AS c FROM part GROUP BY 1, 2), "
    f"{n}_r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY c DESC, k) AS r FROM {n})"
    for n, e in _SETS.items()) + """
SELECT s.entity, coalesce(nullif(i.k, 'Nothing'), '') AS item, coalesce(nullif(a.k, 'No Ability'), '') AS ability,
  coalesce(m.top_moves, '') AS top_moves, split_part(s.k, ':', 1) AS nature,
  CAST(split_part(split_part(s.k, ':', 2), '/', 1) AS INTEGER) AS hp,
  CAST(split_part(split_part(s.k, ':', 2), '/', 6) AS INTEGER) AS speed
FROM spreads_r s JOIN items_r i ON i.entity = s.entity AND i.r = 1 JOIN abilities_r a ON a.entity = s.entity AND a.r = 1
LEFT JOIN (SELECT entity, string_agg(k, ',' ORDER BY r) AS top_moves FROM moves_r WHERE r <= 4 AND k <> 'Nothing' GROUP BY 1) m
  ON m.entity = s.entity
WHERE s.r = 1""")
def representative_set(spark, sf):
    p = table(spark, sf, "part")
    facts = p.select(F.col("p_brand").alias("entity"), F.explode(F.array(*[
        F.struct(F.lit(n).alias("kind"), F.expr(e).alias("k")) for n, e in _SETS.items()])).alias("f"))
    counts = facts.select("entity", "f.*").groupBy("entity", "kind", "k").agg(F.count("*").alias("c"))

    def weighted(kind: str):
        pairs = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("k", "c"))))
        return F.map_from_entries(pairs).alias(kind)

    maps = counts.groupBy("entity").agg(*[weighted(n) for n in _SETS])
    sets = ops.representative_set(maps)
    return sets.select("entity", "item", "ability", F.array_join("top_moves", ",").alias("top_moves"),
                       "nature", "hp", "speed")


def _tiers():
    return F.expr("CASE p_size % 7 WHEN 0 THEN 'ou' WHEN 1 THEN 'vgc' || p_size WHEN 2 THEN 'battlespot' || p_size "
                  "WHEN 3 THEN 'zu' WHEN 4 THEN 'battlestadium' || p_size WHEN 5 THEN 'nationaldexuu' ELSE lower(p_type) END")


@query("tier_order", """WITH f AS (SELECT DISTINCT CASE p_size % 7 WHEN 0 THEN 'ou' WHEN 1 THEN 'vgc' || p_size
  WHEN 2 THEN 'battlespot' || p_size WHEN 3 THEN 'zu' WHEN 4 THEN 'battlestadium' || p_size
  WHEN 5 THEN 'nationaldexuu' ELSE lower(p_type) END AS format FROM part)
SELECT format, CASE WHEN starts_with(format, 'vgc') THEN 8 WHEN starts_with(format, 'battle') THEN 9
  WHEN format = 'ou' THEN 0 WHEN format = 'zu' THEN 21 WHEN format = 'nationaldexuu' THEN 13 ELSE 100 END AS tier_rank FROM f""")
def tier_order(spark, sf):
    return ops.tier_order(table(spark, sf, "part").select(_tiers().alias("format")).distinct())


@query("class_balance", f"""WITH {SQL_FILES}
SELECT label, count(*) FILTER (WHERE s AND NOT sh) AS normal, count(*) FILTER (WHERE s AND sh) AS shiny,
  count(*) FILTER (WHERE s AND NOT sh) = 20 AND count(*) FILTER (WHERE s AND sh) = 20 AS complete
FROM (SELECT label, contains(name, '_synthetic_') AND ends_with(name, '.jpg') AS s,
  contains(lower(name), '_shiny_') AS sh FROM files) GROUP BY 1""")
def class_balance(spark, sf):
    return ops.class_balance(files(spark, sf), 20)


@query("folder_inventory", f"""WITH {SQL_FILES},
img AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS folder FROM files
  WHERE ends_with(lower(name), '.jpg') AND NOT contains(lower(name), 'synthetic'))
SELECT folder, count(*) AS image_count, min(path) AS first_image,
  CASE WHEN contains(folder, 'real') THEN 'Real sorted classifier data'
    WHEN contains(folder, 'debug') OR contains(folder, 'crop') THEN 'Debug/crop images - may be useful after sorting'
    WHEN contains(folder, 'upload') THEN 'Raw uploaded/camera images - useful for full slot detector'
    WHEN contains(folder, 'type') THEN 'Type icon/type combo images'
    WHEN contains(folder, 'sprite_detector') OR contains(folder, 'yolo') THEN 'Object detection dataset'
    ELSE 'Unknown image folder' END AS purpose
FROM img GROUP BY folder""")
def folder_inventory(spark, sf):
    return ops.folder_inventory(files(spark, sf))


@query("folder_inventory_totals", f"""WITH {SQL_FILES}
SELECT count(*) FILTER (WHERE s) AS synthetic_ignored,
  count(DISTINCT CASE WHEN NOT s THEN regexp_replace(path, '/[^/]*$', '') END) AS folders
FROM (SELECT path, contains(lower(name), 'synthetic') AS s FROM files WHERE ends_with(lower(name), '.jpg'))""")
def folder_inventory_totals(spark, sf):
    return ops.folder_inventory_totals(files(spark, sf))
