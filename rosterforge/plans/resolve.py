"""Entity resolution over the part table seen as entity records."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterforge.functions.strings import normalize_key as norm, slug_label as slug
from rosterforge.operators import resolve as ops
from rosterforge.plans.registry import query
from rosterforge.plans.standins import (
    SQL_ENTITIES, SQL_TAGS, SQL_TEAMLISTS, STATS, TAGS, entities, table, tag_at, teamlists,
)


def _n(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]', '', 'g')"


def _api(x: str) -> str:
    return f"replace(lower(trim(coalesce({x}, ''))), '_', '-')"


@query("normalize_key", r"""SELECT doc_id, md5(regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g')) AS k_unicode,
  md5(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS k_ascii FROM documents""")
def normalize_key(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(norm("text")).alias("k_unicode"), F.md5(norm("text", ascii=True)).alias("k_ascii"))


@query("slug_label", r"""SELECT page_id,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(url), '[''.:()\[\]]', '', 'g'),
    '[/\\ -]', '_', 'g'), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '_') AS label,
  coalesce(nullif(trim(regexp_replace(regexp_replace(lower(split_part(url, '#', 2)), '[^a-z0-9]+', '_', 'g'), '_+', '_', 'g'), '_'), ''),
    'unknown') AS slug FROM pages""")
def slug_label(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", slug("url").alias("label"),
        slug(F.split_part("url", F.lit("#"), F.lit(2)), empty="unknown", drop_only_quote=True).alias("slug"))


@query("alias_expand", """WITH n AS (SELECT c_custkey AS id, CASE c_nationkey % 6 WHEN 0 THEN 'Alolan ' || c_name
  WHEN 1 THEN ' Wash Rotom ' WHEN 2 THEN 'Meowstic-F' WHEN 3 THEN 'Hisuian ' || c_mktsegment WHEN 4 THEN 'Paldean Tauros (Aqua)'
  ELSE c_name END AS name, c_nationkey % 6 AS k, c_name, c_mktsegment FROM customer)
SELECT id, 0 AS prio, trim(name) AS cand FROM n UNION ALL
SELECT id, 1, CASE k WHEN 0 THEN c_name || ' Alola' WHEN 1 THEN 'Rotom Wash' WHEN 2 THEN 'Meowstic Female'
  WHEN 3 THEN c_mktsegment || ' Hisui' ELSE 'Tauros Paldea Aqua Breed' END FROM n WHERE k < 5""")
def alias_expand(spark, sf):
    k = F.col("c_nationkey") % 6
    name = (F.when(k == 0, F.concat(F.lit("Alolan "), "c_name")).when(k == 1, " Wash Rotom ")
            .when(k == 2, "Meowstic-F").when(k == 3, F.concat(F.lit("Hisuian "), "c_mktsegment"))
            .when(k == 4, "Paldean Tauros (Aqua)").otherwise(F.col("c_name")))
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), name.alias("name"))
    return ops.alias_expand(rows, "name").drop("name")


SQL_LOOKUP = SQL_ENTITIES + f""",
names AS (
  SELECT 0 AS pass, 0 AS nth, pos, {_n('form_display_name')} AS key FROM entities UNION ALL
  SELECT 0, 1, pos, {_n('form_api_name')} FROM entities UNION ALL
  SELECT 1, 0, pos, {_n('species_display_name')} FROM entities UNION ALL
  SELECT 1, 2, pos, {_n('species_api_name')} FROM entities),
lookup AS (SELECT key, pos FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pass, pos, nth) AS r
  FROM names WHERE key <> '') WHERE r = 1)"""


@query("build_lookup", f"WITH {SQL_LOOKUP} SELECT key, pos FROM lookup")
def build_lookup(spark, sf):
    return ops.build_lookup(entities(spark, sf)).select("key", "rec.pos")


def _detections(spark, sf):
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    name = (F.when(F.col("l_linenumber") == 1, F.col("p_brand"))
            .when(F.col("l_linenumber") == 2, F.upper("p_name"))
            .when(F.col("l_linenumber") == 3, F.lit(""))
            .otherwise(F.upper(F.concat_ws("_", "p_name", "p_type"))))
    return li.join(p, li.l_partkey == p.p_partkey).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", name.alias("name"),
        F.lit(None).cast("string").alias("entity_name"),
        F.array(tag_at(F.col("l_suppkey") % 18)).alias("detected_types"),
        F.when(F.col("l_linenumber") == 2, F.array(tag_at(F.col("l_partkey") % 18))).alias("types"))


SQL_DET = """det AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice,
  CASE l_linenumber WHEN 1 THEN p_brand WHEN 2 THEN upper(p_name) WHEN 3 THEN '' ELSE upper(p_name || '_' || p_type) END AS name
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""
_DET_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]


@query("resolve_names", f"""WITH {SQL_LOOKUP}, {SQL_DET}
SELECT {', '.join(_DET_COLS)}, name, lookup.pos AS pos FROM det LEFT JOIN lookup ON key = {_n('name')}""")
def resolve_names(spark, sf):
    lookup = ops.build_lookup(entities(spark, sf))
    return ops.resolve_names(_detections(spark, sf), lookup, "name").select(*_DET_COLS, "name", "rec.pos")


@query("sibling_forms", f"""WITH {SQL_ENTITIES}, f AS (SELECT {_n('species_api_name')} AS species_key,
  coalesce(form_display_name, species_display_name) AS name, is_default, pos FROM entities)
SELECT species_key, name, is_default, pos AS first_pos FROM
  (SELECT *, row_number() OVER (PARTITION BY species_key, name ORDER BY pos) AS r FROM f) WHERE r = 1""")
def sibling_forms(spark, sf):
    return ops.sibling_forms(entities(spark, sf))


@query("search_contains", f"""WITH {SQL_ENTITIES}, h AS (SELECT coalesce(form_display_name, species_display_name) AS display_name, pos
  FROM entities WHERE contains({_n('form_display_name')}, 'ing') OR contains({_n('species_display_name')}, 'ing')
    OR contains({_n('form_api_name')}, 'ing'))
SELECT display_name, min(pos) AS pos FROM h GROUP BY 1 ORDER BY pos LIMIT 12""")
def search_contains(spark, sf):
    return ops.search_contains(entities(spark, sf), "-iN g!", 12).select("display_name", "pos")


@query("fallback_abilities", f"""WITH {SQL_ENTITIES},
roster AS (SELECT c_custkey AS pos, CASE WHEN c_nationkey = 3 THEN 'elsewhere ' || c_custkey ELSE 'brand ' || (c_custkey % 40) END AS roster_name, c_mktsegment AS ab FROM customer
  UNION ALL SELECT p_partkey, CASE WHEN p_size % 7 = 1 THEN '' ELSE 'gone ' END || p_name || '-' || p_type, p_brand FROM part),
r AS (SELECT {_n('roster_name')} AS key, max_by(ab, pos) AS ab FROM roster GROUP BY 1)
SELECT e.pos, coalesce(n.ab, CASE WHEN e.is_default THEN s.ab END, e.form_api_name) AS abilities
FROM entities e LEFT JOIN r n ON n.key = {_n('e.form_display_name')} AND n.key <> ''
LEFT JOIN r s ON s.key = {_n('e.species_display_name')}""")
def fallback_abilities(spark, sf):
    c, p = table(spark, sf, "customer"), table(spark, sf, "part")
    # Customers of one nation and six of seven parts stand under names that no entity has.
    brand = F.concat(F.lit("brand "), (F.col("c_custkey") % 40).cast("string"))
    roster = c.select(
        F.col("c_custkey").alias("roster_pos"),
        F.when(F.col("c_nationkey") == 3, F.concat(F.lit("elsewhere "), "c_custkey")).otherwise(brand).alias("roster_name"),
        F.array("c_mktsegment").alias("abilities"),
    ).unionByName(p.select(
        F.col("p_partkey").alias("roster_pos"),
        F.concat(F.when(F.col("p_size") % 7 == 1, "").otherwise("gone "), F.concat_ws("-", "p_name", "p_type")).alias("roster_name"),
        F.array("p_brand").alias("abilities")))
    rows = entities(spark, sf).withColumn("name", F.coalesce("form_display_name", F.lit("")))
    rows = rows.withColumn("abilities", F.array("form_api_name"))
    found = ops.fallback_abilities(rows, roster)
    return found.select("pos", F.array_join("resolved_abilities", ",").alias("abilities"))


SQL_ENRICH = f"""WITH {SQL_LOOKUP}, {SQL_DET}
SELECT {', '.join(_DET_COLS)}, name, e.pos IS NOT NULL AS resolved,
  array_to_string(CASE WHEN e.pos IS NOT NULL THEN e.types WHEN l_linenumber = 2 THEN [{SQL_TAGS}[l_partkey % 18 + 1]]
    ELSE [{SQL_TAGS}[l_suppkey % 18 + 1]] END, ',') AS types, e.hp, e.speed
FROM (SELECT * REPLACE (nullif(name, '') AS name) FROM det) LEFT JOIN lookup l ON l.key = {_n('name')} AND name IS NOT NULL
LEFT JOIN entities e ON e.pos = l.pos"""


def _enriched(spark, sf, team_only):
    lookup = ops.build_lookup(entities(spark, sf))
    rows = ops.enrich_detected(_detections(spark, sf), lookup, ["hp", "speed"], team_only)
    return rows.select(*_DET_COLS, "name", "resolved", F.array_join("types", ",").alias("types"), "hp", "speed")


@query("enrich_detected", SQL_ENRICH)
def enrich_detected(spark, sf):
    return _enriched(spark, sf, False)


@query("build_team", SQL_ENRICH + " WHERE name IS NOT NULL")
def build_team(spark, sf):
    return _enriched(spark, sf, True)


@query("merge_details", f"""WITH {SQL_ENTITIES}, {SQL_TEAMLISTS},
st AS (SELECT moves.entity, list(moves.move ORDER BY moves.n DESC, moves.move)[1:4] AS top_moves FROM (
  SELECT entity, move, count(*) AS n FROM (
    SELECT CASE WHEN item = 'RF' THEN 'E-9' || substr(entity, 2) ELSE entity END AS entity, unnest([move_1, move_3]) AS move FROM teamlists) GROUP BY 1, 2) moves GROUP BY 1)
SELECT p.p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'S' || p_name WHEN p_size % 2 = 0 THEN 'D' || p_name ELSE p_name END AS name,
  CASE WHEN p_size % 2 = 0 THEN p_type WHEN p_size % 3 = 0 THEN 'sf' ELSE '' END AS form,
  CASE WHEN p_size % 4 = 0 THEN 'd.png' WHEN p_size % 5 = 0 THEN 'm.png' WHEN p_size % 3 = 0 THEN 's.png' ELSE '' END AS image,
  CASE WHEN p_size % 2 = 0 THEN 'A' || p_size ELSE 'old' END AS ability,
  CASE WHEN p_size % 3 = 0 THEN 'bold' ELSE 'hardy' END AS nature,
  array_to_string(CASE WHEN p_size % 7 = 0 THEN ['k', ''] WHEN top_moves IS NOT NULL THEN top_moves
    WHEN p_size % 2 = 0 THEN ['x', 'y', 'z', 'w'] ELSE ['o1', 'o2'] END, ',') AS moves,
  array_to_string(CASE WHEN p_size % 2 = 0 THEN ['x', 'y', 'z', 'w', 'v'] ELSE ['o1', 'o2'] END, ',') AS move_options,
  array_to_string(CASE WHEN p_size % 2 = 0 THEN ['x', 'y', 'z', 'w', 'v', 'o1', 'o2'] ELSE ['o1', 'o2'] END, ',') AS options
FROM part p LEFT JOIN st ON st.entity = 'E' || p_partkey""")
def merge_details(spark, sf):
    p = table(spark, sf, "part").withColumnRenamed("p_partkey", "id")
    size = F.col("p_size")
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    saved = p.select(
        "id", F.col("p_name").alias("name"), F.lit(None).cast("string").alias("form"),
        F.when(size % 5 == 0, "m.png").otherwise("").alias("image"), words("t").alias("types"),
        F.lit("old").alias("ability"), F.lit(None).cast("string").alias("nature"),
        F.when(size % 7 == 0, words("k", "")).otherwise(words("", "")).alias("moves"),
        words("o1", "o2").alias("move_options"))
    # Details, stats and usage of the other parts stand under a negated id, which nothing saved has.
    only = lambda part: F.when(part, F.col("id")).otherwise(-F.col("id") - 1).alias("id")
    details = p.select(
        only(size % 2 == 0), F.concat(F.lit("D"), "p_name").alias("name"), F.col("p_type").alias("form"),
        F.when(size % 4 == 0, "d.png").otherwise("").alias("image"), words("u").alias("types"),
        F.array(F.concat(F.lit("A"), size.cast("string"))).alias("abilities"),
        words("x", "y", "z", "w", "v").alias("moves"))
    stats = p.select(
        only(size % 3 == 0), F.concat(F.lit("S"), "p_name").alias("name"), F.lit("sf").alias("form"),
        F.lit("bold").alias("nature"), F.lit("s.png").alias("image"))
    from rosterforge.functions.ranking import top_k_per_key
    of = F.when(F.col("item") == "RF", F.concat(F.lit("E-9"), F.substring("entity", 2, 20))).otherwise(F.col("entity"))
    used = teamlists(spark, sf).select(of.alias("entity"), F.explode(F.array("move_1", "move_3")).alias("move"))
    counts = used.groupBy("entity", "move").agg(F.count("*").alias("n"))
    best = top_k_per_key(counts, ["entity"], [F.desc("n"), F.asc("move")], 4)
    usage = best.groupBy(F.substring("entity", 2, 20).cast("long").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "move"))), lambda s: s["move"]).alias("top_moves"))
    merged = ops.merge_details(saved, details, stats, usage, preserve_moves=True)
    options = ops.unique_options(F.col("move_options"), words("o1", "o2"))
    return merged.select("id", "name", "form", "image", "ability", "nature", F.array_join("moves", ",").alias("moves"),
                         F.array_join("move_options", ",").alias("move_options"),
                         F.array_join(options, ",").alias("options"))


# --- files against forms ---------------------------------------------------------------------

def _numbered_files(spark, sf):
    p = table(spark, sf, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    tail = (F.when(size % 4 == 0, "").when(size % 4 == 1, F.concat(F.lit("-"), F.initcap(F.split_part("p_name", F.lit(" "), F.lit(1)))))
            .when(size % 4 == 2, F.concat(F.lit("-Mega_"), F.initcap("p_type"))).otherwise("-Zzz"))
    name = F.when(size % 11 == 0, F.concat(F.lit("other_"), key.cast("string"))).otherwise(
        F.concat(F.lit("Menu_CP_"), F.lpad((key + key % 3 * 1000).cast("string"), 6, "0"), tail))
    return p.select(key.alias("file_id"), F.concat(name, F.lit(".png")).alias("filename"))


SQL_NFILES = """nfiles AS (SELECT p_partkey AS file_id, CASE WHEN p_size % 11 = 0 THEN 'other_' || p_partkey ELSE
  'Menu_CP_' || lpad(CAST(p_partkey + p_partkey % 3 * 1000 AS VARCHAR), 6, '0') || CASE p_size % 4 WHEN 0 THEN ''
    WHEN 1 THEN '-' || upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2)
    WHEN 2 THEN '-Mega_' || upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) ELSE '-Zzz' END END || '.png' AS filename FROM part),
parsed AS (SELECT file_id, filename, coalesce(try_cast(regexp_extract(filename, 'Menu_CP_(\\d+)', 1) AS INTEGER), 0) AS number,
  lower(trim(replace(replace(regexp_extract(filename, '^Menu_CP_\\d+-(.+)\\.png$', 1), '_', ' '), '-', ' '))) AS suffix FROM nfiles),
cands AS (SELECT file_id, e.*, row_number() OVER (PARTITION BY file_id ORDER BY CASE WHEN suffix = '' THEN
    CASE WHEN is_default THEN 0 ELSE 1 END
  WHEN contains(lower(coalesce(form_display_name, '')), suffix) OR contains(replace(form_api_name, '-', ' '), suffix) THEN 0 ELSE 1 END, pos) AS r
  FROM parsed p JOIN entities e ON e.number = p.number),
chosen AS (SELECT * FROM cands WHERE r = 1)"""


@query("match_form_by_suffix", f"""WITH {SQL_ENTITIES}, {SQL_NFILES}
SELECT p.file_id, p.number, p.suffix, c.pos FROM parsed p LEFT JOIN chosen c USING (file_id)""")
def match_form_by_suffix(spark, sf):
    rows = ops.match_form_by_suffix(_numbered_files(spark, sf), entities(spark, sf))
    return rows.select("file_id", "number", "suffix", F.col("form.pos").alias("pos"))


@query("catalog_entries", f"""WITH {SQL_ENTITIES}, {SQL_NFILES},
c AS (SELECT p.filename, p.number, coalesce(form_display_name, species_display_name, 'Entity #' || p.number) AS name,
  species_display_name, form_api_name, types, hp, attack, defense, special_attack, special_defense, speed
  FROM parsed p LEFT JOIN chosen USING (file_id) WHERE p.number > 0)
SELECT number AS id, name, coalesce(species_display_name, name) AS species_name, coalesce(form_api_name, '') AS form_api_name,
  coalesce(array_to_string(types, ','), '') AS types, {', '.join(f'coalesce({s}, 0) AS {s}' for s in STATS)},
  filename AS sprite_filename, contains(lower(name), 'mega') OR contains(lower(filename), 'mega') AS is_mega FROM c""")
def catalog_entries(spark, sf):
    rows = ops.catalog_entries(_numbered_files(spark, sf), entities(spark, sf), STATS)
    return rows.withColumn("types", F.array_join("types", ","))


SQL_LEARN = f"""learn AS (SELECT CASE p_size % 4 WHEN 0 THEN {_api("p_name || '-' || p_type || '-' || p_size")}
    WHEN 1 THEN lower(p_brand) ELSE replace(lower(replace(p_name, ' ', '-')) || '-' || lower(p_type) || '-' || p_size, '-', '') END AS learn_key,
  'mv-' || (p_partkey % 97) AS move FROM part),
learn0 AS (SELECT replace(learn_key, ' ', '-') AS learn_key, move FROM learn),
keys AS (SELECT pos, 0 AS prio, form_api_name AS learn_key FROM entities UNION ALL
  SELECT pos, 1, {_api('species_display_name')} FROM entities UNION ALL SELECT pos, 2, replace(form_api_name, '-', '') FROM entities),
hit AS (SELECT pos, min_by(learn_key, prio) AS learn_key FROM keys WHERE learn_key IN (SELECT learn_key FROM learn0) GROUP BY 1),
moves AS (SELECT DISTINCT pos, move FROM hit JOIN learn0 USING (learn_key))"""


def _learnset(spark, sf):
    p = table(spark, sf, "part")
    api = F.lower(F.concat_ws("-", F.translate("p_name", " ", "-"), "p_type", F.col("p_size").cast("string")))
    key = (F.when(F.col("p_size") % 4 == 0, api).when(F.col("p_size") % 4 == 1, F.lower("p_brand"))
           .otherwise(F.translate(api, "-", "")))
    rows = p.select(key.alias("learn_key"), F.concat(F.lit("mv-"), (F.col("p_partkey") % 97).cast("string")).alias("move"))
    return rows.distinct().groupBy("learn_key").agg(
        F.map_from_entries(F.collect_list(F.struct("move", F.lit("L").alias("how")))).alias("moves"))


@query("learnset_moves", f"WITH {SQL_ENTITIES}, {SQL_LEARN} SELECT pos, move FROM moves")
def learnset_moves(spark, sf):
    return ops.learnset_moves(entities(spark, sf), _learnset(spark, sf))


def _dictionary(spark, sf):
    p = table(spark, sf, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    return p.select(
        key.alias("dict_pos"), F.concat(F.when(size % 2 == 0, "mv-").otherwise("m-v"), (key + size * 0).cast("string")).alias("move_key"),
        F.when(size % 3 == 0, F.initcap("p_name")).alias("display_name"), F.lower("p_type").alias("type"),
        F.when(size % 2 == 0, "physical").otherwise("status").alias("category"),
        F.when(size % 4 != 0, size).alias("power"), F.when(size % 5 != 0, size + 50).alias("accuracy"),
        F.when(size % 6 != 0, size % 20 + 1).alias("pp"), (size % 5 - 2).alias("priority"),
        F.when(size % 9 == 0, F.concat(F.lit("Effect of "), "p_name")).alias("effect"),
        F.when(size % 9 == 1, "short").alias("short_effect"))


SQL_DETAIL = """dict AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'mv-' ELSE 'm-v' END || p_partkey AS move_key,
  CASE WHEN p_size % 3 = 0 THEN p_name END AS shown, lower(p_type) AS type, p_size AS z, p_name FROM part),
asked AS (SELECT DISTINCT 'mv-' || (l_partkey + l_linenumber) AS move FROM lineitem),
found AS (SELECT move, coalesce(x.move_key, c.move_key) AS k, coalesce(x.shown, c.shown) AS shown, coalesce(x.type, c.type) AS type,
  coalesce(x.z, c.z) AS z, coalesce(x.p_name, c.p_name) AS p_name FROM asked LEFT JOIN dict x ON x.move_key = move
  LEFT JOIN dict c ON x.move_key IS NULL AND replace(c.move_key, '-', '') = replace(move, '-', '')),
detail AS (SELECT move, coalesce(k, move) AS name,
  CASE WHEN shown IS NULL THEN 'Mv ' || substr(move, 4) ELSE array_to_string(list_transform(string_split(shown, ' '),
    lambda w: upper(w[1]) || w[2:]), ' ') END AS display_name,
  coalesce(type, '') AS type, CASE WHEN z IS NULL THEN '' WHEN z % 2 = 0 THEN 'physical' ELSE 'status' END AS category,
  CASE WHEN z % 4 <> 0 THEN z END AS power, CASE WHEN z % 5 <> 0 THEN z + 50 END AS accuracy,
  CASE WHEN z % 6 <> 0 THEN z % 20 + 1 END AS pp, coalesce(z % 5 - 2, 0) AS priority,
  CASE WHEN z IS NULL THEN 'Move details unavailable.' WHEN z % 9 = 0 THEN 'Effect of ' || p_name WHEN z % 9 = 1 THEN 'short'
   ELSE CASE WHEN z % 4 <> 0 THEN z || ' power' ELSE 'No direct damage' END || ', ' ||
     CASE WHEN z % 5 <> 0 THEN (z + 50) || '% accuracy' ELSE 'Bypasses accuracy' END ||
     CASE WHEN z % 6 <> 0 THEN ', ' || (z % 20 + 1) || ' PP' ELSE '' END ||
     CASE WHEN z % 5 - 2 > 0 THEN ', +' || (z % 5 - 2) || ' priority' WHEN z % 5 - 2 < 0 THEN ', ' || (z % 5 - 2) || ' priority' ELSE '' END
  END AS effect FROM found)"""


def _details(spark, sf):
    moves = table(spark, sf, "lineitem").select(
        F.concat(F.lit("mv-"), (F.col("l_partkey") + F.col("l_linenumber")).cast("string")).alias("move")).distinct()
    return ops.move_detail(moves, _dictionary(spark, sf))


@query("move_detail", f"WITH {SQL_DETAIL} SELECT * FROM detail")
def move_detail(spark, sf):
    return _details(spark, sf)


@query("move_text_search", f"""WITH {SQL_DETAIL} SELECT move, name FROM detail WHERE contains(lower(display_name || ' ' || name || ' '
  || type || ' ' || CASE category WHEN 'physical' THEN 'Attack' WHEN 'status' THEN 'Status' ELSE 'Unknown' END || ' ' || effect), 'attack no')""")
def move_text_search(spark, sf):
    return ops.move_text_search(_details(spark, sf), " Attack NO").select("move", "name")


def _entries(spark, sf):
    e = entities(spark, sf)
    name = F.when(F.col("attack") % 4 == 0, F.col("species_display_name")).otherwise(F.col("form_api_name"))
    return e.select("pos", "number", name.alias("name"), F.col("species_display_name").alias("species_name"), "form_api_name",
                    "types", ((F.col("speed") % 3 == 0) & ((F.col("hp") % 5 != 0) | (F.col("attack") % 4 != 0))).alias("is_mega"))


SQL_ENTRIES = SQL_ENTITIES + """,
entries AS (SELECT pos, CASE WHEN attack % 4 = 0 THEN species_display_name ELSE form_api_name END AS name,
  species_display_name AS species_name, form_api_name, types, speed % 3 = 0 AND (hp % 5 <> 0 OR attack % 4 <> 0) AS is_mega FROM entities),
walk AS (SELECT lower(species_name) AS species, list_reduce(list({'pos': pos, 'b': lower(name) = lower(species_name), 'm': is_mega} ORDER BY pos),
  lambda a, x: CASE WHEN x.b AND NOT a.b THEN x WHEN NOT x.m AND a.m THEN x ELSE a END).pos AS pos FROM entries GROUP BY 1)"""


@query("species_representative", f"""WITH {SQL_ENTRIES} SELECT pos, name, species_name, is_mega FROM entries WHERE pos IN (SELECT pos FROM walk)""")
def species_representative(spark, sf):
    return ops.species_representative(_entries(spark, sf)).select("pos", "name", "species_name", "is_mega")


@query("facet_filter", f"""WITH {SQL_ENTRIES} SELECT pos, name FROM entries WHERE pos IN (SELECT pos FROM walk)
  AND species_name IN (SELECT species_name FROM entries WHERE contains(lower(name), 'ring') OR contains(lower(species_name), 'ring') OR contains(form_api_name, 'ring'))
  AND species_name IN (SELECT species_name FROM entries WHERE list_contains(types, 'ghost'))""")
def facet_filter(spark, sf):
    return ops.facet_filter(_entries(spark, sf), " Ring", "ghost").select("pos", "name")


@query("facets", f"WITH {SQL_ENTITIES} SELECT DISTINCT unnest(types) AS facet FROM entities")
def facets(spark, sf):
    return ops.facets(entities(spark, sf))


@query("infer_by_containment", f"""WITH {SQL_ENTITIES}, stems AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
    'x' || CASE WHEN l_linenumber < 3 THEN p_name || '_' || p_type ELSE p_brand || p_size END || '-cam' || l_suppkey AS stem
    FROM lineitem JOIN part ON p_partkey = l_partkey),
d AS (SELECT DISTINCT stem, regexp_replace(lower(stem), '[^a-z0-9]', '', 'g') AS s FROM stems),
n AS (SELECT 0 AS kind, {_n('form_display_name')} AS key, min(pos) AS pos FROM entities WHERE form_display_name IS NOT NULL GROUP BY 2
  UNION ALL SELECT 1, {_n('species_display_name')}, min(pos) FROM entities GROUP BY 2),
m AS (SELECT stem, pos, row_number() OVER (PARTITION BY stem ORDER BY kind, CASE WHEN kind = 0 THEN -length(key) ELSE length(key) END, pos) AS r
  FROM d JOIN n ON contains(s, key))
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, stem, pos FROM stems LEFT JOIN (SELECT * FROM m WHERE r = 1) USING (stem)""")
def infer_by_containment(spark, sf):
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    body = F.when(F.col("l_linenumber") < 3, F.concat_ws("_", "p_name", "p_type")).otherwise(
        F.concat("p_brand", F.col("p_size").cast("string")))
    stems = li.join(p, li.l_partkey == p.p_partkey).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        F.concat(F.lit("x"), body, F.lit("-cam"), F.col("l_suppkey").cast("string")).alias("stem"))
    records = entities(spark, sf).withColumn("display_name", F.col("form_display_name"))
    return ops.infer_by_containment(stems, records).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "stem", "rec.pos")


def _repair_files(spark, sf):
    p = table(spark, sf, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    tail = (F.when(size % 4 == 0, "").when(size % 4 == 1, F.concat(F.lit("-"), F.lower("p_type"), F.lit("-"), size.cast("string")))
            .when(size % 4 == 2, F.concat(F.lit("-"), size.cast("string"))).otherwise("-zzz"))
    name = F.when(size % 11 == 0, F.concat(F.lit("img_"), key.cast("string"))).otherwise(
        F.concat(F.lit("Menu_CP_"), (key - key % 4 + key % 3 * 4000).cast("string"), tail,
                 F.when(size % 5 == 0, "_shiny").otherwise(""), F.when(size % 7 == 0, "_synthetic_12").otherwise("")))
    folder = F.when(size % 2 == 0, F.lower(F.concat_ws("_", F.translate("p_name", " ", "_"), "p_type", size.cast("string")))).otherwise("misc")
    return p.select(key.alias("file_id"), F.concat(name, F.lit(".jpg")).alias("name"), folder.alias("folder"))


@query("repair_labels", f"""WITH {SQL_ENTITIES},
f AS (SELECT p_partkey AS file_id, p_size AS z, p_partkey - p_partkey % 4 + p_partkey % 3 * 4000 AS number,
  CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN lower(p_type) || '_' || p_size WHEN 2 THEN '' || p_size ELSE 'zzz' END AS suffix,
  CASE WHEN p_size % 2 = 0 THEN lower(replace(p_name, ' ', '_')) || '_' || lower(p_type) || '_' || p_size ELSE 'misc' END AS folder FROM part),
forms AS (SELECT number, pos, is_default, replace(form_api_name, '-', '_') AS api, lower(replace(coalesce(form_display_name, ''), ' ', '_')) AS shown FROM entities),
sfx AS (SELECT number, pos, api, api AS s FROM forms UNION ALL SELECT number, pos, api, shown FROM forms WHERE shown <> ''
  UNION ALL SELECT number, pos, api, string_split(api, '_')[-1] FROM forms
  UNION ALL SELECT number, pos, api, string_split(shown, '_')[-1] FROM forms WHERE shown <> ''
  UNION ALL SELECT number, pos, api, '' FROM forms WHERE is_default),
mp AS (SELECT number, s, max_by(api, pos) AS label FROM sfx GROUP BY 1, 2),
t AS (SELECT f.*, coalesce(e.label, CASE WHEN suffix <> '' THEN b.label || '_' || suffix END, b.label) AS target FROM f
  LEFT JOIN mp e ON e.number = f.number AND e.s = f.suffix AND z % 11 <> 0
  LEFT JOIN mp b ON b.number = f.number AND b.s = '' AND z % 11 <> 0)
SELECT file_id, target, CASE WHEN target IS NULL THEN 'skipped' WHEN folder = target THEN 'already_correct' ELSE 'moved' END AS status,
  CASE WHEN z % 11 = 0 THEN 'no number in filename' WHEN target IS NULL THEN 'no mapping' ELSE '' END AS reason FROM t""")
def repair_labels(spark, sf):
    forms = entities(spark, sf)
    return ops.repair_labels(_repair_files(spark, sf), forms).select("file_id", "target", "status", "reason")


@query("fixed_tag_folder", f"""WITH w AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'dargon' ELSE {SQL_TAGS}[p_size % 18 + 1] END AS a,
  CASE WHEN p_size % 7 = 0 THEN lower(p_type) ELSE {SQL_TAGS}[p_partkey % 18 + 1] END AS b FROM part),
x AS (SELECT p_partkey, replace(a, 'dargon', 'dragon') AS a, b, list_contains({SQL_TAGS}, b) AS ok FROM w)
SELECT p_partkey, CASE WHEN ok THEN a || '_' || b END AS label, CASE WHEN ok THEN '' ELSE b END AS invalid FROM x""")
def fixed_tag_folder(spark, sf):
    key, size = F.col("p_partkey"), F.col("p_size")
    a = F.when(size % 5 == 0, "Dargon").otherwise(tag_at(size % 18))
    b = F.when(size % 7 == 0, F.col("p_type")).otherwise(tag_at(key % 18))
    fixed = ops.fixed_tag_folder(F.concat_ws("-", a, b), TAGS)
    return table(spark, sf, "part").select("p_partkey", fixed.alias("x")).select(
        "p_partkey", "x.label", F.array_join("x.invalid", ",").alias("invalid"))


@query("type_combos", f"""WITH {SQL_ENTITIES}, k AS (SELECT *, array_to_string(list_sort(types), '_') AS unordered_key FROM entities),
g AS (SELECT unordered_key, count(*) AS n, min_by(types, pos) AS types,
  array_to_string((list(form_api_name ORDER BY pos))[1:12], ',') AS examples FROM k GROUP BY 1)
SELECT array_to_string(types, '_') AS type_key, unordered_key, n, examples FROM g""")
def type_combos(spark, sf):
    rows = entities(spark, sf).select("pos", "form_api_name", F.array_join("types", "|").alias("types"))
    combos = ops.type_combos(rows, shown="form_api_name")
    return combos.select("type_key", "unordered_key", "n", F.array_join("examples", ",").alias("examples"))


@query("pair_combinations", f"""WITH {SQL_ENTITIES}, d AS (SELECT DISTINCT t, list_position({SQL_TAGS}, t) AS pos FROM (SELECT unnest(types) AS t FROM entities))
SELECT t AS label FROM d UNION ALL SELECT a.t || '_' || b.t FROM d a JOIN d b ON a.pos < b.pos""")
def pair_combinations(spark, sf):
    tags = entities(spark, sf).select(F.explode("types").alias("tag")).distinct()
    order = F.array_position(F.array(*[F.lit(t) for t in TAGS]), F.col("tag"))
    return ops.pair_combinations(tags.withColumn("pos", order), "tag")
