"""Stats and matchups over parts (entities) and line items (battle pairs)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterforge.functions import battle as B
from rosterforge.operators import matchup as ops
from rosterforge.plans.registry import query
from rosterforge.plans.standins import (
    SQL_ENTITIES, SQL_TAGS, STATS, entities, table, tag_at,
)

_NATURE_NAMES = ["hardy", *B.NATURES]
SQL_NATURES = "(VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(_NATURE_NAMES)) + ") nat(i, nature)"
SQL_EFFECTS = "(VALUES " + ", ".join(f"('{n}', '{u}', '{d}')" for n, (u, d) in B.NATURES.items()) + ") eff(nature, up, down)"
SQL_CHART = "chart(a, d, f) AS (VALUES " + ", ".join(f"('{a}', '{d}', {f})" for a, d, f in B.CHART) + ")"


def _natured(spark, sf):
    names = F.array(*[F.lit(n) for n in _NATURE_NAMES])
    return entities(spark, sf).withColumn("nature", F.get(names, (F.col("pos") % len(_NATURE_NAMES)).cast("int")))


def _sql_mult(stat: str) -> str:
    return f"CASE WHEN up = '{stat}' THEN 11 WHEN down = '{stat}' THEN 9 ELSE 10 END"


SQL_NATURED = SQL_ENTITIES + f""",
natured AS (SELECT e.*, n.nature, up, down FROM entities e JOIN {SQL_NATURES} ON n_i(e.pos) = i)"""
SQL_NATURED = SQL_NATURED.replace("n_i(e.pos)", f"(e.pos % {len(_NATURE_NAMES)})").replace(
    "n.nature", "nat.nature").replace(" = i)", " = i LEFT JOIN " + SQL_EFFECTS + " ON eff.nature = nat.nature)")


@query("coalesce_fields", f"""WITH {SQL_ENTITIES} SELECT pos, CASE WHEN pos % 2 = 0 THEN hp ELSE hp + 1 END AS hp,
  CASE WHEN pos % 3 = 0 THEN NULL ELSE attack END AS attack, speed, CASE WHEN pos % 3 = 0 THEN 'attack' ELSE '' END AS missing FROM entities""")
def coalesce_fields(spark, sf):
    e = entities(spark, sf)
    raw = e.select(
        "pos", F.when(F.col("pos") % 2 == 0, F.col("hp").cast("string")).alias("base_hp"),
        F.col("special_attack").alias("Sp. Atk"), F.col("special_defense").alias("spDef"), F.col("speed").alias("Speed"),
        F.struct((F.col("hp") + 1).alias("hp"), F.when(F.col("pos") % 3 != 0, F.col("attack")).alias("Attack"),
                 F.col("defense")).alias("base_stats"))
    return ops.coalesce_fields(raw).select(
        "pos", "hp", "attack", "speed", F.array_join("missing", ",").alias("missing"))


@query("level_stats", f"""WITH {SQL_NATURED} SELECT pos, nature,
  ((2 * hp + 31 + (pos % 253) // 4) * 50) // 100 + 60 AS final_hp,
  {', '.join(f"greatest(1, ((((2 * {s} + 31 + (pos % 253) // 4) * 50) // 100 + 5) * {_sql_mult(s)}) // 10) AS final_{s}" for s in STATS[1:])}
FROM natured""")
def level_stats(spark, sf):
    rows = _natured(spark, sf)
    for s in STATS:
        rows = rows.withColumn(f"ev_{s}", F.col("pos") % 253)
    out = ops.level_stats(rows, ev_prefix="ev_")
    return out.select("pos", "nature", *[f"final_{s}" for s in STATS])


@query("invested_stats", f"""WITH {SQL_NATURED}, p AS (SELECT *, least(greatest(0, attack - 60), 32, greatest(0, 66 - hp % 80)) AS pts FROM natured)
SELECT pos, pts, CASE WHEN pos % 5 = 0 THEN 77 + pts ELSE ((2 * hp + 31) * 50) // 100 + 60 + pts END AS invested_hp,
  {', '.join(f"((((2 * {s} + 31) * 50) // 100 + 5 + pts) * {_sql_mult(s)}) // 10 AS invested_{s}" for s in STATS[1:])}
FROM p""")
def invested_stats(spark, sf):
    rows = _natured(spark, sf)
    rows = rows.withColumn("pts", ops.clamp_points(F.col("attack") - 60, F.col("hp") % 80))
    for s in STATS:
        rows = rows.withColumn(f"points_{s}", F.col("pts")).withColumn(f"final_{s}", F.lit(77))
    rows = rows.withColumn("hp", F.when(F.col("pos") % 5 != 0, F.col("hp")))
    return ops.invested_stats(rows).select("pos", F.col("pts").cast("long").alias("pts"), *[f"invested_{s}" for s in STATS])


@query("stat_total", f"""WITH {SQL_ENTITIES} SELECT pos, hp + attack + defense + special_attack + special_defense + speed AS stat_total,
  ['attack', 'defense', 'special_attack', 'special_defense', 'speed'][list_position([attack, defense, special_attack, special_defense, speed],
    greatest(attack, defense, special_attack, special_defense, speed))] AS highest_stat FROM entities""")
def stat_total(spark, sf):
    return ops.stat_total(entities(spark, sf)).select("pos", "stat_total", "highest_stat")


# --- battle pairs ----------------------------------------------------------------------------

def _pairs(spark, sf):
    """Line items as attacks: the part attacks, the supplier number shapes the defender."""
    li = table(spark, sf, "lineitem")
    part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    types = F.array_distinct(F.array(tag_at(supp % 18), tag_at((supp * 7 + 3) % 18)))
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.lit(50).alias("level"), (F.col("l_quantity").cast("int") + 35).alias("power"),
        (part % 150 + 50).cast("int").alias("attack"), (supp % 120 + 50).cast("int").alias("defense"),
        tag_at((part + line) % 18).alias("move_type"), types.alias("defender_types"),
        F.when(F.col("l_returnflag") == "R", 1.5).otherwise(1.0).alias("f_stab"),
        F.when(F.col("l_linestatus") == "F", 0.5).otherwise(1.0).alias("f_burn"),
        F.when(line == 2, 1.5).otherwise(1.0).alias("f_critical"),
        F.when(line == 3, F.lit(2.0) / 3).otherwise(1.0).alias("f_screen"),
        F.when(line == 4, 1.3).otherwise(1.0).alias("f_attacker_item"),
        F.when(line == 5, 0.75).otherwise(1.0).alias("f_defender_ability"),
        ((part * 3 + supp) % 130 + 60).cast("int").alias("max_hp"),
        F.greatest(F.lit(1), ((part * 3 + supp) % 130 + 60) - F.col("l_quantity").cast("int")).cast("int").alias("hp"))


SQL_PAIRS = f"""{SQL_CHART},
p0 AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER) + 35 AS power, l_partkey % 150 + 50 AS attack,
  l_suppkey % 120 + 50 AS defense, {SQL_TAGS}[(l_partkey + l_linenumber) % 18 + 1] AS move_type,
  {SQL_TAGS}[l_suppkey % 18 + 1] AS t1, {SQL_TAGS}[(l_suppkey * 7 + 3) % 18 + 1] AS t2,
  CASE WHEN l_returnflag = 'R' THEN 1.5 ELSE 1.0 END::DOUBLE AS f_stab, CASE WHEN l_linestatus = 'F' THEN 0.5 ELSE 1.0 END::DOUBLE AS f_burn,
  CASE WHEN l_linenumber = 2 THEN 1.5 ELSE 1.0 END::DOUBLE AS f_crit, CASE WHEN l_linenumber = 3 THEN 2::DOUBLE / 3 ELSE 1.0 END AS f_screen,
  CASE WHEN l_linenumber = 4 THEN 1.3 ELSE 1.0 END::DOUBLE AS f_item, CASE WHEN l_linenumber = 5 THEN 0.75 ELSE 1.0 END::DOUBLE AS f_abil,
  (l_partkey * 3 + l_suppkey) % 130 + 60 AS max_hp,
  greatest(1, (l_partkey * 3 + l_suppkey) % 130 + 60 - CAST(l_quantity AS INTEGER)) AS hp FROM lineitem),
p1 AS (SELECT p0.*, coalesce(c1.f, 1.0)::DOUBLE * CASE WHEN t2 <> t1 THEN coalesce(c2.f, 1.0)::DOUBLE ELSE 1.0 END AS f_type FROM p0
  LEFT JOIN chart c1 ON c1.a = move_type AND c1.d = t1 LEFT JOIN chart c2 ON c2.a = move_type AND c2.d = t2)"""
SQL_ROLLED = SQL_PAIRS + """,
r0 AS (SELECT *, floor(floor(22 * power * attack / defense::DOUBLE) / 50) + 2 AS base, unnest(generate_series(85, 100)) AS roll FROM p1),
r1 AS (SELECT *, floor(floor(floor(floor(floor(floor(base * f_crit) * (roll / 100.0::DOUBLE)) * f_stab) * f_type) * f_burn) * f_screen) AS x FROM r0),
r2 AS (SELECT *, ceil(ceil(x * f_item - 0.5) * f_abil - 0.5) AS y FROM r1),
rolled AS (SELECT *, CAST(CASE WHEN f_type = 0 THEN 0 ELSE greatest(1, y) END AS BIGINT) AS dmg FROM r2)"""


def _rolled(spark, sf):
    return ops.with_rolls(ops.type_multipliers(_pairs(spark, sf)))


_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("type_multiplier", f"""WITH {SQL_PAIRS} SELECT {', '.join(_KEYS)}, f_type, CASE WHEN f_type = 0 THEN 'no effect'
  WHEN f_type >= 4 THEN 'extremely effective' WHEN f_type > 1 THEN 'super effective' WHEN f_type <= 0.25 THEN 'extremely not effective'
  WHEN f_type < 1 THEN 'not very effective' ELSE 'neutral damage' END AS effectiveness FROM p1""")
def type_multiplier(spark, sf):
    return ops.type_multipliers(_pairs(spark, sf)).select(*_KEYS, "f_type", "effectiveness")


@query("stage_stat", """SELECT event_id, s.stage, CASE WHEN s.stage >= 0 THEN greatest(1, (v * (2 + s.stage)) // 2)
  ELSE greatest(1, (v * 2) // (2 - s.stage)) END AS stat FROM (SELECT event_id, CAST(floor(value) AS BIGINT) AS v, user_id FROM events) e,
  LATERAL (SELECT greatest(-6, least(6, e.user_id % 17 - 8)) AS stage) s""")
def stage_stat(spark, sf):
    raw = F.col("user_id") % 17 - 8
    return table(spark, sf, "events").select(
        "event_id", F.greatest(F.lit(-6), F.least(F.lit(6), raw)).alias("stage"),
        B.stage_stat(F.floor("value"), raw).alias("stat"))


@query("chain_modifiers", """WITH m AS (SELECT event_id, [2048 + user_id * 37, 4096, 5325, 3072 + (event_id % 2048)] AS mods, value FROM events),
s AS (SELECT *, (4096 * mods[1] + 2048) >> 12 AS a FROM m), t AS (SELECT *, (a * 5325 + 2048) >> 12 AS b FROM s)
SELECT event_id, greatest(41, least(9000, CASE WHEN mods[4] = 4096 THEN b ELSE (b * mods[4] + 2048) >> 12 END)) AS chained,
  CAST(ceil(value - 0.5) AS BIGINT) AS rounded FROM t""")
def chain_modifiers(spark, sf):
    mods = F.array(2048 + F.col("user_id") * 37, F.lit(4096).cast("long"), F.lit(5325).cast("long"),
                   3072 + F.col("event_id") % 2048)
    return table(spark, sf, "events").select(
        "event_id", B.chain_modifiers(mods, 41, 9000).alias("chained"), B.round_half_down(F.col("value")).alias("rounded"))


@query("damage_rolls", f"WITH {SQL_ROLLED} SELECT {', '.join(_KEYS)}, CAST(roll AS INTEGER) AS roll, dmg FROM rolled")
def damage_rolls(spark, sf):
    return ops.damage_rolls(ops.type_multipliers(_pairs(spark, sf))).select(*_KEYS, "roll", "dmg")


_RULES = {"double-kick": [(2, 1.0)], "triple-axel": [(1, 1 / 3), (2, 1 / 3), (3, 1 / 3)],
          "rock-blast": [(2, 0.375), (3, 0.375), (4, 0.125), (5, 0.125)]}


def _hit_rules(spark, sf):
    """Rules keyed by move; each listed outcome comes from the nation table's regions."""
    move = F.col("r_name")
    outcome = lambda rows: F.array(*[F.struct(F.lit(h).alias("hits"), F.lit(float(p)).alias("p")) for h, p in rows])
    rules = (F.when(move == "AFRICA", outcome(_RULES["double-kick"])).when(move == "AMERICA", outcome(_RULES["triple-axel"]))
             .when(move == "ASIA", outcome(_RULES["rock-blast"])))
    return table(spark, sf, "region").select(move.alias("move"), rules.alias("outcomes")).where("outcomes is not null")


def _moves(spark, sf):
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("move"))
    rows = _rolled(spark, sf).withColumn("k", (F.col("l_suppkey") % 5).cast("int"))
    return rows.join(r, "k").withColumn("hits", F.when(F.col("l_linenumber") == 6, 2).otherwise(1))


SQL_HITS = SQL_ROLLED + """,
rules(move, h, p) AS (VALUES ('AFRICA', 2, 1.0::DOUBLE), ('AMERICA', 1, 1 / 3.0::DOUBLE), ('AMERICA', 2, 1 / 3.0::DOUBLE), ('AMERICA', 3, 1 / 3.0::DOUBLE),
  ('ASIA', 2, 0.375), ('ASIA', 3, 0.375), ('ASIA', 4, 0.125), ('ASIA', 5, 0.125)),
mv AS (SELECT p1.*, row_number() OVER () AS rid, r_name AS move FROM p1 JOIN region ON r_regionkey = l_suppkey % 5),
hits AS (SELECT mv.*, CASE WHEN l_linenumber = 6 THEN 2 ELSE coalesce(h, 1) END AS hits,
  CASE WHEN l_linenumber = 6 THEN 1.0 ELSE coalesce(p, 1.0) END::DOUBLE AS p FROM mv LEFT JOIN rules ON rules.move = mv.move AND l_linenumber <> 6)"""


@query("expand_hit_counts", f"WITH {SQL_HITS} SELECT {', '.join(_KEYS)}, move, hits, round(p, 6) AS p FROM hits")
def expand_hit_counts(spark, sf):
    return ops.expand_hit_counts(_moves(spark, sf), _hit_rules(spark, sf)).select(
        *_KEYS, "move", "hits", F.round("p", 6).alias("p"))


def _totals(spark, sf):
    r = F.col("l_suppkey") % 3
    counts = (F.when(r == 0, F.array(F.lit(1))).when(r == 1, F.array(F.lit(2)))
              .otherwise(F.array(*[F.lit(i) for i in (2, 3, 4, 5)])))
    return _rolled(spark, sf).withColumn("totals", ops.pooled_totals(F.col("rolls"), counts))


SQL_TOTALS = SQL_ROLLED + """,
rr AS (SELECT *, row_number() OVER () AS rid FROM p1),
hc AS (SELECT rr.*, unnest(CASE l_suppkey % 3 WHEN 0 THEN [1] WHEN 1 THEN [2] ELSE [2, 3, 4, 5] END) AS h FROM rr),
q0 AS (SELECT *, floor(floor(22 * power * attack / defense::DOUBLE) / 50) + 2 AS base, unnest(generate_series(85, 100)) AS roll FROM hc),
q1 AS (SELECT *, floor(floor(floor(floor(floor(floor(base * f_crit) * (roll / 100.0::DOUBLE)) * f_stab) * f_type) * f_burn) * f_screen) AS x FROM q0),
tot AS (SELECT *, h * CAST(CASE WHEN f_type = 0 THEN 0 ELSE greatest(1, ceil(ceil(x * f_item - 0.5) * f_abil - 0.5)) END AS BIGINT) AS d FROM q1),
agg AS (SELECT rid, any_value(l_orderkey) AS l_orderkey, any_value(l_linenumber) AS l_linenumber, any_value(l_partkey) AS l_partkey,
  any_value(l_suppkey) AS l_suppkey, any_value(hp) AS hp, any_value(max_hp) AS max_hp, any_value(t1) AS t1, any_value(t2) AS t2,
  min(d) AS lo, max(d) AS hi, CAST(sum(d) AS BIGINT) AS s, count(*) AS n, count(*) FILTER (WHERE d >= hp) AS one FROM tot GROUP BY rid)"""


def _sql_ko(lo, hi, one, n, hp):
    return f"""CASE WHEN {one} = {n} THEN 'Guaranteed OHKO' WHEN {one} > 0 THEN CAST(round_even({one} / {n}::DOUBLE * 100, 1) AS VARCHAR) || '% chance to OHKO' WHEN {lo} * 2 >= {hp} THEN 'Guaranteed 2HKO'
  WHEN {hi} * 2 >= {hp} THEN 'Possible 2HKO' WHEN {lo} * 3 >= {hp} THEN 'Guaranteed 3HKO' WHEN {hi} * 3 >= {hp} THEN 'Possible 3HKO'
  ELSE 'Likely 4HKO or worse' END"""


@query("damage_summary", f"""WITH {SQL_TOTALS} SELECT {', '.join(_KEYS)}, lo AS min_damage, hi AS max_damage, s AS total, n,
  CAST(round(round_even(s / n::DOUBLE, 2) * 100) AS BIGINT) AS mean_hundredths, CAST(round(round_even(lo / max_hp::DOUBLE * 100, 1) * 10) AS BIGINT) AS min_tenths,
  CAST(round(round_even(hi / max_hp::DOUBLE * 100, 1) * 10) AS BIGINT) AS max_tenths, {_sql_ko('lo', 'hi', 'one', 'n', 'hp')} AS ko FROM agg""")
def damage_summary(spark, sf):
    out = ops.damage_summary(_totals(spark, sf))
    return out.select(
        *_KEYS, "min_damage", "max_damage",
        F.aggregate("damage_values", F.lit(0).cast("long"), lambda a, d: a + d).alias("total"),
        F.size("damage_values").alias("n"), F.round(F.col("mean_damage") * 100).cast("long").alias("mean_hundredths"),
        *[F.round(F.col(f"{side}_percent") * 10).cast("long").alias(f"{side}_tenths") for side in ("min", "max")], F.col("ko_class").alias("ko"))


@query("hazard_and_residual", f"""WITH {SQL_TOTALS}, z AS (SELECT agg.*, l_linenumber % 4 AS layers,
  CASE WHEN l_partkey % 2 = 0 THEN greatest(1, CAST(floor(max_hp * coalesce(c1.f, 1.0)::DOUBLE * CASE WHEN t2 <> t1 THEN coalesce(c2.f, 1.0)::DOUBLE ELSE 1.0 END / 8) AS BIGINT)) ELSE 0 END AS rock
  FROM agg LEFT JOIN chart c1 ON c1.a = 'rock' AND c1.d = t1 LEFT JOIN chart c2 ON c2.a = 'rock' AND c2.d = t2),
y AS (SELECT *, CASE WHEN l_partkey % 7 = 0 OR t1 = 'flying' OR t2 = 'flying' OR layers = 0 THEN 0
  ELSE greatest(1, max_hp // CASE layers WHEN 1 THEN 8 WHEN 2 THEN 6 ELSE 4 END) END AS spikes,
  CASE l_suppkey % 4 WHEN 0 THEN -greatest(1, max_hp // 16) WHEN 1 THEN -greatest(1, max_hp // 8) ELSE 0 END
  + CASE WHEN l_linenumber = 1 AND t1 NOT IN ('rock', 'ground', 'steel') AND t2 NOT IN ('rock', 'ground', 'steel') THEN -greatest(1, max_hp // 16) ELSE 0 END
  + CASE l_partkey % 5 WHEN 0 THEN greatest(1, max_hp // 16) WHEN 1 THEN CASE WHEN t1 = 'poison' OR t2 = 'poison' THEN greatest(1, max_hp // 16)
    ELSE -greatest(1, max_hp // 8) END ELSE 0 END
  + CASE WHEN l_linenumber = 2 AND l_partkey % 7 <> 0 THEN greatest(1, max_hp // 16) ELSE 0 END AS net FROM z),
k AS (SELECT tot.rid, count(*) FILTER (WHERE d + rock + spikes >= y.hp) AS one FROM tot JOIN y ON y.rid = tot.rid GROUP BY 1)
SELECT {', '.join('y.' + k for k in _KEYS)}, rock AS rock_damage, spikes AS spikes_damage, net AS end_turn_net,
  {_sql_ko('(lo + rock + spikes)', '(hi + rock + spikes)', 'k.one', 'n', 'y.hp')} AS ko FROM y JOIN k ON k.rid = y.rid""")
def hazard_and_residual(spark, sf):
    part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    rows = _totals(spark, sf).withColumn("types", F.col("defender_types")).withColumn("stealth_rock", part % 2 == 0)
    rows = rows.withColumn("spikes_layers", line % 4).withColumn("grounded", part % 7 != 0).withColumn("ability", F.lit(""))
    rows = rows.withColumn("status", F.when(supp % 4 == 0, "burn").when(supp % 4 == 1, "poison"))
    rows = rows.withColumn("item", F.when(part % 5 == 0, "leftovers").when(part % 5 == 1, "black-sludge"))
    rows = rows.withColumn("weather", F.when(line == 1, "sand")).withColumn("terrain", F.when(line == 2, "grassy"))
    out = ops.hazard_residual(rows)
    return out.select(*_KEYS, "rock_damage", "spikes_damage", "end_turn_net", F.col("ko_after_hazards").alias("ko"))


def _fighters(spark, sf):
    e = entities(spark, sf)
    key = F.col("pos")
    moves = F.array(*[F.struct(
        F.concat(F.lit(f"m{i}-"), F.get("types", F.lit(0))).alias("move"), tag_at((key * (i + 2) + i) % 18).alias("move_type"),
        F.when((key + i) % 9 == 0, 0).otherwise(40 + (key * (i + 3)) % 80).cast("int").alias("power"),
        (F.col("attack") if i % 2 == 0 else F.col("special_attack")).alias("attack")) for i in range(4)])
    return e.select(key, F.col("form_api_name").alias("name"), "species_display_name", "types", moves.alias("moves"), "defense",
                    (F.col("hp") + 60).alias("hp"), F.lit(50).alias("level"),
                    F.when(F.col("is_default"), "OU").when(key % 2 == 0, "VGC").otherwise("UU").alias("tier"))


def _roster(spark, sf):
    """One member per species: the best total stat, first on ties."""
    f = _fighters(spark, sf)
    best = f.groupBy("species_display_name").agg(F.max_by(F.struct(*f.columns), F.struct("hp", "pos")).alias("r"))
    return best.select("r.*")


def _sql_moves():
    return ", ".join(f"""{{'i': {i}, 'move': 'm{i}-' || types[1], 't': {SQL_TAGS}[(pos * {i + 2} + {i}) % 18 + 1],
    'p': CASE WHEN (pos + {i}) % 9 = 0 THEN 0 ELSE 40 + (pos * {i + 3}) % 80 END, 'a': {'attack' if i % 2 == 0 else 'special_attack'}}}""" for i in range(4))


SQL_FIGHT = f"""{SQL_ENTITIES}, {SQL_CHART},
fighters AS (SELECT pos, form_api_name AS name, species_display_name, types, [{_sql_moves()}] AS moves, defense, hp + 60 AS hp,
  CASE WHEN is_default THEN 'OU' WHEN pos % 2 = 0 THEN 'VGC' ELSE 'UU' END AS tier FROM entities),
roster AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY species_display_name ORDER BY hp DESC, pos DESC) AS r FROM fighters) WHERE r = 1)"""


def _sql_matrix(att, dfn, where):
    return f"""WITH {SQL_FIGHT},
m0 AS (SELECT {att}.pos AS ap, {dfn}.pos AS dp, {att}.name AS attacker, {dfn}.name AS defender, {att}.types AS own, {dfn}.types AS dt,
  unnest({att}.moves) AS m, {dfn}.defense AS df, {dfn}.hp AS hp FROM fighters f CROSS JOIN roster r {where}),
m1 AS (SELECT m0.*, coalesce(c1.f, 1.0)::DOUBLE * coalesce(c2.f, 1.0)::DOUBLE AS ft, CASE WHEN list_contains(own, m.t) THEN 1.5 ELSE 1.0 END::DOUBLE AS fs,
  floor(floor(22 * m.p * m.a / df::DOUBLE) / 50) + 2 AS base FROM m0
  LEFT JOIN chart c1 ON c1.a = m.t AND c1.d = dt[1] LEFT JOIN chart c2 ON c2.a = m.t AND c2.d = dt[2]),
m2 AS (SELECT *, CASE WHEN ft = 0 OR m.p <= 0 THEN 0 ELSE CAST(greatest(1, floor(floor(floor(base * 0.85::DOUBLE) * fs) * ft)) AS BIGINT) END AS lo,
  CASE WHEN ft = 0 OR m.p <= 0 THEN 0 ELSE CAST(greatest(1, floor(floor(base * fs) * ft)) AS BIGINT) END AS hi FROM m1),
m3 AS (SELECT *, row_number() OVER (PARTITION BY ap, dp ORDER BY hi DESC, m.i) AS k FROM m2)
SELECT attacker, defender, m.move AS move, lo AS min_damage, hi AS max_damage, lo * 1000 // hp AS min_tenths, hi * 1000 // hp AS max_tenths FROM m3 WHERE k = 1"""


def _tenths(df):
    return df.select("attacker", "defender", "move", "min_damage", "max_damage",
                     F.round(F.col("min_percent") * 10).cast("long").alias("min_tenths"),
                     F.round(F.col("max_percent") * 10).cast("long").alias("max_tenths"))


@query("matchup_matrix", _sql_matrix("r", "f", ""))
def matchup_matrix(spark, sf):
    return _tenths(ops.matchup_matrix(_fighters(spark, sf), _roster(spark, sf)))


@query("matchup_matrix_all_vs_one", _sql_matrix("f", "r", "WHERE f.tier IN ('OU', 'UU')"))
def matchup_matrix_all_vs_one(spark, sf):
    return _tenths(ops.matchup_matrix(_fighters(spark, sf), _roster(spark, sf), "all-vs-one", ["OU", "UU"]))


def _sql_chance(n: int) -> str:
    froms = ", ".join(f"ds d{i}" for i in range(n))
    same = " AND ".join(f"d{i}.k = d0.k" for i in range(1, n))
    total = " + ".join(f"d{i}.d" for i in range(n))
    return f"""(SELECT d0.k, count(*) AS ways FROM {froms} WHERE {same}
      AND {total} >= d0.hp + {n - 1} * (d0.eot) + least(0, d0.eot) GROUP BY 1)"""


SQL_CHANCE = f"""{SQL_ENTITIES}, ds AS (SELECT pos AS k, hp + 100 AS hp, CAST(speed % 21 - 10 AS BIGINT) AS eot,
  unnest(list_transform(generate_series(85, 100), lambda r: CAST(floor((attack + 10) * (r / 100.0::DOUBLE)) AS BIGINT))) AS d FROM entities)"""


def _chances(spark, sf, n):
    rolls = F.transform(F.sequence(F.lit(85), F.lit(100)), lambda r: B.long_floor((F.col("attack") + 10) * (r / 100)))
    rows = entities(spark, sf).select("pos", (F.col("hp") + 100).alias("hp"), (F.col("speed") % 21 - 10).alias("eot"), rolls.alias("rolls"))
    return ops.ko_chance_n_hits(rows, n, residual="eot").select("pos", "ko_ways")


@query("ko_chance_n_hits", f"WITH {SQL_CHANCE} SELECT e.pos, coalesce(c.ways, 0) AS ko_ways FROM entities e LEFT JOIN {_sql_chance(3)} c ON c.k = e.pos")
def ko_chance_n_hits(spark, sf):
    return _chances(spark, sf, 3)


@query("ko_chance_two_hits", f"WITH {SQL_CHANCE} SELECT e.pos, coalesce(c.ways, 0) AS ko_ways FROM entities e LEFT JOIN {_sql_chance(2)} c ON c.k = e.pos")
def ko_chance_two_hits(spark, sf):
    return _chances(spark, sf, 2)


@query("hit_chance", """WITH e AS (SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE 50 + user_id % 51 END AS acc,
  greatest(-6, least(6, user_id % 15 - 7)) AS sa, greatest(-6, least(6, event_id % 15 - 7)) AS se, event_type FROM events),
f AS (SELECT *, acc::DOUBLE * CASE WHEN sa >= 0 THEN (3 + sa) / 3.0::DOUBLE ELSE 3.0::DOUBLE / (3 - sa) END
  / CASE WHEN event_type = 'click' THEN 1.0::DOUBLE WHEN se >= 0 THEN (3 + se) / 3.0::DOUBLE ELSE 3.0::DOUBLE / (3 - se) END * 1.3::DOUBLE * 0.9::DOUBLE AS v FROM e),
d AS (SELECT *, CAST(CAST(greatest(0, least(100, v)) AS VARCHAR) AS DECIMAL(30, 17)) * 100 AS x FROM f)
SELECT event_id, CASE WHEN acc IS NULL THEN 10000 ELSE CAST(floor(x) AS BIGINT) + CASE WHEN x - floor(x) > 0.5 OR (x - floor(x) = 0.5 AND floor(x) % 2 = 1) THEN 1 ELSE 0 END END AS chance_bp FROM d""")
def hit_chance(spark, sf):
    kind = F.col("event_type")
    rows = table(spark, sf, "events").select(
        "event_id", F.when(kind != "view", 50 + F.col("user_id") % 51).alias("accuracy"),
        (F.col("user_id") % 15 - 7).alias("accuracy_stage"), (F.col("event_id") % 15 - 7).alias("evasion_stage"),
        (kind == "click").alias("ignores_evasion"), F.lit(False).alias("sure_hit"), F.array(F.lit(1.3), F.lit(0.9)).alias("factors"))
    out = ops.hit_chance(rows)
    return out.select("event_id", F.when(F.col("chance") == 1.0, 10000).otherwise(F.round(F.col("final_accuracy") * 100)).cast("long").alias("chance_bp"))


@query("speed_order", """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 20 + l_partkey % 120 AS us, 20 + l_suppkey % 120 AS os,
  l_linenumber - 3 AS ug, l_linenumber % 3 - 1 AS og, l_returnflag = 'R' AS room, l_linestatus = 'F' AS para FROM lineitem),
q AS (SELECT *, CASE WHEN ug >= 0 THEN us * (2 + ug) // 2 ELSE us * 2 // (2 - ug) END AS u0,
  CASE WHEN og >= 0 THEN os * (2 + og) // 2 ELSE os * 2 // (2 - og) END AS o0 FROM p),
r AS (SELECT *, CASE WHEN para THEN CAST(floor(floor(u0 * 1.5::DOUBLE) * 0.5) AS BIGINT) ELSE CAST(floor(u0 * 1.5::DOUBLE) AS BIGINT) END AS u, o0 * 2 AS o FROM q)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, u AS user_modified, o AS opponent_modified,
  CASE WHEN u = o THEN 'tie' WHEN (u > o) <> room THEN 'user' ELSE 'opponent' END AS first FROM r""")
def speed_order(spark, sf):
    li = table(spark, sf, "lineitem")
    rows = li.select(
        *_KEYS, (20 + F.col("l_partkey") % 120).alias("user_speed"), (20 + F.col("l_suppkey") % 120).alias("opponent_speed"),
        (F.col("l_linenumber") - 3).alias("user_stage"), (F.col("l_linenumber") % 3 - 1).alias("opponent_stage"),
        F.when(F.col("l_linestatus") == "F", F.array(F.lit(1.5), F.lit(0.5))).otherwise(F.array(F.lit(1.5))).alias("user_factors"),
        F.array(F.lit(2.0)).alias("opponent_factors"), (F.col("l_returnflag") == "R").alias("trick_room"))
    return ops.speed_order(rows).select(*_KEYS, "user_modified", "opponent_modified", "first")
