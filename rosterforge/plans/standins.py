"""Projections of the driver's tables that play the library's record types.

Each stand-in exists twice: as a DataFrame and as a SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterforge.session import dealt_by_rows

# Team list rows of a task that nests them.
PAYLOAD_ROWS = 131_072
# The eighteen tags, in chart order.
TAGS = ("normal", "fire", "water", "electric", "grass", "ice", "fighting", "poison", "ground",
        "flying", "psychic", "bug", "rock", "ghost", "dragon", "dark", "steel", "fairy")
SQL_TAGS = "[" + ", ".join(f"'{t}'" for t in TAGS) + "]"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tag_at(index: Column) -> Column:
    return F.get(F.array(*[F.lit(t) for t in TAGS]), index.cast("int"))


# --- tournaments -----------------------------------------------------------------------------

def tournaments(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("date"),
        F.col("o_orderpriority").alias("format"),
        F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("name"),
        F.col("o_custkey").alias("organizer"),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("players"),
        (F.col("o_orderstatus") == "O").alias("isOnline"),
        (F.col("o_orderstatus") != "P").alias("decklists"),
        F.lit("EV").alias("game"),
        F.concat(F.lit("/t/"), F.col("o_orderkey").cast("string")).alias("url"),
    )


SQL_TOURNAMENTS = """tournaments AS (
  SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS date,
    o_orderpriority AS format, 'T' || o_orderkey AS name, o_custkey AS organizer,
    CAST(floor(o_totalprice / 1000) AS INTEGER) AS players, o_orderstatus = 'O' AS is_online,
    o_orderstatus <> 'P' AS decklists, 'EV' AS game, '/t/' || o_orderkey AS url
  FROM orders)"""


# --- team lists ------------------------------------------------------------------------------

def teamlists(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").cast("string").alias("tournament_id"),
        F.concat(F.lit("P"), F.col("l_suppkey").cast("string")).alias("player_id"),
        F.concat(F.lit("E"), F.col("l_partkey").cast("string")).alias("entity"),
        F.concat("l_returnflag", "l_linestatus").alias("item"),
        F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("move_1"),
        F.concat(F.lit("q"), F.col("l_quantity").cast("int").cast("string")).alias("move_2"),
        F.concat(F.lit("s"), F.month("l_shipdate").cast("string")).alias("move_3"),
        F.nullif(F.col("l_returnflag"), F.lit("R")).alias("move_4"),
        F.round(F.col("l_discount") * 100).cast("int").alias("wins"),
        F.round(F.col("l_tax") * 100).cast("int").alias("losses"),
        F.col("l_linenumber").alias("placing"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
    )


SQL_TEAMLISTS = """teamlists AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS tournament_id, 'P' || l_suppkey AS player_id,
    'E' || l_partkey AS entity, l_returnflag || l_linestatus AS item,
    'm' || l_linenumber AS move_1, 'q' || CAST(l_quantity AS INTEGER) AS move_2,
    's' || month(l_shipdate) AS move_3, nullif(l_returnflag, 'R') AS move_4,
    CAST(round(l_discount * 100) AS INTEGER) AS wins, CAST(round(l_tax * 100) AS INTEGER) AS losses,
    l_linenumber AS "placing", CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
  FROM lineitem)"""

_SLOT_ORDER = ("entity", "cents", "item", "move_1", "move_2", "move_3", "wins", "losses")


def slotted_teamlists(spark: SparkSession, sf: str) -> DataFrame:
    """Team lists with ``team_slot`` numbered inside each team."""
    return _slotted(teamlists(spark, sf))


def _slotted(rows: DataFrame) -> DataFrame:
    window = Window.partitionBy("tournament_id", "player_id").orderBy(*_SLOT_ORDER)
    return rows.withColumn("team_slot", F.row_number().over(window))


SQL_SLOTTED = SQL_TEAMLISTS + f""",
slotted AS (SELECT *, CAST(row_number() OVER (PARTITION BY tournament_id, player_id
  ORDER BY {', '.join(_SLOT_ORDER)}) AS INTEGER) AS team_slot FROM teamlists)"""


# --- nested payloads -------------------------------------------------------------------------

def payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Team lists re-grouped into one nested payload per tournament.

    Rows are dealt by tournament once; slots, teams, standings and pairings all form there.
    """
    rows = teamlists(spark, sf)
    rows = _slotted(dealt_by_rows(rows, rows.count(), PAYLOAD_ROWS, "tournament_id"))
    element = F.struct(
        F.col("entity").alias("name"), F.lit("a").alias("ability"), F.col("item"),
        F.col("move_3").alias("tera"),
        F.array_compact(F.array("move_1", "move_2", "move_4")).alias("attacks"))
    team = rows.groupBy("tournament_id", "player_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("team_slot", element.alias("e")))),
                    lambda s: s["e"]).alias("decklist"),
        F.min("placing").alias("placing"), F.sum("wins").cast("int").alias("wins"),
        F.sum("losses").cast("int").alias("losses"), F.sum("cents").alias("score"))
    standing = F.struct(
        F.col("player_id").alias("player"), F.concat(F.lit("N"), "player_id").alias("name"),
        F.lit("XX").alias("country"), "placing", "wins", "losses", F.lit(0).alias("ties"), "score",
        F.lit(None).cast("int").alias("dropRound"), "decklist")
    nested = team.groupBy(F.col("tournament_id").alias("id")).agg(
        F.collect_list(standing).alias("standings"),
        F.array_sort(F.collect_list(F.struct("player_id", "score"))).alias("_teams"))
    nested = nested.select("id", "standings", F.transform("_teams", _pairing).alias("pairings"))
    head = tournaments(spark, sf).withColumn("id", F.col("id").cast("string"))
    return head.join(nested, "id", "left")


def _pairing(team: Column, at: Column) -> Column:
    """The match of a team with the next one of ``_teams``, as ``matches`` has it."""
    other = F.get("_teams", at + 1)
    winner = _winner(team["player_id"], other["player_id"], team["score"], other["score"])
    return F.struct(
        F.concat(F.lit("M"), (at + 1).cast("string")).alias("match"), F.lit(1).alias("phase"), F.lit(1).alias("round"),
        (at + 1).alias("table"), team["player_id"].alias("player1"), other["player_id"].alias("player2"), winner.alias("winner"))


def _winner(player1: Column, player2: Column, c: Column, c2: Column) -> Column:
    return F.when(c2.isNull(), None).when(c > c2, player1).when(c < c2, player2).otherwise("-1")


SQL_TEAMS = SQL_SLOTTED + """,
teams AS (SELECT tournament_id, player_id, min("placing") AS "placing", CAST(sum(wins) AS INTEGER) AS wins,
  CAST(sum(losses) AS INTEGER) AS losses, CAST(sum(cents) AS BIGINT) AS score
  FROM slotted GROUP BY 1, 2)"""


def matches(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring players of a tournament meet; the higher summed price wins, ties read -1."""
    totals = teamlists(spark, sf).groupBy("tournament_id", "player_id").agg(F.sum("cents").alias("c"))
    w = Window.partitionBy("tournament_id").orderBy("player_id")
    paired = totals.select(
        "tournament_id", F.row_number().over(w).alias("table"), F.col("player_id").alias("player1"),
        F.lead("player_id").over(w).alias("player2"), "c", F.lead("c").over(w).alias("c2"))
    winner = _winner(F.col("player1"), F.col("player2"), F.col("c"), F.col("c2"))
    return paired.select(
        "tournament_id", F.concat(F.lit("M"), F.col("table").cast("string")).alias("match"),
        F.lit(1).alias("phase"), F.lit(1).alias("round"), "table", "player1", "player2",
        winner.alias("winner"))


SQL_MATCHES = SQL_TEAMLISTS + """,
totals AS (SELECT tournament_id, player_id, sum(cents) AS c FROM teamlists GROUP BY 1, 2),
paired AS (SELECT tournament_id, row_number() OVER w AS tbl, player_id AS player1,
  lead(player_id) OVER w AS player2, c, lead(c) OVER w AS c2 FROM totals
  WINDOW w AS (PARTITION BY tournament_id ORDER BY player_id)),
matches AS (SELECT tournament_id, 'M' || tbl AS match, CAST(tbl AS INTEGER) AS tbl, player1, player2,
  CASE WHEN c2 IS NULL THEN NULL WHEN c > c2 THEN player1 WHEN c < c2 THEN player2 ELSE '-1' END AS winner
  FROM paired)"""


# --- entity records --------------------------------------------------------------------------

STATS = ("hp", "attack", "defense", "special_attack", "special_defense", "speed")
_STAT_RULES = {"hp": (7, 40, 100), "attack": (11, 30, 120), "defense": (13, 35, 110),
               "special_attack": (17, 25, 130), "special_defense": (19, 35, 105), "speed": (23, 20, 125)}


def entities(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    first = tag_at(key % 18)
    second = F.when(size % 4 != 0, F.nullif(tag_at((size * 5) % 18), first))
    return p.select(
        key.alias("pos"),
        F.col("p_brand").alias("species_display_name"), F.lower("p_brand").alias("species_api_name"),
        F.when(size % 10 != 0, F.concat_ws(" ", "p_name", "p_type")).alias("form_display_name"),
        F.concat_ws("-", F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))), F.lower("p_type"),
                    F.col("p_size").cast("string")).alias("form_api_name"),
        (size % 3 == 0).alias("is_default"),
        (key - key % 4).alias("number"),
        F.array_compact(F.array(first, second)).alias("types"),
        *[((key * a + size) % m + b).cast("int").alias(s) for s, (a, b, m) in _STAT_RULES.items()],
        F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"),
    )


SQL_ENTITIES = f"""entities AS (
  SELECT p_partkey AS pos, p_brand AS species_display_name, lower(p_brand) AS species_api_name,
    CASE WHEN p_size % 10 <> 0 THEN p_name || ' ' || p_type END AS form_display_name,
    lower(replace(p_name, ' ', '-')) || '-' || lower(p_type) || '-' || p_size AS form_api_name,
    p_size % 3 = 0 AS is_default, p_partkey - p_partkey % 4 AS number,
    list_filter([{SQL_TAGS}[p_partkey % 18 + 1],
      CASE WHEN p_size % 4 <> 0 THEN nullif({SQL_TAGS}[(p_size * 5) % 18 + 1], {SQL_TAGS}[p_partkey % 18 + 1]) END],
      lambda x: x IS NOT NULL) AS types,
    {', '.join(f'CAST((p_partkey * {a} + p_size) % {m} + {b} AS INTEGER) AS {s}' for s, (a, b, m) in _STAT_RULES.items())},
    CAST(round(p_retailprice * 100) AS BIGINT) AS cents
  FROM part)"""


# --- files -----------------------------------------------------------------------------------

def files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents seen as labelled image files."""
    d = table(spark, sf, "documents")
    name = F.concat(F.col("source"), F.when(F.col("n_chars") % 2 == 0, "_shiny").otherwise(""),
                    F.when(F.col("n_chars") % 3 != 0, "_synthetic_").otherwise("_crop_"),
                    F.col("doc_id").cast("string"),
                    F.when(F.col("n_chars") % 5 == 0, ".txt").otherwise(".jpg"))
    label = F.concat_ws("_", "lang", "source")
    return d.select("doc_id", label.alias("label"), name.alias("name"),
                    F.concat_ws("/", F.lit("data"), "source", "lang", name).alias("path"))


SQL_FILES = """files AS (
  SELECT doc_id, lang || '_' || source AS label, name, 'data/' || source || '/' || lang || '/' || name AS path
  FROM (SELECT *, source || CASE WHEN n_chars % 2 = 0 THEN '_shiny' ELSE '' END
    || CASE WHEN n_chars % 3 <> 0 THEN '_synthetic_' ELSE '_crop_' END || doc_id
    || CASE WHEN n_chars % 5 = 0 THEN '.txt' ELSE '.jpg' END AS name FROM documents))"""
