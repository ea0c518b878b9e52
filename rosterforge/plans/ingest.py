"""Flattening of nested payloads, checked by un-nesting back to the flat stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterforge.functions.strings import iso_date as iso_date_col
from rosterforge.operators import ingest as ops
from rosterforge.plans.registry import query
from rosterforge.plans.standins import (
    SQL_MATCHES, SQL_TEAMS, SQL_TOURNAMENTS, payloads, table, tournaments,
)


@query("flatten_tournaments", f"""WITH {SQL_TOURNAMENTS}
SELECT t.date, t.decklists, t.format, t.game, t.is_online,
  CASE WHEN c.c_custkey IS NOT NULL AND t.players % 2 = 0 THEN c.c_name ELSE t.name END AS name,
  t.organizer, t.players, CAST(t.id AS VARCHAR) AS tournament_id, t.url
FROM tournaments t LEFT JOIN customer c ON c.c_custkey = t.organizer""")
def flatten_tournaments(spark, sf):
    listing = tournaments(spark, sf)
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("organizer"), "c_name")
    details = listing.join(names, "organizer").select(
        "id", F.when(F.col("players") % 2 == 0, F.col("c_name")).alias("name"))
    return ops.flatten_tournaments(listing, details)


@query("flatten_standings", f"""WITH {SQL_TEAMS}, {SQL_TOURNAMENTS}
SELECT 'XX' AS country, CAST(NULL AS INTEGER) AS drop_round, p."placing" = 1 AS is_winner, p.losses, p."placing",
  p.player_id, 'N' || p.player_id AS player_name, t.players AS players_in_tournament, 0 AS ties,
  p.tournament_id, t.name AS tournament_name, p.score AS weighted_score, p.wins
FROM teams p JOIN tournaments t ON CAST(t.id AS VARCHAR) = p.tournament_id""")
def flatten_standings(spark, sf):
    return ops.flatten_standings(payloads(spark, sf))


@query("flatten_teamlists", f"""WITH {SQL_TEAMS}, {SQL_TOURNAMENTS}
SELECT 'a' AS ability, s.item, p.losses, s.move_1, s.move_2, s.move_4 AS move_3, CAST(NULL AS VARCHAR) AS move_4,
  p."placing", s.player_id, 'N' || s.player_id AS player_name, t.players AS players_in_tournament, s.entity,
  '{{"name":"' || s.entity || '","ability":"a","item":"' || s.item || '","tera":"' || s.move_3 || '","attacks":["'
    || s.move_1 || '","' || s.move_2 || '"' || coalesce(',"' || s.move_4 || '"', '') || ']}}' AS raw,
  s.team_slot, s.move_3 AS tera_type, 0 AS ties, s.tournament_id, t.name AS tournament_name, p.wins
FROM slotted s JOIN teams p USING (tournament_id, player_id)
JOIN tournaments t ON CAST(t.id AS VARCHAR) = s.tournament_id""")
def flatten_teamlists(spark, sf):
    return ops.flatten_teamlists(payloads(spark, sf))


@query("flatten_matches", f"""WITH {SQL_MATCHES}
SELECT match, 1 AS phase, player1, player2, 1 AS round, tbl AS "table", coalesce(winner, '-1') AS winner,
  CASE WHEN coalesce(winner, '-1') = '-1' THEN 'tie/other' WHEN winner = player1 THEN 'win' ELSE 'loss' END AS player1_result,
  CASE WHEN coalesce(winner, '-1') = '-1' OR player2 IS NULL THEN 'tie/other'
    WHEN winner = player2 THEN 'win' ELSE 'loss' END AS player2_result,
  tournament_id, 'T' || tournament_id AS tournament_name
FROM matches WHERE EXISTS (SELECT 1 FROM orders WHERE CAST(o_orderkey AS VARCHAR) = tournament_id)""")
def flatten_matches(spark, sf):
    return ops.flatten_matches(payloads(spark, sf)).drop("raw")


@query("iso_date", """SELECT event_id, CASE WHEN event_type = 'error' THEN '' ELSE
  strftime(ts, '%Y-%m-%d') END AS day FROM events""")
def iso_date(spark, sf):
    stamp = F.when(F.col("event_type") != "error", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return table(spark, sf, "events").select("event_id", iso_date_col(stamp).alias("day"))
