"""Flatten nested tournament payloads into the four contract tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Column contracts of the four stored tables.
TOURNAMENT_COLUMNS = ["date", "decklists", "format", "game", "is_online", "name", "organizer",
                      "players", "tournament_id", "url"]
STANDING_COLUMNS = ["country", "drop_round", "is_winner", "losses", "placing", "player_id",
                    "player_name", "players_in_tournament", "ties", "tournament_id",
                    "tournament_name", "weighted_score", "wins"]
TEAMLIST_COLUMNS = ["ability", "item", "losses", "move_1", "move_2", "move_3", "move_4", "placing",
                    "player_id", "player_name", "players_in_tournament", "entity", "raw",
                    "team_slot", "tera_type", "ties", "tournament_id", "tournament_name", "wins"]
MATCH_COLUMNS = ["match", "phase", "player1", "player1_result", "player2", "player2_result", "raw",
                 "round", "table", "tournament_id", "tournament_name", "winner"]
CONTRACTS = {
    "tournaments": TOURNAMENT_COLUMNS,
    "standings": STANDING_COLUMNS,
    "teamlists": TEAMLIST_COLUMNS,
    "matches": MATCH_COLUMNS,
}

_JSON = {"ignoreNullFields": "false"}
_RENAMED = {"is_online": "isOnline", "tournament_id": "id"}


def flatten_tournaments(listing: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """One contract row per listed tournament; detail fields win over listing fields."""
    def field(side: str, name: str) -> Column:
        return F.col(f"{side}.{_RENAMED.get(name, name)}")

    rows = listing.alias("l")
    shared: set[str] = set()
    if details is not None:
        rows = rows.join(details.alias("d"), F.col("l.id") == F.col("d.id"), "left")
        shared = set(details.columns)
    columns = []
    for name in TOURNAMENT_COLUMNS:
        source = _RENAMED.get(name, name)
        value = field("l", name)
        if source in shared:
            value = F.coalesce(field("d", name), value)
        if name == "tournament_id":
            value = F.coalesce(value.cast("string"), F.lit(""))
        columns.append(value.alias(name))
    return rows.select(*columns)


def _standings(payload: DataFrame) -> DataFrame:
    return payload.select(
        F.col("id").alias("tournament_id"), F.col("name").alias("tournament_name"),
        F.col("players").alias("players_in_tournament"), F.explode("standings").alias("s"),
    )


def flatten_standings(payload: DataFrame) -> DataFrame:
    return _standings(payload).select(
        "tournament_id", "tournament_name", "players_in_tournament",
        F.col("s.country").alias("country"), F.col("s.dropRound").alias("drop_round"),
        F.coalesce(F.col("s.placing") == 1, F.lit(False)).alias("is_winner"),
        F.col("s.losses").alias("losses"), F.col("s.placing").alias("placing"),
        F.col("s.player").alias("player_id"), F.col("s.name").alias("player_name"),
        F.col("s.ties").alias("ties"), F.col("s.score").alias("weighted_score"),
        F.col("s.wins").alias("wins"),
    ).select(*STANDING_COLUMNS)


def flatten_teamlists(payload: DataFrame) -> DataFrame:
    """One row per decklist element, slots numbered from 1; no decklist gives no rows."""
    slots = _standings(payload).select("*", F.posexplode("s.decklist").alias("pos", "e"))
    moves = [F.get("e.attacks", F.lit(i)).alias(f"move_{i + 1}") for i in range(4)]
    return slots.select(
        "tournament_id", "tournament_name", "players_in_tournament",
        F.col("e.ability").alias("ability"), F.col("e.item").alias("item"),
        F.col("s.losses").alias("losses"), *moves,
        F.col("s.placing").alias("placing"), F.col("s.player").alias("player_id"),
        F.col("s.name").alias("player_name"), F.col("e.name").alias("entity"),
        F.to_json("e", _JSON).alias("raw"), (F.col("pos") + 1).alias("team_slot"),
        F.col("e.tera").alias("tera_type"), F.col("s.ties").alias("ties"),
        F.col("s.wins").alias("wins"),
    ).select(*TEAMLIST_COLUMNS)


def pairing_result(player: Column, winner: Column) -> Column:
    """``win``/``loss`` for a known player and winner, ``tie/other`` otherwise."""
    undecided = winner.isNull() | winner.isin("-1", "") | player.isNull() | (player == "")
    return F.when(undecided, "tie/other").when(player == winner, "win").otherwise("loss")


def flatten_matches(payload: DataFrame) -> DataFrame:
    """Explode pairings; a pairing without a winner reads as -1."""
    rows = payload.select(
        F.col("id").alias("tournament_id"), F.col("name").alias("tournament_name"),
        F.explode("pairings").alias("p"),
    )
    winner = F.coalesce(F.col("p.winner").cast("string"), F.lit("-1"))
    return rows.select(
        "tournament_id", "tournament_name",
        *[F.col(f"p.{c}").alias(c) for c in ("match", "phase", "player1", "player2", "round", "table")],
        pairing_result(F.col("p.player1"), winner).alias("player1_result"),
        pairing_result(F.col("p.player2"), winner).alias("player2_result"),
        F.to_json("p", _JSON).alias("raw"), winner.alias("winner"),
    ).select(*MATCH_COLUMNS)
