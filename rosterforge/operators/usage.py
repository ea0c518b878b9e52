"""Usage statistics: counts, top-k attributes, thresholds and representative sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterforge.functions.ranking import top_k_per_key

MOVE_COLUMNS = ("move_1", "move_2", "move_3", "move_4")
TOP_MOVES_KEPT = 6

# Display order of formats; anything else ranks 100.
TIER_RANKS = {
    "ou": 0, "ubers": 1, "uu": 2, "ru": 3, "nu": 4, "pu": 5, "lc": 6, "doublesou": 7, "vgc": 8,
    "bss": 9, "monotype": 10, "nationaldex": 11, "nationaldexubers": 12, "nationaldexuu": 13,
    "nationaldexru": 14, "nationaldexmonotype": 15, "anythinggoes": 16, "1v1": 17,
    "balancedhackmons": 18, "purehackmons": 19, "almostanyability": 20, "zu": 21, "cap": 22,
    "tradebacksou": 23,
}
UNKNOWN_TIER = 100
# Formats whose usage needs a higher share.
LOW_QUALITY_FORMATS = "uber|anythinggoes|doublesou|gen1nu|gen1pu"
# Order of the values in a spread.
SPREAD_STATS = ("hp", "attack", "defense", "special_attack", "special_defense", "speed")
# Purposes by folder-name fragment, first match wins.
FOLDER_PURPOSES = (
    ("real", "Real sorted classifier data"),
    ("debug|crop", "Debug/crop images - may be useful after sorting"),
    ("upload", "Raw uploaded/camera images - useful for full slot detector"),
    ("type", "Type icon/type combo images"),
    ("sprite_detector|yolo", "Object detection dataset"),
)
DEFAULT_PURPOSE = "Unknown image folder"
IGNORED_FOLDERS = (".git", "__pycache__", "node_modules", ".venv", "venv")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "bmp")


def value_counts(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))


def top_k_values(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """The k most frequent values per key, ties by value."""
    return top_k_per_key(value_counts(df, key, value), [key], [F.desc("n"), F.asc(value)], k)


def top_items_per_entity(teamlists: DataFrame, k: int) -> DataFrame:
    return top_k_values(teamlists, "entity", "item", k)


def stacked_moves(teamlists: DataFrame) -> DataFrame:
    return teamlists.select("entity", F.explode(F.array(*MOVE_COLUMNS)).alias("move"))


def top_moves_per_entity(teamlists: DataFrame, k: int = TOP_MOVES_KEPT) -> DataFrame:
    return top_k_values(stacked_moves(teamlists), "entity", "move", k)


def usage_summary(teamlists: DataFrame, k: int = TOP_MOVES_KEPT) -> DataFrame:
    """Appearances, results, win rate and ranked moves and items per entity.

    One scan: every roster row becomes one total, one item and up to four move facts, which
    are counted together; the shuffle carries partial counts, never roster rows.
    """
    fact = "struct<kind:string,value:string,wins:bigint,losses:bigint>"

    def entry(kind: str, value: Column, wins: Column, losses: Column) -> Column:
        return F.struct(F.lit(kind), value, wins, losses).cast(fact)

    zero = F.lit(0)
    facts = F.array(
        entry("total", F.lit(""), F.coalesce("wins", zero), F.coalesce("losses", zero)),
        entry("item", F.col("item"), zero, zero),
        *[entry("move", F.col(m), zero, zero) for m in MOVE_COLUMNS],
    )
    counts = (
        teamlists.select("entity", F.explode(facts).alias("f")).select("entity", "f.*")
        .where(F.col("value").isNotNull())
        .groupBy("entity", "kind", "value")
        .agg(F.count("*").alias("n"), F.sum("wins").alias("wins"), F.sum("losses").alias("losses"))
    )
    ranked = top_k_per_key(counts, ["entity", "kind"], [F.desc("n"), F.asc("value")], k)

    def ranked_array(kind: str) -> Column:
        value = F.when(F.col("kind") == kind,
                       F.struct("rank", F.col("value").alias(kind), F.col("n").alias("count")))
        return F.transform(F.array_sort(F.collect_list(value)),
                           lambda s: F.struct(s[kind].alias(kind), s["count"].alias("count")))

    total = F.col("kind") == "total"
    summary = ranked.groupBy("entity").agg(
        F.max(F.when(total, F.col("n"))).alias("appearances"),
        F.max(F.when(total, F.col("wins"))).alias("wins"),
        F.max(F.when(total, F.col("losses"))).alias("losses"),
        ranked_array("move").alias("top_moves"),
        ranked_array("item").alias("top_items"),
    )
    games = F.col("wins") + F.col("losses")
    return summary.select(
        "entity", "appearances", "wins", "losses", games.alias("games"),
        F.coalesce(F.try_divide(F.col("wins"), games), F.lit(0.0)).alias("win_rate"),
        "top_moves", "top_items",
    )


def top_teams_per_entity(teamlists: DataFrame, k: int) -> DataFrame:
    """Best-placed teams holding an entity, with the ordered member list.

    The k teams are chosen first; members are gathered only for chosen teams.
    """
    team = ["tournament_id", "player_id"]
    teams = teamlists.groupBy("entity", *team).agg(F.min("placing").alias("placing"))
    order = [F.asc_nulls_last("placing"), F.asc("tournament_id"), F.asc("player_id")]
    best = top_k_per_key(teams, ["entity"], order, k)
    members = (
        teamlists.join(best.select(*team).distinct(), team, "left_semi")
        .groupBy(*team)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("team_slot", "entity"))),
                         lambda s: s["entity"]).alias("members"))
    )
    return best.join(members, team).select("entity", "rank", *team, "placing", "members")


def usage_lookup(names: DataFrame, usage: DataFrame, name: str = "name", entity: str = "entity") -> DataFrame:
    """Case- and edge-space-insensitive lookup; an all-zero record on a miss."""
    key = F.lower(F.trim(F.coalesce(F.col(entity), F.lit(""))))
    rest = [c for c in usage.columns if c != entity]
    table = usage.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*rest), F.col(entity)).alias("u"))
    joined = names.join(table, F.lower(F.trim(F.coalesce(F.col(name), F.lit("")))) == F.col("_key"), "left")

    def default(field) -> Column:
        value = F.col(f"u.{field.name}")
        kind = field.dataType.simpleString()
        empty = F.array().cast(kind) if kind.startswith("array") else F.lit(0).cast(kind)
        return F.coalesce(value, empty).alias(field.name)

    fields = [f for f in usage.schema.fields if f.name != entity]
    return joined.select(*names.columns, *[default(f) for f in fields], F.col("_key").isNotNull().alias("found"))


def usage_threshold(format_col: Column, battles: Column) -> Column:
    """Least weighted share that counts as used; infinity for tiny formats."""
    return (
        F.when(battles < 100, F.lit(float("inf")))
        .when(battles < 400, F.lit(0.05))
        .when(format_col.rlike(LOW_QUALITY_FORMATS), F.lit(0.03))
        .otherwise(F.lit(0.01))
    )


def usage_threshold_filter(usage: DataFrame, formats: DataFrame, curated: DataFrame) -> DataFrame:
    return (
        usage.join(formats, "format")
        .where(F.col("weighted") >= usage_threshold(F.col("format"), F.col("battles")))
        .join(curated, ["format", "entity"], "left_anti")
    )


def top_of_map(weights: Column, n: int) -> Column:
    """Keys of the n heaviest entries; ties keep map order."""
    ranked = F.array_sort(F.transform(
        F.map_entries(weights),
        lambda e, i: F.struct((-e["value"].cast("double")).alias("w"), i.alias("i"), e["key"].alias("k"))))
    return F.slice(F.transform(ranked, lambda s: s["k"]), 1, n)


def representative_set(usage: DataFrame) -> DataFrame:
    """One set per row from weighted maps ``spreads items abilities moves``."""
    def top1(column: str, none: str) -> Column:
        best = F.get(top_of_map(F.col(column), 1), F.lit(0))
        return F.coalesce(F.nullif(best, F.lit(none)), F.lit(""))

    spread = F.get(top_of_map(F.col("spreads"), 1), F.lit(0))
    values = F.split(F.split_part(spread, F.lit(":"), F.lit(2)), "/")
    stats = [F.coalesce(F.get(values, F.lit(i)).try_cast("int"), F.lit(0)).alias(s)
             for i, s in enumerate(SPREAD_STATS)]
    return usage.select(
        "*", top1("items", "Nothing").alias("item"), top1("abilities", "No Ability").alias("ability"),
        F.filter(top_of_map(F.col("moves"), 4), lambda m: m != "Nothing").alias("top_moves"),
        F.split_part(spread, F.lit(":"), F.lit(1)).alias("nature"), *stats,
    )


def tier_rank(col: Column) -> Column:
    folded = (
        F.when(col.startswith("vgc"), "vgc")
        .when(col.startswith("battlestadium") | col.startswith("battlespot"), "bss")
        .otherwise(col)
    )
    table = F.create_map(*[F.lit(x) for pair in TIER_RANKS.items() for x in pair])
    return F.coalesce(table[folded], F.lit(UNKNOWN_TIER))


def tier_order(formats: DataFrame, col: str = "format") -> DataFrame:
    return formats.withColumn("tier_rank", tier_rank(F.col(col))).orderBy("tier_rank", col)


def class_balance(files: DataFrame, target: int) -> DataFrame:
    """Normal and marked variants of synthetic images per label."""
    name = F.lower("name")
    counted = F.col("name").like("%\\_synthetic\\_%.jpg")
    marked = name.contains("_shiny_")
    counts = files.groupBy("label").agg(
        F.count_if(counted & ~marked).alias("normal"), F.count_if(counted & marked).alias("shiny"))
    complete = (F.col("normal") == target) & (F.col("shiny") == target)
    return counts.withColumn("complete", complete)


def _images(files: DataFrame) -> DataFrame:
    parts = F.split("path", "/")
    name = F.lower(F.element_at(parts, -1))
    ignored = F.arrays_overlap(parts, F.array(*[F.lit(p) for p in IGNORED_FOLDERS]))
    image = F.element_at(F.split(name, "\\."), -1).isin(*IMAGE_EXTENSIONS) & name.contains(".")
    return files.where(~ignored & image).withColumn("_synthetic", name.contains("synthetic"))


def folder_purpose(folder: Column, purposes=FOLDER_PURPOSES) -> Column:
    """Purpose by the first pattern found in the lower-cased folder."""
    text = F.lower(folder)
    chain = F.when(F.lit(False), "")
    for pattern, purpose in purposes:
        chain = chain.when(text.rlike(pattern), purpose)
    return chain.otherwise(DEFAULT_PURPOSE)


def folder_inventory(files: DataFrame, purposes=FOLDER_PURPOSES) -> DataFrame:
    """Real images per folder: count, first path, purpose; largest first."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    counts = (
        _images(files).where(~F.col("_synthetic")).groupBy(folder.alias("folder"))
        .agg(F.count("*").alias("image_count"), F.min("path").alias("first_image"))
    )
    return counts.withColumn("purpose", folder_purpose(F.col("folder"), purposes)).orderBy(
        F.desc("image_count"), F.asc("folder"))


def folder_inventory_totals(files: DataFrame) -> DataFrame:
    folder = F.when(~F.col("_synthetic"), F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    return _images(files).agg(
        F.count_if("_synthetic").alias("synthetic_ignored"), F.count_distinct(folder).alias("folders"))
