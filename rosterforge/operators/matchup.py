"""Stat tables, damage rolls, matchups and speed order.

Rolls live in an array beside their pair, so rolls, hit counts, summaries and n-hit chances are
all row-wise: a matchup table of any size is computed without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterforge.functions import battle as B
from rosterforge.session import spread

# Total and single limits of stat points.
MAX_STAT_POINTS = 32
MAX_TOTAL_POINTS = 66
# Spellings of a stat field, first present wins.
STAT_ALIASES = {
    "hp": ("hp", "base_hp", "HP"),
    "attack": ("attack", "base_attack", "Attack"),
    "defense": ("defense", "base_defense", "Defense"),
    "special_attack": ("special_attack", "specialAttack", "sp_attack", "spAtk", "Sp. Atk"),
    "special_defense": ("special_defense", "specialDefense", "sp_defense", "spDef", "Sp. Def"),
    "speed": ("speed", "base_speed", "Speed"),
}
NESTED_STATS = ("baseStats", "base_stats", "stats")
# Factors in the order they apply; the second group rounds half down.
FLOORED_FIRST = ("f_spread", "f_weather", "f_critical", "roll", "f_stab", "f_type", "f_burn",
                 "f_screen", "f_terrain", "f_charge")
ROUNDED = ("f_attacker_item", "f_defender_item", "f_attacker_ability", "f_defender_ability")
# Members of one block, and of a roster that is sent to all tasks whole.
ROSTER_ROWS, SHIPPED_ROWS = 64, 65_536
# 16 ** 15 fits a 64-bit count, 16 ** 31 a decimal of 38 digits.
NARROW_HITS, MAX_HITS = 15, 31


def coalesce_fields(df: DataFrame, spec: Mapping[str, Sequence[str]] = STAT_ALIASES,
                    nested: Sequence[str] = NESTED_STATS) -> DataFrame:
    """One column per stat from the first present spelling, top level before nested structs.

    Only spellings the schema really has are read. ``missing`` lists stats without a value.
    """
    top = set(df.columns)
    structs = {f.name: set(f.dataType.fieldNames()) for f in df.schema.fields
               if f.name in nested and hasattr(f.dataType, "fieldNames")}

    def quoted(*path: str) -> Column:
        return F.col(".".join(f"`{p}`" for p in path))

    values = {}
    for stat, names in spec.items():
        found = [quoted(n) for n in names if n in top]
        inner = F.lit(None)
        for holder in reversed([n for n in nested if n in structs]):
            own = [quoted(holder, n) for n in names if n in structs[holder]]
            own_value = F.coalesce(*own) if own else F.lit(None)
            inner = F.when(quoted(holder).isNotNull(), own_value).otherwise(inner)
        values[stat] = F.coalesce(*[c.cast("int") for c in found], inner.cast("int"))
    spellings = {n.lower() for names in spec.values() for n in names}
    kept = [quoted(c) for c in df.columns if c.lower() not in spellings and c not in structs]
    missing = F.array_compact(F.array(*[F.when(v.isNull(), F.lit(s)) for s, v in values.items()]))
    return df.select(*kept, *[v.alias(s) for s, v in values.items()], missing.alias("missing"))


def level_stats(df: DataFrame, level: int = 50, iv: int = 31, nature: str | Column = "nature",
                ev_prefix: str | None = None) -> DataFrame:
    """Add ``final_<stat>`` at ``level``."""
    named = F.col(nature) if isinstance(nature, str) else nature
    out = []
    for stat in B.STAT_NAMES:
        ev = F.coalesce(F.col(f"{ev_prefix}{stat}"), F.lit(0)) if ev_prefix else F.lit(0)
        out.append(B.level_stat(stat, F.col(stat), F.lit(level), F.lit(iv), ev, named).alias(f"final_{stat}"))
    return df.select("*", *out)


def invested_stats(df: DataFrame, nature: str = "nature") -> DataFrame:
    """Add ``invested_<stat>`` from base, ``points_<stat>`` and nature; no base: final + points."""
    out = []
    for stat in B.STAT_NAMES:
        base = F.coalesce(F.col(stat), F.lit(0))
        points = F.coalesce(F.col(f"points_{stat}"), F.lit(0))
        core = B.int_div((2 * base + 31) * 50, 100)
        if stat == "hp":
            grown = core + 60 + points
        else:
            grown = B.int_div((core + 5 + points) * B.nature_tenths(stat, F.col(nature)), 10)
        bare = F.coalesce(F.col(f"final_{stat}"), F.lit(0)) + points
        out.append(F.when(base == 0, bare).otherwise(grown).cast("long").alias(f"invested_{stat}"))
    return df.select("*", *out)


def clamp_points(requested: Column, others: Column) -> Column:
    """Points granted to one stat: within [0, 32] and the 66 in total."""
    left = F.greatest(F.lit(0), MAX_TOTAL_POINTS - others)
    return F.least(F.greatest(F.lit(0), F.coalesce(requested, F.lit(0))), F.lit(MAX_STAT_POINTS), left)


def stat_total(df: DataFrame) -> DataFrame:
    """Sum of the six stats and the highest stat other than hp (first wins ties)."""
    values = [F.coalesce(F.col(s), F.lit(0)) for s in B.STAT_NAMES]
    total = values[0]
    for value in values[1:]:
        total = total + value
    others = F.array(*values[1:])
    names = F.array(*[F.lit(s) for s in B.STAT_NAMES[1:]])
    best = F.get(names, (F.array_position(others, F.array_max(others)) - 1).cast("int"))
    return df.select("*", total.alias("stat_total"), best.alias("highest_stat"))


def type_multipliers(pairs: DataFrame, move_type: str = "move_type", types: str = "defender_types") -> DataFrame:
    factor = B.type_multiplier(F.col(move_type), F.col(types))
    return pairs.withColumn("f_type", factor).withColumn(
        "effectiveness", B.effectiveness_label(F.col("f_type")))


def _chain(columns: Sequence[str]) -> tuple[Column, Column, Callable[[Column, Column], Column]]:
    """Damage before the roll, whether it is immune, and the step from (roll, start) to damage.

    Only factor columns that exist take part; a null factor counts as 1.
    """
    def factor(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(1.0)) if name in columns else F.lit(1.0)

    base = B.base_damage(F.col("level"), F.col("power"), F.col("attack"), F.col("defense"))
    head = FLOORED_FIRST.index("roll")
    start = B.product_floor(base, [factor(n) for n in FLOORED_FIRST[:head] if n in columns])
    immune = (factor("f_weather") == 0) | (factor("f_type") == 0) | (F.coalesce("power", F.lit(0)) <= 0)

    def one(roll: Column, value: Column) -> Column:
        value = B.long_floor(value * (roll / 100))
        value = B.product_floor(value, [factor(n) for n in FLOORED_FIRST[head + 1:] if n in columns])
        for name in ROUNDED:
            if name in columns:
                value = B.round_half_down(value * factor(name))
        if "f_helping_hand" in columns:
            value = B.long_floor(value * factor("f_helping_hand"))
        if "f_friend_guard" in columns:
            value = B.round_half_down(value * factor("f_friend_guard"))
        return F.greatest(F.lit(1).cast("long"), value)

    return start, immune, one


def damage_rolls(pairs: DataFrame) -> DataFrame:
    """One row per roll: ``roll`` 85..100 and ``dmg``, from level, power, attack, defense and factors.

    Scalar arithmetic after a constant explode, so the whole chain is generated code.
    """
    start, immune, one = _chain(pairs.columns)
    rows = pairs.select("*", start.alias("_start"), immune.alias("_immune"),
                        F.explode(F.sequence(F.lit(B.ROLLS[0]), F.lit(B.ROLLS[1]))).alias("roll"))
    dmg = F.when(F.col("_immune"), F.lit(0).cast("long")).otherwise(one(F.col("roll"), F.col("_start")))
    return rows.select(*pairs.columns, "roll", dmg.alias("dmg"))


def with_rolls(pairs: DataFrame) -> DataFrame:
    """The same damage as an ascending array ``rolls`` of 16 beside its pair."""
    start, immune, one = _chain(pairs.columns)
    rolls = F.element_at(F.transform(F.array(start), lambda value: F.transform(
        F.sequence(F.lit(B.ROLLS[0]), F.lit(B.ROLLS[1])), lambda r: one(r, value))), 1)
    return pairs.withColumn("rolls", F.when(immune, F.array_repeat(F.lit(0).cast("long"), 16)).otherwise(rolls))


def expand_hit_counts(moves: DataFrame, rules: DataFrame, key: str = "move", weighted: bool = False) -> DataFrame:
    """One row per possible hit count of a move with its probability.

    ``rules`` has ``key`` and ``outcomes array<struct<hits, p>>``; a fixed ``hits`` above one on
    the move wins, and a move without a rule hits once. Pooling ignores the probabilities unless
    ``weighted``, in which case ``weight`` carries them.
    """
    def single(hits: Column) -> Column:
        return F.array(F.struct(hits.cast("int").alias("hits"), F.lit(1.0).alias("p")))

    fixed = F.coalesce(F.col("hits"), F.lit(1)) if "hits" in moves.columns else F.lit(1)
    outcomes = F.when(fixed > 1, single(fixed)).otherwise(F.coalesce(F.col("outcomes"), single(F.lit(1))))
    rows = moves.join(rules.select(key, "outcomes"), key, "left").withColumn("_o", F.explode(outcomes))
    kept = [c for c in moves.columns if c != "hits"]
    weight = F.col("_o.p") if weighted else F.lit(1.0)
    return rows.select(*kept, F.col("_o.hits").alias("hits"), F.col("_o.p").alias("p"), weight.alias("weight"))


def pooled_totals(rolls: Column, hit_counts: Column) -> Column:
    """Totals of every roll for every possible hit count, pooled and sorted; rolls are worked out once, not per count."""
    return F.element_at(F.transform(F.array(rolls), lambda each: F.array_sort(
        F.flatten(F.transform(hit_counts, lambda h: F.transform(each, lambda d: d * h))))), 1)


def ko_class(totals: Column, hp: Column, low: Column | None = None, high: Column | None = None,
             one: Column | None = None) -> Column:
    """Knock-out class of pooled totals against the remaining hit points."""
    n = F.size(totals)
    one = F.size(F.filter(totals, lambda d: d >= hp)) if one is None else one
    low = F.array_min(totals) if low is None else low
    high = F.array_max(totals) if high is None else high
    share = F.bround(one / n * 100, 1)
    return (
        F.when((n == 0) | (hp <= 0) | totals.isNull(), "Unknown")
        .when(one == n, "Guaranteed OHKO")
        .when(one > 0, F.concat(share.cast("string"), F.lit("% chance to OHKO")))
        .when(low * 2 >= hp, "Guaranteed 2HKO").when(high * 2 >= hp, "Possible 2HKO")
        .when(low * 3 >= hp, "Guaranteed 3HKO").when(high * 3 >= hp, "Possible 3HKO")
        .otherwise("Likely 4HKO or worse")
    )


def damage_summary(rolled: DataFrame, totals: str = "totals", hp: str = "hp", max_hp: str = "max_hp") -> DataFrame:
    """Replace pooled totals by min, max, mean, percents, sorted values and class, row by row."""
    kept = [c for c in rolled.columns if c != totals]
    rows = rolled.select(*kept, F.array_sort(totals).alias("_t"))
    t = F.col("_t")
    rows = rows.select(
        *kept, "_t", F.array_min(t).alias("_low"), F.array_max(t).alias("_high"),
        F.size(F.filter(t, lambda d: d >= F.col(hp))).alias("_one"),
        (F.aggregate(t, F.lit(0).cast("long"), lambda a, d: a + d) / F.nullif(F.size(t), F.lit(0))).alias("_mean"))
    low, high = F.col("_low"), F.col("_high")

    def percent(value: Column) -> Column:
        return F.when((F.col(max_hp) <= 0) | value.isNull(), 0.0).otherwise(F.bround(value / F.col(max_hp) * 100, 1))

    return rows.select(
        *kept, F.coalesce(low, F.lit(0)).alias("min_damage"), F.coalesce(high, F.lit(0)).alias("max_damage"),
        F.coalesce(F.bround("_mean", 2), F.lit(0.0)).alias("mean_damage"), t.alias("damage_values"),
        percent(low).alias("min_percent"), percent(high).alias("max_percent"),
        ko_class(t, F.col(hp), low, high, F.col("_one")).alias("ko_class"))


def pair_with_roster(rows: DataFrame, roster: DataFrame, name: str = "other") -> DataFrame:
    """Every row of ``rows`` beside every member of ``roster`` as a struct column.

    A roster of at most 64 members (checked by a bounded count) travels as one array inside
    the plan and is unpacked row by row: no join, no shuffle. A larger one is cut into blocks, each
    one array, and every row meets every block where it lies, however few blocks there are.
    """
    member = F.struct(*[F.col(c) for c in roster.columns])
    if roster.limit(ROSTER_ROWS + 1).count() <= ROSTER_ROWS:
        packed = roster.agg(F.collect_list(member).alias("members")).scalar()
        return rows.withColumn(name, F.explode(packed))
    size = roster.count()
    blocks = -(-size // ROSTER_ROWS)
    key = F.pmod(F.xxhash64(*[c for c, kind in roster.dtypes if "map<" not in kind]), F.lit(blocks)).cast("int")
    parts = roster.groupBy(key.alias("_block")).agg(F.collect_list(member).alias("_members")).select("_members")
    met = rows.crossJoin(F.broadcast(parts) if size <= SHIPPED_ROWS else parts)
    return met.withColumn(name, F.explode("_members")).drop("_members")


def matchup_matrix(entities: DataFrame, roster: DataFrame, mode: str = "one-vs-all",
                   tiers: Sequence[str] | None = None) -> DataFrame:
    """Best move of each attacker against each defender.

    Both sides carry ``name, types, moves array<struct<move, move_type, power, attack>>,
    defense, hp, level`` and ``entities`` also ``tier``. In ``one-vs-all`` the roster attacks
    every entity, otherwise every entity attacks the roster. The move with the highest maximum
    wins, the first on ties; percents are floored to a tenth. What depends on one side alone (strength and
    bonus of a move, factors of a defender) is worked out before the pairs form; rows are dealt out
    first, since each makes as many pairs as the roster has members.
    """
    rows = entities.where(F.col("tier").isin(list(tiers))) if tiers else entities

    def readied(side: DataFrame, attacks: bool) -> DataFrame:
        if not attacks:
            return side.select("name", "hp", F.greatest(F.lit(1), "defense").alias("wall"), B.type_multipliers(F.col("types")).alias("factors"))

        def move(m: Column) -> Column:
            stab = F.when(F.array_contains(F.col("types"), m["move_type"]), 1.5).otherwise(1.0)
            return F.struct(m["move"].alias("move"), F.lower(F.trim(m["move_type"])).alias("tag"), (m["power"] <= 0).alias("idle"),
                            B.attack_strength(F.col("level"), m["power"], m["attack"]).alias("strength"), stab.alias("stab"))

        return side.select("name", F.transform("moves", move).alias("moves"))

    one = mode == "one-vs-all"
    mine = readied(spread(rows), not one)
    pairs = pair_with_roster(mine.select(F.struct(*mine.columns).alias("me")), readied(roster, one), "other")
    att, dfn = ("other", "me") if one else ("me", "other")

    def scored(move: Column, index: Column) -> Column:
        factor = F.coalesce(F.col(f"{dfn}.factors")[move["tag"]], F.lit(1.0))
        base = B.int_div(B.long_floor(move["strength"] / F.col(f"{dfn}.wall")), 50) + 2
        return F.struct(factor.alias("f"), base.alias("b"), index.alias("pos"), move.alias("m"))

    def hit(s: Column, roll: int) -> Column:
        value = B.product_floor(s["b"], [F.lit(roll / 100), s["m"]["stab"], s["f"]])
        return F.when((s["f"] == 0) | s["m"]["idle"], F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), value))

    def ranked(s: Column) -> Column:
        return F.struct((-hit(s, 100)).alias("neg_max"), s["pos"].alias("pos"), hit(s, 85).alias("lo"), s["m"]["move"].alias("move"))

    best = F.array_min(F.transform(F.transform(F.col(f"{att}.moves"), scored), ranked))
    hp = F.col(f"{dfn}.hp")
    out = pairs.withColumn("_best", best)
    return out.select(
        F.col(f"{att}.name").alias("attacker"), F.col(f"{dfn}.name").alias("defender"),
        F.col("_best.move").alias("move"), F.col("_best.lo").alias("min_damage"),
        (-F.col("_best.neg_max")).alias("max_damage"),
        (F.floor(F.col("_best.lo") * 1000 / hp) / 10).alias("min_percent"),
        (F.floor(-F.col("_best.neg_max") * 1000 / hp) / 10).alias("max_percent"))


def ko_chance_n_hits(rolled: DataFrame, n: int, rolls: str = "rolls", hp: str = "hp",
                     residual: str | None = None, max_hp: str | None = None,
                     toxic: str | None = None) -> DataFrame:
    """Exact probability that ``n`` hits reach ``hp``, with the number of winning roll tuples.

    ``residual`` is the end-of-turn gain; a net gain is ignored on the last turn. ``toxic`` is
    the poison counter, which grows by one per turn. The distribution of the sum is an integer
    convolution inside Arrow batches, once per distinct distribution, exact and without a shuffle;
    equal sums merge, so it is never binned.
    """
    zero = F.lit(0).cast("long")
    eot = F.coalesce(F.col(residual).cast("long"), zero) if residual else zero
    counter = F.coalesce(F.col(toxic), F.lit(0)) if toxic else None

    def poison(turn: int) -> Column:
        if counter is None:
            return zero
        return F.when(counter > 0, B.int_div((counter + turn) * F.col(max_hp), 16)).otherwise(zero)

    healed = F.least(zero, eot - poison(n - 1))
    for turn in range(n - 1):
        healed = healed + eot - poison(turn)
    return rolled.withColumn("ko_ways", winning_tuples(n)(F.col(rolls), F.col(hp).cast("long") + healed)).withColumn(
        "ko_chance", F.col("ko_ways").cast("double") / F.pow(F.size(rolls).cast("double"), F.lit(float(n))))


def distributions(rolls: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, which, low): the distinct distributions of rolls above their lowest one as rows of one
    matrix, and for each list its row there and its lowest roll."""
    size = np.array([len(r) for r in rolls])
    starts = np.cumsum(size) - size
    flat = np.concatenate(rolls).astype("int64")
    low = np.minimum.reduceat(flat, starts)
    padded = np.full((len(rolls), size.max()), -1, "int64")
    padded[np.repeat(np.arange(len(rolls)), size), np.arange(len(flat)) - np.repeat(starts, size)] = flat - np.repeat(low, size)
    shapes, which = np.unique(np.sort(padded, axis=1), axis=0, return_inverse=True)
    counts = np.zeros((len(shapes), int(shapes.max()) + 1), "int64")
    row, col = np.nonzero(shapes >= 0)
    np.add.at(counts, (row, shapes[row, col]), 1)
    return counts, which.reshape(-1), low


def winning_tuples(n: int):
    """Arrow function: how many of the roll tuples of length ``n`` sum to at least the need.

    A batch's distinct distributions form one matrix and are convolved together. Counts are 64-bit up
    to 15 hits of 16 rolls and decimals of 38 digits up to 31. Null or empty rolls, or a null need, give null.
    """
    if n > MAX_HITS:
        raise ValueError(f"more than {MAX_HITS} hits overflow a decimal count of tuples")
    wide = n > NARROW_HITS

    @F.pandas_udf("decimal(38,0)" if wide else "long")
    def count(rolls: pd.Series, need: pd.Series) -> pd.Series:
        known = np.array([r is not None and len(r) > 0 for r in rolls], bool) & need.notna().to_numpy()
        out = np.full(len(rolls), None, dtype=object)
        if known.any():
            single, which, low = distributions(list(rolls[known]))
            ways = single.astype(object) if wide else single
            for _ in range(n - 1):
                grown = np.zeros((len(single), ways.shape[1] + single.shape[1] - 1), ways.dtype)
                for shift in range(single.shape[1]):
                    grown[:, shift:shift + ways.shape[1]] += single[:, shift:shift + 1] * ways
                ways = grown
            reach = np.cumsum(ways[:, ::-1], axis=1)[:, ::-1]
            spot = np.maximum(0, need[known].to_numpy().astype("int64") - n * low)
            beyond = spot >= reach.shape[1]
            told = reach[which, np.minimum(spot, reach.shape[1] - 1)]
            told[beyond] = 0
            out[known] = [Decimal(int(v)) for v in told] if wide else told
        return pd.Series(out) if wide else pd.Series(out, dtype="Int64")

    return count


def part_of(hp: Column, by: int) -> Column:
    return F.greatest(F.lit(1).cast("long"), B.int_div(hp, by))


def hazard_damage(df: DataFrame) -> DataFrame:
    """Entry damage from ``stealth_rock`` and ``spikes_layers`` on ``types``, ``grounded``, ``max_hp``."""
    hp = F.col("max_hp")
    rock = F.greatest(F.lit(1).cast("long"), B.long_floor(hp * B.type_multiplier(F.lit("rock"), F.col("types")) / 8))
    floats = ~F.col("grounded") | F.array_contains("types", "flying") | (F.coalesce("ability", F.lit("")) == "levitate")
    layers = F.greatest(F.lit(0), F.least(F.lit(3), F.coalesce("spikes_layers", F.lit(0))))
    spikes = (F.when(floats | (layers == 0), F.lit(0).cast("long")).when(layers == 1, part_of(hp, 8))
              .when(layers == 2, part_of(hp, 6)).otherwise(part_of(hp, 4)))
    return df.withColumn("rock_damage", F.when(F.col("stealth_rock"), rock).otherwise(F.lit(0).cast("long"))) \
        .withColumn("spikes_damage", spikes) \
        .withColumn("hazard_damage", F.col("rock_damage") + F.col("spikes_damage"))


def end_turn_changes() -> Column:
    """Map of named end-of-turn changes of max hp; absent conditions are dropped."""
    hp, types = F.col("max_hp"), F.col("types")
    ability, item = F.coalesce("ability", F.lit("")), F.coalesce("item", F.lit(""))
    status, weather = F.coalesce("status", F.lit("")), F.coalesce("weather", F.lit(""))
    guard = ability == "magic-guard"
    sandproof = ability.isin("sand-veil", "sand-rush", "sand-force", "magic-guard", "overcoat") | (
        item == "safety-goggles") | F.arrays_overlap(types, F.array(F.lit("rock"), F.lit("ground"), F.lit("steel")))
    dry = ability == "dry-skin"
    rules = [
        ("burn", (status == "burn") & ~guard, -16),
        ("poison_heal", (status == "poison") & (ability == "poison-heal"), 8),
        ("poison", (status == "poison") & ~guard & (ability != "poison-heal"), -8),
        ("sand", (weather == "sand") & ~sandproof, -16),
        ("ice_body", (weather == "snow") & (ability == "ice-body"), 16),
        ("dry_skin_sun", weather.isin("sun", "harsh-sun") & dry, -8),
        ("dry_skin_rain", weather.isin("rain", "heavy-rain") & dry, 8),
        ("solar_power", weather.isin("sun", "harsh-sun") & (ability == "solar-power"), -8),
        ("leftovers", item == "leftovers", 16),
        ("black_sludge", (item == "black-sludge") & F.array_contains(types, "poison"), 16),
        ("black_sludge_harm", (item == "black-sludge") & ~F.array_contains(types, "poison"), -8),
        ("grassy_terrain", (F.coalesce("terrain", F.lit("")) == "grassy") & F.col("grounded"), 16),
    ]
    pairs = []
    for name, applies, part in rules:
        change = part_of(hp, abs(part)) * (1 if part > 0 else -1)
        pairs += [F.lit(name), F.when(applies, change)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def hazard_residual(df: DataFrame, totals: str = "totals", hp: str = "hp") -> DataFrame:
    """Hazard damage, class after hazards and the net end-of-turn change.

    Hazards add the same to every total, so the least, the greatest and the knock-outs are taken from the totals once
    and columns of their own; no shifted copy of the totals is made.
    """
    rows = hazard_damage(df).withColumn("end_turn", end_turn_changes())
    kept, t, hazard = rows.columns, F.col(totals), F.col("hazard_damage")
    rows = rows.select(
        "*", (F.array_min(t) + hazard).alias("_low"), (F.array_max(t) + hazard).alias("_high"),
        F.size(F.filter(t, lambda d: d + hazard >= F.col(hp))).alias("_one"))
    net = F.aggregate(F.map_values("end_turn"), F.lit(0).cast("long"), lambda a, v: a + v)
    ko = ko_class(t, F.col(hp), F.col("_low"), F.col("_high"), F.col("_one"))
    return rows.select(*[F.col(f"`{c}`") for c in kept], ko.alias("ko_after_hazards"), net.alias("end_turn_net"))


def hit_chance(df: DataFrame) -> DataFrame:
    """Accuracy after stages and factors, clamped to 0..100; a null accuracy always hits.

    Reads ``accuracy, accuracy_stage, evasion_stage, ignores_evasion, sure_hit`` and the ordered
    ``factors`` array.
    """
    evasion = F.when(F.col("ignores_evasion"), 1.0).otherwise(B.stage_ratio(F.col("evasion_stage")))
    start = F.col("accuracy").cast("double") * B.stage_ratio(F.col("accuracy_stage")) / evasion
    value = F.aggregate(F.coalesce("factors", F.array().cast("array<double>")), start, lambda a, f: a * f)
    value = F.greatest(F.lit(0.0), F.least(F.lit(100.0), value))
    sure = F.col("accuracy").isNull() | F.col("sure_hit")
    return df.withColumn("final_accuracy", F.when(~sure, F.bround(value, 2))).withColumn(
        "chance", F.when(sure, 1.0).otherwise(F.bround(value / 100, 4)))


def modified_speed(speed: Column, stage: Column, factors: Column) -> Column:
    none = F.array().cast("array<double>")
    return F.aggregate(F.coalesce(factors, none), B.stage_stat(speed, stage), lambda s, f: B.long_floor(s * f))


def speed_order(pairs: DataFrame) -> DataFrame:
    """Modified speeds of both sides and who moves first: ``user``, ``opponent`` or ``tie``."""
    out = pairs
    for side in ("user", "opponent"):
        out = out.withColumn(f"{side}_modified", modified_speed(
            F.col(f"{side}_speed"), F.col(f"{side}_stage"), F.col(f"{side}_factors")))
    u, o, room = F.col("user_modified"), F.col("opponent_modified"), F.col("trick_room")
    return out.withColumn("first", F.when(u == o, "tie").when((u > o) != room, "user").otherwise("opponent"))
