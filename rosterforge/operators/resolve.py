"""Entity resolution: alias keys, first-wins lookups, form matching and catalog joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterforge.functions.ranking import explode_once, first_per_key, top_k, top_k_per_key
from rosterforge.functions.strings import (
    api_name, blank_to_null, normalize_key, slug_label, strip_ws,
)
from rosterforge.session import spread

# Regional prefixes and the suffix they turn into.
REGIONAL_FORMS = {"Alolan ": " Alola", "Galarian ": " Galar", "Hisuian ": " Hisui"}
# First words that swap with the species in a two-word name.
SWAPPED_SPECIES = "Rotom"
SWAPPED_FORMS = ("Heat", "Wash", "Frost", "Fan", "Mow")
# Whole-name aliases.
NAME_ALIASES = {
    "Basculegion-M": "Basculegion Male",
    "Basculegion-F": "Basculegion Female",
    "Meowstic-M": "Meowstic Male",
    "Meowstic-F": "Meowstic Female",
    "Eternal Floette": "Floette Eternal",
    "Paldean Tauros": "Tauros Paldea Combat Breed",
    "Paldean Tauros (Blaze)": "Tauros Paldea Blaze Breed",
    "Paldean Tauros (Aqua)": "Tauros Paldea Aqua Breed",
}
# Misspelt tag words.
WORD_FIXES = {"dargon": "dragon"}

FORM_PASS = ("form_display_name", "form_api_name")
ALL_PASS = ("species_display_name", "form_display_name", "species_api_name", "form_api_name")
FILE_STEM = "^(.*?)(\\.[^.]*)?$"
# Characters of a record name that a stem is searched for first.
HEAD = 6
# Rows of one name that meet it in one place.
NAME_ROWS = 65_536


def alternate_names(value: Column, aliases: Mapping[str, str] = NAME_ALIASES,
                    regional: Mapping[str, str] = REGIONAL_FORMS) -> Column:
    """Candidate names in order: itself, regional suffix form, swapped form, alias."""
    name = strip_ws(F.coalesce(value, F.lit("")))
    candidates = [name]
    for prefix, suffix in regional.items():
        rest = F.substr(name, F.lit(len(prefix) + 1))
        candidates.append(F.when(name.startswith(prefix), F.concat(rest, F.lit(suffix))))
    words = F.split(name, "\\s+")
    swap = (F.size(words) == 2) & F.get(words, F.lit(0)).isin(*SWAPPED_FORMS) & (
        F.get(words, F.lit(1)) == SWAPPED_SPECIES)
    candidates.append(F.when(swap, F.concat_ws(" ", F.lit(SWAPPED_SPECIES), F.get(words, F.lit(0)))))
    if aliases:
        table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
        candidates.append(table[name])
    return F.array_compact(F.array(*candidates))


def lookup_keys(value: Column, **rules) -> Column:
    keys = F.transform(alternate_names(value, **rules), lambda n: normalize_key(n))
    return F.filter(keys, lambda k: k != "")


def alias_expand(df: DataFrame, col: str, **rules) -> DataFrame:
    """One row per candidate name, ``prio`` from 0."""
    return df.select("*", F.posexplode(alternate_names(F.col(col), **rules)).alias("prio", "cand"))


def build_lookup(records: DataFrame, passes: Sequence[Sequence[str]] = (FORM_PASS, ALL_PASS),
                 pos: str = "pos", **rules) -> DataFrame:
    """First-wins ``key -> record``: every record's pass-1 names come before any pass-2 name.

    Records are dealt out before each becomes one row per name, since a task sorts those rows.
    """
    names = F.array(*[
        F.struct(F.lit(p).alias("pass"), F.lit(i).alias("nth"), lookup_keys(F.col(c), **rules).alias("keys"))
        for p, columns in enumerate(passes) for i, c in enumerate(columns)])
    keyed = (
        spread(records, pos).select("*", F.explode(names).alias("_n"))
        .select("*", F.posexplode("_n.keys").alias("_k", "key"))
    )
    order = [F.col("_n.pass"), F.col(pos), F.col("_n.nth"), F.col("_k")]
    rec = F.struct(*[F.col(c) for c in records.columns])
    return keyed.groupBy("key").agg(F.min_by(rec, F.struct(*order)).alias("rec"))


def resolve_names(df: DataFrame, lookup: DataFrame, name: str, **rules) -> DataFrame:
    """Add ``rec`` of the first candidate key present in ``lookup``; misses keep null.

    Distinct names are resolved once, so a name on a third of all rows costs one lookup. Rows then meet
    their names in shares of about NAME_ROWS, and those without a name are dealt over all tasks.
    """
    counts = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("_n"))
    candidates = counts.select(name, F.posexplode(lookup_keys(F.col(name), **rules)).alias("prio", "key"))
    resolved = candidates.join(lookup, "key").groupBy(name).agg(F.min_by("rec", "prio").alias("rec"))
    crowded = counts.where(F.col("_n") > NAME_ROWS).select(name, F.ceil(F.col("_n") / NAME_ROWS).alias("_shares"))
    shares = F.coalesce("_shares", F.lit(1).cast("long"))
    told = resolved.join(crowded, name, "left").select(name, "rec", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("_share"))
    told_apart = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    places = F.when(F.col(name).isNull(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))).otherwise(shares)
    # At most one name in NAME_ROWS rows is crowded, so their list stays small.
    rows = df.join(F.broadcast(crowded), name, "left").withColumn("_share", F.pmod(F.xxhash64(*told_apart), places)).drop("_shares")
    return spread(rows, name, "_share").join(told, [name, "_share"], "left").drop("_share")


def display_name(*columns: str) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in columns])


def sibling_forms(records: DataFrame, pos: str = "pos") -> DataFrame:
    """Per species the distinct display names in source order, numbered, with the default flag.

    Siblings are stored once per species; a record reaches them by its ``species_key``.
    """
    forms = records.select(
        normalize_key(display_name("species_api_name", "species_display_name")).alias("species_key"),
        display_name("form_display_name", "species_display_name", "form_api_name").alias("name"),
        F.coalesce("is_default", F.lit(False)).alias("is_default"), F.col(pos).alias("first_pos"),
    ).where((F.col("species_key") != "") & F.col("name").isNotNull())
    return first_per_key(forms.withColumn("_p", F.col("first_pos")), ["species_key", "name"], ["_p"]).drop("_p")


def search_contains(records: DataFrame, query: str, limit: int = 12, pos: str = "pos") -> DataFrame:
    """First ``limit`` distinct display names whose names contain the normalised query."""
    needle = "".join(c for c in query.lower() if c.isalnum())
    limit = min(max(limit, 1), 24)
    names = F.array(*[F.col(c) for c in ALL_PASS])
    shown = display_name("form_display_name", "species_display_name", "form_api_name", "species_api_name")
    hits = records.withColumn("display_name", shown).where(F.col("display_name").isNotNull())
    hits = hits.where(F.lit(needle != "") & F.exists(names, lambda n: normalize_key(n).contains(needle)))
    firsts = first_per_key(hits.withColumn("_p", F.col(pos)), ["display_name"], ["_p"]).drop("_p")
    return top_k(firsts, [F.asc(pos)], limit)


def fallback_abilities(entities: DataFrame, roster: DataFrame, name: str = "name", **rules) -> DataFrame:
    """Ability list: roster by name or form, by species for default forms, else the record's own.

    ``roster`` has ``roster_pos, roster_name, abilities``; the last spelling of a key wins there.
    """
    keyed = roster.groupBy(normalize_key("roster_name").alias("key")).agg(
        F.max_by("abilities", "roster_pos").alias("found"))
    keyed = keyed.where(F.size("found") > 0)
    form = F.when(F.col("form_display_name").isNotNull(), F.array(normalize_key("form_display_name")))
    exact = F.concat(lookup_keys(F.col(name), **rules), F.coalesce(form, F.array().cast("array<string>")))
    default = F.coalesce("is_default", F.lit(True))
    species = F.when(default, F.array(normalize_key("species_display_name")))
    keys = F.concat(exact, F.coalesce(species, F.array().cast("array<string>")))
    shape = entities.withColumn("_keys", keys)
    wanted = shape.select("_keys").distinct()
    hit = (
        wanted.select("_keys", F.posexplode("_keys").alias("prio", "key")).join(keyed, "key")
        .groupBy("_keys").agg(F.min_by("found", "prio").alias("found"))
    )
    own = F.coalesce(F.col("abilities"), F.array().cast("array<string>"))
    return shape.join(hit, "_keys", "left").withColumn(
        "resolved_abilities", F.coalesce("found", own)).drop("_keys", "found")


def enrich_detected(detections: DataFrame, lookup: DataFrame, stats: Sequence[str],
                    team_only: bool = False, **rules) -> DataFrame:
    """Left-enrich detections with types and stats; on a miss keep detected types, null stats."""
    named = detections.withColumn("name", F.coalesce(blank_to_null("name"), F.col("entity_name")))
    if team_only:
        named = named.where(F.col("name").isNotNull() & (F.col("name") != ""))
    rows = resolve_names(named, lookup, "name", **rules)
    own = F.when(F.size("types") > 0, F.col("types")).otherwise(F.col("detected_types"))
    hit = F.col("rec").isNotNull()
    return rows.select(
        *[c for c in named.columns if c != "types"], hit.alias("resolved"),
        F.when(hit, F.col("rec.types")).otherwise(own).alias("types"),
        *[F.col(f"rec.{s}").alias(s) for s in stats],
    )


def merge_details(saved: DataFrame, details: DataFrame, stats: DataFrame, usage: DataFrame,
                  key: str = "id", preserve_moves: bool = False) -> DataFrame:
    """Overlay fresh details on saved rows: computed stats first, then details, then saved.

    ``stats`` has ``key, name, form, nature, image``; ``details`` the record with ``moves``
    and ``abilities``; ``usage`` the ranked ``top_moves`` names.
    """
    rows = (
        saved.alias("m").join(details.alias("d"), key, "left")
        .join(stats.alias("s"), key, "left").join(usage.alias("u"), key, "left")
    )
    def some(*cols: str) -> Column:
        return F.coalesce(*[F.col(c) for c in cols])

    def filled(*cols: str) -> Column:
        return F.coalesce(*[blank_to_null(F.col(c)) for c in cols], F.lit(""))

    none = F.array().cast("array<string>")
    learned = F.when(F.size("d.moves") > 0, F.col("d.moves")).otherwise(
        F.coalesce("m.move_options", "m.moves", none))
    used = F.slice(F.filter(F.coalesce("u.top_moves", none), lambda m: m.isNotNull() & (m != "")), 1, 4)
    kept = F.exists(F.coalesce("m.moves", none), lambda m: m.isNotNull() & (m != ""))
    moves = F.when(F.size(used) > 0, used).otherwise(F.slice(learned, 1, 4))
    if preserve_moves:
        moves = F.when(kept, F.col("m.moves")).otherwise(moves)
    return rows.select(
        key, some("s.name", "d.name", "m.name").alias("name"),
        F.coalesce("d.form", "s.form", "m.form", F.lit("")).alias("form"),
        filled("d.image", "m.image", "s.image").alias("image"),
        some("d.types", "m.types").alias("types"),
        F.coalesce(F.get("d.abilities", F.lit(0)), F.col("m.ability")).alias("ability"),
        F.coalesce("s.nature", "m.nature", F.lit("hardy")).alias("nature"),
        moves.alias("moves"), learned.alias("move_options"),
    )


def unique_options(primary: Column, fallback: Column) -> Column:
    """Ordered union of two lists without blanks."""
    none = F.array().cast("array<string>")
    both = F.array_distinct(F.concat(F.coalesce(primary, none), F.coalesce(fallback, none)))
    return F.filter(both, lambda x: x.isNotNull() & (x != ""))


# --- files and forms -------------------------------------------------------------------------

def file_number(filename: Column, prefix: str = "Menu_CP_") -> Column:
    return F.coalesce(blank_to_null(F.regexp_extract(filename, prefix + "(\\d+)", 1)).cast("int"), F.lit(0))


def file_suffix(filename: Column, prefix: str = "Menu_CP_") -> Column:
    """Form suffix after the number, separators as spaces, lower case."""
    stem = F.regexp_extract(filename, FILE_STEM, 1)
    suffix = F.regexp_extract(stem, "^" + prefix + "\\d+-(.+)$", 1)
    return F.lower(F.trim(F.translate(suffix, "_-", "  ")))


def match_form_by_suffix(files: DataFrame, forms: DataFrame, pos: str = "pos",
                         filename: str = "filename", **naming) -> DataFrame:
    """Attach the chosen form of the file's number; no candidate leaves nulls.

    The first form whose name holds the file's suffix wins, for an empty suffix the first default one,
    and else the first of the number. The choice depends only on (number, suffix), so it is made once
    per distinct pair. Names are indexed by their parts of the lengths that the suffixes of their number
    have; a pair looks its suffix up, so pairs and forms of one number never meet all with all. The index
    holds positions, not forms, and is made from forms that are dealt out first.
    """
    parsed = files.withColumn("number", file_number(F.col(filename), **naming)).withColumn(
        "suffix", file_suffix(F.col(filename), **naming))
    pairs = parsed.select("number", "suffix").distinct()
    lengths = pairs.where("suffix <> ''").groupBy("number").agg(F.collect_set(F.length("suffix")).alias("_l"))
    rec = F.struct(*[F.col(c) for c in forms.columns])
    shown = F.lower(F.coalesce("form_display_name", F.lit("")))
    api = F.translate(F.lower(F.coalesce("form_api_name", F.lit(""))), "-", " ")

    def parts(name: Column) -> Column:
        return F.flatten(F.transform(F.filter("_l", lambda n: n <= F.length(name)), lambda n: F.transform(
            F.sequence(F.lit(1), F.length(name) - n + 1), lambda i: F.substring(name, i, n))))

    named = forms.select("number", F.col(pos).alias("_pos"), rec.alias("_rec"), shown.alias("_shown"), api.alias("_api"))
    held = F.array_distinct(F.concat(parts(F.col("_shown")), parts(F.col("_api"))))
    dealt = spread(named.join(lengths, "number").select("number", "_pos", "_shown", "_api", "_l"), "number", "_pos")
    index = explode_once(dealt.select("number", "_pos", held.alias("_held")), F.col("_held"), "suffix")
    fitting = index.groupBy("number", "suffix").agg(F.min("_pos").alias("_pos")).join(pairs, ["number", "suffix"])
    fits = named.join(fitting.select("number", "_pos").distinct(), ["number", "_pos"]).groupBy("number", "_pos").agg(F.first("_rec").alias("_fit"))
    fitting = fitting.join(fits, ["number", "_pos"]).drop("_pos")
    default = F.coalesce("_rec.is_default", F.lit(False))
    firsts = spread(named, "number", "_pos").groupBy("number").agg(F.min_by("_rec", F.when(default, F.col("_pos"))).alias("_default"), F.min_by("_rec", "_pos").alias("_first"))
    chosen = pairs.join(firsts, "number").join(fitting, ["number", "suffix"], "left").select(
        "number", "suffix", F.coalesce("_fit", F.when(F.col("suffix") == "", F.col("_default")), "_first").alias("form"))
    return parsed.join(chosen, ["number", "suffix"], "left")


def catalog_entries(files: DataFrame, forms: DataFrame, stats: Sequence[str], placeholder: str = "Entity #",
                    **naming) -> DataFrame:
    """One sorted catalog entry per numbered file, placeholder when no form matches."""
    rows = match_form_by_suffix(files, forms, **naming).where(F.col("number") > 0)
    blank = F.concat(F.lit(placeholder), F.col("number").cast("string"))
    name = F.coalesce(blank_to_null(F.col("form.form_display_name")),
                      blank_to_null(F.col("form.species_display_name")), blank)
    rows = rows.withColumn("name", name)
    mega = F.lower("name").contains("mega") | F.lower("filename").contains("mega")
    return rows.select(
        F.col("number").alias("id"), "name",
        F.coalesce(F.col("form.species_display_name"), F.col("name")).alias("species_name"),
        F.coalesce(F.col("form.form_api_name"), F.lit("")).alias("form_api_name"),
        F.coalesce(F.col("form.types"), F.array().cast("array<string>")).alias("types"),
        *[F.coalesce(F.col(f"form.{s}").cast("int"), F.lit(0)).alias(s) for s in stats],
        F.col("filename").alias("sprite_filename"), mega.alias("is_mega"),
    ).orderBy("id", "name")


def learnset_moves(forms: DataFrame, learnset: DataFrame, key: str = "pos") -> DataFrame:
    """Moves of the first learnset key present: api name, species, then both without dashes.

    ``learnset`` has ``learn_key`` and ``moves`` (map keyed by move name).
    """
    api, species = api_name("form_api_name"), api_name("species_display_name")
    keys = F.array(api, species, F.translate(api, "-", ""), F.translate(species, "-", ""))
    hit = (
        forms.select(key, F.posexplode(keys).alias("prio", "learn_key")).join(learnset, "learn_key")
        .groupBy(key).agg(F.min_by("moves", "prio").alias("moves"))
    )
    return hit.select(key, F.explode(F.array_sort(F.map_keys("moves"))).alias("move"))


def move_effect_text(power: Column, accuracy: Column, pp: Column, priority: Column) -> Column:
    """Composed sentence used when a move has no effect text."""
    rank = F.coalesce(priority, F.lit(0))
    return F.concat_ws(
        ", ",
        F.when(power != 0, F.concat(power.cast("string"), F.lit(" power"))).otherwise("No direct damage"),
        F.when(accuracy != 0, F.concat(accuracy.cast("string"), F.lit("% accuracy"))).otherwise("Bypasses accuracy"),
        F.when(pp != 0, F.concat(pp.cast("string"), F.lit(" PP"))),
        F.when(rank != 0, F.format_string("%+d priority", rank)),
    )


def move_detail(moves: DataFrame, dictionary: DataFrame, move: str = "move") -> DataFrame:
    """Dictionary entry of a move by key, else by the first key equal without dashes.

    ``dictionary`` has ``dict_pos, move_key, display_name, type, category, power, accuracy, pp,
    priority, effect, short_effect``.
    """
    names = moves.select(move).distinct().withColumn("_key", api_name(move))
    compact = first_per_key(
        dictionary.withColumn("_compact", F.translate("move_key", "-", "")).withColumn("_p", F.col("dict_pos")),
        ["_compact"], ["_p"]).drop("_p")
    exact = dictionary.withColumn("_hit", F.col("move_key"))
    fields = [c for c in dictionary.columns if c != "dict_pos"]
    joined = (
        names.join(exact.select(F.struct(*fields).alias("x"), "_hit"), F.col("_key") == F.col("_hit"), "left")
        .join(compact.select(F.struct(*fields).alias("c"), "_compact"),
              F.col("x").isNull() & (F.translate("_key", "-", "") == F.col("_compact")), "left")
        .withColumn("m", F.coalesce("x", "c"))
    )
    titled = F.initcap(F.translate(move, "-", " "))
    composed = move_effect_text(F.col("m.power"), F.col("m.accuracy"), F.col("m.pp"), F.col("m.priority"))
    effect = F.when(F.col("m").isNull(), "Move details unavailable.").otherwise(
        F.coalesce(blank_to_null(F.col("m.effect")), blank_to_null(F.col("m.short_effect")), composed))
    detail = joined.select(
        F.col(move), F.coalesce("m.move_key", "_key").alias("name"),
        F.coalesce(blank_to_null(F.col("m.display_name")), titled).alias("display_name"),
        F.coalesce("m.type", F.lit("")).alias("type"), F.coalesce("m.category", F.lit("")).alias("category"),
        F.col("m.power").alias("power"), F.col("m.accuracy").alias("accuracy"), F.col("m.pp").alias("pp"),
        F.coalesce("m.priority", F.lit(0)).alias("priority"), effect.alias("effect"))
    return moves.join(detail, move)


def species_representative(entries: DataFrame, pos: str = "pos") -> DataFrame:
    """One entry per species, as the ordered replacement rule leaves it.

    The rule walks a species in order: a base-named entry replaces one that is not, and a
    plain entry replaces a mega. A plain base-named entry therefore ends the walk. Without one,
    plain entries and base-named megas replace each other in turn, so the survivor opens the
    last run of whichever class comes last. Both cases need only per-class positions, which
    are aggregates, so no species is ever sorted in one task.
    """
    key = F.lower(F.coalesce(blank_to_null("species_name"), F.col("name"), F.lit("")))
    rows = entries.withColumn("_species", key).where(F.col("_species") != "")
    base = F.lower("name") == F.lower(F.coalesce("species_name", F.lit("")))
    rows = rows.withColumn("_class", F.when(base & ~F.col("is_mega"), 3).when(base, 2)
                           .when(~F.col("is_mega"), 1).otherwise(0))
    marks = rows.groupBy("_species").agg(
        F.max("_class").alias("_best"),
        F.max(F.when(F.col("_class") == 1, F.col(pos))).alias("_last_plain"),
        F.max(F.when(F.col("_class") == 2, F.col(pos))).alias("_last_base_mega"))
    plain_wins = F.coalesce(F.col("_last_plain") > F.col("_last_base_mega"), F.col("_last_plain").isNotNull())
    other = F.when(plain_wins, F.col("_last_base_mega")).otherwise(F.col("_last_plain"))
    alternating = (F.col("_class") == F.when(plain_wins, 1).otherwise(2)) & (
        other.isNull() | (F.col(pos) > other))
    eligible = F.when(F.col("_best") == 3, F.col("_class") == 3).when(
        F.col("_best") == 0, F.lit(True)).otherwise(alternating)
    picked = rows.join(marks, "_species").where(eligible).select("_species", *entries.columns)
    return first_per_key(picked.withColumn("_p", F.col(pos)), ["_species"], ["_p"]).drop("_species", "_p")


def normalized_tags(tags: Column) -> Column:
    return F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: t != "")


def facets(entries: DataFrame) -> DataFrame:
    """Distinct tags, sorted."""
    return entries.select(F.explode(normalized_tags(F.col("types"))).alias("facet")).distinct().orderBy("facet")


def facet_filter(entries: DataFrame, text: str = "", tag: str = "all") -> DataFrame:
    """Species with any form matching the text and any form carrying the tag."""
    key = F.lower(F.coalesce(blank_to_null("species_name"), F.col("name"), F.lit("")))
    rows = entries.withColumn("_species", key)
    needle = text.strip().lower()
    kept = species_representative(entries).withColumn("_species", key)
    if needle:
        match = F.greatest(*[F.lower(F.coalesce(c, F.lit(""))).contains(needle)
                             for c in ("name", "species_name", "form_api_name")])
        kept = kept.join(rows.where(match).select("_species"), "_species", "left_semi")
    if tag != "all":
        tagged = rows.where(F.array_contains(normalized_tags(F.col("types")), tag))
        kept = kept.join(tagged.select("_species"), "_species", "left_semi")
    return kept.drop("_species")


def category_label(category: Column) -> Column:
    text = F.lower(F.coalesce(category, F.lit("")))
    return (F.when(text == "physical", "Attack").when(text == "special", "Special")
            .when(text == "status", "Status").otherwise("Unknown"))


def move_text_search(moves: DataFrame, query: str) -> DataFrame:
    """Moves whose names, type, category label or effect contain the query."""
    needle = query.strip().lower()
    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("display_name", "name", "type")],
                       category_label(F.col("category")), F.coalesce("effect", F.lit("")))
    return moves.where(F.lower(text).contains(needle)) if needle else moves


def name_heads(text: DataFrame, stem: str) -> DataFrame:
    """(stem, _norm, _at, _head): the substrings of ``_norm`` of the lengths ``_lens``, by their place."""
    parts = F.flatten(F.transform(
        F.filter("_lens", lambda n: n <= F.length("_norm")),
        lambda n: F.transform(F.sequence(F.lit(1), F.length("_norm") - n + 1),
                              lambda i: F.struct(i.alias("at"), F.substring(F.col("_norm"), i, n).alias("head")))))
    rows = explode_once(text.select(stem, "_norm", parts.alias("_parts")), F.col("_parts"), "_p")
    return rows.select(stem, "_norm", F.col("_p.at").alias("_at"), F.col("_p.head").alias("_head"))


def infer_by_containment(stems: DataFrame, records: DataFrame, stem: str = "stem", pos: str = "pos") -> DataFrame:
    """Attach the record whose normalised name the stem contains.

    Longest display or form name wins, else the shortest species name; ties go to the first
    record. Containment is two equi-joins on distinct stems: a stem lists its substrings of the lengths
    that the heads of names have, at most HEAD of them; where a head occurs, it lists those of the lengths
    that names with this head have. Names are reduced to one record each first.
    """
    names = records.select(
        F.struct(*[F.col(c) for c in records.columns]).alias("rec"), F.col(pos).alias("_pos"),
        F.explode(F.array(
            F.struct(F.lit(0).alias("kind"), normalize_key("display_name").alias("key")),
            F.struct(F.lit(0).alias("kind"), normalize_key("form_display_name").alias("key")),
            F.struct(F.lit(1).alias("kind"), normalize_key("species_display_name").alias("key")))).alias("n"))
    names = names.where(F.col("n.key") != "").groupBy("n.kind", "n.key").agg(F.min_by("rec", "_pos").alias("rec"),
                                                                            F.min("_pos").alias("_pos"))
    heads = names.groupBy(F.substring("key", 1, HEAD).alias("_head")).agg(F.collect_set(F.length("key")).alias("_sizes"))
    lengths = heads.agg(F.collect_set(F.length("_head"))).scalar()
    text = stems.select(stem).distinct().withColumn("_norm", normalize_key(stem)).withColumn("_lens", lengths)
    at = name_heads(text, stem).join(heads, "_head")
    whole = F.transform(F.filter("_sizes", lambda n: n < F.length("_norm") - F.col("_at") + 2), lambda n: F.substring(F.col("_norm"), F.col("_at"), n))
    found = explode_once(at.select(stem, whole.alias("_g")), F.col("_g"), "key").drop("_g")
    size = F.length("key")
    order = F.struct(F.col("kind"), F.when(F.col("kind") == 0, -size).otherwise(size), F.col("_pos"))
    hits = found.join(names, "key").groupBy(stem).agg(F.min_by("rec", order).alias("rec"))
    return stems.join(hits, stem, "left")


# --- label repair ----------------------------------------------------------------------------

def parse_numbered_label(name: Column, prefix: str = "menu_cp") -> Column:
    """Struct (number, suffix) of a generated file name; nulls when it has no number."""
    stem = F.regexp_extract(name, FILE_STEM, 1)
    stem = F.regexp_replace(stem, "(?i)_synthetic_\\d+$", "")
    stem = F.replace(F.regexp_replace(stem, "(?i)_shiny$", ""), F.lit("-shiny"), F.lit(""))
    label = slug_label(stem)
    number = blank_to_null(F.regexp_extract(label, f"^{prefix}_(\\d+)(?:_([a-z0-9_]+))?$", 1)).cast("int")
    suffix = blank_to_null(F.regexp_extract(label, f"^{prefix}_(\\d+)(?:_([a-z0-9_]+))?$", 2))
    return F.struct(number.alias("number"), suffix.alias("suffix"))


def label_mapping(forms: DataFrame, pos: str = "pos") -> DataFrame:
    """(number, suffix) -> label, last form wins; suffix '' is the number's base label."""
    api, shown = slug_label("form_api_name"), slug_label("form_display_name")
    species = slug_label(F.coalesce(blank_to_null("species_api_name"), F.col("species_display_name"), F.lit("")))
    mega = F.array_contains(F.split(api, "_"), "mega") | F.array_contains(F.split(shown, "_"), "mega")
    rows = forms.select(F.col("number"), F.col(pos).alias("_pos"), "is_default",
                        api.alias("api"), shown.alias("shown"), species.alias("species"), mega.alias("mega"))
    rows = rows.where((F.col("api") != "") & ~F.col("mega"))

    def tails(c: Column) -> Column:
        lead = F.concat(F.col("species"), F.lit("_"))
        own = F.when((F.col("species") != "") & c.startswith(lead), F.substr(c, F.length(lead) + 1))
        last = F.when(c.contains("_"), F.element_at(F.split(c, "_"), -1))
        return F.when(c != "", F.array_compact(F.array(c, own, last))).otherwise(F.array().cast("array<string>"))

    base = F.coalesce(F.col("is_default"), F.lit(False)) | (F.col("api") == F.col("species"))
    suffixes = F.array_distinct(F.concat(
        tails(F.col("api")), tails(F.col("shown")),
        F.when(base, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))))
    exploded = rows.select("number", "_pos", "api", F.explode(suffixes).alias("suffix"))
    return exploded.groupBy("number", "suffix").agg(F.max_by("api", "_pos").alias("label"))


def repair_labels(files: DataFrame, forms: DataFrame, pos: str = "pos") -> DataFrame:
    """Target label and status per file: moved, already_correct or skipped with a reason.

    ``files`` has ``name`` and its present ``folder``.
    """
    mapping = label_mapping(forms, pos)
    parsed = files.withColumn("_p", parse_numbered_label(F.col("name")))
    wanted = parsed.select("_p.number", F.coalesce("_p.suffix", F.lit("")).alias("suffix")).where(
        "number is not null").distinct()
    bases = mapping.where(F.col("suffix") == "").select("number", F.col("label").alias("base"))
    exact = wanted.join(mapping, ["number", "suffix"], "left").join(bases, "number", "left")
    composed = F.when(F.col("suffix") != "", slug_label(F.concat_ws("_", F.col("base"), F.col("suffix"))))
    target = F.coalesce("label", F.when(F.col("base").isNotNull(), composed), "base")
    table = exact.select(F.col("number").alias("_n"), F.col("suffix").alias("_s"), target.alias("target"))
    rows = parsed.join(table, (F.col("_p.number") == F.col("_n")) &
                       (F.coalesce("_p.suffix", F.lit("")) == F.col("_s")), "left")
    status = (F.when(F.col("_p.number").isNull() | F.col("target").isNull(), "skipped")
              .when(F.col("folder") == F.col("target"), "already_correct").otherwise("moved"))
    reason = (F.when(F.col("_p.number").isNull(), "no number in filename")
              .when(F.col("target").isNull(), "no mapping").otherwise(""))
    return rows.select(*files.columns, "target", status.alias("status"), reason.alias("reason"))


def fixed_tag_folder(name: Column, vocabulary: Sequence[str]) -> Column:
    """Struct (label, invalid): spell-fixed folder name, or the words that are no tags."""
    words = F.filter(F.split(slug_label(name), "_"), lambda w: w != "")
    fixes = F.create_map(*[F.lit(x) for pair in WORD_FIXES.items() for x in pair])
    words = F.transform(words, lambda w: F.coalesce(fixes[w], w))
    known = F.array(*[F.lit(v) for v in vocabulary])
    invalid = F.filter(words, lambda w: ~F.array_contains(known, w))
    return F.struct(F.when(F.size(invalid) == 0, F.array_join(words, "_")).alias("label"), invalid.alias("invalid"))


# --- tag combinations ------------------------------------------------------------------------

def type_combos(records: DataFrame, types: str = "types", shown: str = "display_name",
                pos: str = "pos", examples: int = 12) -> DataFrame:
    """Records per unordered set of one or two tags: count, first-seen order, first examples.

    Examples are cut by a per-key top-k before they are gathered.
    """
    tags = F.array_distinct(normalized_tags(F.split(F.col(types), "\\|")))
    rows = records.select(F.col(shown).alias("shown"), F.col(pos).alias("_pos"), tags.alias("tags"))
    rows = rows.where(F.size("tags").between(1, 2)).withColumn(
        "unordered_key", F.array_join(F.array_sort("tags"), "_"))
    counts = rows.groupBy("unordered_key").agg(
        F.count("*").alias("n"), F.min_by("tags", "_pos").alias("tags"))
    first = top_k_per_key(rows.select("unordered_key", "shown", "_pos"), ["unordered_key"],
                          [F.asc("_pos")], examples)
    shown_first = first.groupBy("unordered_key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "shown"))), lambda s: s["shown"]).alias("examples"))
    return counts.join(shown_first, "unordered_key").select(
        "tags", F.array_join("tags", "_").alias("type_key"), "unordered_key", "n", "examples",
    ).orderBy(F.size("tags"), "tags")


def pair_combinations(domain: DataFrame, col: str, pos: str = "pos") -> DataFrame:
    """All singletons and ordered-once pairs of a small domain."""
    a = domain.select(F.col(col).alias("a"), F.col(pos).alias("pa"))
    b = domain.select(F.col(col).alias("b"), F.col(pos).alias("pb"))
    pairs = a.join(b, F.col("pa") < F.col("pb")).select(F.concat_ws("_", "a", "b").alias("label"))
    return a.select(F.col("a").alias("label")).unionByName(pairs)
