"""Nearest-neighbour search, tag pools, arbitration, evidence merging and review flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterforge.functions.ranking import top_k_per_key
from rosterforge.functions.vectors import confidence, overlap_score, tag_set
from rosterforge.operators.blocks import EVERY, blocked_topk

# Arbitration and review thresholds.
FILTER_CONFIDENCE = 0.78
LOW_CONFIDENCE = 0.74
CONSISTENCY_BONUS = 0.08
OVERRIDE_MARGIN = 0.10
GLOBAL_WITHOUT_REVIEW = 0.88
PARTIAL_WITHOUT_REVIEW = 0.86
NEAR_EXACT, NEAR_EXACT_MARGIN = 0.985, 0.06
STRONG_RESCUE, STRONG_RESCUE_MARGIN = 0.91, 0.07
RERANK_DEPTH = 40
RERANK_REVIEW = 0.68
TAG_GUARD_CONFIDENCE = 0.97
VARIANT_REVIEW = 0.78
QUALITY_WEIGHT = 0.12
OVERLAP_LIMIT = 0.20
EVIDENCE_ACCEPT, FILTERED_FAST, GLOBAL_FAST, TEMPLATE_ACCEPT = 0.78, 0.70, 0.80, 0.62
COMBO_TRUST = 0.74
COMBO_FLOOR = 0.42
# Depth and limits of the staged rerank.
SECOND_STAGE, THIRD_STAGE = 24, 16
PARTIAL_BELOW, MIN_DETECTION = 0.35, 0.40
CONFIRMED_FLOOR, SUPPORTED_FLOOR = 0.75, 0.55
RESCUE_BELOW, RESCUE_SCORE, RESCUE_MARGIN = 0.70, 0.82, 0.08
PREFERENCE_MARGIN = 0.055
# Tag sets that are read as another pair.
PAIR_SUBSTITUTES = {
    ("ground", "poison"): ("fighting", "poison"),
    ("grass", "water"): ("grass", "poison"),
    ("dark", "fire"): ("fire", "dark"),
    ("dark", "steel"): ("dark", "steel"),
    ("dragon", "poison"): ("dragon", "ghost"),
    ("fighting", "water"): ("psychic", "fighting"),
    ("fighting", "poison", "water"): ("psychic", "fighting"),
    ("fighting", "poison", "psychic"): ("psychic", "fighting"),
}
# Fallback crop sources and their quality limit.
FALLBACK_SOURCE = "fixed_type_icon_fallback"
WEAK_SOURCES = (FALLBACK_SOURCE, "shifted_fixed_type_icon_left", "shifted_fixed_type_icon_right",
                "shifted_fixed_type_icon_down", "shifted_fixed_type_icon_wide")
WEAK_QUALITY = 0.05
SINGLE_VALUE_EXCEPTION = "fire"
MODES = ("exact_type", "contains_all_types", "partial_type", "global")
NO_TAGS = "array<string>"


def none_tags() -> Column:
    return F.array().cast(NO_TAGS)


def knn_topk(queries: DataFrame, base: DataFrame, k: int, query_id: str = "q", query_vec: str = "vector",
             base_id: str = "id", base_vec: str = "vector") -> DataFrame:
    """Exact top-k by inner product for a batch of queries: ``q, rank, id, score``."""
    hits = blocked_topk(queries.select(query_id, query_vec), base.select(base_id, base_vec), k,
                        query_id, query_vec, base_id, base_vec)
    return hits.select(F.col("q").alias(query_id), "rank", F.col("id").alias(base_id), "score")


def with_confidence(hits: DataFrame) -> DataFrame:
    return hits.withColumn("confidence", F.bround(confidence(F.col("score")), 4)).withColumn(
        "distance", F.bround(1 - F.col("score"), 4)).withColumn("similarity", F.bround("score", 4))


def _tag_key(tags: Column) -> Column:
    return F.array_join(tag_set(tags), "|")


def tag_pools(queries: DataFrame, base: DataFrame, query_tags: str = "detected_types",
              base_tags: str = "types") -> DataFrame:
    """Pools between distinct tag sets: ``qg, bg, mode, n`` with the best non-empty level only.

    Rows never meet here. Base rows are counted per tag set first; a query set meets only the
    base sets that share a tag, through an equi-join on the tag, and the number of shared tags
    tells the level. A query set that shares none meets the one group of all rows, ``EVERY``.
    """
    base_sets = base.groupBy(_tag_key(F.col(base_tags)).alias("bg")).agg(F.count("*").alias("n"))
    query_sets = queries.select(_tag_key(F.col(query_tags)).alias("qg")).distinct()

    def tags(c: str) -> Column:
        return F.filter(F.split(c, "\\|"), lambda t: t != "")

    q = query_sets.select("qg", F.size(tags("qg")).alias("qn"), F.explode(tags("qg")).alias("tag"))
    b = base_sets.select("bg", "n", F.size(tags("bg")).alias("bn"), F.explode(tags("bg")).alias("tag"))
    shared = q.join(b, "tag").groupBy("qg", "qn", "bg", "bn", "n").agg(F.count("*").alias("both"))
    level = F.when(F.col("both") < F.col("qn"), 3).when(F.col("both") < F.col("bn"), 2).otherwise(1)
    shared = shared.select("qg", "bg", "n", level.alias("level"))
    best = shared.groupBy("qg").agg(F.min("level").alias("best"))
    # A superset pool includes the exact sets and an overlap pool includes both, as each level does.
    narrow = shared.join(best, "qg").where(F.col("level") <= F.col("best")).select("qg", "bg", "n", "best")
    total = base_sets.agg(F.sum("n").alias("n")).scalar()
    wide = query_sets.join(best, "qg", "left_anti").select("qg", F.lit(EVERY).alias("bg"), total.alias("n"), F.lit(4).alias("best")).where("n > 0")
    mode = F.get(F.array(*[F.lit(m) for m in MODES]), F.col("best") - 1)
    return narrow.unionByName(wide).select("qg", "bg", "n", mode.alias("mode"))


def candidate_pools(queries: DataFrame, base: DataFrame, query_id: str = "q", query_tags: str = "detected_types",
                    base_tags: str = "types") -> DataFrame:
    """Pool mode and size per query."""
    sizes = tag_pools(queries, base, query_tags, base_tags).groupBy("qg").agg(
        F.any_value("mode").alias("mode"), F.sum("n").alias("candidate_count"))
    keyed = queries.select(query_id, _tag_key(F.col(query_tags)).alias("qg"))
    return keyed.join(sizes, "qg", "left").select(
        query_id, F.coalesce("mode", F.lit("none")).alias("mode"), F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"))


def filtered_nearest(queries: DataFrame, base: DataFrame, query_id: str = "q", vec: str = "vector",
                     base_id: str = "id", query_tags: str = "detected_types", base_tags: str = "types") -> DataFrame:
    """Best match inside each query's pool with mode, pool size and confidence.

    Vectors meet only inside the pool, block by block; a query without any candidate gets an
    ``unknown`` record.
    """
    pools = tag_pools(queries, base, query_tags, base_tags)
    group = F.when(F.col("bg") == EVERY, EVERY).otherwise(F.col("qg")).alias("grp")
    q = queries.select(query_id, vec, _tag_key(F.col(query_tags)).alias("qg")).join(pools.select("qg", group).distinct(), "qg")
    b = base.select(base_id, vec, _tag_key(F.col(base_tags)).alias("bg"))
    best = blocked_topk(q.select(query_id, vec, F.col("grp").alias("qg")), b, 1, query_id, vec, base_id, vec, pools.select(group.alias("qg"), "bg").distinct())
    sizes = candidate_pools(queries, base, query_id, query_tags, base_tags)
    found = best.select(F.col("q").alias(query_id), F.col("id").alias(base_id), "score")
    return describe_match(sizes.join(found, query_id, "left"), base, base_id)


def global_nearest(queries: DataFrame, base: DataFrame, query_id: str = "q", vec: str = "vector",
                   base_id: str = "id") -> DataFrame:
    best = knn_topk(queries, base, 1, query_id, vec, base_id, vec).drop("rank")
    total = base.agg(F.count("*")).scalar()
    rows = queries.select(query_id).join(best, query_id, "left").withColumn("mode", F.lit("global"))
    return describe_match(rows.withColumn("candidate_count", total), base, base_id)


def describe_match(rows: DataFrame, base: DataFrame, base_id: str = "id") -> DataFrame:
    """Attach the reference's name, tags and path to matches; misses become ``unknown``."""
    ref = base.select(base_id, "name", F.col("types").alias("reference_types"), "path", "is_shiny")
    out = rows.join(ref, base_id, "left")
    hit = F.col("score").isNotNull()
    conf = confidence(F.coalesce("score", F.lit(0.0)))
    return out.select(
        *[c for c in rows.columns if c not in (base_id, "mode", "score", "candidate_count")],
        F.col(base_id), F.coalesce("name", F.lit("unknown")).alias("name"),
        F.when(hit, F.bround(conf, 4)).otherwise(0.0).alias("confidence"),
        F.when(hit, F.bround("score", 4)).otherwise(0.0).alias("similarity"),
        F.when(hit, F.bround(1 - F.col("score"), 4)).otherwise(1.0).alias("distance"),
        F.coalesce("reference_types", none_tags()).alias("reference_types"),
        F.coalesce("path", F.lit("")).alias("path"), F.coalesce("is_shiny", F.lit(False)).alias("is_shiny"),
        F.when(hit, F.col("mode")).otherwise("none").alias("mode"),
        F.when(hit, F.col("candidate_count")).otherwise(0).alias("candidate_count"),
        F.when(hit, F.concat(F.lit("embedding-"), F.translate("mode", "_", "-"))).otherwise("no-candidates").alias("reason"))


def needs_review(name: Column, conf: Column, mode: Column, detected: Column, reference: Column) -> Column:
    """Whether a person should confirm a match."""
    tagged = F.size(tag_set(detected)) > 0
    return (
        (name == "unknown") | (conf < LOW_CONFIDENCE)
        | (tagged & (overlap_score(detected, reference) == 0))
        | ((mode == "partial_type") & (conf < PARTIAL_WITHOUT_REVIEW))
        | ((mode == "global") & (conf < GLOBAL_WITHOUT_REVIEW))
    )


def review_flag(df: DataFrame, detected: str = "detected_types") -> DataFrame:
    return df.withColumn("needs_review", needs_review(
        F.col("name"), F.col("confidence"), F.col("mode"), F.col(detected), F.col("reference_types")))


def arbitrate_matches(queries: DataFrame, filtered: DataFrame, everywhere: DataFrame, query_id: str = "q",
                      detected: str = "detected_types") -> DataFrame:
    """Choose the filtered or the global best per query by ordered rules and flag it for review."""
    fields = [c for c in filtered.columns if c != query_id]
    pack = lambda df, name: df.select(query_id, F.struct(*fields).alias(name))
    rows = queries.select(query_id, detected).join(pack(filtered, "t"), query_id).join(pack(everywhere, "g"), query_id)
    tags = F.col(detected)
    conf_t, conf_g = F.col("t.confidence"), F.col("g.confidence")
    over_t = overlap_score(tags, F.col("t.reference_types"))
    over_g = overlap_score(tags, F.col("g.reference_types"))
    rule = (
        F.when(F.size(tag_set(tags)) == 0, "embedding-global")
        .when((conf_g >= NEAR_EXACT) & (conf_g >= conf_t + NEAR_EXACT_MARGIN), "embedding-near-exact-global-rescue")
        .when((conf_g >= STRONG_RESCUE) & (conf_g >= conf_t + STRONG_RESCUE_MARGIN), "embedding-strong-global-rescue")
        .when((F.col("t.mode") != "global") & (conf_t >= FILTER_CONFIDENCE), F.col("t.reason"))
        .when(conf_g + over_g * CONSISTENCY_BONUS >= conf_t + over_t * CONSISTENCY_BONUS + OVERRIDE_MARGIN,
              "embedding-global-fallback")
        .otherwise(F.col("t.reason"))
    )
    rows = rows.withColumn("reason", rule)
    from_global = F.col("reason").isin(
        "embedding-near-exact-global-rescue", "embedding-strong-global-rescue", "embedding-global-fallback") | (
        F.size(tag_set(tags)) == 0)
    rows = rows.withColumn("c", F.when(from_global, F.col("g")).otherwise(F.col("t")))
    compact = lambda side: F.struct(*[F.col(f"{side}.{f}").alias(f) for f in
                                      ("name", "confidence", "distance", "path", "reference_types", "mode", "candidate_count")])
    kept = [f for f in fields if f not in ("reason",)]
    out = rows.select(
        query_id, detected, *[F.col(f"c.{f}").alias(f) for f in kept], "reason",
        F.when(from_global, over_g).otherwise(over_t).alias("overlap_score"),
        compact("t").alias("filtered_best"), compact("g").alias("global_best"))
    return review_flag(out, detected)


def rerank_by_tags(hits: DataFrame, references: DataFrame, queries: DataFrame, query_id: str = "q",
                   base_id: str = "id", detected: str = "detected_types") -> DataFrame:
    """Winner among the ranked hits by similarity plus tag bonus, then similarity, then rank."""
    rows = (
        hits.where(F.col("rank") <= RERANK_DEPTH).join(references.select(base_id, "name", "types"), base_id)
        .join(queries.select(query_id, detected), query_id)
    )
    bonus = F.when(F.size(tag_set(F.col(detected), True)) > 0, overlap_score(F.col(detected), F.col("types"), "bonus")).otherwise(0.0)
    order = F.struct((F.col("score") + bonus).alias("total"), "score", (-F.col("rank")).alias("neg"))
    best = rows.groupBy(query_id).agg(
        F.max_by(F.struct(base_id, "name", "types", "score", "rank", detected), order).alias("w"))
    changed = F.col("w.rank") > 1
    out = best.select(query_id, "w.*")
    reference, seen = tag_set(F.col("types"), True), tag_set(F.col(detected), True)
    return out.select(
        query_id, base_id, "name", "types", F.col("rank").alias("hit_rank"), "score",
        F.bround(confidence(F.col("score")), 4).alias("confidence"), F.bround("score", 4).alias("similarity"),
        F.when(F.col("rank") > 1, "tag-guided").otherwise("nearest").alias("reason"),
        ((F.col("name") == "unknown") | (F.col("score") < RERANK_REVIEW)).alias("needs_review"),
        ((F.size(reference) > 0) & (F.size(seen) > 0) & (reference != seen)).alias("tag_mismatch"))


def tag_guard(matches: DataFrame, detected: str = "detected_types") -> DataFrame:
    """Turn a match without any common tag into ``unknown`` unless it is nearly exact."""
    seen, reference = tag_set(F.col(detected)), tag_set(F.col("reference_types"))
    missing = (F.size(seen) == 0) | (F.size(reference) == 0)
    clash = ~missing & ~F.arrays_overlap(seen, reference)
    exact = F.coalesce("confidence", F.lit(0.0)) >= TAG_GUARD_CONFIDENCE
    rejected = clash & ~exact
    flagged = F.col("needs_review") if "needs_review" in matches.columns else F.lit(False)
    kept = [c for c in matches.columns if c not in ("name", "confidence", "needs_review")]
    return matches.select(
        *kept, F.when(rejected, "unknown").otherwise(F.col("name")).alias("name"),
        F.when(rejected, 0.0).otherwise(F.col("confidence")).alias("confidence"),
        (missing | clash | flagged).alias("needs_review"), clash.alias("tag_mismatch"),
        F.when(missing, "missing-types").when(clash & exact, "near-exact-visual-type-mismatch")
        .when(clash, "rejected-zero-type-overlap").alias("guard_reason"),
        F.when(rejected, F.col("name")).alias("rejected_name"),
        F.when(rejected, F.col("confidence")).alias("rejected_confidence"))


def best_variant(hits: DataFrame, item: str = "item", variant: str = "variant") -> DataFrame:
    """Best match over the variants of an item; the first variant wins ties; low ones need review.

    ``hits`` has ``item, variant, id, score``; ``variant`` orders the variants.
    """
    conf = F.bround(confidence(F.col("score")), 4)
    rest = [c for c in hits.columns if c != item]
    rows = hits.withColumn("_c", conf)
    best = rows.groupBy(item).agg(F.min_by(F.struct(*rest, "_c"), F.struct((-F.col("_c")).alias("c"), variant, "id")).alias("b"))
    return best.select(item, "b.*").withColumnRenamed("_c", "confidence").withColumn(
        "needs_review", F.col("confidence") < VARIANT_REVIEW)


def substitute_pair(tags: Column, table: Mapping[tuple, tuple] = PAIR_SUBSTITUTES) -> Column:
    """Replace a known tag set by its stand-in, keep anything else in order."""
    entries = [x for key, value in table.items()
               for x in (F.lit("|".join(sorted(key))), F.array(*[F.lit(v) for v in value]))]
    return F.coalesce(F.create_map(*entries)[F.array_join(F.array_sort(F.array_distinct(tags)), "|")], tags)


def smaller_overlap(a: Column, b: Column) -> Column:
    """Shared area of two boxes over the smaller area; zero for an empty box."""
    w = F.greatest(F.lit(0), F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0), F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"]))
    area = F.least(a["width"] * a["height"], b["width"] * b["height"])
    return F.when(area > 0, w * h / area).otherwise(0.0)


def select_distinct_nonoverlap(detections: DataFrame, item: str = "item", pos: str = "pos",
                               table: Mapping[tuple, tuple] = PAIR_SUBSTITUTES) -> DataFrame:
    """Up to two detections per item with different tags and little overlap.

    The greedy choice of two is two aggregates: the best detection, then the best one that
    differs from it and hardly covers it. No item is gathered in one place.
    """
    rank = F.bround(F.col("confidence") + F.coalesce("quality", F.lit(0.0)) * QUALITY_WEIGHT, 4)
    rows = detections.where((F.coalesce("tag", F.lit("")) != "") & (F.col("confidence") >= FILTER_CONFIDENCE))
    rows = rows.withColumn("selection_score", rank)
    order = F.struct((-F.col("selection_score")).alias("s"), (-F.col("confidence")).alias("c"), F.col(pos).alias("p"))
    body = F.struct("tag", "confidence", "selection_score", "x", "y", "width", "height", pos)
    first = rows.groupBy(item).agg(F.min_by(body, order).alias("a"))
    rest = rows.withColumn("_b", body).withColumn("_o", order).join(first, item)
    rest = rest.where((F.col("tag") != F.col("a.tag")) & (smaller_overlap(F.col("_b"), F.col("a")) <= OVERLAP_LIMIT))
    second = rest.groupBy(item).agg(F.min_by("_b", "_o").alias("b"))
    pairs = first.join(second, item, "left")
    chosen = F.array_compact(F.array("a", "b"))
    return pairs.select(
        item, substitute_pair(F.transform(chosen, lambda s: s["tag"]), table).alias("selected"),
        F.transform(F.array_sort(F.transform(chosen, lambda s: F.struct(s["x"].alias("x"), s[pos].alias("p"), s["tag"].alias("tag")))),
                    lambda s: s["tag"]).alias("tags_by_x"))


def merge_evidence(embedding: DataFrame, template: DataFrame, item: str = "item") -> DataFrame:
    """Decide per item between an embedding match and a template match.

    Both carry ``name, confidence, reason``; the embedding side also ``mode``.
    """
    e = embedding.select(item, F.struct("name", "confidence", "reason", "mode", "needs_review").alias("e"))
    t = template.select(item, F.struct("name", "confidence", "reason").alias("t"))
    rows = e.join(t, item, "full_outer")
    ce, ct = F.coalesce("e.confidence", F.lit(0.0)), F.coalesce("t.confidence", F.lit(0.0))
    rule = (
        F.when(F.col("e").isNotNull() & (ce >= EVIDENCE_ACCEPT), "embedding")
        .when(F.col("e.mode").isin("exact_type", "contains_all_types") & (ce >= FILTERED_FAST), "embedding-fast")
        .when((F.col("e.mode") == "global") & (ce >= GLOBAL_FAST), "embedding-fast")
        .when(ct >= TEMPLATE_ACCEPT, "template")
        .when(F.col("e").isNotNull() & (ce >= ct), "embedding-weak")
        .otherwise("template-weak")
    )
    rows = rows.withColumn("rule", rule)
    own = F.col("rule").startswith("embedding")
    reason = (F.when(F.col("rule") == "embedding-fast", F.concat("e.reason", F.lit("-fast")))
              .when(own, F.col("e.reason")).otherwise(F.coalesce("t.reason", F.lit("template"))))
    return rows.select(
        item, F.when(own, F.col("e.name")).otherwise(F.coalesce("t.name", F.lit("unknown"))).alias("name"),
        F.when(own, ce).otherwise(ct).alias("confidence"), "rule", reason.alias("reason"),
        F.when(F.col("rule") == "embedding", F.col("e.needs_review")).when(F.col("rule") == "template", F.lit(False))
        .otherwise(F.lit(True)).alias("needs_review"))


def combine_tag_evidence(df: DataFrame, table: Mapping[tuple, tuple] = PAIR_SUBSTITUTES) -> DataFrame:
    """Selected tags from the embedding list, the template list and the embedding details.

    Reads ``embedding_tags``, ``template_tags``, ``template_source``, ``has_boxes`` and
    ``details array<struct<tag, confidence, has_symbol, source, quality, idx>>``.
    """
    e, t = F.coalesce("embedding_tags", none_tags()), F.coalesce("template_tags", none_tags())
    first_e, first_t = F.get(e, F.lit(0)), F.get(t, F.lit(0))
    single = (F.size(e) == 1) & (F.size(t) == 1) & (first_e != first_t)
    strong = F.filter("details", lambda d: (d["tag"] == first_e) & d["has_symbol"] & (d["confidence"] >= 0.84))
    weak = F.exists("details", lambda d: (d["source"] == FALLBACK_SOURCE) | ~d["has_symbol"] | (d["confidence"] < 0.80))
    own = F.get(F.filter("details", lambda d: d["tag"] == first_e), F.lit(0))
    pair_e, pair_t = F.slice(substitute_pair(e, table), 1, 2), F.slice(substitute_pair(t, table), 1, 2)
    shaky = F.exists("details", lambda d: (F.coalesce(d["tag"], F.lit("")) != "") & ~F.array_contains(pair_t, d["tag"])
                     & d["source"].isin(*WEAK_SOURCES) & (F.coalesce(d["quality"], F.lit(0.0)) <= WEAK_QUALITY))
    pair = ((F.size(pair_e) == 2) & (F.size(pair_t) == 2) & (F.array_sort(pair_e) != F.array_sort(pair_t))
            & shaky & F.arrays_overlap(pair_e, pair_t))
    template_first = (F.size(t) > 0) & (
        F.coalesce("template_source", F.lit("")).startswith("type_combo_template")
        | F.coalesce("template_source", F.lit("")).startswith("single_type_template"))
    rule = (
        F.when(F.col("has_boxes") & (F.size(e) > 0), "type_embedding_object_layer")
        .when(template_first, F.col("template_source"))
        .when(single & (F.size(strong) >= 2), "type_embedding_cv_complement")
        .when(single & weak & (own["idx"] == 2), "cv_template_embedding_disagreement")
        .when(pair, "cv_template_weak_embedding_fallback")
        .when(F.size(e) > 0, "type_embedding").otherwise("cv_template_fallback")
    )
    rows = df.withColumn("rule", rule)
    kind = F.col("rule")
    both = F.array(first_e, first_t)
    chosen = (
        F.when(kind.isin("type_embedding_object_layer", "type_embedding"), pair_e)
        .when(kind == "type_embedding_cv_complement", F.slice(substitute_pair(substitute_pair(both, table), table), 1, 2))
        .when(kind == "cv_template_fallback", pair_t).otherwise(t)
    )
    rows = rows.withColumn("selected", chosen)
    dual = F.size("selected") > 1
    counted = kind.isin("type_embedding_object_layer", "type_embedding", "type_embedding_cv_complement", "cv_template_fallback")
    inside = F.filter("details", lambda d: F.array_contains(F.col("selected"), d["tag"]))
    strongest = F.array_min(F.transform(inside, lambda d, i: F.struct(
        (-d["confidence"]).alias("c"), (~d["has_symbol"]).alias("s"),
        F.when(F.coalesce(d["idx"], F.lit(0)) == 0, 99).otherwise(d["idx"]).alias("n"), i.alias("i"), d["tag"].alias("tag"))))
    return rows.withColumn("source", F.when(counted & dual, F.concat(kind, F.lit("_dual"))).otherwise(kind)).withColumn(
        "strongest", F.when(counted & dual, F.coalesce(strongest["tag"], F.get("selected", F.lit(0)))))


def trusted_tags(df: DataFrame) -> DataFrame:
    """Keep selected tags only when their evidence is confident."""
    source = F.coalesce("source", F.lit(""))
    firm = F.transform(F.filter("details", lambda d: F.coalesce(d["accepted"], F.lit(True)) & d["has_symbol"]
                                & (d["confidence"] >= 0.80)), lambda d: d["tag"])
    all_firm = F.size(F.array_except("selected", firm)) == 0
    combo = ~F.coalesce("combo_review", F.lit(True)) & (F.coalesce("combo_score", F.lit(0.0)) >= COMBO_TRUST)
    keep = (source.startswith("type_embedding_object_layer") & all_firm) | (source.startswith("type_combo_template") & combo)
    return df.withColumn("trusted", F.when(keep & (F.size("selected") > 0), F.col("selected")).otherwise(none_tags()))


def use_fixed_match(current_name: Column, current_conf: Column, fixed_name: Column, fixed_conf: Column,
                    fixed_types: Column, detected: Column) -> Column:
    """Whether a fixed-crop match replaces the current one."""
    usable = fixed_name.isNotNull() & (fixed_name != "unknown") & (fixed_conf >= 0.50) & (F.size(fixed_types) >= 2)
    clash = (F.size(detected) > 0) & ~F.arrays_overlap(detected, fixed_types)
    decided = (
        F.when(current_name == "unknown", fixed_conf >= 0.52)
        .when(fixed_conf < current_conf + 0.08, False)
        .when(clash, (fixed_conf >= 0.62) & (fixed_conf >= current_conf + 0.14)).otherwise(True)
    )
    return F.coalesce(usable & decided, F.lit(False))


def weighted_evidence(scores: DataFrame, item: str = "item", pos: str = "pos", expected: str | None = None) -> DataFrame:
    """Best candidate per item by the weighted component score; weak ones lose their tags."""
    rows = scores.where(F.col(expected).isNull() | (F.size("types") == F.col(expected))) if expected else scores
    score = F.bround(F.col("pixel") * 0.45 + F.col("colour") * 0.35 + F.col("feature") * 0.20, 4)
    rows = rows.withColumn("score", score)
    rest = [c for c in rows.columns if c != item]
    best = rows.groupBy(item).agg(F.min_by(F.struct(*rest), F.struct((-F.col("score")).alias("s"), pos)).alias("b"))
    low = F.col("score") < COMBO_FLOOR
    return best.select(item, "b.*").select(
        item, *[c for c in rest if c != "types"], F.when(low, none_tags()).otherwise(F.col("types")).alias("types"),
        F.when(low, "low_confidence").otherwise("template").alias("source"), (F.col("score") < COMBO_TRUST).alias("needs_review"))


def preference_score(gray: str = "gray", colour: str = "colour", pgray: str = "partial_gray",
                     pcolour: str = "partial_colour") -> Column:
    standard = F.greatest(F.col(gray), F.col(colour))
    return F.greatest(standard, F.greatest(F.col(pgray), F.col(pcolour)) * 0.70 + standard * 0.30)


def preferred_reference(matches: DataFrame, scores: DataFrame, overrides: DataFrame, query_id: str = "q") -> DataFrame:
    """Replace a winner by a preferred name that scores nearly as well.

    ``matches`` has ``q, tags, winner, winner_score``; ``scores`` has ``q, name, pos, score``;
    ``overrides`` has ``tag_key, winner_name`` (null for any other), ``preferred, prio``.
    """
    keyed = matches.withColumn("tag_key", _tag_key(F.col("tags")))
    applies = F.coalesce(F.col("winner") == F.col("winner_name"), F.col("winner") != F.col("preferred"))
    wanted = keyed.join(overrides, "tag_key").where(applies).select(query_id, "winner_score", "preferred", "prio")
    near = wanted.join(scores.withColumnRenamed("name", "preferred"), [query_id, "preferred"])
    near = near.where(F.col("score") >= F.col("winner_score") - PREFERENCE_MARGIN)
    best = near.groupBy(query_id).agg(F.min_by(
        F.struct("preferred", "score"), F.struct("prio", (-F.col("score")).alias("s"), "pos")).alias("p"))
    return matches.join(best, query_id, "left").select(
        query_id, F.coalesce("p.preferred", "winner").alias("name"),
        F.coalesce("p.score", "winner_score").alias("score"), F.col("p").isNotNull().alias("overridden"))


def fallback_order(pos: str = "pos") -> Column:
    """First reference that is not shiny, then not female, then in order."""
    return F.struct(F.col("is_shiny"), F.lower(F.coalesce("form", F.lit(""))).contains("female"), F.col(pos))


def staged_rerank(scores: DataFrame, k1: int = SECOND_STAGE, k2: int = THIRD_STAGE, query_id: str = "q") -> DataFrame:
    """Cheap score for all, a second for the top ``k1``, a third for the top ``k2``, then floors.

    ``scores`` has one row per query and reference with four-decimal components ``gray, colour,
    feature, partial_gray, partial_colour``, flags ``in_pool, is_rescue, is_shiny, tagged`` and
    ``name, species, form, pos``. Whole-pool facts are aggregates; only the top ``k1`` rows are
    ever gathered per query.
    """
    ref = F.struct("name", "species", "pos")
    pool = F.col("in_pool")
    blended = F.greatest("partial_gray", "partial_colour") * 0.70 + F.greatest("gray", "colour") * 0.30
    wide = scores.groupBy(query_id).agg(
        F.count_if(pool).alias("pool_size"), F.bool_or("tagged").alias("tagged"),
        F.max_by(F.struct(blended.alias("s"), ref.alias("r")),
                 F.when(pool, F.struct(blended, -F.col("pos")))).alias("partial"),
        F.max_by(F.struct(preference_score().alias("s"), ref.alias("r")),
                 F.when(F.col("is_rescue"), F.struct(preference_score(), -F.col("pos")))).alias("rescue"),
        F.min_by(ref, F.when(pool, fallback_order())).alias("fallback"))
    top = top_k_per_key(scores.where(pool), [query_id], [F.desc("gray"), F.asc("pos")], k1)
    second = F.greatest("gray", "colour")
    gathered = top.groupBy(query_id).agg(
        F.array_sort(F.collect_list(F.struct((-second).alias("k"), "rank", second.alias("s2"), "gray",
                                             F.greatest(second, F.col("feature")).alias("s3"), ref.alias("r")))).alias("c"),
        F.size(F.collect_set("species")).alias("species_seen"))

    def leader(array: Column, score: str) -> Column:
        return F.array_min(F.transform(array, lambda e, i: F.struct(
            (-e[score]).alias("k"), i.alias("i"), e[score].alias("s"), e["r"].alias("r"))))

    by_gray = F.array_sort(F.transform("c", lambda e: F.struct(
        e["rank"].alias("rank"), e["gray"].alias("gray"), e["s2"].alias("s2"), e["r"].alias("r"))))
    rows = wide.join(gathered, query_id, "left")
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("struct<name:string,species:string,pos:bigint>").alias("r"))

    def better(current: Column, challenger: Column) -> Column:
        cand = F.struct(F.bround(challenger["s"], 4).alias("s"), challenger["r"].alias("r"))
        return F.when(challenger.isNotNull() & (challenger["s"] > current["s"]), cand).otherwise(current)

    rows = rows.withColumn("g", by_gray).withColumn("b1", better(zero, leader(F.col("g"), "gray")))
    rows = rows.withColumn("b2", better(F.col("b1"), leader(F.col("g"), "s2")))
    rows = rows.withColumn("b3", better(F.col("b2"), leader(F.slice("c", 1, k2), "s3")))
    rows = rows.withColumn("b4", F.when(F.col("b3.s") < PARTIAL_BELOW, better(F.col("b3"), F.col("partial"))).otherwise(F.col("b3")))
    rescued = ((F.col("b4.s") < RESCUE_BELOW) & (F.col("rescue.s") >= RESCUE_SCORE)
               & (F.col("rescue.s") >= F.col("b4.s") + RESCUE_MARGIN))
    rows = rows.withColumn("rescued", F.coalesce(rescued, F.lit(False)))
    rows = rows.withColumn("b5", F.when(F.col("rescued"), F.struct(F.bround("rescue.s", 4).alias("s"), F.col("rescue.r").alias("r")))
                           .otherwise(F.col("b4")))
    low = F.col("b5.s") < MIN_DETECTION
    narrow = F.col("tagged") & (F.col("pool_size") <= 8) & (F.col("species_seen") <= 3)
    confirmed = low & narrow & ((F.col("species_seen") == 1) | (F.col("b5.s") >= PARTIAL_BELOW))
    confirmed = F.coalesce(confirmed, F.lit(False))
    floor = F.when(F.col("species_seen") == 1, CONFIRMED_FLOOR).otherwise(SUPPORTED_FLOOR)
    return rows.select(
        query_id,
        F.when(confirmed, F.coalesce("b5.r.name", "fallback.name")).when(low, "unknown").otherwise(F.col("b5.r.name")).alias("name"),
        F.when(confirmed, F.greatest("b5.s", floor)).otherwise(F.col("b5.s")).alias("confidence"),
        F.when(confirmed, "type-confirmed").when(low, "").when(F.col("rescued"), "guided-visual-rescue").otherwise("").alias("reason"),
        F.col("pool_size"))


def method_priority(df: DataFrame, table: Mapping[tuple, tuple] = PAIR_SUBSTITUTES) -> DataFrame:
    """Tag list by detector priority: component, combined, agreement of fixed and symbol."""
    col = lambda c: F.coalesce(c, none_tags())
    component, combined, fixed, symbol = col("component"), col("combined"), col("fixed"), col("symbol")
    agreed = F.filter(fixed, lambda t: F.array_contains(symbol, t))
    chosen = (
        F.when(F.size(component) > 0, substitute_pair(F.slice(component, 1, 2), table))
        .when(F.size(combined) >= 2, substitute_pair(F.slice(combined, 1, 2), table))
        .when(F.size(combined) == 1, combined)
        .when(F.size(agreed) > 0, substitute_pair(F.slice(agreed, 1, 2), table))
        .when(fixed == F.array(F.lit(SINGLE_VALUE_EXCEPTION)), fixed).otherwise(none_tags())
    )
    return df.withColumn("selected", chosen)


def candidate_gap(hits: DataFrame, query_id: str = "q", label: str = "label", shown: int = 5) -> DataFrame:
    """Gap between the two best scores, top labels and a compact string, from ranked hits."""
    top = hits.where(F.col("rank") <= shown)
    packed = F.array_sort(F.collect_list(F.struct("rank", F.col(label).alias("label"), "score")))
    rows = top.groupBy(query_id).agg(packed.alias("top"))
    text = F.transform("top", lambda s: F.format_string("%s:%.3f", s["label"], F.bround(s["score"], 3)))
    return rows.select(
        query_id, (F.get("top", F.lit(0))["score"] - F.get("top", F.lit(1))["score"]).alias("gap"),
        F.array_join(text, " | ").alias("top_text"), "top")


def blocked_reference(allow: Sequence[str] = (), filenames: Sequence[str] = ()) -> Column:
    """Whether a reference is a blocked form or a blocked file; allowed names never are."""
    path = F.lower(F.translate(F.coalesce("path", F.lit("")), "\\", "/"))
    word = F.greatest(*[F.coalesce(c, F.lit("")).rlike("(?i)\\bmega\\b") for c in ("name", "species", "form")])
    blocked = word | path.rlike("(^|[-_/])mega($|[-_. /])") | path.contains("gigantamax")
    if filenames:
        blocked = blocked | F.element_at(F.split(path, "/"), -1).isin(*filenames)
    if allow:
        blocked = blocked & ~F.coalesce("name", F.lit("")).isin(*allow)
    return blocked


def prune_index(index: DataFrame, allow: Sequence[str] = (), filenames: Sequence[str] = ()) -> DataFrame:
    """Index without blocked references; an index that loses everything is an error."""
    kept = index.where(~blocked_reference(allow, filenames))
    if kept.isEmpty():
        raise ValueError("pruning removed every reference")
    return kept


def prune_counts(index: DataFrame, allow: Sequence[str] = (), filenames: Sequence[str] = ()) -> DataFrame:
    blocked = blocked_reference(allow, filenames)
    return index.agg(F.count("*").alias("before"), F.count_if(blocked).alias("removed"), F.count_if(~blocked).alias("after"))


def cap_per_class(files: DataFrame, n: int, seed: int, label: str = "label", path: str = "path", salts: int = 64) -> DataFrame:
    """At most ``n`` distinct paths per label in seeded hash order.

    Rows are cut per (label, salt) first, so a dominant label is never sorted in one task.
    """
    rows = files.select(label, path).distinct().withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), path)))
    order = [F.asc("_h"), F.asc(path)]
    rows = rows.withColumn("_s", F.pmod(F.xxhash64(path), F.lit(salts)))
    rows = top_k_per_key(rows, [label, "_s"], order, n).drop("_s", "rank")
    return top_k_per_key(rows, [label], order, n).drop("_h", "rank")
