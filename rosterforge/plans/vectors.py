"""Vector search over the embeddings table and arbitration on its results."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterforge.functions.vectors import confidence as conf_of, l2_normalize as normalize, overlap_score as overlap
from rosterforge.operators import vectors as ops
from rosterforge.plans.registry import query
from rosterforge.plans.standins import SQL_FILES, SQL_TAGS, TAGS, files, table, tag_at

# References are the stored vectors; every query is a stored vector with a quarter of its
# values blanked, so that no query meets an exact copy.


def references(spark, sf):
    e = table(spark, sf, "embeddings")
    label, key = F.col("label"), F.col("vec_id")
    types = F.when(key % 11 != 0, F.array_distinct(F.array(tag_at(label), tag_at((label * 3 + key % 3) % 18)))).otherwise(
        F.array().cast("array<string>"))
    return e.select(
        key.alias("id"), F.col("embedding").alias("vector"), label, types.alias("types"),
        F.concat(F.lit("E"), label.cast("string"), F.when(key % 13 == 0, " Mega").when(key % 17 == 0, " Meganium").otherwise("")).alias("name"),
        F.concat(F.lit("S"), label.cast("string")).alias("species"), F.when(key % 5 == 0, "Female").otherwise("").alias("form"),
        F.concat(F.lit("ref/"), label.cast("string"), F.when(key % 19 == 0, "/x-mega_").when(key % 23 == 0, "/Gigantamax").otherwise("/p"),
                 key.cast("string"), F.lit(".png")).alias("path"),
        (key % 4 == 0).alias("is_shiny"))


def query_rows(spark, sf):
    e = table(spark, sf, "embeddings")
    key, label = F.col("vec_id"), F.col("label")
    blanked = F.transform("embedding", lambda x, i: F.when(i % 4 == key % 4, 0.0).otherwise(x.cast("double")))
    tags = (F.when(key % 6 == 0, F.array().cast("array<string>")).when(key % 6 == 1, F.array(tag_at(label)))
            .when(key % 6 == 2, F.array(tag_at(label), tag_at(label * 3 % 18))).when(key % 6 == 3, F.array(tag_at(F.lit(17))))
            .when(key % 6 == 4, F.array(tag_at(F.lit(16)), tag_at(label))).otherwise(F.array(F.lit("no-such-tag"))))
    return e.select(key.alias("q"), blanked.alias("vector"), F.array_distinct(tags).alias("detected_types"))


SQL_VECS = f"""refs AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label, CASE WHEN vec_id % 11 = 0 THEN []::VARCHAR[]
    WHEN label = (label * 3 + vec_id % 3) % 18 THEN [{SQL_TAGS}[label + 1]] ELSE [{SQL_TAGS}[label + 1], {SQL_TAGS}[(label * 3 + vec_id % 3) % 18 + 1]] END AS types,
  'E' || label || CASE WHEN vec_id % 13 = 0 THEN ' Mega' WHEN vec_id % 17 = 0 THEN ' Meganium' ELSE '' END AS name, 'S' || label AS species,
  'ref/' || label || CASE WHEN vec_id % 19 = 0 THEN '/x-mega_' WHEN vec_id % 23 = 0 THEN '/Gigantamax' ELSE '/p' END || vec_id || '.png' AS path
  FROM embeddings),
qs AS (SELECT vec_id AS q, list_transform(embedding::DOUBLE[], lambda x, i: CASE WHEN (i - 1) % 4 = vec_id % 4 THEN 0.0 ELSE x END) AS v,
  list_sort(list_distinct(CASE vec_id % 6 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [{SQL_TAGS}[label + 1]] WHEN 2 THEN [{SQL_TAGS}[label + 1], {SQL_TAGS}[label * 3 % 18 + 1]]
    WHEN 3 THEN ['fairy'] WHEN 4 THEN ['steel', {SQL_TAGS}[label + 1]] ELSE ['no-such-tag'] END)) AS det FROM embeddings),
pairs AS (SELECT q, id, list_inner_product(qs.v, refs.v) AS s, det, list_sort(types) AS types FROM qs, refs)"""
SQL_POOLS = SQL_VECS + """,
lv AS (SELECT *, CASE WHEN len(det) = 0 THEN 4 WHEN len(types) = 0 THEN 5 WHEN det = types THEN 1 WHEN list_has_all(types, det) THEN 2
  WHEN list_has_any(types, det) THEN 3 ELSE 5 END AS lvl FROM pairs),
bestlv AS (SELECT q, least(min(lvl), 4) AS b FROM lv GROUP BY 1),
pooled AS (SELECT lv.*, b, CASE b WHEN 1 THEN 'exact_type' WHEN 2 THEN 'contains_all_types' WHEN 3 THEN 'partial_type' ELSE 'global' END AS mode
  FROM lv JOIN bestlv USING (q) WHERE b = 4 OR lvl <= b)"""
_OVER = """CASE WHEN len({d}) = 0 OR len({r}) = 0 THEN {n0} WHEN {d} = {r} THEN {a} WHEN list_has_all({r}, {d}) THEN {b} WHEN list_has_any({r}, {d}) THEN {c} ELSE {n1} END"""


def _over(d, r, scale=(0, 1, 0.85, 0.55, 0)):
    n0, a, b, c, n1 = scale
    return _OVER.format(d=d, r=r, n0=f"{n0}::DOUBLE", a=f"{a}::DOUBLE", b=f"{b}::DOUBLE", c=f"{c}::DOUBLE", n1=f"{n1}::DOUBLE")


SQL_MATCHES = SQL_POOLS + f""",
t0 AS (SELECT *, count(*) OVER (PARTITION BY q) AS n, row_number() OVER (PARTITION BY q ORDER BY s DESC, id) AS r FROM pooled),
t AS (SELECT q, id, s, mode, n, types, det, round(greatest(0, least(1, (s + 1) / 2)), 4) AS c FROM t0 WHERE r = 1),
g0 AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, id) AS r, count(*) OVER (PARTITION BY q) AS n FROM pairs),
g AS (SELECT q, id, s, types, n, round(greatest(0, least(1, (s + 1) / 2)), 4) AS c FROM g0 WHERE r = 1),
m0 AS (SELECT t.q, t.det, t.id AS tid, g.id AS gid, t.c AS tc, g.c AS gc, t.mode AS tmode, t.types AS tt, g.types AS gt, t.n AS tn,
  {_over('t.det', 't.types')} AS tov, {_over('t.det', 'g.types')} AS gov FROM t JOIN g USING (q)),
m1 AS (SELECT *, CASE WHEN len(det) = 0 THEN 'embedding-global' WHEN gc >= 0.985 AND gc >= tc + 0.06 THEN 'embedding-near-exact-global-rescue'
  WHEN gc >= 0.91 AND gc >= tc + 0.07 THEN 'embedding-strong-global-rescue' WHEN tmode <> 'global' AND tc >= 0.78 THEN 'embedding-' || replace(tmode, '_', '-')
  WHEN gc + gov * 0.08 >= tc + tov * 0.08 + 0.10 THEN 'embedding-global-fallback' ELSE 'embedding-' || replace(tmode, '_', '-') END AS reason FROM m0),
m2 AS (SELECT *, len(det) = 0 OR reason IN ('embedding-near-exact-global-rescue', 'embedding-strong-global-rescue', 'embedding-global-fallback') AS gl FROM m1),
m3 AS (SELECT q, det, CASE WHEN gl THEN gid ELSE tid END AS id, CASE WHEN gl THEN gc ELSE tc END AS c, CASE WHEN gl THEN 'global' ELSE tmode END AS mode,
  CASE WHEN gl THEN gt ELSE tt END AS types, CASE WHEN gl THEN gov ELSE tov END AS ov, reason, tid, gid FROM m2),
arb AS (SELECT m3.*, c < 0.74 OR (len(det) > 0 AND ov = 0) OR (mode = 'partial_type' AND c < 0.86) OR (mode = 'global' AND c < 0.88) AS review FROM m3)"""


def _bp(col, scale=10000):
    return F.round(F.col(col) * scale).cast("long")


@query("l2_normalize", """SELECT vec_id, CAST(round(list_sum(list_transform(v, lambda x: x * x)) * 1000000) AS BIGINT) AS norm,
  CAST(round(v[1] * 1000000) AS BIGINT) AS first FROM (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN list_transform(e, lambda x: 0.0::DOUBLE)
   ELSE list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) END AS v
   FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (1 + vec_id % 7)) AS e FROM embeddings))""")
def l2_normalize(spark, sf):
    e = table(spark, sf, "embeddings")
    scale = F.when(F.col("vec_id") % 10 == 0, 0).otherwise(1 + F.col("vec_id") % 7)
    rows = e.select("vec_id", normalize(F.transform("embedding", lambda x: x.cast("double") * scale)).alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    return rows.select("vec_id", F.round(norm * 1000000).cast("long").alias("norm"),
                       F.round(F.get("v", F.lit(0)) * 1000000).cast("long").alias("first"))


@query("knn_topk", f"""WITH {SQL_VECS} SELECT q, rank, id, CAST(round(s * 1000000) AS BIGINT) AS score FROM (SELECT *,
  row_number() OVER (PARTITION BY q ORDER BY s DESC, id) AS rank FROM pairs) WHERE rank <= 5""")
def knn_topk(spark, sf):
    hits = ops.knn_topk(query_rows(spark, sf), references(spark, sf), 5)
    return hits.select("q", "rank", "id", F.round(F.col("score") * 1000000).cast("long").alias("score"))


@query("confidence", f"""WITH {SQL_VECS}, b AS (SELECT q, id, s FROM pairs WHERE q = id)
SELECT q, CAST(round(greatest(0, least(1, (s + 1) / 2)) * 10000) AS BIGINT) AS confidence, CAST(round((1 - s) * 10000) AS BIGINT) AS distance FROM b""")
def confidence(spark, sf):
    from rosterforge.functions.vectors import dot
    rows = query_rows(spark, sf).join(references(spark, sf).select(F.col("id").alias("q"), F.col("vector").alias("r")), "q")
    rows = ops.with_confidence(rows.select("q", dot(F.col("vector"), F.col("r")).alias("score")))
    return rows.select("q", _bp("confidence").alias("confidence"), _bp("distance").alias("distance"))


@query("candidate_pools", f"WITH {SQL_POOLS} SELECT q, any_value(mode) AS mode, count(*) AS candidate_count FROM pooled GROUP BY 1")
def candidate_pools(spark, sf):
    return ops.candidate_pools(query_rows(spark, sf), references(spark, sf))


@query("filtered_nearest", f"WITH {SQL_MATCHES} SELECT q, id, mode, n AS candidate_count, CAST(round(c * 10000) AS BIGINT) AS confidence FROM t")
def filtered_nearest(spark, sf):
    out = ops.filtered_nearest(query_rows(spark, sf), references(spark, sf))
    return out.select("q", "id", "mode", "candidate_count", _bp("confidence").alias("confidence"))


def _arbitrated(spark, sf):
    q, r = query_rows(spark, sf), references(spark, sf)
    return ops.arbitrate_matches(q, ops.filtered_nearest(q, r), ops.global_nearest(q, r))


@query("arbitrate_matches", f"""WITH {SQL_MATCHES} SELECT q, id, CAST(round(c * 10000) AS BIGINT) AS confidence, mode, reason,
  CAST(round(ov * 100) AS BIGINT) AS overlap, review AS needs_review FROM arb""")
def arbitrate_matches(spark, sf):
    return _arbitrated(spark, sf).select("q", "id", _bp("confidence").alias("confidence"), "mode", "reason",
                                         _bp("overlap_score", 100).alias("overlap"), "needs_review")


def _evidence(spark, sf):
    """Events as matches with a confidence, a mode and two tag lists."""
    e = table(spark, sf, "events")
    key, user = F.col("event_id"), F.col("user_id")
    none = F.array().cast("array<string>")
    modes = F.array(*[F.lit(m) for m in ops.MODES])
    return e.select(
        key, user, F.when(key % 29 == 0, "unknown").otherwise(F.concat(F.lit("E"), user.cast("string"))).alias("name"),
        (F.floor(F.col("value") * 37) % 1001 / 1000).alias("confidence"),
        F.get(modes, (key % 4).cast("int")).alias("mode"),
        F.when(key % 7 == 0, none).otherwise(F.array_distinct(F.array(tag_at(user % 6), tag_at(key % 5)))).alias("detected_types"),
        F.when(key % 13 == 0, none).otherwise(F.array_distinct(F.array(tag_at(user % 6), tag_at((key + user) % 4)))).alias("reference_types"),
        "event_type")


SQL_EVID = f"""ev AS (SELECT event_id, user_id, CASE WHEN event_id % 29 = 0 THEN 'unknown' ELSE 'E' || user_id END AS name,
  CAST(floor(value * 37) AS BIGINT) % 1001 / 1000.0::DOUBLE AS c, ['exact_type', 'contains_all_types', 'partial_type', 'global'][event_id % 4 + 1] AS mode,
  CASE WHEN event_id % 7 = 0 THEN []::VARCHAR[] ELSE list_sort(list_distinct([{SQL_TAGS}[user_id % 6 + 1], {SQL_TAGS}[event_id % 5 + 1]])) END AS det,
  CASE WHEN event_id % 13 = 0 THEN []::VARCHAR[] ELSE list_sort(list_distinct([{SQL_TAGS}[user_id % 6 + 1], {SQL_TAGS}[(event_id + user_id) % 4 + 1]])) END AS ref,
  event_type FROM events)"""


@query("review_flag", f"""WITH {SQL_EVID} SELECT event_id, name = 'unknown' OR c < 0.74 OR (len(det) > 0 AND {_over('det', 'ref')} = 0)
  OR (mode = 'partial_type' AND c < 0.86) OR (mode = 'global' AND c < 0.88) AS needs_review FROM ev""")
def review_flag(spark, sf):
    return ops.review_flag(_evidence(spark, sf)).select("event_id", "needs_review")


@query("overlap_score", f"""WITH {SQL_EVID} SELECT event_id, CAST(round({_over('det', 'ref')} * 100) AS BIGINT) AS similarity,
  CAST(round({_over('det', 'ref', (0, 0.14, 0.10, 0.06, -0.08))} * 100) AS BIGINT) AS bonus FROM ev""")
def overlap_score(spark, sf):
    rows = _evidence(spark, sf)
    d, r = F.col("detected_types"), F.col("reference_types")
    return rows.select("event_id", F.round(overlap(d, r) * 100).cast("long").alias("similarity"),
                       F.round(overlap(d, r, "bonus") * 100).cast("long").alias("bonus"))


@query("rerank_by_tags", f"""WITH {SQL_VECS}, h AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, id) AS rank FROM pairs),
sc AS (SELECT *, s + CASE WHEN len(det) = 0 THEN 0 ELSE {_over('det', 'types', (0, 0.14, 0.10, 0.06, -0.08))} END AS total FROM h WHERE rank <= 40),
w AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY total DESC, s DESC, rank) AS k FROM sc)
SELECT q, id, rank AS hit_rank, CAST(round(s * 10000) AS BIGINT) AS similarity, CASE WHEN rank > 1 THEN 'tag-guided' ELSE 'nearest' END AS reason,
  s < 0.68 AS needs_review, len(det) > 0 AND len(types) > 0 AND det <> types AS tag_mismatch FROM w WHERE k = 1""")
def rerank_by_tags(spark, sf):
    q, r = query_rows(spark, sf), references(spark, sf)
    out = ops.rerank_by_tags(ops.knn_topk(q, r, ops.RERANK_DEPTH), r, q)
    return out.select("q", "id", "hit_rank", _bp("score").alias("similarity"), "reason", "needs_review", "tag_mismatch")


@query("tag_guard", f"""WITH {SQL_EVID}, x AS (SELECT *, len(det) = 0 OR len(ref) = 0 AS missing, list_has_any(det, ref) AS common FROM ev)
SELECT event_id, CASE WHEN NOT missing AND NOT common AND c < 0.97 THEN 'unknown' ELSE name END AS name,
  CASE WHEN NOT missing AND NOT common AND c < 0.97 THEN 0 ELSE CAST(round(c * 1000) AS BIGINT) END AS confidence, missing OR NOT common AS needs_review,
  CASE WHEN missing THEN 'missing-types' WHEN common THEN NULL WHEN c >= 0.97 THEN 'near-exact-visual-type-mismatch' ELSE 'rejected-zero-type-overlap' END AS guard_reason,
  CASE WHEN NOT missing AND NOT common AND c < 0.97 THEN name END AS rejected_name FROM x""")
def tag_guard(spark, sf):
    return ops.tag_guard(_evidence(spark, sf)).select("event_id", "name", _bp("confidence", 1000).alias("confidence"),
                                                      "needs_review", "guard_reason", "rejected_name")


@query("best_variant", f"""WITH {SQL_VECS}, v AS (SELECT q // 3 AS item, q % 3 AS variant, q, id, round(greatest(0, least(1, (s + 1) / 2)), 4) AS c,
  row_number() OVER (PARTITION BY q ORDER BY s DESC, id) AS r FROM pairs),
b AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY c DESC, variant) AS k FROM v WHERE r = 1)
SELECT item, variant, id, CAST(round(c * 10000) AS BIGINT) AS confidence, c < 0.78 AS needs_review FROM b WHERE k = 1""")
def best_variant(spark, sf):
    hits = ops.knn_topk(query_rows(spark, sf), references(spark, sf), 1)
    rows = hits.select(F.floor(F.col("q") / 3).alias("item"), (F.col("q") % 3).alias("variant"), "id", "score")
    out = ops.best_variant(rows)
    return out.select("item", "variant", "id", _bp("confidence").alias("confidence"), "needs_review")


def _tag_boxes(spark, sf):
    li = table(spark, sf, "lineitem")
    part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    return li.select(
        F.col("l_orderkey").alias("item"), (part * 10000 + supp * 10 + line).alias("pos"), tag_at((part + line) % 12).alias("tag"),
        ((part * 7 + supp * 3) % 41 / 100 + 0.6).alias("confidence"), ((part + supp) % 11 / 10).alias("quality"),
        (part % 60).alias("x"), (supp % 40).alias("y"), (part % 30 + 10).alias("width"), (supp % 20 + 10).alias("height"))


@query("select_distinct_nonoverlap", f"""WITH b AS (SELECT l_orderkey AS item, l_partkey * 10000 + l_suppkey * 10 + l_linenumber AS pos, {SQL_TAGS}[(l_partkey + l_linenumber) % 12 + 1] AS tag,
  (l_partkey * 7 + l_suppkey * 3) % 41 / 100.0::DOUBLE + 0.6 AS c, (l_partkey + l_suppkey) % 11 / 10.0::DOUBLE AS qual,
  l_partkey % 60 AS x, l_suppkey % 40 AS y, l_partkey % 30 + 10 AS w, l_suppkey % 20 + 10 AS h FROM lineitem),
s AS (SELECT *, round(c + qual * 0.12, 4) AS sc FROM b WHERE c >= 0.78),
l AS (SELECT item, list({{'tag': tag, 'x': x, 'y': y, 'w': w, 'h': h, 'pos': pos}} ORDER BY sc DESC, c DESC, pos) AS a FROM s GROUP BY 1),
k AS (SELECT item, list_reduce(a, lambda acc, n: CASE WHEN len(acc) >= 2 OR list_contains(list_transform(acc, lambda o: o.tag), n.tag)
    OR len(list_filter(acc, lambda o: greatest(0, least(o.x + o.w, n.x + n.w) - greatest(o.x, n.x)) * greatest(0, least(o.y + o.h, n.y + n.h) - greatest(o.y, n.y))
       > 0.20::DOUBLE * least(o.w * o.h, n.w * n.h))) > 0 THEN acc ELSE list_append(acc, n) END, []::STRUCT(tag VARCHAR, x BIGINT, y BIGINT, w BIGINT, h BIGINT, pos BIGINT)[]) AS sel FROM l),
t AS (SELECT item, list_transform(sel, lambda o: o.tag) AS tags, sel FROM k)
SELECT item, CASE array_to_string(list_sort(tags), '|') WHEN 'ground|poison' THEN 'fighting,poison' WHEN 'grass|water' THEN 'grass,poison' WHEN 'dark|fire' THEN 'fire,dark'
  WHEN 'dark|steel' THEN 'dark,steel' WHEN 'dragon|poison' THEN 'dragon,ghost' WHEN 'fighting|water' THEN 'psychic,fighting' ELSE array_to_string(tags, ',') END AS selected,
  array_to_string(list_transform(list_sort(list_transform(sel, lambda o: {{'x': o.x, 'p': o.pos, 't': o.tag}})), lambda o: o.t), ',') AS tags_by_x FROM t""")
def select_distinct_nonoverlap(spark, sf):
    out = ops.select_distinct_nonoverlap(_tag_boxes(spark, sf))
    return out.select("item", F.array_join("selected", ",").alias("selected"), F.array_join("tags_by_x", ",").alias("tags_by_x"))


@query("merge_evidence", f"""WITH {SQL_EVID}, e AS (SELECT * REPLACE (CASE WHEN event_type = 'error' THEN -event_id - 1 ELSE event_id END AS event_id) FROM ev),
t AS (SELECT CASE WHEN event_type = 'view' THEN -event_id - 1 ELSE event_id END AS event_id, 'T' || user_id AS name, (event_id * 31) % 1001 / 1000.0::DOUBLE AS c FROM events),
j AS (SELECT coalesce(e.event_id, t.event_id) AS item, e.name AS en, t.name AS tn, coalesce(e.c, 0) AS ec, coalesce(t.c, 0) AS tc, mode, e.event_id IS NOT NULL AS has_e FROM e FULL JOIN t ON t.event_id = e.event_id),
r AS (SELECT *, CASE WHEN has_e AND ec >= 0.78 THEN 'embedding' WHEN mode IN ('exact_type', 'contains_all_types') AND ec >= 0.70 THEN 'embedding-fast'
  WHEN mode = 'global' AND ec >= 0.80 THEN 'embedding-fast' WHEN tc >= 0.62 THEN 'template' WHEN has_e AND ec >= tc THEN 'embedding-weak' ELSE 'template-weak' END AS rule FROM j)
SELECT item, rule, CASE WHEN starts_with(rule, 'embedding') THEN en ELSE coalesce(tn, 'unknown') END AS name,
  CAST(round(CASE WHEN starts_with(rule, 'embedding') THEN ec ELSE tc END * 1000) AS BIGINT) AS confidence, rule NOT IN ('embedding', 'template') AS needs_review FROM r""")
def merge_evidence(spark, sf):
    rows = _evidence(spark, sf)
    # Errors on one side and views on the other stand under keys that the other side lacks.
    apart = lambda kind: F.when(F.col("event_type") == kind, -F.col("event_id") - 1).otherwise(F.col("event_id")).alias("event_id")
    e = rows.withColumn("event_id", apart("error")).withColumn("reason", F.lit("embedding")).withColumn("needs_review", F.lit(False))
    t = rows.select(
        apart("view"), F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("name"),
        (F.col("event_id") * 31 % 1001 / 1000).alias("confidence"), F.lit("template").alias("reason"))
    out = ops.merge_evidence(e.withColumnRenamed("event_id", "item"), t.withColumnRenamed("event_id", "item"))
    return out.select("item", "rule", "name", _bp("confidence", 1000).alias("confidence"), "needs_review")


def _tag_evidence(spark, sf):
    e = table(spark, sf, "events")
    key, user = F.col("event_id"), F.col("user_id")
    a, b, c = tag_at(user % 9), tag_at(key % 9), tag_at((key + user) % 9)
    none = F.array().cast("array<string>")
    emb = F.when(key % 5 == 0, none).when(key % 5 < 3, F.array(a)).otherwise(F.array_distinct(F.array(a, b)))
    tmpl = F.when(user % 4 == 0, none).when(user % 4 < 2, F.array(c)).otherwise(F.array_distinct(F.array(a, c)))

    def detail(tag, conf, idx, source):
        return F.struct(tag.alias("tag"), conf.alias("confidence"), ((key + idx) % 3 != 0).alias("has_symbol"), F.lit(source).alias("source"),
                        ((user + idx) % 20 / 100).alias("quality"), F.lit(idx).alias("idx"), F.lit(True).alias("accepted"))
    details = F.array(detail(a, 0.7 + key % 31 / 100, 1, ops.FALLBACK_SOURCE), detail(b, 0.7 + user % 31 / 100, 2, "object"),
                      detail(a, 0.7 + (key + user) % 31 / 100, 3, "object"))
    return e.select(
        key, emb.alias("embedding_tags"), tmpl.alias("template_tags"), (key % 4 == 0).alias("has_boxes"), details.alias("details"),
        F.when(key % 11 == 0, "type_combo_template").otherwise("other").alias("template_source"),
        (user % 3 == 0).alias("combo_review"), (key % 101 / 100).alias("combo_score"))


_SUB = "CASE array_to_string(list_sort(list_distinct({x})), '|') " + " ".join(
    f"WHEN '{'|'.join(sorted(k))}' THEN [{', '.join(repr(v) for v in vs)}]" for k, vs in ops.PAIR_SUBSTITUTES.items()) + " ELSE {x} END"
SQL_TAGEV = f"""x AS (SELECT event_id, user_id, {SQL_TAGS}[user_id % 9 + 1] AS a, {SQL_TAGS}[event_id % 9 + 1] AS b, {SQL_TAGS}[(event_id + user_id) % 9 + 1] AS c FROM events),
y AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN []::VARCHAR[] WHEN event_id % 5 < 3 OR a = b THEN [a] ELSE [a, b] END AS e,
  CASE WHEN user_id % 4 = 0 THEN []::VARCHAR[] WHEN user_id % 4 < 2 THEN [c] WHEN a = c THEN [a] ELSE [a, c] END AS t,
  [{{'tag': a, 'conf': 0.7::DOUBLE + event_id % 31 / 100.0::DOUBLE, 'sym': (event_id + 1) % 3 <> 0, 'weak': true, 'q': (user_id + 1) % 20 / 100.0::DOUBLE, 'i': 1}},
   {{'tag': b, 'conf': 0.7::DOUBLE + user_id % 31 / 100.0::DOUBLE, 'sym': (event_id + 2) % 3 <> 0, 'weak': false, 'q': (user_id + 2) % 20 / 100.0::DOUBLE, 'i': 2}},
   {{'tag': a, 'conf': 0.7::DOUBLE + (event_id + user_id) % 31 / 100.0::DOUBLE, 'sym': event_id % 3 <> 0, 'weak': false, 'q': (user_id + 3) % 20 / 100.0::DOUBLE, 'i': 3}}] AS d FROM x),
z AS (SELECT *, {_SUB.format(x='e')} AS pe, {_SUB.format(x='t')} AS pt, len(e) = 1 AND len(t) = 1 AND e[1] <> t[1] AS single FROM y),
r AS (SELECT *, CASE WHEN event_id % 4 = 0 AND len(e) > 0 THEN 'type_embedding_object_layer' WHEN event_id % 11 = 0 AND len(t) > 0 THEN 'type_combo_template'
  WHEN single AND len(list_filter(d, lambda o: o.tag = e[1] AND o.sym AND o.conf >= 0.84)) >= 2 THEN 'type_embedding_cv_complement'
  WHEN single AND len(list_filter(d, lambda o: o.weak OR NOT o.sym OR o.conf < 0.80)) > 0 AND list_filter(d, lambda o: o.tag = e[1])[1].i = 2 THEN 'cv_template_embedding_disagreement'
  WHEN len(pe) = 2 AND len(pt) = 2 AND list_sort(pe) <> list_sort(pt) AND list_has_any(pe, pt)
    AND len(list_filter(d, lambda o: o.weak AND o.q <= 0.05 AND NOT list_contains(pt, o.tag))) > 0 THEN 'cv_template_weak_embedding_fallback'
  WHEN len(e) > 0 THEN 'type_embedding' ELSE 'cv_template_fallback' END AS rule FROM z),
s AS (SELECT *, CASE WHEN rule IN ('type_embedding_object_layer', 'type_embedding') THEN pe WHEN rule = 'type_embedding_cv_complement' THEN {_SUB.format(x='[e[1], t[1]]')}
  WHEN rule = 'cv_template_fallback' THEN pt ELSE t END AS sel FROM r)"""


@query("combine_tag_evidence", f"WITH {SQL_TAGEV} SELECT event_id, rule, array_to_string(sel, ',') AS selected FROM s")
def combine_tag_evidence(spark, sf):
    return ops.combine_tag_evidence(_tag_evidence(spark, sf)).select("event_id", "rule", F.array_join("selected", ",").alias("selected"))


@query("trusted_tags", f"""WITH {SQL_TAGEV} SELECT event_id, CASE WHEN rule = 'type_embedding_object_layer' AND len(sel) > 0
    AND list_has_all(list_transform(list_filter(d, lambda o: o.sym AND o.conf >= 0.80), lambda o: o.tag), sel) THEN array_to_string(sel, ',')
  WHEN rule = 'type_combo_template' AND user_id % 3 <> 0 AND event_id % 101 >= 74 THEN array_to_string(sel, ',') ELSE '' END AS trusted FROM s""")
def trusted_tags(spark, sf):
    rows = ops.trusted_tags(ops.combine_tag_evidence(_tag_evidence(spark, sf)))
    return rows.select("event_id", F.array_join("trusted", ",").alias("trusted"))


@query("use_fixed_match", f"""WITH {SQL_EVID}, f AS (SELECT *, (event_id * 17) % 1001 / 1000.0::DOUBLE AS fc FROM ev)
SELECT event_id, fc >= 0.5 AND len(ref) >= 2 AND CASE WHEN name = 'unknown' THEN fc >= 0.52 WHEN fc < c + 0.08 THEN false
  WHEN len(det) > 0 AND NOT list_has_any(det, ref) THEN fc >= 0.62 AND fc >= c + 0.14 ELSE true END AS use_fixed FROM f""")
def use_fixed_match(spark, sf):
    rows = _evidence(spark, sf).withColumn("fc", F.col("event_id") * 17 % 1001 / 1000)
    flag = ops.use_fixed_match(F.col("name"), F.col("confidence"), F.lit("fixed"), F.col("fc"), F.col("reference_types"), F.col("detected_types"))
    return rows.select("event_id", flag.alias("use_fixed"))


def _components(spark, sf):
    """Line items as scored references of an order."""
    li = table(spark, sf, "lineitem")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return li.select(
        F.col("l_orderkey").alias("q"), (p * 100000 + s * 10 + F.col("l_linenumber")).alias("pos"), F.concat(F.lit("N"), (p % 40).cast("string")).alias("name"),
        F.concat(F.lit("S"), (p % 3).cast("string")).alias("species"), F.when(s % 3 == 0, "Female").otherwise("").alias("form"),
        *[(((p * a + s * b) % m) / 10000).alias(c) for c, a, b, m in (
            ("gray", 13, 7, 5200), ("colour", 29, 3, 5200), ("feature", 5, 31, 6100), ("partial_gray", 11, 17, 6000), ("partial_colour", 3, 19, 9900))],
        (s % 5 != 0).alias("in_pool"), (s % 7 == 0).alias("is_rescue"), (p % 2 == 0).alias("is_shiny"), (F.col("l_orderkey") % 3 != 0).alias("tagged"))


SQL_COMP = """cp AS (SELECT l_orderkey AS q, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS pos, 'N' || (l_partkey % 40) AS name, 'S' || (l_partkey % 3) AS species,
  l_suppkey % 3 = 0 AS female, ((l_partkey * 13 + l_suppkey * 7) % 5200) / 10000.0::DOUBLE AS gray, ((l_partkey * 29 + l_suppkey * 3) % 5200) / 10000.0::DOUBLE AS colour,
  ((l_partkey * 5 + l_suppkey * 31) % 6100) / 10000.0::DOUBLE AS feature, ((l_partkey * 11 + l_suppkey * 17) % 6000) / 10000.0::DOUBLE AS pg,
  ((l_partkey * 3 + l_suppkey * 19) % 9900) / 10000.0::DOUBLE AS pc, l_suppkey % 5 <> 0 AS in_pool, l_suppkey % 7 = 0 AS is_rescue, l_partkey % 2 = 0 AS shiny, l_orderkey % 3 <> 0 AS tagged FROM lineitem)"""


@query("weighted_evidence", f"""WITH {SQL_COMP}, w AS (SELECT q, pos, name, round(gray * 0.45 + colour * 0.35 + feature * 0.20, 4) AS score FROM cp),
b AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, pos) AS k FROM w)
SELECT q, name, CAST(round(score * 1000) AS BIGINT) AS score, CASE WHEN score < 0.42 THEN '' ELSE 'x' END AS types,
 CASE WHEN score < 0.42 THEN 'low_confidence' ELSE 'template' END AS source, score < 0.74 AS needs_review FROM b WHERE k = 1""")
def weighted_evidence(spark, sf):
    rows = _components(spark, sf).select("q", "pos", "name", F.col("gray").alias("pixel"), "colour", "feature", F.array(F.lit("x")).alias("types"), F.lit(1).alias("want"))
    out = ops.weighted_evidence(rows, item="q", expected="want")
    return out.select("q", "name", _bp("score", 1000).alias("score"), F.array_join("types", ",").alias("types"), "source", "needs_review")


@query("staged_rerank", f"""WITH {SQL_COMP}, pool AS (SELECT *, greatest(gray, colour) AS s2, greatest(gray, colour, feature) AS s3,
  greatest(pg, pc) * 0.70::DOUBLE + greatest(gray, colour) * 0.30::DOUBLE AS part, row_number() OVER (PARTITION BY q ORDER BY gray DESC, pos) AS gr FROM cp WHERE in_pool),
p2 AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s2 DESC, gr) AS sr FROM pool WHERE gr <= 24),
a1 AS (SELECT q, gray AS s, name FROM pool WHERE gr = 1),
a2 AS (SELECT q, s2 AS s, name FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s2 DESC, gr) AS k FROM p2) WHERE k = 1),
a3 AS (SELECT q, s3 AS s, name FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s3 DESC, sr) AS k FROM p2 WHERE sr <= 16) WHERE k = 1),
a4 AS (SELECT q, part AS s, name FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY part DESC, pos) AS k FROM pool) WHERE k = 1),
rs AS (SELECT q, vs AS s, name FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY vs DESC, pos) AS k FROM (SELECT *, greatest(greatest(gray, colour), greatest(pg, pc) * 0.70::DOUBLE + greatest(gray, colour) * 0.30::DOUBLE) AS vs FROM cp WHERE is_rescue)) WHERE k = 1),
fb AS (SELECT q, name FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY shiny, female, pos) AS k FROM pool) WHERE k = 1),
st AS (SELECT q, count(*) FILTER (WHERE in_pool) AS n, bool_or(tagged) AS tagged, count(DISTINCT CASE WHEN in_pool THEN species END) AS sp FROM cp GROUP BY 1),
j1 AS (SELECT st.*, CASE WHEN a1.s > 0 THEN a1.s ELSE 0 END AS c1, CASE WHEN a1.s > 0 THEN a1.name END AS n1, a2.s AS s2, a2.name AS n2, a3.s AS s3, a3.name AS n3, a4.s AS s4, a4.name AS n4, rs.s AS sr, rs.name AS nr, fb.name AS nf
  FROM st LEFT JOIN a1 USING (q) LEFT JOIN a2 USING (q) LEFT JOIN a3 USING (q) LEFT JOIN a4 USING (q) LEFT JOIN rs USING (q) LEFT JOIN fb USING (q)),
j2 AS (SELECT *, CASE WHEN s2 > c1 THEN s2 ELSE c1 END AS c2, CASE WHEN s2 > c1 THEN n2 ELSE n1 END AS m2 FROM j1),
j3 AS (SELECT *, CASE WHEN s3 > c2 THEN s3 ELSE c2 END AS c3, CASE WHEN s3 > c2 THEN n3 ELSE m2 END AS m3 FROM j2),
j4 AS (SELECT *, CASE WHEN c3 < 0.35 AND s4 > c3 THEN round(s4, 4) ELSE c3 END AS c4, CASE WHEN c3 < 0.35 AND s4 > c3 THEN n4 ELSE m3 END AS m4 FROM j3),
j5 AS (SELECT *, coalesce(c4 < 0.70 AND sr >= 0.82 AND sr >= c4 + 0.08, false) AS resc FROM j4),
j6 AS (SELECT *, CASE WHEN resc THEN round(sr, 4) ELSE c4 END AS c5, CASE WHEN resc THEN nr ELSE m4 END AS m5 FROM j5),
j7 AS (SELECT *, c5 < 0.40 AS low, coalesce(c5 < 0.40 AND tagged AND n <= 8 AND sp BETWEEN 1 AND 3 AND (sp = 1 OR c5 >= 0.35), false) AS ok FROM j6)
SELECT q, CASE WHEN ok THEN coalesce(m5, nf) WHEN low THEN 'unknown' ELSE m5 END AS name,
  CAST(floor(CASE WHEN ok THEN greatest(c5, CASE WHEN sp = 1 THEN 0.75 ELSE 0.55 END) ELSE c5 END * 1000 + 0.0001) AS BIGINT) AS confidence,
  CASE WHEN ok THEN 'type-confirmed' WHEN low THEN '' WHEN resc THEN 'guided-visual-rescue' ELSE '' END AS reason, n AS pool_size FROM j7""")
def staged_rerank(spark, sf):
    out = ops.staged_rerank(_components(spark, sf))
    return out.select("q", "name", F.floor(F.col("confidence") * 1000 + 0.0001).alias("confidence"), "reason", "pool_size")


@query("preferred_reference", f"""WITH {SQL_COMP}, v AS (SELECT *, greatest(gray, colour, feature) AS score FROM cp),
w AS (SELECT q, name AS winner, score AS ws, species FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, pos) AS k FROM v) WHERE k = 1),
o(tag, wn, pref, prio) AS (VALUES ('S0', 'N3', 'N7', 0), ('S0', 'N3', 'N8', 1), ('S1', NULL, 'N5', 0), ('S2', NULL, 'N9', 0)),
c AS (SELECT w.q, pref, prio, v.score, v.pos FROM w JOIN o ON o.tag = w.species AND CASE WHEN wn IS NOT NULL THEN wn = winner ELSE winner <> pref END
  JOIN v ON v.q = w.q AND v.name = pref WHERE v.score >= ws - 0.055),
b AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY prio, score DESC, pos) AS k FROM c)
SELECT w.q, coalesce(pref, winner) AS name, CAST(round(coalesce(score, ws) * 10000) AS BIGINT) AS score, pref IS NOT NULL AS overridden FROM w LEFT JOIN b ON b.q = w.q AND k = 1""")
def preferred_reference(spark, sf):
    v = _components(spark, sf).withColumn("score", F.greatest("gray", "colour", "feature"))
    best = v.groupBy("q").agg(F.max_by(F.struct("name", "score", "species"), F.struct("score", -F.col("pos"))).alias("w"))
    matches = best.select("q", F.array("w.species").alias("tags"), F.col("w.name").alias("winner"), F.col("w.score").alias("winner_score"))
    rules = [("s0", "N3", "N7", 0), ("s0", "N3", "N8", 1), ("s1", None, "N5", 0), ("s2", None, "N9", 0)]
    overrides = spark.createDataFrame(rules, "tag_key string, winner_name string, preferred string, prio int")
    out = ops.preferred_reference(matches, v.select("q", "name", "pos", "score"), overrides)
    return out.select("q", "name", _bp("score").alias("score"), "overridden")


@query("method_priority", f"""WITH x AS (SELECT event_id, {SQL_TAGS}[user_id % 10 + 1] AS a, {SQL_TAGS}[event_id % 10 + 1] AS b, event_id % 6 AS k FROM events),
y AS (SELECT *, [a, b] AS ab FROM x) SELECT event_id, array_to_string(CASE k WHEN 0 THEN {_SUB.format(x='ab')} WHEN 1 THEN {_SUB.format(x='[b, a]')} WHEN 2 THEN [a]
  WHEN 3 THEN {_SUB.format(x='ab')} WHEN 4 THEN CASE WHEN a = 'fire' THEN ['fire'] ELSE [] END ELSE CASE WHEN a = b THEN [a] WHEN a = 'fire' THEN ['fire'] ELSE [] END END, ',') AS selected FROM y""")
def method_priority(spark, sf):
    key = F.col("event_id") % 6
    a, b = tag_at(F.col("user_id") % 10), tag_at(F.col("event_id") % 10)
    rows = table(spark, sf, "events").select(
        "event_id", F.when(key == 0, F.array(a, b, a)).alias("component"),
        F.when(key == 1, F.array(b, a)).when(key == 2, F.array(a)).alias("combined"),
        F.when(key == 3, F.array(a, F.lit("zz"), b)).when(key >= 4, F.array(a)).alias("fixed"),
        F.when(key == 3, F.array(b, a)).when(key == 5, F.array(b)).alias("symbol"))
    return ops.method_priority(rows).select("event_id", F.array_join("selected", ",").alias("selected"))


@query("candidate_gap", f"""WITH {SQL_VECS}, h AS (SELECT q, s, label, row_number() OVER (PARTITION BY q ORDER BY s DESC, pairs.id) AS rank FROM pairs JOIN refs USING (id)),
t AS (SELECT q, max(CASE WHEN rank = 1 THEN s END) - max(CASE WHEN rank = 2 THEN s END) AS gap, string_agg('L' || label || ':' || printf('%.3f', round_even(s, 3)), ' | ' ORDER BY rank) AS labels FROM h WHERE rank <= 5 GROUP BY 1)
SELECT q, CAST(round(gap * 100000) AS BIGINT) AS gap, labels FROM t""")
def candidate_gap(spark, sf):
    r = references(spark, sf)
    hits = ops.knn_topk(query_rows(spark, sf), r, 5).join(r.select("id", F.concat(F.lit("L"), F.col("label").cast("string")).alias("label")), "id")
    out = ops.candidate_gap(hits)
    return out.select("q", _bp("gap", 100000).alias("gap"), F.col("top_text").alias("labels"))


SQL_BLOCKED = r"regexp_matches(lower(name), '\bmega\b') OR regexp_matches(lower(path), '(^|[-_/])mega($|[-_. /])') OR contains(lower(path), 'gigantamax') OR ends_with(path, '/p7.png')"


@query("prune_index", f"WITH {SQL_VECS} SELECT id, name FROM refs WHERE name = 'E3 Mega' OR NOT ({SQL_BLOCKED})")
def prune_index(spark, sf):
    return ops.prune_index(references(spark, sf), allow=["E3 Mega"], filenames=["p7.png"]).select("id", "name")


@query("prune_counts", f"WITH {SQL_VECS}, b AS (SELECT name <> 'E3 Mega' AND ({SQL_BLOCKED}) AS x FROM refs) SELECT count(*) AS before, count(*) FILTER (WHERE x) AS removed, count(*) FILTER (WHERE NOT x) AS after FROM b")
def prune_counts(spark, sf):
    return ops.prune_counts(references(spark, sf), allow=["E3 Mega"], filenames=["p7.png"])


@query("cap_per_class", f"""WITH {SQL_FILES} SELECT label, path FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || path), path) AS r FROM files) WHERE r <= 5""")
def cap_per_class(spark, sf):
    return ops.cap_per_class(files(spark, sf), 5, 42)
