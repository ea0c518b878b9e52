"""Mixing sources to target weights by nested hash thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rosterforge.llm.shared import staged

WEIGHTS = (5, 2, 1)
HASH_BITS, STEP_BITS = 60, 12


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size): weights by source order, nulls last, capped and reshared.

    Resharing what is above the cap ends at min(cap * size, level * weight); the level follows from sources in
    the order of the level at which each reaches its cap. One row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    full = F.lit(cap) * F.col("source_size")
    weighed = weighed.withColumn("reach", full / F.col("weight"))
    before = Window.orderBy("reach", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("reach", F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(whole) - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    fits = weighed.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") <= F.col("reach"), F.col("level"))).over(whole))
    return fits.select("source", "source_size", F.least(full, F.coalesce(F.col("level") * F.col("weight"), full)).alias("target"))


def mix_hash(seed: int, key: str, text: str) -> Column:
    """60 bits of a row's key and text."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.col(text)).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_plan(docs: DataFrame, seed: int = 9, key: str = "doc_id", text: str = "text", source: str = "source",
             weights: tuple[int, ...] = WEIGHTS, share: float = 1.5) -> DataFrame:
    """Staged (source, source_size, target, whole, cut), a row per source: what the mix takes of it.

    A source takes all rows ``whole`` = floor(target / size) times and once more those whose hash is below ``cut``.
    The cut comes from histograms: words by source and leading hash bits, the bucket where the running sum passes
    the budget, then the same within that bucket alone by the next bits. No row is sorted, and every level sums
    before its shuffle, so a source with a third of the rows costs no more than others.

    Null text: size 0. Null sources are one source, last. Equal key and text: equal hash, taken together.
    Rows of size 0 add nothing wherever they fall. An empty table gives no rows. Other columns are ignored.
    """
    narrow = staged(docs.select(F.col(source).cast("string").alias("source"), words_in(text).alias("size"), mix_hash(seed, key, text).alias("h")))
    goals = source_targets(narrow, weights, share).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goals = staged(goals.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    # At each level a source has one open bucket: its leading bits and the words below it.
    open_ = goals.select("source", "rest", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("inside"))
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        rows = narrow.alias("n").join(open_.alias("o"), F.col("n.source").eqNullSafe(F.col("o.source"))
                                      & (F.shiftright("n.h", shift + STEP_BITS) == F.col("o.bucket")))
        bars = rows.groupBy("o.source", "o.rest", "o.below", F.shiftright("n.h", shift).alias("bucket")).agg(F.sum("size").alias("inside"))
        upto = F.col("below") + F.sum("inside").over(Window.partitionBy("source").orderBy("bucket"))
        open_ = bars.withColumn("upto", upto).where("upto > rest").groupBy("source", "rest").agg(F.min(F.struct("bucket", "upto", "inside")).alias("b")) \
            .select("source", "rest", "b.bucket", (F.col("b.upto") - F.col("b.inside")).alias("below"), F.col("b.inside").alias("inside"))
    # The last bucket is one hash value: in, if that comes closer to the budget.
    closer = F.col("below") + F.col("inside") - F.col("rest") < F.col("rest") - F.col("below")
    cuts = open_.select("source", F.when(closer, F.col("bucket") + 1).otherwise(F.col("bucket")).alias("cut"))
    return staged(goals.alias("g").join(cuts.alias("c"), F.col("g.source").eqNullSafe(F.col("c.source")), "left")
                  .select("g.source", "source_size", "target", "whole", F.when(F.col("g.rest") > 0, F.coalesce("c.cut", F.lit(0))).otherwise(0).alias("cut")))


def times_taken(docs: DataFrame, plan: DataFrame, seed: int = 9, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """All columns of ``docs``, and ``__source_size``, ``__target`` and ``__times`` of each row; the plan joins by source, texts stay in place."""
    told = plan.toDF("__source", "__source_size", "__target", "__whole", "__cut")
    times = F.col("__whole") + (mix_hash(seed, f"d.{key}", f"d.{text}") < F.col("__cut")).cast("long")
    met = docs.alias("d").join(told, F.col(f"d.{source}").cast("string").eqNullSafe(F.col("__source")))
    return met.select("d.*", "__source_size", "__target", times.alias("__times"))


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    size = words_in("text")
    return times_taken(docs, mix_plan(docs)).select(
        "doc_id", size.alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (size * F.col("__times")).alias("taken"))


OP9_SQL = r"""
WITH n AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
    ('0x' || substr(md5(concat_ws(':', '9', doc_id::VARCHAR, text)), 1, 15))::BIGINT AS h FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM n GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM t),
r AS (SELECT *, 2.0::DOUBLE * source_size / weight AS reach FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY reach, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY reach, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
g AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce(max(level) FILTER (level <= reach) OVER () * weight, 2.0::DOUBLE * source_size)) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM g),
c AS (SELECT *, target - whole * source_size AS rest FROM b),
hs AS (SELECT source, h, sum(size)::BIGINT AS inside FROM n GROUP BY source, h),
run AS (SELECT *, sum(inside) OVER (PARTITION BY source ORDER BY h)::BIGINT AS upto FROM hs),
first_over AS (SELECT run.source, min(h) AS h FROM run JOIN c ON run.source IS NOT DISTINCT FROM c.source WHERE upto > rest GROUP BY run.source),
cut AS (SELECT f.source, CASE WHEN run.upto - c.rest < c.rest - (run.upto - run.inside) THEN f.h + 1 ELSE f.h END AS cut FROM first_over f
    JOIN run ON run.source IS NOT DISTINCT FROM f.source AND run.h = f.h JOIN c ON c.source IS NOT DISTINCT FROM f.source)
SELECT n.doc_id, n.size, c.source_size, c.target, n.size * (c.whole + (n.h < coalesce(cut.cut, 0))::BIGINT) AS taken
FROM n JOIN c ON n.source IS NOT DISTINCT FROM c.source LEFT JOIN cut ON cut.source IS NOT DISTINCT FROM n.source
"""
