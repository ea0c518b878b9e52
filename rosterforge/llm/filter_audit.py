"""Filter interaction audit: what every order of five filters keeps and removes, from wide packed counters.

A document's failures form a mask. Each mask maps to one big integer whose fields hold the outcomes of all 600
(order, step) pairs; adding the integers of a part's documents adds all fields at once, and one pass unpacks them.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
STEPS = [(order, step) for order in ORDERS for step in range(1, len(LETTERS) + 1)]
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
# A count of rows is below 2 ** 63, and a filter's sum over 120 orders is at most 120 times that: 70 bits never carry
# into the next field. The columns are longs, so a part may hold 7e16 rows before its sum over the orders leaves them.
FIELD_BITS = 70
FIELD = (1 << FIELD_BITS) - 1
PACKED_BYTES = -(-FIELD_BITS * (len(STEPS) * len(OUTCOMES) + len(LETTERS)) // 8)
AUDIT = "part string, filter_order string, step int, " + ", ".join(f"{o} long" for o in OUTCOMES) + ", shapley long"


def filter_flags(docs: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """(key, part, digest, fails): the mask of filters A to D and a digest of the text, null read as empty."""
    said = docs.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("said"))
    told = said.withColumn("words", F.array_remove(F.split("said", r"[\x20\x09-\x0D]+"), "")).withColumn("n", F.size("words"))
    fails: list[Column] = [
        F.col("n") < 200,
        100 * F.size(F.array_distinct("words")) < 50 * F.col("n"),
        100 * F.regexp_count("said", F.lit("[A-Z]")) > 2 * F.length("said"),
        F.col("said").rlike(r"[#$%&*|]"),
    ]
    mask = functools.reduce(lambda a, b: a + b, (F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails)))
    return told.select("key", "part", F.unhex(F.sha2("said", 256)).alias("digest"), mask.alias("fails"))


def failure_counts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, fails, good, toxic, n): documents by mask of failed filters (A is bit 0) and by label; at most 128 rows a part.

    A: under 200 words. B: fewer than half of the words distinct. C: over 2 % of the code points in A-Z. D: one of
    # $ % & * |. E: a smaller key holds the same text anywhere in the table. Equal rows are counted together before any
    shuffle, and whether a row is its text's first is read off the least key of the text's groups, so copies never meet
    row by row. Null texts are empty, null parts the empty string. A null key is no smaller and no larger than others:
    such rows never fail E and make none fail. Rows that repeat key and text do not fail each other. A key with several
    labels is good or toxic if any says 1; without labels neither. Other columns are ignored.
    """
    rows = filter_flags(docs, key, text, part).groupBy("key", "part", "digest", "fails").agg(F.count("*").alias("n"))
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    marked = rows.join(marks, "key", "left").select(
        "key", "part", "digest", "fails", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    # Rows of one text, part and label: how many there are, how many without key, the least key and how many hold it.
    same = marked.groupBy("digest", "part", "fails", "good", "toxic", "key").agg(F.sum("n").alias("n"))
    same = same.groupBy("digest", "part", "fails", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0)).alias("bare"),
        F.min(F.when(F.col("key").isNotNull(), F.struct("key", "n"))).alias("least"))
    each = same.withColumn("first", F.min("least.key").over(Window.partitionBy("digest")))
    passing = F.col("bare") + F.when(F.col("least.key") == F.col("first"), F.col("least.n")).otherwise(0)
    split = each.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("fails"), passing.alias("n")), F.struct((F.col("fails") + 16).alias("fails"), (F.col("n") - passing).alias("n")))).alias("s"))
    return split.where("s.n > 0").groupBy("part", F.col("s.fails").cast("int").alias("fails"), "good", "toxic").agg(F.sum("s.n").alias("n"))


@functools.cache
def packed_outcomes(fails: int, good: bool, toxic: bool) -> int:
    """The big integer of one document: a field for every outcome of every step of every order, then one per filter."""
    total, at = 0, 0
    removals = dict.fromkeys(LETTERS, 0)
    for order in ORDERS:
        gone = False
        for letter in order:
            bad = bool(fails >> LETTERS.index(letter) & 1)
            removed = bad and not gone
            redundant, gone = bad and gone, gone or bad
            removals[letter] += removed
            alone = fails == 1 << LETTERS.index(letter)
            for value in (not gone, removed, redundant, alone, removed and good, removed and toxic):
                total |= int(value) << at
                at += FIELD_BITS
    for letter in LETTERS:
        total |= removals[letter] << at
        at += FIELD_BITS
    return total


def packed_sums(counts: DataFrame) -> DataFrame:
    """(part, packed): the sum of the big integers of a part's documents, little-endian. A part is at most 128 rows of ``counts``."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(int(n) * packed_outcomes(int(f), bool(g), bool(t)) for f, g, t, n in zip(pdf["fails"], pdf["good"], pdf["toxic"], pdf["n"], strict=True))
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "packed": [total.to_bytes(PACKED_BYTES, "little")]})

    return counts.groupBy("part").applyInPandas(add, "part string, packed binary")


def added_sums(packed: DataFrame) -> DataFrame:
    """Sums of several audits of the same parts (of shards or days) as one; E is judged inside each audit."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(int.from_bytes(p, "little") for p in pdf["packed"])
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "packed": [total.to_bytes(PACKED_BYTES, "little")]})

    return packed.groupBy("part").applyInPandas(add, "part string, packed binary")


def unpacked(packed: DataFrame) -> DataFrame:
    """One row per part, order and step from ``packed_sums``, zeros included."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, raw in zip(batch["part"], batch["packed"], strict=True):
                total = int.from_bytes(raw, "little")
                values = [total >> FIELD_BITS * i & FIELD for i in range(len(STEPS) * len(OUTCOMES) + len(LETTERS))]
                removals = dict(zip(LETTERS, values[-len(LETTERS):], strict=True))
                width = len(OUTCOMES)
                yield pd.DataFrame(
                    [(part, order, step, *values[i * width:(i + 1) * width], removals[order[step - 1]]) for i, (order, step) in enumerate(STEPS)],
                    columns=["part", "filter_order", "step", *OUTCOMES, "shapley"])

    return packed.mapInPandas(read, AUDIT)


def filter_audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    See ``failure_counts`` for the filters and for nulls, repeats and labels. An empty table has no parts and gives no rows.
    """
    return unpacked(packed_sums(failure_counts(docs, labels, key, text, part)))


def op12(spark, sf_dir: str) -> DataFrame:
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
m AS (SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] AS f, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d JOIN firsts USING (t) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, f, good, toxic, count(*) AS n FROM m GROUP BY ALL),
i AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT part, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, step, o[step] AS x, f[o[step]] AS bad, n, good, toxic, f,
    list_bool_or(list_transform(o[1:step - 1], lambda x: f[x])) AS before FROM c, o, (SELECT i AS step FROM i)),
r AS (SELECT part, filter_order, step, x, sum(CASE WHEN bad OR coalesce(before, false) THEN 0 ELSE n END) AS kept,
    sum(CASE WHEN bad AND NOT coalesce(before, false) THEN n ELSE 0 END) AS removed, sum(CASE WHEN bad AND coalesce(before, false) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN bad AND len(list_filter(f, lambda y: y)) = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN bad AND NOT coalesce(before, false) AND good = 1 THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN bad AND NOT coalesce(before, false) AND toxic = 1 THEN n ELSE 0 END) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM r
"""
