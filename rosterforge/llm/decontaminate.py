"""Benchmark decontamination with a distributed positional inverted index, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rosterforge.llm.shared import ascii_lower, staged

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13


def index_words(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased; no words for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def positional_index(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Staged postings (term, key, row, pos) of every occurrence of ``terms`` (column ``term``, hashes of words).

    ``row`` is a hash of the text, so that rows that share a key, or have none, are told apart. Each row of ``docs``
    also leaves one closing posting: term null, pos the number of words. Lists of words that no test item uses would never be read and are not stored.
    """
    spoken = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("row"), F.array_append(index_words(F.col(text)), F.lit(None).cast("string")).alias("words"))
    each = spoken.select("key", "row", F.posexplode("words").alias("pos", "word")).withColumn("term", F.when(F.col("word").isNotNull(), F.xxhash64("word")))
    hits = each.join(terms.select("term", F.lit(True).alias("asked")), "term", "left").where("asked OR word IS NULL")
    return staged(hits.select("term", "key", "row", "pos"))


def item_windows(items: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, words, at, pos, term): for each window of each item, start ``at``, its words with their item positions."""
    words = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), index_words(F.col(text)).alias("words")).where("size(words) > 0").distinct()
    starts = words.select("item", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - window))).alias("at"))
    return starts.select("item", "words", "at", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + window, F.size("words")) - 1)).alias("pos")) \
        .withColumn("term", F.xxhash64(F.get("words", F.col("pos"))))


def phrase_candidates(index: DataFrame, windows: DataFrame) -> DataFrame:
    """Distinct (key, row, item, words, shift) at which the two rarest terms of some window stand at the right distance.

    ``shift`` is the place in the document minus the place in the item, so lists meet on one value. A term that no
    document holds excludes its windows. Rarity only decides the order of work; any order finds the same phrases.
    """
    lists = index.where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("n"))
    rare = windows.join(lists, "term", "left").groupBy("item", "words", "at").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "pos", "term")).alias("r1"), F.collect_set(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "pos", "term")).alias("all"))
    rare = rare.withColumn("r2", F.get(F.sort_array("all"), F.lit(1))).where("r1.n > 0").select("item", "words", "r1", "r2")
    rare = staged(rare.distinct())

    def shifted(which: str) -> DataFrame:
        asked = rare.where(f"{which} IS NOT NULL").select("item", "words", F.col(f"{which}.term").alias("term"), F.col(f"{which}.pos").alias("at")).distinct()
        return index.join(asked, "term").select("key", "row", "item", "words", "at", (F.col("pos") - F.col("at")).alias("shift"))

    first = shifted("r1").drop("words")
    pairs = rare.select("item", "words", F.col("r1.pos").alias("at"), F.col("r2.pos").alias("at2")).distinct()
    begun = first.join(pairs, ["item", "at"])
    second = shifted("r2").select("key", "row", "item", F.col("at").alias("at2"), "shift").distinct()
    met = F.col("b.key").eqNullSafe(F.col("s.key"))
    for name in ("row", "item", "at2", "shift"):
        met &= F.col(f"b.{name}") == F.col(f"s.{name}")
    both = begun.where("at2 IS NOT NULL").alias("b").join(second.alias("s"), met, "left_semi")
    told = ("key", "row", "item", "words", "shift")
    return begun.where("at2 IS NULL").select(*told).unionByName(both.select(*told)).distinct()


def proximity_matches(index: DataFrame, phrases: DataFrame, slack: int) -> DataFrame:
    """Distinct (key, phrase) where all terms of ``phrases`` (phrase, term) lie within ``slack`` words of the rarest one."""
    lists = index.where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("n"))
    terms = phrases.distinct().join(lists, "term", "left").withColumn("place", F.row_number().over(Window.partitionBy("phrase").orderBy(F.coalesce("n", F.lit(0)), "term")))
    sizes = phrases.distinct().groupBy("phrase").agg(F.count("*").alias("asked"))
    seeds = index.join(terms.where("place = 1").select("term", "phrase"), "term").select("key", "phrase", F.col("pos").alias("seed"))
    near = index.join(terms.select("term", "phrase"), "term").select("key", "phrase", "term", "pos")
    met = seeds.join(near, ["key", "phrase"]).where(F.abs(F.col("pos") - F.col("seed")) <= slack)
    return met.groupBy("key", "phrase", "seed").agg(F.countDistinct("term").alias("found")).join(sizes, "phrase").where("found = asked").select("key", "phrase").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, one_in: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, row, n_words, n_hit, items (sorted), contaminated.

    Candidates come from the index; their documents' words are then compared with the item's, and every word
    inside an exact occurrence of a window is hit once. Contaminated: some hit, and ``one_in`` * hits >= words.
    Null or empty texts have no words and no hits. Repeated rows each give a row. Rows with a
    null key are judged like others. Null items are skipped, an item
    without id counts under the empty id; an empty benchmark leaves every document clean. Other columns are ignored.
    """
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    windows = staged(item_windows(items, window))
    index = positional_index(docs, windows.select("term").distinct(), "key", "text")
    found = phrase_candidates(index, windows).groupBy("key", "row").agg(F.collect_list(F.struct("item", "words", "shift")).alias("found"))
    met = F.col("d.key").eqNullSafe(F.col("f.key")) & (F.col("d.row") == F.col("f.row"))
    told = docs.where("text IS NOT NULL").withColumn("row", F.xxhash64("text")).alias("d").join(found.alias("f"), met).select("d.key", "d.row", index_words(F.col("text")).alias("said"), "found").distinct()

    def checked(c: Column) -> Column:
        width = F.least(F.lit(window), F.size(c["words"]))
        fits = F.transform(F.sequence(F.lit(0), F.size(c["words"]) - 1), lambda i: F.when(c["shift"] + i >= 0, F.coalesce(F.get("said", (c["shift"] + i).cast("int")) == F.get(c["words"], i.cast("int")), F.lit(False))).otherwise(False))
        return F.struct(c["item"].alias("item"), c["shift"].alias("shift"), width.alias("width"), fits.alias("fits"))

    def starts(c: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(c["fits"]) - c["width"]), lambda s: F.forall(F.slice(c["fits"], s + 1, c["width"]), lambda x: x))
        return F.struct(c["item"].alias("item"), F.flatten(F.transform(at, lambda s: F.sequence(c["shift"] + s, c["shift"] + s + c["width"] - 1))).alias("hit"))

    seen = told.select("key", "row", F.explode(F.transform("found", checked)).alias("c")).select("key", "row", starts(F.col("c")).alias("c")).where("size(c.hit) > 0")
    hits = seen.groupBy("key", "row").agg(F.size(F.array_distinct(F.flatten(F.collect_list("c.hit")))).cast("long").alias("n_hit"), F.sort_array(F.collect_set("c.item")).alias("items"))
    ends = index.where("term IS NULL").select("key", "row", F.col("pos").cast("long").alias("n_words"))
    joined = ends.alias("e").join(hits.alias("h"), F.col("e.key").eqNullSafe(F.col("h.key")) & (F.col("e.row") == F.col("h.row")), "left")
    return joined.select(F.col("e.key").alias(key), F.col("e.row").alias("row"), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                         F.coalesce("items", F.array().cast("array<string>")).alias("items")) \
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words")))


def op5(spark, sf_dir: str) -> DataFrame:
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS k, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks WHERE len(w) >= k)),
m AS (SELECT dw.doc_id, bw.item, dw.s, dw.k FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
