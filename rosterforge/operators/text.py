"""Cleaning, chunking, keyword ranking, context assembly and grading."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterforge.functions.ranking import explode_once, first_per_key, top_k_per_key
from rosterforge.functions.strings import SPACE, clean_text, strip_ws
from rosterforge.functions.vectors import l2_normalize
from rosterforge.operators.cells import local_topk
from rosterforge.session import durable_checkpoint

# Words a ranking question ignores.
STOP_WORDS = ("what", "does", "this", "that", "the", "and", "for")
# Defaults of chunking and retrieval.
CHUNK_SIZE = 900
CHUNK_OVERLAP = 150
BOUNDARY_SHARE = 0.6
SPACE_SEARCH = 40
NEIGHBOUR_FACTOR = 0.95
ANSWER_LIMIT = 420
NO_ANSWER = "Insufficient information available."
NO_SOURCE = "Local RAG Knowledge Base"
# Section phrases that decide how a relation is worded.
TRADE_SECTION = "trade evolutions with items"
LEVEL_SECTION = "level-up while holding item"

PIECE = 2048
# Distinct keywords of one pass, words of the sets it broadcasts, counts that are summed at once, sets that meet a block at once,
# texts of one block, keyword lists that meet a document at once.
PASS_KEYWORDS = 1_048_576
PASS_WORDS = 16_777_216
BLOCK_SCORES = 1_000_000
BLOCK_SETS = 16_384
BLOCK_TEXTS = 64
# Blocks that are ruled out together.
GROUP_BLOCKS = 8
# What a worker keeps of the runs of letters and digits it has met: their letters, the keywords in them and RUN_COST a run.
RUN_ROOM, RUN_COST = 16_777_216, 16
# Kept as a name that callers set; sums in blocks need no common keywords.
COMMON_SETS = 32
ANSWER_SETS = 512
# Queries that share one copy of a context.
CONTEXT_QUERIES = 512


def piece_size(size: int) -> int:
    """Pieces long enough that a window of ``size`` and the search behind it span three at most."""
    return max(PIECE, size + SPACE_SEARCH)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_pieces(text: Column, size: int = PIECE) -> Column:
    """Text cut into fixed pieces, so that a window can be read without walking from the start."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % size), F.lit(0))


def piece_window(pieces: Column, start: Column, length: int | Column, size: int = PIECE) -> Column:
    """``text[start : start + length]`` (0-based) read from at most three neighbouring pieces."""
    first = F.floor(start / size).cast("int")
    span = F.concat_ws("", *[F.get(pieces, first + i) for i in range(3)])
    return F.substr(span, (start - first * size + 1).cast("int"),
                    length if isinstance(length, Column) else F.lit(length))


def last_index(window: Column, needle: str) -> Column:
    """0-based position of the last occurrence, -1 when absent."""
    back = F.locate(needle[::-1], F.reverse(window))
    return F.when(back > 0, F.length(window) - back - len(needle) + 1).otherwise(F.lit(-1))


def chunk_spans(text: Column, size: int, overlap: int) -> Column:
    """Array of (start, end) spans found by one ordered fold over the pieces of a text."""
    floor = int(size * BOUNDARY_SHARE)
    step = floor + 2 - overlap
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    if step <= 0:
        raise ValueError("overlap leaves no sure advance")
    piece = piece_size(size)
    span = "array<struct<start:int,end:int>>"

    def walk(pieces: Column, length: Column) -> Column:
        def next_state(state: Column, _i: Column) -> Column:
            start = state["start"]

            def from_window(window: Column) -> Column:
                cut = F.greatest(last_index(window, "\n\n"), last_index(window, ". "))
                natural = F.when(cut > floor, start + cut + 1).otherwise(start + size)
                end = F.when(start + size < length, natural).otherwise(length).cast("int")
                return bind(end, from_end)

            def from_end(end: Column) -> Column:
                back = F.greatest(F.lit(0), end - overlap)

                def settle(ahead: Column) -> Column:
                    blank = F.locate(" ", ahead)
                    inside = ~ahead.rlike(f"(?U)^{SPACE}")
                    return F.when((back > 0) & inside & (blank > 0), back + blank).otherwise(back)

                following = bind(piece_window(pieces, back, SPACE_SEARCH, piece), settle)
                item = F.struct(start.alias("start"), end.alias("end"))
                return F.struct(
                    following.cast("int").alias("start"), (end >= length).alias("done"),
                    F.concat(state["spans"], F.array(item)).cast(span).alias("spans"))

            return F.when(state["done"], state).otherwise(bind(piece_window(pieces, start, size, piece), from_window))

        initial = F.struct(F.lit(0).alias("start"), (length == 0).alias("done"), F.array().cast(span).alias("spans"))
        steps = F.sequence(F.lit(1), F.ceil(length / step).cast("int") + 1)
        return F.aggregate(steps, initial, next_state, lambda s: s["spans"])

    return bind(text_pieces(text, piece), lambda pieces: bind(F.length(text), lambda n: walk(pieces, n)))


def split_text(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of non-empty stripped chunks."""
    def cut(pieces: Column) -> Column:
        return F.transform(chunk_spans(text, size, overlap), lambda s: strip_ws(
            piece_window(pieces, s["start"], s["end"] - s["start"], piece_size(size))))

    return F.filter(bind(text_pieces(text, piece_size(size)), cut), lambda c: c != "")


def chunk_documents(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                    text: str = "text") -> DataFrame:
    """Overlapping chunks, indexed from 1, one projection and one explode."""
    kept = [c for c in docs.columns if c != text]
    pieces = docs.select(*kept, split_text(F.col(text), size, overlap).alias("_c"))
    chunks = explode_once(pieces, F.col("_c"), text, "_i")
    return chunks.select(*kept, (F.col("_i") + 1).alias("chunk_index"), F.length(text).alias("chunk_size"), text)


def corpus_summary(docs: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Cleaned length and chunk count per document."""
    counts = chunks.groupBy(key).agg(F.count("*").alias("chunks"))
    return docs.select(key, F.length("text").alias("cleaned_chars")).join(counts, key, "left").withColumn(
        "chunks", F.coalesce("chunks", F.lit(0)))


def corpus_totals(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars")).withColumn(
        "chunks", chunks.agg(F.count("*")).scalar())


def sample_chunks(chunks: DataFrame, order: Sequence[str], n: int = 5, chars: int = 700) -> DataFrame:
    """The first ``n`` chunks, long ones shortened for reading."""
    shown = F.concat(F.substring("text", 1, chars), F.when(F.length("text") > chars, "\n...").otherwise(""))
    return chunks.orderBy(*order).limit(n).withColumn("text", shown)


# --- embedding -------------------------------------------------------------------------------

def hashed_token_encoder(dims: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in encoder: counts of tokens by the first 16 bits of their MD5."""
    import hashlib
    import re

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), dtype="float32")
        for row, text in enumerate(texts):
            for token in re.findall(r"[a-z0-9]+", (text or "").lower()):
                out[row, int(hashlib.md5(token.encode()).hexdigest()[:4], 16) % dims] += 1
        return out

    return encode


def embed_column(df: DataFrame, col: str, encoder_factory: Callable[[], Callable[[list[str]], np.ndarray]],
                 batch: int = 16, out: str = "embedding") -> DataFrame:
    """Encode a text column; the encoder is built once per Python worker and fed small batches."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoder_factory()
        for texts in series:
            parts = [np.asarray(encoder(texts.iloc[i:i + batch].tolist()), dtype="float32")
                     for i in range(0, len(texts), batch)]
            yield pd.Series([row for part in parts for row in part])

    normal = F.transform(l2_normalize(F.col("_e")), lambda x: x.cast("float"))
    return df.withColumn("_e", encode(F.col(col))).withColumn(out, normal).drop("_e")


# --- context ---------------------------------------------------------------------------------

def expand_neighbours(hits: DataFrame, chunks: DataFrame, max_context: int = 4) -> DataFrame:
    """Each hit, then its previous and next chunk; first mention wins; cut to ``max_context``.

    ``hits`` has ``q, rank, chunk_id, score``; ``chunks`` has ``chunk_id, filename, chunk_index``.
    """
    places = chunks.select("chunk_id", "filename", "chunk_index")
    steps = F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(d).alias("delta")) for i, d in enumerate((0, -1, 1))])
    around = hits.join(places, "chunk_id").select(
        "q", "rank", "score", "filename", "chunk_index", F.explode(steps).alias("s"))
    around = around.select("q", F.col("rank").alias("hit_rank"), "filename", F.col("s.turn").alias("turn"),
                           (F.col("chunk_index") + F.col("s.delta")).alias("chunk_index"),
                           F.when(F.col("s.delta") == 0, F.col("score")).otherwise(
                               F.col("score") * NEIGHBOUR_FACTOR).alias("score"))
    found = around.join(places, ["filename", "chunk_index"])
    found = found.withColumn("_r", F.col("hit_rank")).withColumn("_t", F.col("turn"))
    once = first_per_key(found, ["q", "chunk_id"], ["_r", "_t"]).drop("_r", "_t")
    cut = top_k_per_key(once, ["q"], [F.asc("hit_rank"), F.asc("turn")], max_context, "position")
    return cut.select("q", "position", "chunk_id", "filename", "chunk_index", "score")


def format_context(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """One context string per query from its cut hits.

    Queries with the same hits share one context, which is made once and copied per CONTEXT_QUERIES
    of them, so texts are shuffled per distinct list of hits and not per query.
    """
    lists = hits.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("position", "chunk_id"))).alias("_list"))
    wanted = lists.groupBy("_list").agg(F.ceil(F.count("*") / CONTEXT_QUERIES).alias("_shares"))
    rows = wanted.select("_list", "_shares", F.inline("_list")).join(
        chunks.select("chunk_id", "filename", "chunk_index", "text"), "chunk_id")
    block = F.concat(
        F.lit("[Chunk "), F.col("position").cast("string"), F.lit(" | Source: "), "filename",
        F.lit(" | Chunk index: "), F.col("chunk_index").cast("string"), F.lit("]\n"), "text")
    ordered = F.array_sort(F.collect_list(F.struct("position", block.alias("block"))))
    made = rows.groupBy("_list", "_shares").agg(F.array_join(F.transform(ordered, lambda s: s["block"]), "\n\n").alias("context"))
    copies = made.select("_list", "context", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_shares"))).alias("_share"))
    dealt = lists.join(wanted, "_list").select("q", "_list", (F.pmod(F.xxhash64("q"), "_shares") + 1).alias("_share"))
    return dealt.join(copies, ["_list", "_share"]).select("q", "context")


def build_prompt(contexts: DataFrame, questions: DataFrame, system: str) -> DataFrame:
    """Two role/content messages per question."""
    rows = questions.join(contexts, "q", "left")
    user = F.concat(F.lit("Context:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion:\n"), "question",
                    F.lit("\n\nAnswer:"))
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")))
    return rows.select("q", messages.alias("messages"))


def source_list(hits: DataFrame, order: str = "position") -> DataFrame:
    """Distinct filenames per query in first-seen order."""
    seen = hits.where(F.coalesce("filename", F.lit("")) != "").groupBy("q", "filename").agg(F.min(order).alias("p"))
    names = seen.groupBy("q").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("p", "filename"))), lambda s: s["filename"]), ", ").alias("sources"))
    return hits.select("q").distinct().join(names, "q", "left").withColumn(
        "sources", F.coalesce("sources", F.lit(NO_SOURCE)))


# --- keyword ranking -------------------------------------------------------------------------

def keyword_tokens(col: Column, stop: Sequence[str] = STOP_WORDS, distinct: bool = True) -> Column:
    """Lower-cased ASCII tokens longer than two characters."""
    tokens = F.filter(F.regexp_extract_all(F.lower(col), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 2)
    if not distinct:
        return tokens
    return F.array_except(F.array_distinct(tokens), F.array(*[F.lit(s) for s in stop])) if stop else F.array_distinct(tokens)


def keyword_sets(questions: DataFrame, question: str = "question", distinct: bool = True) -> DataFrame:
    """(q, set): the sorted keywords of every question, joined by spaces."""
    return questions.select("q", F.array_join(F.array_sort(keyword_tokens(F.col(question), distinct=distinct)), " ").alias("set"))


def overlaps_itself(word: str) -> bool:
    """Whether two occurrences of a word can share characters."""
    return any(word.startswith(word[i:]) for i in range(1, len(word)))


class KeywordAutomaton:
    """Counts many keywords in one pass over a text; occurrences of one keyword do not overlap each other.

    Keywords of a-z and 0-9 occur only inside the longest runs of these characters, so a run is walked once and
    what it holds is kept for the next text, while the kept runs take about RUN_ROOM places.
    """

    def __init__(self, keywords: Sequence[str]):
        import ahocorasick

        self.keywords = keywords
        self.doubtful = {i for i, w in enumerate(keywords) if overlaps_itself(w)}
        self.machine = ahocorasick.Automaton()
        for number, word in enumerate(keywords):
            self.machine.add_word(word, number)
        self.machine.make_automaton()
        self.may_overlap = np.zeros(len(keywords), bool)
        self.may_overlap[list(self.doubtful)] = True
        self.plain = bool(keywords) and all(map(re.compile("[a-z0-9]+").fullmatch, keywords))
        self.runs = re.compile("[a-z0-9]{%d,}" % min(map(len, keywords), default=1)).findall
        self._forget()

    def counts(self, text: str) -> dict[int, int]:
        found = Counter([number for _, number in self.machine.iter(text)]) if self.keywords else Counter()
        for number in self.doubtful.intersection(found):
            if found[number] > 1:
                found[number] = text.count(self.keywords[number])
        return found

    def _forget(self) -> None:
        """Per known run its place; ``spans`` has where its keywords begin in ``held`` and how many they are."""
        self.place: dict[str, int] = {}
        self.spans, self.held = np.empty((1024, 2), "int64"), np.empty(4096, "int32")
        self.used = self.letters = 0

    def _learn(self, runs: list[str]) -> None:
        """Walk new runs, as one text with line ends between them, and keep the keywords of each, one entry per occurrence."""
        ends = np.cumsum(np.fromiter(map(len, runs), "int64", len(runs)) + 1)
        met = np.fromiter(chain.from_iterable(self.machine.iter("\n".join(runs))), "int64").reshape(-1, 2)
        run, number = np.searchsorted(ends, met[:, 0], "right"), met[:, 1]
        if self.doubtful and (among := np.flatnonzero(self.may_overlap[number])).size:
            pairs, again = np.unique(run[among] << 32 | number[among], return_counts=True)
            kept = np.ones(len(run), bool)
            kept[among] = False
            times = again.copy()
            for i in np.flatnonzero(again > 1).tolist():
                times[i] = runs[pairs[i] >> 32].count(self.keywords[pairs[i] & 0xFFFFFFFF])
            pairs = np.repeat(pairs, times)
            run, number = np.concatenate([run[kept], pairs >> 32]), np.concatenate([number[kept], pairs & 0xFFFFFFFF])
            order = np.argsort(run, kind="stable")
            run, number = run[order], number[order]
        known, used = len(self.place), self.used + len(run)
        while len(self.spans) < known + len(runs):
            self.spans = np.concatenate([self.spans, np.empty_like(self.spans)])
        while len(self.held) < used:
            self.held = np.concatenate([self.held, np.empty_like(self.held)])
        size = np.bincount(run, minlength=len(runs))
        self.spans[known:known + len(runs), 0] = self.used + np.cumsum(size) - size
        self.spans[known:known + len(runs), 1] = size
        self.held[self.used:used] = number
        self.place.update(zip(runs, range(known, known + len(runs)), strict=True))
        self.used, self.letters = used, self.letters + int(ends[-1])

    def occurrences(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, keyword, times): what the texts hold; a keyword may come several times in one text, and times add up."""
        if not self.plain:
            found = [self.counts(text) for text in texts]
            size = np.fromiter(map(len, found), "int64", len(found))
            return (np.repeat(np.arange(len(texts)), size), np.fromiter(chain.from_iterable(found), "int64", size.sum()),
                    np.fromiter(chain.from_iterable(map(Counter.values, found)), "int64", size.sum()))
        said = [Counter(self.runs(text)) for text in texts]
        if RUN_COST * len(self.place) + self.used + self.letters > RUN_ROOM:
            self._forget()
        if new := [run for run in set().union(*said) if run not in self.place]:
            self._learn(new)
        spoken = np.fromiter(map(len, said), "int64", len(said))
        at = self.spans[np.fromiter(map(self.place.__getitem__, chain.from_iterable(said)), "int64", spoken.sum())]
        times = np.fromiter(chain.from_iterable(map(Counter.values, said)), "int64", spoken.sum())
        size = at[:, 1]
        first = np.cumsum(size) - size
        held = self.held[np.repeat(at[:, 0] - first, size) + np.arange(size.sum())]
        return np.repeat(np.repeat(np.arange(len(texts)), spoken), size), held, np.repeat(times, size)


@dataclass(frozen=True)
class Packed:
    """Keyword sets as a broadcast carries them: all keywords, and the keywords of one set after those of the other."""

    keywords: list[str]
    named: np.ndarray
    size: np.ndarray


def packed(sets: Sequence[str]) -> Packed:
    keywords = sorted({w for s in sets for w in s.split(" ")})
    number = {w: i for i, w in enumerate(keywords)}
    # The keywords of one set stand together, once per time the set holds them.
    named = np.fromiter((number[w] for s in sets for w in s.split(" ")), "int32")
    return Packed(keywords, named, np.array([s.count(" ") + 1 for s in sets], "int64"))


class Counts(NamedTuple):
    """Occurrences in some texts: a row per keyword that any of them holds, after one of zeros, and every keyword's row."""

    rows: np.ndarray
    row_of: np.ndarray


class SetScores:
    """Scores of keyword sets against documents, by an automaton over all keywords of the sets."""

    def __init__(self, sets: list[str] | Packed):
        told = packed(sets) if isinstance(sets, list) else sets
        self.automaton = KeywordAutomaton(told.keywords)
        self.named, self.size = told.named, told.size
        self.begins = np.cumsum(self.size) - self.size

    def counted(self, texts: Sequence[str]) -> Counts:
        """Occurrences of all keywords; only those that occur take room."""
        column, number, times = self.automaton.occurrences(texts)
        row_of = np.zeros(len(self.automaton.keywords), "int32")
        row_of[number] = 1
        row_of = np.where(row_of > 0, np.cumsum(row_of, dtype="int32"), 0)
        shape = (int(row_of.max(initial=0)) + 1, len(texts))
        rows = np.bincount(row_of[number] * np.int64(len(texts)) + column, times, shape[0] * shape[1])
        return Counts(rows.astype("int32").reshape(shape), row_of)

    def highest(self, counts: Counts) -> np.ndarray:
        """Per keyword its greatest count in a text."""
        return counts.rows.max(axis=1, initial=0)[counts.row_of]

    def bound(self, highest: np.ndarray, sets: np.ndarray | None = None) -> np.ndarray:
        """Per set (all, or the numbered ones) a score that no text with such greatest counts exceeds."""
        if sets is None:
            return np.add.reduceat(highest[self.named], self.begins, dtype="int64")
        out = np.empty(len(sets), "int64")
        for lo, hi, first, place in self._parts(sets, 1):
            out[lo:hi] = np.add.reduceat(highest[self.named[place]], first, dtype="int64")
        return out

    def most(self, counts: Counts) -> np.ndarray:
        """Per set a score that none of the counted texts exceeds."""
        return self.bound(self.highest(counts))

    def _parts(self, sets: np.ndarray, texts: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """The numbered sets in parts of about BLOCK_SCORES counts: (from, to, where each begins, places in ``named``)."""
        part = np.cumsum(self.size[sets]) * texts // BLOCK_SCORES
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(sets)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo < hi:
                size = self.size[sets[lo:hi]]
                first = np.cumsum(size) - size
                yield lo, hi, first, np.repeat(self.begins[sets[lo:hi]] - first, size) + np.arange(size.sum())

    def summed(self, counts: Counts, sets: np.ndarray) -> np.ndarray:
        """Scores of the numbered sets, sets x texts, in parts of about BLOCK_SCORES counts."""
        texts = counts.rows.shape[1]
        out = np.empty((len(sets), texts), "int64")
        for lo, hi, first, place in self._parts(sets, texts):
            out[lo:hi] = np.add.reduceat(counts.rows[counts.row_of[self.named[place]]], first, axis=0, dtype="int64")
        return out

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        """Scores, sets x texts."""
        every = np.arange(len(self.size))
        parts = [self.summed(self.counted(texts[i:i + BLOCK_TEXTS]), every) for i in range(0, len(texts), BLOCK_TEXTS)]
        return np.concatenate(parts, axis=1) if parts else np.zeros((len(every), 0), "int64")


# The last broadcast list of sets that this Python worker met, and its scores.
_KEPT: list = [None, None]


def kept_scores(names: list[str] | Packed) -> SetScores:
    """Scores of a broadcast list, made once per Python worker and not once per task; only the last ones are kept."""
    if _KEPT[0] is not names:
        _KEPT[:] = [None, None]
        _KEPT[:] = [names, SetScores(names)]
    return _KEPT[1]


def _best_of(rows: pa.Table, k: int) -> pa.Table:
    """The k best rows of every set: higher scores first, then lower ids."""
    rows = rows.sort_by([("set", "ascending"), ("score", "descending"), ("id", "ascending")])
    number = rows.column("set").to_numpy()
    begins = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])[:len(number)])
    place = np.arange(len(number)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(number)]])))
    return rows.filter(pa.array(place < k))


def rank_documents(questions: DataFrame, docs: DataFrame, k: int, key: str = "filename",
                   question: str = "question", text: str = "text") -> DataFrame:
    """Top-k documents per question ``q`` by summed keyword occurrences, ties by document key.

    Questions with the same keywords share one keyword set. The sets travel to the documents in
    passes of about PASS_WORDS words or PASS_KEYWORDS distinct ones, so what a pass broadcasts and builds has a
    fixed size; there is one pass unless the questions hold more, since each counts all documents anew. Sets travel as
    numbers of their keywords and come back as 64-bit hashes that tell them apart (checked). In a pass every Python worker
    builds one automaton over the keywords, walks each distinct run of letters and digits that it meets once and counts
    documents by their runs, before any shuffle. Documents are scored in blocks, long ones first; the greatest count of
    each keyword in some blocks, then in one, bounds what its documents can score, and a set skips blocks below the k-th
    score it has. A task leaves at most k documents per set. Null texts and questions without keywords rank nothing.
    """
    spark = docs.sparkSession
    asked = keyword_sets(questions, question)
    sets = asked.where(F.col("set") != "").select("set").distinct()
    words, keywords = sets.select(F.explode(F.split("set", " ")).alias("w")).agg(F.count("*"), F.count_distinct("w")).first()
    passes = max(1, -(-words // PASS_WORDS), -(-keywords // PASS_KEYWORDS))
    kinds = T.StructType([
        T.StructField("key", T.LongType()), T.StructField("id", docs.schema[key].dataType), T.StructField("score", T.LongType())])
    spoken = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.lower(text).alias("low"))

    def ranked(names: list[str], keys: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((packed(names), keys))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sets, keys = shared.value
            scores = kept_scores(sets)
            best: list[pa.Table] = []
            held = 0
            # The k best scores of every set so far, and the score that a further text must reach.
            tops = np.zeros((len(keys), k), "int32")
            reach = np.ones(len(keys), "int64")
            for batch in batches:
                table = pa.Table.from_batches([batch])
                # Long texts first: they score most, and blocks of shorter ones are soon out of reach of most sets.
                table = table.take(pc.sort_indices(pc.negate(pc.utf8_length(table.column("low")))))
                start = 0
                while start < table.num_rows:
                    # As many blocks as lie before, GROUP_BLOCKS at most, are ruled out together.
                    blocks = min(GROUP_BLOCKS, max(1, start // BLOCK_TEXTS))
                    parts = [table.slice(first, BLOCK_TEXTS).sort_by("id") for first in range(start, min(table.num_rows, start + blocks * BLOCK_TEXTS), BLOCK_TEXTS)]
                    start += blocks * BLOCK_TEXTS
                    counted = [scores.counted(part.column("low").to_pylist()) for part in parts]
                    highest = [scores.highest(counts) for counts in counted]
                    group = np.flatnonzero(scores.bound(np.maximum.reduce(highest)) >= reach)
                    for part, counts, high in zip(parts, counted, highest, strict=True):
                        every = group if len(parts) == 1 else group[scores.bound(high, group) >= reach[group]]
                        for first in range(0, len(every), BLOCK_SETS):
                            open_ = every[first:first + BLOCK_SETS]
                            block = scores.summed(counts, open_)
                            rows, cols = local_topk(block, k)
                            hit = block[rows, cols] >= reach[open_[rows]]
                            rows, cols = rows[hit], cols[hit]
                            tops[open_] = np.partition(np.concatenate([tops[open_], block], axis=1), -k, axis=1)[:, -k:]
                            reach[open_] = np.maximum(1, tops[open_].min(axis=1))
                            best.append(pa.table([pa.array(open_[rows]), part.column("id").combine_chunks().take(pa.array(cols)), pa.array(block[rows, cols])], ["set", "id", "score"]))
                            held += len(rows)
                    if held > 3 * k * len(keys) // 2 + 100_000:
                        best = [_best_of(pa.concat_tables(best), k)]
                        held = best[0].num_rows
            if held:
                told = _best_of(pa.concat_tables(best), k)
                yield from pa.table([pa.array(keys[told.column("set").to_numpy()]), told.column("id"), told.column("score")], kinds.fieldNames()).to_batches()

        return spoken.mapInArrow(run, kinds)

    if k <= 0:
        return asked.limit(0).join(spark.createDataFrame([], kinds)).select("q", F.lit(0).alias("rank"), F.col("id").alias(key), "score")
    hits, seed = [], 0
    while len(hits) < passes:
        number = F.xxhash64("set", F.lit(seed))
        told = sets.where(F.pmod(number, F.lit(passes)) == len(hits)).select(number, "set").collect()
        keys = np.array([r[0] for r in told], "int64")
        if len(np.unique(keys)) < len(keys):
            hits, seed = [], seed + 1
        else:
            hits.append(ranked([r[1] for r in told], keys))
    best = top_k_per_key(reduce(DataFrame.unionByName, hits), ["key"], [F.desc("score"), F.asc("id")], k)
    asked = asked.select("q", F.when(F.col("set") != "", number).alias("key"))
    return asked.join(best, "key").select("q", "rank", F.col("id").alias(key), "score")


def compact_answer(paragraph: Column) -> Column:
    """Paragraph on one line, cut to the answer limit; null when nothing is left."""
    def cut(text: Column) -> Column:
        head = F.regexp_replace(F.substring(text, 1, ANSWER_LIMIT - 3), f"(?U){SPACE}+$", "")
        return F.when(F.length(text) > ANSWER_LIMIT, F.concat(head, F.lit("..."))).otherwise(F.nullif(text, F.lit("")))

    return bind(strip_ws(F.regexp_replace(paragraph, "(?U)\\s+", " ")), cut)


def paragraphs(text: str) -> Column:
    """The parts between blank lines, stripped; the whole text where all are empty."""
    pieces = F.filter(F.transform(F.split(text, "\\n(?U:\\s*)\\n"), lambda p: strip_ws(p)), lambda p: p != "")
    return bind(pieces, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(strip_ws(text))))


def extract_answer(ranked: DataFrame, questions: DataFrame, docs: DataFrame, key: str = "filename",
                   question: str = "question", text: str = "text") -> DataFrame:
    """Answer from the best paragraph of the best document; a fixed sentence when none ranked.

    A document is scored once per distinct list of keywords that chose it. The lists of a document
    come in shares of about ANSWER_SETS, so one that answers a third of all questions is split over
    many tasks. A paragraph is cut to an answer once per share, before the lists choose, so whole paragraphs do not leave a task. ``docs`` holds one row per key.
    """
    best = durable_checkpoint(ranked.where(F.col("rank") == 1).select("q", key))
    asked = keyword_sets(questions, question, distinct=False)
    wanted = best.join(asked, "q").select(key, "set").distinct()
    shares = wanted.groupBy(key).agg(F.ceil(F.count("*") / ANSWER_SETS).alias("_shares"))
    lists = wanted.join(shares, key).withColumn("_share", F.pmod(F.xxhash64("set"), "_shares")).groupBy(key, "_share").agg(F.collect_list("set").alias("_sets"))
    met = lists.join(docs.select(key, F.col(text).alias("_text")), key).withColumn("_p", paragraphs("_text"))
    met = met.select(F.col(key).alias("id"), F.col("_sets").alias("sets"), F.transform("_p", compact_answer).alias("parts"), F.transform("_p", lambda p: F.lower(p)).alias("low"))
    kinds = T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("set", T.StringType()), T.StructField("answer", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets, parts = [], [], []
            for place, (names, said, low) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                # The first of the best paragraphs; the first one if none holds a keyword.
                parts += [said[i] for i in SetScores(names).scores(low).argmax(axis=1)] if len(low) > 1 else said * len(names)
                sets += names
                ids += [place] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(sets, pa.string()), pa.array(parts, pa.string())], kinds.fieldNames())

    answers = met.mapInArrow(run, kinds).withColumnRenamed("id", key)
    found = best.join(asked, "q").join(answers, [key, "set"]).select("q", key, "answer")
    return questions.select("q").join(found, "q", "left").select(
        "q", F.coalesce("answer", F.lit(NO_ANSWER)).alias("answer"), F.coalesce(key, F.lit(NO_SOURCE)).alias("source"))


def grade_answers(df: DataFrame, answer: str = "answer", keywords: str = "required_keywords") -> DataFrame:
    """Correct when every required keyword occurs, Partial when some do."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    found = F.size(F.filter(keywords, lambda w: low.contains(F.lower(w))))
    grade = F.when(found == F.size(keywords), "Correct").when(found > 0, "Partial").otherwise("Incorrect")
    return df.withColumn("grade", grade)


def grade_counts(graded: DataFrame) -> DataFrame:
    """Count per grade; absent grades count zero."""
    columns = [F.count_if(F.col("grade") == g).alias(g) for g in ("Correct", "Partial", "Incorrect")]
    totals = graded.agg(*columns)
    return totals.select(F.explode(F.array(*[
        F.struct(F.lit(g).alias("grade"), F.col(g).alias("n")) for g in ("Correct", "Partial", "Incorrect")])).alias("r")).select("r.*")


# --- relations -------------------------------------------------------------------------------

def extract_relations(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """Lines ``A + item -> B`` as rows with the condition worded from the lines before them.

    Only the first line naming a section matters, so each chunk is read once as an array.
    """
    lines = F.split(text, "\\r\\n|[\\n\\u000b\\f\\r\\x1c-\\x1e\\u0085\\u2028\\u2029]")

    def first_line(phrase: str) -> Column:
        marks = F.transform("_lines", lambda s, i: F.when(F.lower(s).contains(phrase), i))
        return F.coalesce(F.array_min(F.filter(marks, lambda m: m.isNotNull())), F.lit(2_000_000_000))

    rows = chunks.select(key, lines.alias("_lines"))
    rows = rows.select(key, first_line(TRADE_SECTION).alias("_trade"), first_line(LEVEL_SECTION).alias("_level"),
                       F.posexplode_outer("_lines").alias("line_no", "_line")).where(F.col("_line").rlike("\\+"))
    line = strip_ws(F.regexp_replace(strip_ws("_line"), "^-+", ""))
    line = F.replace(F.replace(line, F.lit("â†’"), F.lit("->")), F.lit("→"), F.lit("->"))
    pattern = "^(.+?)\\s+\\+\\s+(.+?)\\s+->\\s+(.+)"
    rows = rows.withColumn("_l", line).where(F.col("_l").rlike(pattern))
    rows = rows.select(key, "line_no", "_trade", "_level", *[
        strip_ws(F.regexp_extract("_l", pattern, i + 1)).alias(c) for i, c in enumerate(("subject", "item", "result"))])
    item = F.lower("item")
    leveled = (F.col("_level") < F.col("line_no")) | item.contains("night") | item.contains("day")
    condition = (
        F.when(F.col("_trade") < F.col("line_no"), F.concat(F.lit("by being traded while holding "), "item"))
        .when(leveled, F.concat(F.lit("by leveling up while holding "), "item"))
        .otherwise(F.concat(F.lit("using or meeting the condition for "), "item")))
    return rows.select(key, "line_no", "subject", "item", "result", condition.alias("condition"))


def answer_relations(questions: DataFrame, hits: DataFrame, relations: DataFrame,
                     question: str = "question", key: str = "chunk_id") -> DataFrame:
    """First relation of the ranked hits whose subject occurs in an evolution question."""
    low = F.lower(question)
    asked = questions.where(low.contains("evolve") | low.contains("evolution"))
    rows = hits.select("q", "position", key).join(asked, "q").join(relations, key)
    rows = rows.where(low.contains(F.lower("subject")))
    best = rows.groupBy("q").agg(F.min_by(F.struct("subject", "result", "condition"), F.struct("position", "line_no")).alias("r"))
    return best.select("q", F.concat("r.subject", F.lit(" evolves into "), "r.result", F.lit(" "), "r.condition", F.lit(".")).alias("answer"))


def cleaned(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn(text, clean_text(text))
