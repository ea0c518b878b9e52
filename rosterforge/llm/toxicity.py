"""Toxicity by weak supervision: voters, a generative label model, a linear classifier."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

HELD_OUT, FOLDS = 2, 4
SAMPLE_ROWS = 6000  # labelled rows of each class, at most
TERMS = 256
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+")
# A small plain list of common insults, one voter among others.
INSULTS = {
    "idiot", "moron", "stupid", "scum", "loser", "trash", "pathetic", "worthless", "disgusting", "dumb", "fool", "bastard", "bitch", "crap",
    "idiota", "imbécil", "estúpido", "basura", "asqueroso", "idiote", "imbécile", "stupide", "connard", "ordure", "dummkopf", "trottel", "abschaum", "dumm",
}
SHOUT = re.compile(r"\b[A-Z]{4,}\b|!{2,}")
ADDRESS = re.compile(r"\b(?:you|your|du|tu|vous|usted|eres)\b", re.IGNORECASE)


def terms_of(word: str) -> list[str]:
    """A word and, marked by ``^``, its longer beginnings: inflected forms share a beginning."""
    return [word, *("^" + word[:n] for n in PREFIXES if len(word) > n)]


class TermIndex(dict):
    """Raw white-space token (bytes) -> numbers of the known terms in it; most tokens have none."""

    def __init__(self, terms: list[str]):
        super().__init__()
        self.number = {t: i for i, t in enumerate(terms)}

    def __missing__(self, token: bytes) -> tuple[int, ...]:
        if len(self) > 1_000_000:
            self.clear()
        words = WORD.findall(token.decode("utf-8", "replace").lower())
        value = self[token] = tuple(self.number[t] for w in words for t in terms_of(w) if t in self.number)
        return value


def term_counts(text: str | None, index: TermIndex) -> tuple[Counter, int]:
    tokens = (text or "").encode("utf-8", "replace").split()
    return Counter(i for found in map(index.__getitem__, tokens) for i in found), len(tokens)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(id, toxic, text): at most ``rows`` labelled documents of each class outside the held-out fold, by hash order."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD_OUT)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for c in (0, 1)]
    picked = chosen[0].unionByName(chosen[1]).select(F.col("doc_id").alias("id"), "toxic")
    return docs.select(F.col("doc_id").alias("id"), "text").join(picked, "id").dropDuplicates(["text"])


def _count_terms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of each class that hold a term, summed over the task's rows before they leave it."""
    seen = (Counter(), Counter())
    for frame in frames:
        for toxic, text in zip(frame["toxic"], frame["text"], strict=True):
            seen[toxic].update({t for w in set(WORD.findall((text or "").lower())) for t in terms_of(w)})
    terms = list(seen[0].keys() | seen[1].keys())
    yield pd.DataFrame({"term": terms, "clean": [seen[0][t] for t in terms], "toxic": [seen[1][t] for t in terms]})


def mined_terms(sample: DataFrame, clean: int, toxic: int, limit: int = TERMS) -> list[str]:
    """The ``limit`` terms that tell most: at least eight times as frequent among toxic documents, most frequent first."""
    counts = sample.select("toxic", "text").mapInPandas(_count_terms, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    gain = F.col("t") / toxic - F.col("c") / clean
    least = max(5, toxic // 100)
    telling = counts.where((F.col("t") >= least) & ((F.col("t") + 0.5) / toxic >= 8 * (F.col("c") + 0.5) / clean))
    return [r["term"] for r in telling.orderBy(gain.desc(), "term").limit(limit).select("term").collect()]


def votes(counts: np.ndarray, words: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Which voters fire, per document: term voters, word-list voters, patterns and a vote of silence."""
    hits = counts.sum(axis=1)
    dense = hits / np.maximum(1, words)
    single, rest = counts[:, :40] > 0, counts[:, 40:]
    lists = [rest[:, i::8].sum(axis=1) > 0 for i in range(8)] if rest.shape[1] else []
    patterns = [hits >= 2, hits >= 4, hits >= 8, dense >= 0.002, dense >= 0.01, hits == 0, extra[:, 0] > 0, extra[:, 1] > 0, (extra[:, 2] > 0) & (hits > 0)]
    return np.column_stack([single, *lists, *patterns]).astype(float)


class LabelModel:
    """Latent class with one firing rate per voter and class, fitted by expectation maximisation.

    Voters that agree more than the class explains share their weight: a voter counts 1 / (1 + the sum of its positive
    within-class correlations), so a family of copies speaks about once.
    """

    def fit(self, fired: np.ndarray, first: np.ndarray, weights: np.ndarray, rounds: int = 30) -> LabelModel:
        post = first.copy()
        share = np.ones(fired.shape[1])
        for turn in range(rounds):
            mass = np.stack([(1 - post) * weights, post * weights])
            self.prior = mass.sum(axis=1) / mass.sum()
            self.rate = np.clip((mass @ fired + 0.5) / (mass.sum(axis=1, keepdims=True) + 1), 1e-4, 1 - 1e-4)
            if turn % 5 == 0:
                share = self._shares(fired, mass)
            self.share = share
            post = self.posterior(fired)
        return self

    def _shares(self, fired: np.ndarray, mass: np.ndarray) -> np.ndarray:
        total = np.zeros((fired.shape[1],) * 2)
        for c in (0, 1):
            off = fired - self.rate[c]
            total += (off * mass[c][:, None]).T @ off
        spread = np.sqrt(np.maximum(np.diag(total), 1e-9))
        self.correlation = total / np.outer(spread, spread)
        positive = np.maximum(self.correlation, 0)
        np.fill_diagonal(positive, 0)
        positive[positive < 0.1] = 0
        return 1 / (1 + positive.sum(axis=1))

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        ones, zeros = np.log(self.rate[1] / self.rate[0]), np.log((1 - self.rate[1]) / (1 - self.rate[0]))
        score = np.log(self.prior[1] / self.prior[0]) + fired @ (self.share * ones) + (1 - fired) @ (self.share * zeros)
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def features(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    hits = counts.sum(axis=1, keepdims=True)
    return np.hstack([np.log1p(counts), np.log1p(hits), hits > 0, np.minimum(1, 20 * hits / np.maximum(1, words)[:, None]), np.ones((len(counts), 1))]).astype(float)


def fit_logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, penalty: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column is the intercept and is hardly penalised."""
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        curve = (x * (weights * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, x.T @ (weights * (p - y)) + ridge * beta)
        beta -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> dict:
    """Terms and weights, learned from at most ``rows`` labelled rows of each class outside the held-out fold.

    The driver receives the mined terms and, per sampled row, its counts of those terms; never texts. Without
    labelled rows of both classes the model rests on the plain list of insults.
    """
    sample = labelled_sample(docs, labels, rows)
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return {"terms": sorted(INSULTS), "beta": [0.0] * len(INSULTS) + [3.0, 1.0, 0.0, -3.0]}
    terms = mined_terms(sample, sizes[0], sizes[1]) or sorted(INSULTS)

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = TermIndex(terms)
        for frame in frames:
            out = []
            for toxic, text in zip(frame["toxic"], frame["text"], strict=True):
                found, words = term_counts(text, index)
                body = text or ""
                out.append((int(toxic), words, list(found.keys()), list(found.values()), [float(bool(INSULTS & set(body.lower().split()))), float(bool(SHOUT.search(body))), float(bool(ADDRESS.search(body)))]))
            yield pd.DataFrame(out, columns=["toxic", "words", "at", "n", "extra"])

    got = sample.select("toxic", "text").mapInPandas(counted, "toxic int, words long, at array<int>, n array<int>, extra array<double>").collect()
    got.sort(key=lambda r: (r["toxic"], r["words"], r["at"], r["n"]))
    counts = np.zeros((len(got), len(terms)))
    for i, r in enumerate(got):
        counts[i, r["at"]] = r["n"]
    words, truth, extra = (np.array([r[k] for r in got], float) for k in ("words", "toxic", "extra"))
    # Classes are sampled alike; rows weigh as their class does among all labelled rows of the training folds.
    base = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD_OUT).agg(F.avg("toxic")).first()[0]
    weights = np.where(truth == 1, base / truth.mean(), (1 - base) / (1 - truth.mean()))

    fired = votes(counts, words, extra)
    hits = counts.sum(axis=1)
    model = LabelModel().fit(fired, np.clip(0.05 + 0.9 * (hits > 0), 0.05, 0.95), weights)
    post = model.posterior(fired)
    x = features(counts, words)
    beta = fit_logistic(x, post, weights)
    # The posterior labels say what matters; two numbers put the score on the scale of the true labels.
    line = np.column_stack([x @ beta, np.ones(len(x))])
    scale, shift = fit_logistic(line, truth, weights, 0.01)
    beta = beta * max(scale, 0.05)
    beta[-1] += shift
    return {"terms": terms, "beta": beta.tolist()}


def toxicity_score(model: dict, text: Column) -> Column:
    """A score between 0 and 1 for each whole text; null and empty texts score as a text without known terms."""
    terms, beta = model["terms"], np.array(model["beta"])

    @pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = TermIndex(terms)
        for texts in parts:
            out = np.empty(len(texts))
            for i, text in enumerate(texts):
                found, words = term_counts(text, index)
                total = sum(found.values())
                z = beta[-1] + beta[-4] * np.log1p(total) + beta[-3] * (total > 0) + beta[-2] * min(1, 20 * total / max(1, words))
                out[i] = z + sum(beta[k] * np.log1p(n) for k, n in found.items())
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    return score(text)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT
    scored = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), toxicity_score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
