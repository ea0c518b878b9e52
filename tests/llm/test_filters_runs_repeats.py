"""Filter audit, periodic runs and repeated substrings against SQL and brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterforge.llm import filter_audit, periodic_runs, recompression
from rosterforge.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, part string, key long, fails int, n long, digest string, words string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, repeats, copies under other keys, a very long text and columns named like the operators' own."""
    base = " ".join(f"w{i}" for i in range(220))
    rows = [(1, base, "s"), (2, base, "t"), (2, base, "t"), (3, None, None), (4, "", ""), (4, "", "s"), (None, base, "t"), (None, base, "t"),
            (5, "one", None), (6, "x y\nx y\n\n #", "t"), (7, "long " * 100_000, "t"), (8, "A B C " * 90, "s"), (9, base, "s"), (0, "x\ty", "s")]
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "p", 9, 9, 9, "d", "w") for i, t, s in rows], DOC)


def audit_by_hand(docs, labels):
    good, toxic = ({k for k, *v in labels if v[i] == 1 and k is not None} for i in (0, 1))
    said = [(k, t or "", s or "") for k, t, s in docs]
    first: dict = {}
    for k, t, _ in said:
        if k is not None:
            first[t] = min(k, first.get(t, k))
    told = {}
    for part in {s for *_, s in said}:
        masks = []
        for k, t, s in said:
            if s == part:
                w = re.findall(r"[^\x20\x09-\x0D]+", t)
                masks.append((k, {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                                  "D": bool(re.search(r"[#$%&*|]", t)), "E": k is not None and k > first[t]}))
        for order in permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                before = order[:step - 1]
                out = [(k, m) for k, m in masks if m[x] and not any(m[y] for y in before)]
                told[part, "".join(order), step] = [
                    sum(not any(m[y] for y in order[:step]) for _, m in masks), len(out), sum(m[x] and any(m[y] for y in before) for _, m in masks),
                    sum(m[x] and sum(m.values()) == 1 for _, m in masks), sum(k in good for k, _ in out), sum(k in toxic for k, _ in out)]
    shapley: dict = {}
    for (part, order, step), v in told.items():
        shapley[part, order[step - 1]] = shapley.get((part, order[step - 1]), 0) + v[1]
    return {k: [*v, shapley[k[0], k[1][k[2] - 1]]] for k, v in told.items()}


def test_audit_of_odd_rows(spark, odd):
    labels = [(1, 1, 0), (2, 1, 1), (2, None, 0), (5, 0, 1), (None, 1, 1), (7, 1, None), (99, 1, 1), (8, 2, 1)]
    out = filter_audit.filter_audit(odd, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    told = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in (*filter_audit.OUTCOMES, "shapley")] for r in out.collect()}
    assert told == audit_by_hand([(r.doc_id, r.text, r.source) for r in odd.collect()], labels)
    empty = filter_audit.filter_audit(odd.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert empty.count() == 0 and empty.columns == out.columns


def test_fields_never_carry(spark):
    counts = spark.createDataFrame([("p", 31, True, True, 2 ** 55), ("p", 1, True, False, 2 ** 55)], "part string, fails int, good boolean, toxic boolean, n long")
    rows = filter_audit.unpacked(filter_audit.packed_sums(counts).select("part", "packed")).where("filter_order = 'BACDE'").orderBy("step").collect()
    assert [(r.kept, r.removed, r.redundant, r.unique_fails) for r in rows[:2]] == [(2 ** 55, 2 ** 55, 0, 0), (0, 2 ** 55, 2 ** 55, 2 ** 55)]


def test_sums_of_two_shards_add_up(spark, odd):
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    one, two = (filter_audit.packed_sums(filter_audit.failure_counts(odd.where(F.col("doc_id") % 2 == i), labels)) for i in (0, 1))
    both = filter_audit.unpacked(filter_audit.added_sums(one.unionByName(two))).where("step = 1").groupBy().agg(F.sum("kept"), F.sum("removed")).first()
    parts = [filter_audit.unpacked(x).where("step = 1").groupBy().agg(F.sum("kept"), F.sum("removed")).first() for x in (one, two)]
    assert list(both) == [a + b for a, b in zip(*parts)]


@pytest.mark.parametrize("name", [n for n in ORACLES if n.startswith(("op11", "op12", "op13"))])
def test_query_matches_sql(spark, name):
    ok, note = compare(spark, connect(SF), name, QUERIES[name], ORACLES[name], SF)
    assert ok, note


def runs_by_hand(words):
    """Every maximal stretch with its smallest period, by trying all periods at all places."""
    n, out = len(words), set()
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    a = np.array([ids[w] for w in words], np.int64)
    for q in range(1, n // 3 + 1):
        same = np.concatenate([[False], a[q:] == a[:-q], [False]]).astype(np.int8)
        edges = np.diff(same)
        for s, e in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)):
            length = int(e - s + q)
            if length >= max(24, 3 * q) and not any(q % d == 0 and (a[s:s + length - d] == a[s + d:s + length]).all() for d in range(1, q)):
                out.add((int(s), length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted_by_hand(key, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    return words


def run_row(key, text):
    words = planted_by_hand(key, text)
    runs = runs_by_hand(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    milli = 1000 * best[1] // best[2] if runs else None
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (key, len(runs), *best, milli, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def test_runs_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    told = {tuple(r) for r in QUERIES["op13_periodic_runs"](spark, SF).collect()}
    wanted = {run_row(r.doc_id, r.text) for r in docs}
    assert told == wanted and sum(r[1] > 0 for r in wanted) > 10


def test_runs_of_small_alphabets(spark):
    dice = random.Random(13)
    texts = []
    for _ in range(250):
        words = []
        while len(words) < dice.randint(0, 400):
            block = dice.choices("ab" if dice.random() < .5 else "abcdef", k=dice.randint(1, 40))
            words += block * dice.randint(1, 6) + block[:dice.randint(0, len(block))]
        texts.append(" ".join(words))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    told = {int(r.key): [(x.start, x.length, x.period) for x in r.runs] for r in periodic_runs.periodic_runs(rows).collect()}
    assert told == {i: runs_by_hand(t.split()) for i, t in enumerate(texts)}


def test_runs_of_odd_rows(spark, odd):
    out = periodic_runs.periodic_runs(odd).collect()
    assert len(out) == odd.count()
    long = next(r for r in out if r.key == "7")
    assert [tuple(r) for r in long.runs] == [(0, 1, 100_000)] and long.said == "long" and long.n_words == 100_000
    assert [r.said for r in out if r.key == "8"] == ["A B C"] and [r.said for r in out if r.key == "3"] == [""]
    assert len([r for r in out if r.key is None]) == 2 and all(not r.runs for r in out if r.key is None)
    repeated = odd.unionByName(odd).unionByName(odd)
    assert sorted(map(str, periodic_runs.periodic_runs(repeated, digests=True).select("key", "runs", "digest").collect())) == sorted(
        str(r) for r in periodic_runs.periodic_runs(odd, digests=True).select("key", "runs", "digest").collect() for _ in range(3))
    assert periodic_runs.periodic_runs(odd.limit(0)).count() == 0


def test_tiles_of_one_text_meet_in_the_shuffle(spark):
    """Fragments of one run, cut by tiles that other tasks solved, become one run; two runs of one period stay two."""
    found = [(5, 0, 40), (5, 30, 70), (5, 64, 90), (5, 87, 120), (7, 10, 20)]
    tiled = spark.createDataFrame([("1", b"r", [dict(zip(("period", "start", "stop"), f))]) for f in found], "key string, row binary, found array<struct<period:long,start:long,stop:long>>")
    assert {tuple(r)[1:] for r in periodic_runs.stitched_runs(tiled).collect()} == {(0, 90, 5), (87, 33, 5)}


def cut_by_hand(rows):
    """Per row (key, text): words left, by comparing every window of 13 words with all others."""
    said = [(k, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in rows]
    first: dict = {}
    for k, w in said:
        for i in range(len(w) - 12):
            if k is not None:
                g = tuple(w[i:i + 13])
                first[g] = min(k, first.get(g, k))
    out = []
    for k, w in said:
        gone = {j for i in range(len(w) - 12) if k is not None and first[tuple(w[i:i + 13])] < k for j in range(i, i + 13)}
        out.append((k, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def told_cuts(docs, digests=False):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in recompression.without_repeats(docs, digests=digests).collect()), key=str)


def test_repeats_of_odd_rows(spark, odd):
    assert told_cuts(odd) == cut_by_hand([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    assert recompression.without_repeats(odd.limit(0)).count() == 0
    told = recompression.without_repeats(odd, digests=True).select("doc_id", "kept_digest").collect()
    assert sorted(told, key=str) == sorted(((k, hashlib.sha256(t.encode()).hexdigest()) for k, *_, t in cut_by_hand([(r.doc_id, r.text) for r in odd.collect()])), key=str)


@pytest.mark.parametrize("alphabet", [2, 5, 3000])
def test_repeats_of_small_batches(spark, monkeypatch, alphabet):
    """Passages of 10 to 80 words dealt over many texts, some under one key, some with none, in many batches and cells."""
    monkeypatch.setattr(recompression, "BATCH_CHARS", 3000)
    monkeypatch.setattr(recompression, "CELL_CHARS", 9000)
    dice = random.Random(alphabet)
    words = [f"w{i}" for i in range(alphabet)]
    passages = [dice.choices(words, k=dice.randint(10, 80)) for _ in range(12)]
    rows = []
    for i in range(160):
        text = []
        for _ in range(dice.randint(0, 4)):
            passage = dice.choice(passages)
            text += passage[dice.randint(0, 5):dice.randint(8, len(passage))] + dice.choices(words, k=dice.randint(0, 20))
        rows.append((dice.choice([i, i, i, i // 3, None]), dice.choice([" ", "\n", "\t "]).join(text)))
    rows += [(1000 + i, rows[3][1]) for i in range(40)]
    assert told_cuts(spark.createDataFrame(rows, "doc_id long, text string")) == cut_by_hand(rows)


def test_equal_windows_name_equal_symbols():
    dice = np.random.default_rng(11)
    shared = dice.integers(0, 2 ** 63, 13, dtype=np.uint64)
    names = set()
    for _ in range(200):
        before, after = (dice.choice(shared, n) if n % 2 else dice.integers(0, 2 ** 63, n, dtype=np.uint64) for n in dice.integers(0, 9, 2))
        ids = np.concatenate([before, shared, after])
        names.add(int(recompression.window_symbols(ids, np.zeros(len(ids), np.int64))[len(before)]))
    assert len(names) == 1
    assert names.pop() >> 58 >= 2


def test_batches_are_read_in_place(spark):
    """Later passes join their answers to the bucketed texts without a second shuffle of the texts."""
    name, _, cells = recompression.batches_of_texts(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text")
    texts = spark.table(name)
    assert texts.groupBy().agg(F.count("*"), F.countDistinct("row")).first()[:] == (texts.count(), texts.count())
    plan = recompression.cut_texts(texts, spark.createDataFrame([], "b long, p binary, q binary, r binary"), True)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") <= 1
    spark.sql(f"DROP TABLE {name}")
