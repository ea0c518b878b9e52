"""Keyword ranking and answers in many passes, chunks and shares, against plain counting."""

from __future__ import annotations

import random
import re

import pytest

from rosterforge.operators import text


def keywords(question):
    return [w for w in re.findall(r"[a-z0-9]+", question.lower()) if len(w) > 2]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(text, "PASS_KEYWORDS", 40)
    monkeypatch.setattr(text, "BLOCK_SCORES", 60)
    monkeypatch.setattr(text, "COMMON_SETS", 3)
    monkeypatch.setattr(text, "ANSWER_SETS", 2)


def corpus(seed):
    dice = random.Random(seed)
    parts = ["aaa", "aaaa", "aba", "bab", "abab", "cde", "the", "x12", " ", " ", ". ", "\n\n", "\n \n", "É", "ß"]
    make = lambda n: "".join(dice.choice(parts) for _ in range(n))
    docs = [(f"f{i:02d}", make(80)) for i in range(25)] + [("f90", None), ("f91", ""), ("f92", "aaa aba bab abab cde x12 " * 40)]
    asked = [(i, make(14)) for i in range(60)] + [(98, "the and"), (99, "")]
    return docs, asked


def test_ranking_in_passes(spark, small):
    docs, asked = corpus(1)
    out = text.rank_documents(spark.createDataFrame(asked, "q int, question string"), spark.createDataFrame(docs, "filename string, text string"), 4)
    got: dict = {}
    for r in out.orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append((r.filename, r.score))
    for q, question in asked:
        scored = [(name, sum(body.lower().count(w) for w in {*keywords(question)} - {*text.STOP_WORDS})) for name, body in docs if body is not None]
        assert got.get(q, []) == sorted([s for s in scored if s[1] > 0], key=lambda s: (-s[1], s[0]))[:4]


def test_answers_of_a_crowded_document(spark, small):
    """One document is best for most questions; its keyword lists come in shares."""
    docs, asked = corpus(2)
    questions = spark.createDataFrame(asked, "q int, question string")
    table = spark.createDataFrame(docs, "filename string, text string")
    ranked = text.rank_documents(questions, table, 1)
    best = {r.q: r.filename for r in ranked.collect()}
    assert list(best.values()).count("f92") > 30
    said = dict(docs)
    for r in text.extract_answer(ranked, questions, table).collect():
        if r.q not in best:
            assert (r.answer, r.source) == (text.NO_ANSWER, text.NO_SOURCE)
            continue
        parts = [p.strip() for p in re.split(r"\n\s*\n", said[best[r.q]]) if p.strip()]
        scores = [sum(p.lower().count(w) for w in keywords(dict(asked)[r.q])) for p in parts]
        wanted = re.sub(r"\s+", " ", parts[scores.index(max(scores))]).strip()
        wanted = wanted if len(wanted) <= text.ANSWER_LIMIT else wanted[:text.ANSWER_LIMIT - 3].rstrip() + "..."
        assert (r.answer, r.source) == (wanted, best[r.q])


def test_answers_are_cut_before_the_lists_choose(spark):
    """A whole paragraph does not leave a task once per keyword list."""
    docs = spark.createDataFrame([("a", "one two"), ("b", "one\n\ntwo")], "filename string, text string")
    questions = spark.createDataFrame([(1, "two"), (2, "none"), (3, "one two")], "q int, question string")
    ranked = spark.createDataFrame([(1, 1, "b"), (3, 1, "a")], "q int, rank int, filename string")
    out = text.extract_answer(ranked, questions, docs)
    assert {r.q: (r.answer, r.source) for r in out.collect()} == {1: ("two", "b"), 2: (text.NO_ANSWER, text.NO_SOURCE), 3: ("one two", "a")}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan and "regexp_replace" not in plan[:plan.index("MapInArrow")]


def test_a_worker_keeps_the_scores_of_the_last_sets():
    names = ["aaa bbb", "ccc"]
    kept = text.kept_scores(names)
    assert text.kept_scores(names) is kept and text.kept_scores(["aaa bbb", "ccc"]) is not kept


def test_queries_with_the_same_hits_share_a_context(spark, monkeypatch):
    monkeypatch.setattr(text, "CONTEXT_QUERIES", 3)
    chunks = spark.createDataFrame([(i, f"f{i // 2}", i % 2, f"t{i}") for i in range(6)] + [(4, "g", 7, "t4")], "chunk_id int, filename string, chunk_index int, text string")
    lists = {q: [(1, q % 2), (2, 5)] for q in range(20)} | {30: [(1, 4)], 31: [(1, 9)], 32: [(1, 9), (2, 3), (2, 3)], 33: [(1, None), (2, 0)]}
    hits = spark.createDataFrame([(q, *hit) for q, each in lists.items() for hit in each], "q int, position int, chunk_id int")
    out = text.format_context(hits, chunks)
    told = lambda n, c: f"[Chunk {n} | Source: f{c // 2} | Chunk index: {c % 2}]\nt{c}"
    wanted = {q: "\n\n".join([told(1, q % 2), told(2, 5)]) for q in range(20)}
    wanted |= {30: "\n\n".join([told(1, 4), "[Chunk 1 | Source: g | Chunk index: 7]\nt4"]), 32: "\n\n".join([told(2, 3)] * 2), 33: told(2, 0)}
    rows = out.collect()
    assert len(rows) == len(wanted) and {r.q: r.context for r in rows} == wanted
    # Texts are gathered per list of hits, never per query.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    gathers = [line for line in plan.splitlines() if "Aggregate" in line and "[Chunk " in line]
    assert gathers and all("Aggregate [_list" in line for line in gathers)


def test_no_token_reaches_a_shuffle(spark):
    docs = spark.createDataFrame([("a", "one two")], "filename string, text string")
    plan = text.rank_documents(spark.createDataFrame([(1, "one")], "q int, question string"), docs, 3)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow"):]
    assert "Generate" not in plan and "Exchange" not in below


def test_automaton_counts_like_plain_search():
    machine = text.KeywordAutomaton(["aaa", "aa", "ab", "bab"])
    for said in ("aaaaaaa", "babab", "", "xaaab", "aabaabab"):
        assert machine.counts(said) == {i: said.count(w) for i, w in enumerate(["aaa", "aa", "ab", "bab"]) if said.count(w)}


def test_sets_of_common_words_share_one_pass(spark, monkeypatch):
    """Documents are counted once however many sets hold the same keywords, and only keywords that occur take room."""
    monkeypatch.setattr(text, "PASS_KEYWORDS", 40)
    monkeypatch.setattr(text, "BLOCK_SETS", 7)
    dice = random.Random(7)
    words = [f"{a}{b}{c}" for a in "abc" for b in "abc" for c in "abc"]
    docs = [(f"f{i:02d}", " ".join(dice.choice(words) for _ in range(30))) for i in range(150)]
    asked = [(i, " ".join(dice.sample(words, 6))) for i in range(80)]
    rows = spark.createDataFrame(docs, "filename string, text string").coalesce(2)
    out = text.rank_documents(spark.createDataFrame(asked, "q int, question string"), rows, 3)
    assert out._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 1
    want = set()
    for q, question in asked:
        scored = sorted((-sum(body.count(w) for w in keywords(question)), name) for name, body in docs)
        want |= {(q, i + 1, name, -s) for i, (s, name) in enumerate(scored[:3]) if s}
    assert {(r.q, r["rank"], r.filename, r.score) for r in out.collect()} == want
    scores = text.SetScores([f"k{i:04d}" for i in range(1000)])
    assert scores.counted(["k0001 k0007", "k0007"]).rows.tolist() == [[0, 0], [1, 0], [1, 1]]


def test_a_run_is_walked_once_and_counts_like_plain_search(monkeypatch):
    """Runs met before are not walked again, and what is kept stays bounded."""
    dice = random.Random(9)
    names = ["aaa", "aba", "bab", "abab", "aaaa", "cde", "x12", "bcd"]
    texts = [" ".join("".join(dice.choice(["a", "b", "ab", "cde", "x12", "-"]) for _ in range(dice.randint(1, 7))) for _ in range(60)) for _ in range(40)]

    def counted(machine, some):
        out = [dict.fromkeys(range(len(names)), 0) for _ in some]
        for place, number, times in zip(*machine.occurrences(some), strict=True):
            out[place][int(number)] += int(times)
        return out

    plain = [{i: t.count(w) for i, w in enumerate(names)} for t in texts]
    machine = text.KeywordAutomaton(names)
    assert counted(machine, texts) == plain
    machine.machine = None
    assert counted(machine, texts[::-1]) == plain[::-1]
    monkeypatch.setattr(text, "RUN_ROOM", 500)
    machine = text.KeywordAutomaton(names)
    assert [x for i in range(40) for x in counted(machine, texts[i:i + 1])] == plain
    assert len(machine.place) < 100
    spaced = text.KeywordAutomaton(["a b", "ab"])
    assert [a.tolist() for a in spaced.occurrences(["a b ab a b", ""])] == [[0, 0], [0, 1], [2, 1]]


def test_hits_travel_without_the_words_of_their_sets(spark):
    """Sets come back from the tasks as numbers; a pass per 16,777,216 words, so questions of 5 GB need two or three."""
    docs = spark.createDataFrame([("a", "one two")], "filename string, text string")
    out = text.rank_documents(spark.createDataFrame([(1, "one"), (2, None), (3, "")], "q int, question string"), docs, 3)
    assert [tuple(r) for r in out.collect()] == [(1, 1, "a", 1)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "#" in plan and "[key#" in plan[plan.index("MapInArrow"):]
    assert text.rank_documents(spark.createDataFrame([(1, "one")], "q int, question string"), docs, 0).collect() == []
