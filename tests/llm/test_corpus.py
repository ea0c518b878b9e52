"""Corpus operators against SQL twins, brute force and odd inputs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rosterforge.llm import (
    decontaminate, embedding_pairs, html_text, line_dedup, mixing, ngram_join, sharding, token_edits, toxicity, warc,
)
from rosterforge.llm.queries import ORACLES, QUERIES
from rosterforge.llm.shared import connected_components
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, shard int, times long, h long, row string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, repeats, a very long text and columns named like the operators' own."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base, "s"), (2, base + " extra", "s"), (3, None, None), (4, "", "s"), (4, "", "s"), (None, base, "t"), (5, "one", None),
            (6, "x y\nx y\n\n", "t"), (7, "long " * 200_000, "t"), (8, base, "s"), (8, base, "s")]
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 9, 9, 9, "r") for i, t, s in rows], DOC)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, name):
    ok, note = compare(spark, connect(SF), name, QUERIES[name], ORACLES[name], SF)
    assert ok, note


def test_rows_law(spark):
    rows = sharding.op1(spark, SF).collect()
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(rows) == 200
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, sharding.op1(spark, SF).collect()), key=str)


def test_shards_of_odd_rows(spark, odd):
    out = sharding.shuffle_into_shards(odd, 3, bucket_bytes=100_000)
    assert out.count() == odd.count() and set(out.columns) == {*odd.columns, "slot"}
    assert sharding.shuffle_into_shards(odd.limit(0)).count() == 0


def test_targets_equal_repeated_resharing(spark):
    sizes = {f"s{i}": random.Random(i).randint(0, 50) ** 2 for i in range(11)} | {None: 40}
    told = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")).collect()}
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight, left, free, goal = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}, 1.5 * sum(sizes.values()), set(names), {}
    while over := [n for n in free if left * weight[n] / sum(weight[m] for m in free) > 2 * sizes[n]]:
        goal |= {n: 2 * sizes[n] for n in over}
        left -= sum(2 * sizes[n] for n in over)
        free -= set(over)
    goal |= {n: left * weight[n] / sum(weight[m] for m in free) for n in free}
    assert {n: pytest.approx(told[n]) for n in names} == goal


def test_mixing_odd_rows(spark, odd):
    out = mixing.times_taken(odd, mixing.mix_plan(odd))
    assert out.count() == odd.count() and out.where("__times NOT BETWEEN 0 AND 2").count() == 0
    assert mixing.mix_plan(odd.limit(0)).count() == 0


def test_decontamination_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20, 40))), (2, "one"), (3, None), (4, "")], "item_id long, text string")
    out = {(r.doc_id, r.row): r for r in decontaminate.contamination(odd, items).collect()}
    assert {k[0]: (r.n_hit, r["items"], r.contaminated) for k, r in out.items()}[1] == (20, ["1"], True)
    assert {k[0]: (r.n_words, r.n_hit) for k, r in out.items()}[5] == (1, 1)
    assert {k[0]: (r.n_words, r.n_hit) for k, r in out.items()}[3] == (0, 0)
    assert decontaminate.contamination(odd, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(odd.limit(0), items).count() == 0


def test_decontamination_judges_rows_without_key(spark, odd):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20, 40))), (2, "solo")], "item_id long, text string")
    out = [r for r in decontaminate.contamination(odd, items).collect() if r.doc_id is None]
    assert [(r.n_words, r.n_hit, r["items"], r.contaminated) for r in out] == [(60, 20, ["1"], True)]
    bare = spark.createDataFrame([(None, "solo"), (3, None)], "item_id long, text string")
    assert [(r.n_hit, r["items"], r.contaminated) for r in decontaminate.contamination(spark.createDataFrame([(1, "a solo b")], "doc_id long, text string"), bare).collect()] == [(1, [""], True)]
    more = spark.createDataFrame([(None, "solo"), (None, "clean text"), (7, "solo"), (7, "clean text")], "doc_id long, text string")
    got = decontaminate.contamination(more, items).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.contaminated) for r in got) == [("7", 1, 1, True), ("7", 2, 0, False), ("None", 1, 1, True), ("None", 2, 0, False)]
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").first().text
    docs = spark.createDataFrame([(None, benchmark, "en", "s", 1), (None, "clean text", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.text for r in corpus_pipeline.drop_contaminated(spark, docs, SF).collect()] == ["clean text"]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta"), (2, "alpha x x x x x beta")], "doc_id long, text string")
    terms = spark.createDataFrame([("p", "alpha"), ("p", "beta")], "phrase string, word string").select("phrase", F.xxhash64("word").alias("term"))
    index = decontaminate.positional_index(docs, terms.select("term").distinct())
    assert [r.key for r in decontaminate.proximity_matches(index, terms, 3).collect()] == [1]


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    texts, base = [], [f"v{rng.randint(0, 900)}" for _ in range(120)]
    for i in range(60):
        words = list(base) if i % 3 else [f"v{rng.randint(0, 900)}" for _ in range(rng.choice([0, 1, 3, 30, 150]))]
        for _ in range(rng.choice([0, 1, 2, 4])):
            if words:
                words[rng.randrange(len(words))] = "edit" + str(rng.randint(0, 5))
        texts.append(" ".join(words))
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for t in texts]
    group = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and len(a & b) * 100 >= len(a | b) * 80:
                    group[i] = group[j] = min(group[i], group[j])
    got = ngram_join.near_duplicate_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), g) for i, (s, g) in enumerate(zip(sets, group, strict=True))}


def test_near_duplicates_odd_rows(spark, odd):
    out = ngram_join.near_duplicate_groups(odd).collect()
    assert len(out) == odd.count() and {r.component_id for r in out if r.doc_id in (1, 2, 8)} == {1}
    assert {r.component_id for r in out if r.doc_id in (3, 4)} == {3, 4} and [r.component_id for r in out if r.doc_id is None] == [None]
    assert ngram_join.near_duplicate_groups(odd.limit(0)).count() == 0


def test_unrelated_long_sets_of_a_cluster_are_not_compared(monkeypatch):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**63, 5000 + 20 * i).astype(np.uint64)) for i in range(40)]
    sets.append(np.unique(np.concatenate([sets[7][:-100], rng.integers(0, 2**63, 100).astype(np.uint64)])))
    table = pa.table({
        "cluster": [1] * 41, "i": [0] * 41, "j": [0] * 41, "side": [0] * 41, "id": list(range(41)), "n": [len(s) for s in sets],
        "bits": [ngram_join.parity_bits(s) for s in sets], "tokens": [s.view(np.int64) for s in sets]})
    calls, intersect = [], np.intersect1d
    monkeypatch.setattr(np, "intersect1d", lambda *a, **k: calls.append(1) or intersect(*a, **k))
    out = pa.Table.from_batches(list(ngram_join._forest(80, "cluster", True)(iter(table.combine_chunks().to_batches()))))
    assert out.to_pydict() == {"a": [7], "b": [40]}
    assert len(calls) == 1


def test_small_cells_are_judged_side_by_side(monkeypatch):
    rng = np.random.default_rng(7)
    rows, near = [], ngram_join._near_pairs
    for cell in range(300):
        sets = [rng.integers(0, 2**63, 60).astype(np.uint64) for _ in range(2 + cell % 9)]
        if cell % 50 == 0:
            sets.append(np.concatenate([sets[0][:-1], sets[1][:1]]))
        rows += [(cell, 0, 0, 0, 100 * cell + i, len(s), ngram_join.parity_bits(s)) for i, s in enumerate(sets)]
    table = pa.table([pa.array([r[c] for r in rows]) for c in range(7)], ["k", "i", "j", "side", "id", "n", "bits"])
    calls = []
    monkeypatch.setattr(ngram_join, "_near_pairs", lambda *a: calls.append(1) or near(*a))
    out = pa.Table.from_batches(list(ngram_join._forest(80, "k", False)(iter(table.to_batches(max_chunksize=101)))))
    met = [(100 * c, 100 * c + 2 + c % 9) for c in range(0, 300, 50)]
    assert sorted(zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True)) == met
    assert len(calls) < 110


def test_wide_sketches_bound_the_difference():
    rng = np.random.default_rng(6)
    for n, m, changed in ((3000, 3000, 40), (5000, 1500, 300), (200, 190, 1), (70_000, 80_000, 900)):
        base = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        other = np.unique(np.concatenate([base[changed:min(n, m)], rng.integers(0, 2**63, changed + max(0, m - n)).astype(np.uint64)]))
        apart = len(np.setxor1d(base, other))
        sizes = np.array([len(base), len(other)])
        for percent in (50, 80, 90, 99):
            if apart * (100 + percent) <= int(sizes.sum()) * (100 - percent):
                assert ngram_join._still_near(np.array([[0], [1]]), sizes, [base, other], percent).shape[1] == 1


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(1)
    for n in (5, 300, 4000):
        a = np.unique(rng.integers(0, 2**62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 10:], rng.integers(0, 2**62, n // 20 + 1).astype(np.uint64)]))
        apart = int(np.bitwise_count((ngram_join.parity_bits(a) ^ ngram_join.parity_bits(b)).view(np.uint64)).sum())
        assert apart <= len(np.setxor1d(a, b))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors_odd_rows_and_crowds(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.standard_normal(16)
    rows = [(i, (base + 0.05 * rng.standard_normal(16)).tolist(), 1) for i in range(40)]
    rows += [(100, base.tolist(), None), (101, None, 1), (102, [0.0] * 16, 1), (103, [float("nan")] * 16, 1), (104, [], 1), (None, base.tolist(), 1), (105, [1.0, 2.0], 1), (106, [1.0, 2.0], 1)]
    monkeypatch.setattr(embedding_pairs, "BLOCK_ROWS", 8)
    got = {r.vec_id: r for r in embedding_pairs.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit = np.array([r[1] for r in rows[:40]])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert [got[i].n_links for i in range(40)] == ((unit @ unit.T >= 0.93).sum(axis=1) - 1).tolist()
    assert all(got[i].n_links == 0 and got[i].kept for i in (100, 101, 102, 103, 104)) and got[106].component_id == 105 and len(got) == 48


def test_page_blocks():
    page = ("<title>t</title><header>Top</header><nav>a b</nav><div class='cookie-notice'>We use</div><article><h1>T &amp; x</h1><p><b>One<br>two<p class=ad>AD<p>Three <i>fo</i>ur&nbsp;x"
            "<ul><li>k1<li>k2</ul><div class=comments><p>no</div><script>var t='</p>';</script></article><aside>s</aside><form>f</form>")
    assert html_text.assembled(html_text.page_blocks(page), set()) == "T & x One two Three four x k1 k2"
    assert html_text.assembled(html_text.page_blocks(None), set()) == "" and html_text.page_blocks("<" * 5000) and html_text.page_blocks("<p a='" * 500)


def test_class_words_are_read_whole():
    pages = {"<main class='has-sidebar'>Main text</main>": "Main text", "<div class='no-sidebar'><article>Art</article></div>": "Art",
             "<div class='menu-closed'><article>Art</article></div>": "Art", "<article class='post comment-status-open'>Art <p class='share-price'>up</p></article>": "Art up",
             "<article>Art<div class='share-buttons'>x</div><div class=site-footer-inner>y</div><article class=comment>z</article><p id=ad-300x250>q</p><div class='sidebar left'>r</div></article>": "Art",
             "<article>Art<nav class=has-menu>x</nav><ul class='post-comments'><li>y</ul><div class='main-nav'>z</div></article>": "Art"}
    assert {p: html_text.assembled(html_text.page_blocks(p), set()) for p in pages} == pages


def test_repeated_runs_go_and_articles_stay(spark):
    legal = "all rights reserved by the owner of this site since long ago"
    rows = [(i, f"http://h.example/{i}", f"<body><div>own story number {i} of a page about things</div><div>{legal}</div></body>") for i in range(3)]
    rows += [(9, "http://g.example/", f"<body><article><p>{legal}</p></article></body>"), (10, None, None), (11, "http://h.example/x", "")]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert legal not in got[0] and got[0].startswith("own story number 0") and got[9] == legal and got[10] == got[11] == ""
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_articles_stay_when_other_pages_advertise_them(spark):
    head, first = "Council of the old town votes on the new harbour bridge", "The mayor said on Monday that work would begin at once"
    rows = [(1, "http://h.example/1", f"<body><nav>a</nav><article><h1>{head}</h1><p>{first}</p><p>More</p></article></body>"),
            (2, "http://h.example/2", f"<body><main><h1>{head}</h1><article><p>{first}</p></article></main></body>")]
    rows += [(i, f"http://h.example/{i}", f"<body><div class=ad>{head}</div><footer>{first}</footer><article><p>Other {i}</p></article></body>") for i in (3, 4, 5)]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: f"{head} {first} More", 2: f"{head} {first}", 3: "Other 3", 4: "Other 4", 5: "Other 5"}


def test_open_pages_lose_template_blocks_and_keep_shared_passages(spark):
    legal = "all rights reserved by the owner of this site since long ago " * 8
    quote = "the minister told reporters that nobody had seen the letter before last week"
    story = " ".join(f"edit{i}" for i in range(60))
    own = {i: [f"Short note number {i} on weather"] for i in range(8)} | {i: [f"Lead {i}", quote] for i in (8, 9)} | {i: [f"{story} v{i}"] for i in (10, 11)}
    rows = [(i, f"http://h.example/{i}", "<body>" + "".join(f"<div>{t}</div>" for t in [*texts, legal]) + "</body>") for i, texts in own.items()]
    rows += [(i, "http://c.example/", f"<body><div>{story}</div></body>") for i in (20, 21, 22, 23)]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: " ".join(t) for i, t in own.items()} | {i: story for i in (20, 21, 22, 23)}


def test_archives_round_trip(spark):
    rows = [(1, "u", "x"), (2, None, "x"), (3, "u\n", None), (4, "u", ""), (5, "é", "x\r\n\r\n" * 300_000)]
    got = {r.page_id: r for r in warc.read_records(warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    assert {k: (r.record_type, r.refers_to, r.payload_bytes) for k, r in got.items()} == {
        1: ("response", None, 1), 2: ("revisit", 1, 1), 3: ("response", None, 0), 4: ("revisit", 3, 0), 5: ("response", None, 1_500_000)}
    assert got[5].payload_digest == warc.digest_of(rows[4][2].encode())
    assert warc.read_records(warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_archives_of_pages_without_number(spark):
    rows = [(2, "u", "x"), (None, "v", "x"), (None, None, "x"), (None, "w", "y"), (None, "w", "y"), (None, None, None), (3, "z", "")]
    got = warc.read_records(warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert sorted(((r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes) for r in got), key=str) == sorted([
        (2, "u", "response", None, 1), (None, "v", "revisit", 2, 1), (None, "", "revisit", 2, 1), (None, "w", "response", None, 1),
        (None, "w", "response", None, 1), (None, "", "revisit", 3, 0), (3, "z", "response", None, 0)], key=str)


def test_lines_in_crowded_blocks_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"v{i}" for i in range(40)]
    seeds = [rng.sample(words, 12) for _ in range(4)] + [[f"long{k}_{i}" for i in range(700)] for k in range(2)]
    lines = []
    for _ in range(160):
        line = list(rng.choice(seeds))
        for _ in range(rng.choice([0, 1, 2, len(line) // 9, len(line) // 8])):
            line[rng.randrange(len(line))] = rng.choice(words)
        lines.append(" ".join(line))
    docs = [(d, "\n".join(lines[d * 4:d * 4 + 4])) for d in range(40)]
    sets = [set(x.split()) for x in lines]
    gone = [any(10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) for i in range(j)) for j in range(160)]
    monkeypatch.setattr(line_dedup, "BLOCK_ROWS", 6)
    monkeypatch.setattr(line_dedup, "PAIRS", 50)
    monkeypatch.setattr(line_dedup, "TOKENS", 3000)
    out = line_dedup.repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, k) for r in out for k in r.removed} == {(j // 4, j % 4) for j in range(160) if gone[j]}


def test_lines_odd_rows(spark, odd):
    out = line_dedup.repeated_lines(odd)
    got = {r.doc_id: (r.n_lines, r.removed) for r in out.collect()}
    assert got[6] == (4, [1]) and got[3] == (0, []) and got[2] == (1, [0]) and got[1] == (1, [])
    assert [r.text for r in line_dedup.without_lines(odd, out).where("doc_id = 6").collect()] == ["x y\n\n"]
    assert line_dedup.repeated_lines(odd.limit(0)).count() == 0


def test_lines_of_rows_that_share_a_key(spark):
    first = "one two three four five"
    rows = [(1, first), (None, f"{first}\nalpha beta gamma"), (None, "delta epsilon zeta"), (2, f"eta theta\n{first}"), (2, "iota kappa\nlambda mu"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = line_dedup.repeated_lines(docs)
    assert sorted((str(r.doc_id), r.n_lines, r.removed) for r in out.collect()) == [("1", 1, []), ("2", 2, []), ("2", 2, [1]), ("3", 0, []), ("None", 1, []), ("None", 2, [0])]
    left = {(r.doc_id, r.text) for r in line_dedup.without_lines(docs, out).collect()}
    assert left == {(1, first), (None, "alpha beta gamma"), (None, "delta epsilon zeta"), (2, "eta theta"), (2, "iota kappa\nlambda mu"), (3, None)}


def test_edited_counts_equal_new_counts():
    counter, rng = token_edits.TokenCounter(token_edits.TOKENIZERS), random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "'s", "'", "1", "23", "é", "!", "-", "\t", "x y", " 's"]
    for _ in range(400):
        tree = token_edits.SegmentTree("".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 5, 40, 900]))), counter)
        for _ in range(3):
            a = rng.randint(0, len(tree.text))
            tree.edit(a, min(len(tree.text), a + rng.choice([0, 1, 3, 30])), "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 5]))))
            assert tree.total == len(counter.encoding.encode_ordinary(tree.text)) and tree.chars[1] == len(tree.text)


def test_edited_counts_of_documents(spark, odd):
    counter = token_edits.TokenCounter(token_edits.TOKENIZERS)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in token_edits.op8(spark, SF).collect():
        after = token_edits.PERSONAL.sub(token_edits.REDACTION, texts[r.doc_id])
        assert (r.n_tokens, r.n_tokens_after, r.n_chars_after) == (len(counter.encoding.encode_ordinary(texts[r.doc_id])), len(counter.encoding.encode_ordinary(after)), len(after))
    assert token_edits.counts_after_edits(odd).count() == odd.count()


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op10(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.9 and n[1, 1] / (n[1, 1] + n.get((0, 1), 0)) > 0.8


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(odd, labels)
    assert odd.select(toxicity.toxicity_score(model, F.col("text")).alias("s")).where("s BETWEEN 0 AND 1").count() == odd.count()


def test_folds_follow_crc(spark):
    got = toxicity.op10(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_pipeline_stages(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "sharding":
            assert out.columns == docs.columns
        else:
            assert out.count() == docs.count()
        docs = out
    assert corpus_pipeline.STAGES[1][1](spark, odd.limit(0), SF).count() == 0
    kept = corpus_pipeline.drop_near_duplicates(spark, odd, SF)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "4", "5", "6", "7"]


def test_near_duplicate_stage_keeps_every_text_once(spark):
    """Ids under several texts, texts under several ids or none, repeated rows: one row a group stays, no group is lost."""
    dice = random.Random(3)
    words = [[f"{t}{i}" for i in range(40)] for t in "abcdefgh"]
    rows = []
    for _ in range(90):
        w = list(dice.choice(words))
        if dice.random() < 0.4:
            w[dice.randrange(40)] = f"x{dice.randrange(3)}"
        rows.append((dice.choice([None, *range(12)]), " ".join(w[:dice.choice([40, 40, 39, 20])]), dice.choice("st")))
    rows += rows[:20] + [(2, "A " * 9, "s"), (2, "B b", "s"), (4, "A " * 9, "s"), (5, "C c", "s"), (1, "B b", "s"), (5, "B b", "s"), (6, None, "s"), (6, "", "s"), (6, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sets = {}
    for _, t, _ in rows:
        w = (t or "").lower().split()
        sets[t] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    texts = [t for t in sets if sets[t]]
    of = {t: t for t in texts}

    def root(t):
        while of[t] != t:
            t = of[t]
        return t
    for a in texts:
        for b in texts:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                of[root(a)] = root(b)
    kept = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    assert Counter(t for _, t, _ in kept if not sets[t]) == Counter(t for _, t, _ in rows if not sets[t])
    groups = Counter(root(t) for _, t, _ in kept if sets[t])
    assert groups == Counter({root(t) for t in texts})
    least = {}
    for k, t, _ in rows:
        if sets[t]:
            least[root(t)] = min(least.get(root(t), (True, 0)), (k is None, k or 0))
    assert all((k is None, k or 0) == least[root(t)] for k, t, _ in kept if sets[t])


def test_words_are_those_of_the_contract():
    text = "A b\x1cc\td\ne É"
    assert [w.decode() for w in ngram_join.space_words(text)] == re.findall(r"[^\x20\x09-\x0D]+", text.replace("A", "a"))
