"""Pivot cells: exact search and density clusters against brute force, pruning, odd vectors, crowded cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rosterforge.operators import blocks, cells, clusters, vectors


def clustered(rng, n, groups=20, dims=8):
    centres = rng.normal(0, 40, (groups, dims))
    return np.round(centres[rng.integers(0, groups, n)] + rng.normal(0, 0.5, (n, dims)), 3)


def frame(spark, rows, id_col="id", kind="long"):
    return spark.createDataFrame([(i if kind == "long" else f"k{i:04d}", v if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(rows)], f"{id_col} {kind}, vector array<double>")


@pytest.mark.parametrize("resident", [50, 65_536])
def test_topk_with_bounds(spark, resident):
    rng = np.random.default_rng(5)
    base = np.round(clustered(rng, 700) * 8) / 8
    base[::4] = base[1]
    queries = np.round(clustered(rng, 60) * 8) / 8
    hits = blocks.blocked_topk(frame(spark, queries, "q"), frame(spark, base), 6, "q", "vector", "id", "vector", resident_rows=resident)
    got: dict = {}
    for r in hits.orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append(r.id)
    for i, v in enumerate(queries):
        scores = base @ v
        assert got[i] == sorted(range(len(base)), key=lambda j: (-scores[j], j))[:6]


def test_scores_are_held_in_small_blocks(spark, monkeypatch):
    """One cell holds most rows; queries meet it in parts, and batches meet the pivots in parts."""
    monkeypatch.setattr(blocks, "BLOCK_SCORES", 64)
    monkeypatch.setattr(blocks, "STREAM_ROWS", 8)
    monkeypatch.setattr(cells, "STREAM_ROWS", 8)
    sizes = []
    monkeypatch.setattr(blocks, "local_topk", lambda scores, k: sizes.append(scores.size) or cells.local_topk(scores, k))
    monkeypatch.setattr(blocks, "stream_past", lambda rows, keys, kinds, start: past(spark, rows, kinds, start))
    rng = np.random.default_rng(10)
    base = np.round(clustered(rng, 300, 2) * 8) / 8
    base[::3] = base[1]

    def past(spark, rows, kinds, start):
        groups: dict = {}
        for r in sorted(rows.toArrow().to_pylist(), key=lambda r: r["kind"]):
            groups.setdefault((r["pool"], r["bin"], r["slice"]), ([], []))[r["kind"]].append(r)
        schema = rows.toArrow().schema
        out = [start(pa.Table.from_pylist(g[0], schema))(pa.Table.from_pylist(g[1], schema)) for g in groups.values() if g[0] and g[1]]
        return spark.createDataFrame(pa.Table.from_batches(out))

    hits = blocks.blocked_topk(frame(spark, base[:40], "q"), frame(spark, base), 5, "q", "vector", "id", "vector")
    got: dict = {}
    for r in hits.orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append(r.id)
    assert all(got[i] == sorted(range(300), key=lambda j: (-(base @ base[i])[j], j))[:5] for i in range(40))
    assert sizes and max(sizes) <= 64

    batch = pa.RecordBatch.from_pylist([{"i": i} for i in range(20)])
    assert [part.num_rows for part in cells.stream_parts(iter([batch, batch.slice(0, 0)]))] == [8, 8, 4]


def test_odd_vectors_are_no_candidates(spark):
    rows = [[1.0, 0.0], None, [2.0, None], [float("nan"), 1.0], [5.0, 5.0, 5.0], [], [float("inf"), 0.0], [0.5, 0.5]]
    hits = vectors.knn_topk(frame(spark, rows, "q"), frame(spark, rows), 9)
    assert sorted((r.q, r.rank, r.id) for r in hits.collect()) == [(0, 1, 0), (0, 2, 7), (7, 1, 0), (7, 2, 7)]
    assert vectors.knn_topk(frame(spark, rows, "q"), frame(spark, rows).limit(0), 2).count() == 0
    assert vectors.knn_topk(frame(spark, rows, "q").limit(0), frame(spark, rows), 2).count() == 0
    out = {r.id: (r.cluster, r.is_core) for r in clusters.density_clusters(frame(spark, rows), 2.0, 1).collect()}
    assert out == {0: (0, True), 7: (0, True), **{i: (-1, False) for i in range(1, 7)}}


def test_base_copies_do_not_depend_on_the_queries(spark):
    rng = np.random.default_rng(6)
    base = frame(spark, clustered(rng, 400))

    def copies(n):
        plan = blocks.blocked_topk(frame(spark, clustered(rng, n), "q"), base, 3, "q", "vector", "id", "vector")._jdf.queryExecution().optimizedPlan().toString()
        return plan[plan.index("explode("):].split(")")[0].replace("explode(", "")
    assert copies(5) == copies(300)


def test_bounds_leave_most_bins_unvisited(spark):
    """On clustered rows a query meets few of the bins."""
    rng = np.random.default_rng(7)
    points = clustered(rng, 1200, 30)
    base = frame(spark, points)
    found = cells.pivot_cells(base, "id", "vector", 8, 1200)
    first, spread = blocks.packed_bins(found, 60)
    near = points @ found.pivots.T
    reach = np.sort(near, axis=1)[:, -5]
    alive = near + np.sqrt((points ** 2).sum(1))[:, None] * found.radius[None] >= reach[:, None]
    bins = np.array([len({b for c in np.flatnonzero(a) for b in range(first[c], first[c] + spread[c])}) for a in alive])
    assert bins.mean() < 0.35 * (first + spread).max()


def brute(points, eps, m):
    near = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= m
    label = np.where(core, np.arange(len(points)), len(points))
    while True:
        new = np.where(core, np.where(near & core[None], label[None], len(points)).min(1), len(points))
        if (new == label).all():
            break
        label = new
    border = np.where(near & core[None], label[None], len(points)).min(1)
    return np.where(core, label, np.where(border < len(points), border, -1)), core


@pytest.mark.parametrize("kind", ["long", "string"])
def test_density_of_crowded_cells(spark, monkeypatch, kind):
    """A third of the points are copies of one; home blocks are tiny, so a cell is spread over many tasks."""
    monkeypatch.setattr(clusters, "HOME_ROWS", 16)
    rng = np.random.default_rng(8)
    points = np.concatenate([clustered(rng, 160, 6, 3), rng.uniform(-90, 90, (40, 3))])
    points = np.round(points[rng.permutation(len(points))], 2)
    points[::3] = points[1]
    label, core = brute(points, 0.9, 4)
    name = (lambda i: int(i)) if kind == "long" else (lambda i: f"k{i:04d}" if i >= 0 else "-1")
    out = {r.id: (r.cluster, r.is_core) for r in clusters.density_clusters(frame(spark, points, kind=kind), 0.9, 4).collect()}
    assert out == {name(i): (name(label[i]), bool(core[i])) for i in range(len(points))}


def test_few_pairs_meet_on_clustered_points(spark):
    rng = np.random.default_rng(9)
    n = 1500
    points = frame(spark, clustered(rng, n, 40))
    found = cells.pivot_cells(points, "id", "vector", 8, n)
    sizes = clusters.near_cells(points, found, 1.0).groupBy("cell").agg(F.count_if("home").alias("h"), F.count("*").alias("all")).collect()
    assert sum(r.h for r in sizes) == n
    assert sum(r.h * r["all"] for r in sizes) < 0.1 * n * n


def test_density_writes_points_once(spark, monkeypatch, tmp_path):
    """Where every chunk meets every other, vectors are dealt out once and not copied to each other's tasks; repeated ids are one point."""
    monkeypatch.setattr(clusters, "HOME_ROWS", 32)
    monkeypatch.setattr(clusters, "MET_ROWS", 7)
    rng = np.random.default_rng(10)
    points = np.concatenate([np.round(rng.normal(0, 1, (300, 3)), 2), [[50, 0, 0]] * 5, [[90, 0, 0]] * 5])
    rows = [(i, p) for i, p in enumerate(points.tolist())] + [(302, points[309].tolist()), (None, [70.0, 0.0, 0.0]), (400, None)]
    table = spark.createDataFrame(rows, "id long, vector array<double>")
    written, keep = [], clusters.Chunks.keep
    monkeypatch.setattr(clusters.Chunks, "keep", lambda self, name, rows: written.append((name, rows.columns, rows.count())) or keep(self, name, rows))
    out = clusters.density_clusters(table, 0.4, 4)
    got = {(r.id, r.cluster, r.is_core) for r in out.collect()}
    label, core = brute(points, 0.4, 4)
    wanted = {(i, 300 if i >= 300 else int(label[i]), bool(core[i])) for i in range(310)} | {(None, -1, False), (400, -1, False)}
    assert got == wanted
    assert [(n, r) for n, c, r in written if "vector" in c] == [("points", 312)]
