"""Suppression in regions and rounds, and merging in bands, against the plain walks."""

from __future__ import annotations

import random
import time

import pytest

from rosterforge.operators import curation, overlap


def frame(spark, rows):
    return spark.createDataFrame(rows, "image string, pos long, x long, y long, width long, height long, score double, source string")


def draw(n, span, largest, seed, image="hot"):
    dice = random.Random(seed)
    return [(image, i, dice.randrange(span), dice.randrange(span), dice.randrange(0, largest), dice.randrange(1, largest), dice.randrange(60) / 60, dice.choice(["a", "b", None])) for i in range(n)]


def walk(rows, metric):
    kept: dict = {}
    for image, pos, x, y, w, h, _, source in sorted(rows, key=lambda r: (-r[6], r[1])):
        for ox, oy, ow, oh, osource, _ in kept.setdefault(image, []):
            both = max(0, min(x + w, ox + ow) - max(x, ox)) * max(0, min(y + h, oy + oh) - max(y, oy))
            if metric == "iou" and (osource != source or both / max(1, w * h + ow * oh - both) <= curation.SUPPRESS_IOU):
                continue
            if metric == "ratio" and both / max(1, min(w * h, ow * oh)) <= curation.SUPPRESS_RATIO:
                continue
            break
        else:
            kept[image].append((x, y, w, h, source, pos))
    return {(image, b[5]) for image, bs in kept.items() for b in bs}


@pytest.mark.parametrize("metric", ["ratio", "iou"])
@pytest.mark.parametrize("region", [15, overlap.REGION_BOXES])
def test_regions_decide_like_the_walk(spark, metric, region):
    rows = draw(900, 500, 40, 1) + [r for k in range(8) for r in draw(30, 120, 50, 10 + k, f"i{k}")]
    rows += [("hot", 5000, -40, -30, 700, 700, 0.41, "a"), ("hot", 5001, 100, 0, 30, 900, 0.83, "b"), ("hot", 5002, 100, 0, 30, 900, 0.83, "b"), ("flat", 1, 0, 0, 0, 5, 1.0, "a"), ("flat", 2, 0, 0, 0, 5, 1.0, "a"),
             ("twins", 7, 0, 0, 9, 9, 0.5, "a"), ("twins", 7, 0, 0, 9, 9, 0.5, "b"), ("twins", 7, 50, 0, 9, 9, 0.5, "b")]
    out = curation.suppress_overlaps(frame(spark, rows), metric=metric, region_boxes=region)
    told = [(r.image, r.pos) for r in out.collect()]
    assert set(told) == walk(rows, metric)
    assert len(told) == len(set(told)) + (1 if metric == "ratio" else 2)


def test_copies_are_one_box(spark):
    rows = [("hot", i, 5, 5, 20, 20, (i % 7) / 7, "a") for i in range(4000)] + draw(50, 100, 30, 3)[10:]
    out = curation.suppress_overlaps(frame(spark, rows))
    assert {(r.image, r.pos) for r in out.collect()} == walk(rows, "ratio")


@pytest.mark.parametrize("metric", ["ratio", "iou"])
def test_small_images_are_dealt_out_once(spark, metric):
    """Images of one region are walked where their boxes meet; none is checkpointed or joined back, whatever large ones lie beside them."""
    rows = [r for k in range(40) for r in draw(25, 120, 50, 30 + k, f"i{k}")] + draw(400, 300, 40, 4)
    odd = [("i1", None, 0, 0, 500, 500, 2.0, "a"), (None, 3, 0, 0, 9, 9, 0.5, "a"), ("i2", 9000, None, 0, 9, 9, 0.5, "a"), ("i2", 9001, 0, None, 9, 9, 0.5, "a")]
    out = curation.suppress_overlaps(frame(spark, rows + odd), metric=metric, region_boxes=30)
    wanted = walk([r for r in rows if r[0] != "i1"], metric)
    assert {(r.image, r.pos) for r in out.collect() if r.image != "i1"} == wanted
    small = curation.suppress_overlaps(frame(spark, [r for r in rows if r[0] != "hot"]), metric=metric)
    plan = small._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan and "Aggregate" not in plan


def test_one_large_box_costs_little():
    """A box as large as the page lies on its own level; finding what touches a small box stays as cheap."""
    def spent(rows):
        grid, started = overlap.LevelGrid("ratio", 0.99), time.process_time()
        for _, _, x, y, w, h, _, source in rows:
            if grid.verdict(x, y, w, h, source) != overlap.DROPPED:
                grid.add(x, y, w, h, source, False)
        looked = sum(len(cells) for _, _, x, y, w, h, _, _ in rows for cells in grid.near(x, y, x + w, y + h))
        return time.process_time() - started, looked

    rows = draw(4000, 3000, 30, 5)
    (_, alone), (_, beside) = spent(rows), spent([("hot", -1, 0, 0, 3000, 3000, 1.0, "a"), *rows])
    assert beside - alone <= len(rows) + alone * 0.2


def merged(rows):
    """The plain walk: each box joins the first earlier one of its row that it overlaps in x."""
    out: dict = {}
    for image, x, y, w, h in sorted(rows, key=lambda r: (r[0], r[2], r[1], r[3], r[4])):
        acc = out.setdefault(image, [])
        for i, (ax, ay, aw, ah) in enumerate(acc):
            wide = max(0, min(ax + aw, x + w) - max(ax, x))
            if abs(ay + ah / 2 - y - h / 2) <= max(ah, h) * 0.65 and wide / max(1, min(aw, w)) >= 0.35:
                left, top = min(ax, x), min(ay, y)
                acc[i] = (left, top, max(ax + aw, x + w) - left, max(ay + ah, y + h) - top)
                break
        else:
            acc.append((x, y, w, h))
    return sorted((image, *b) for image, bs in out.items() for b in bs)


@pytest.mark.parametrize("step", [3, 12, 40])
def test_bands_merge_like_the_walk(spark, step):
    dice = random.Random(step)
    rows, y = [], -500
    for i in range(700):
        y += dice.choice([0, 0, 1, step, step * 4])
        rows.append(("a" if i % 3 else "b", dice.randrange(90), y, dice.randrange(0, 50), dice.choice([0, 1, 5, 20, 21, 60])))
    rows.append(("b", 0, rows[300][2], 90, 1500))
    boxes = spark.createDataFrame(rows, "image string, x long, y long, width long, height long")
    assert sorted(tuple(r) for r in curation.merge_boxes(boxes).collect()) == merged(rows)


def test_a_long_page_has_many_bands(spark):
    rows = [("page", i % 7 * 9, i // 7 * 60, 12, 20) for i in range(12_000)]
    boxes = spark.createDataFrame([(i, x, y, w, h) for i, x, y, w, h in rows], "image string, x long, y long, width long, height long")
    assert len({tuple(r) for r in curation.merge_boxes(boxes).collect()}) == len(merged(rows))
    bands = curation.merge_bands(boxes.selectExpr("image", "y - 4 AS lo", "y + height AS hi"), "image")
    assert bands.select("band").distinct().count() == 12_000 // 7 + 1


def test_runs_join_over_all_levels(spark, monkeypatch):
    """Runs that span many blocks of every level, negative indexes and gaps on edges."""
    monkeypatch.setattr(curation, "RUN_FAN", 4)
    dice = random.Random(4)
    rows, wanted = [], []
    for series in "ab":
        at = -300
        while at < 500:
            length = dice.choice([1, 2, 3, 9, 70])
            wanted.append((series, at, at + length - 1))
            rows += [(series, i, 1.0) for i in range(at, at + length)] + [(series, at + length, 0.0)]
            at += length + dice.randint(1, 4)
    out = curation.runs_above_threshold(spark.createDataFrame(rows, "series string, idx int, value double"), 0.5, block=2 ** 50)
    assert sorted(tuple(r) for r in out.collect()) == sorted(wanted)
    small = curation.runs_above_threshold(spark.createDataFrame(rows, "series string, idx int, value double"), 0.5, 3, block=8)
    assert sorted(tuple(r) for r in small.collect()) == sorted(r for r in wanted if r[2] - r[1] >= 2)
