"""Greedy overlap suppression on a grid of levels, in regions.

An image is cut into square regions, as many as its number of boxes asks for, of a side at least eight
times that of its usual box. A region's boxes stream by rank past an index of those kept so far: a grid
per power of two, in which a box lies on the level of its own size, so that large and small boxes meet
in few cells. Images of one region are dealt out and walked as a whole. In others a box that lies in several regions is decided by all of them; boxes that depend on an
undecided one wait for the next round. One region is decided in one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterforge.session import durable_checkpoint

REGION_BOXES = 4096
CLEAR, WAITING, DROPPED = 0, 1, 2


class LevelGrid:
    """Boxes by the power of two that holds their longer side, in the cells of that size."""

    def __init__(self, metric: str, threshold: float):
        self.by_source = metric == "iou"
        self.threshold = threshold
        self.levels: dict[int, dict[tuple[int, int], list[tuple]]] = {}

    def add(self, x: int, y: int, width: int, height: int, source: str | None, waiting: bool) -> None:
        if width <= 0 or height <= 0:
            return
        level = (max(width, height) - 1).bit_length()
        cells = self.levels.setdefault(level, {})
        entry = (x, y, x + width, y + height, width * height, source, waiting)
        for cx in range(x >> level, (x + width - 1 >> level) + 1):
            for cy in range(y >> level, (y + height - 1 >> level) + 1):
                cells.setdefault((cx, cy), []).append(entry)

    def near(self, x: int, y: int, right: int, bottom: int) -> Iterator[list[tuple]]:
        for level, cells in self.levels.items():
            across, down = range(x >> level, (right - 1 >> level) + 1), range(y >> level, (bottom - 1 >> level) + 1)
            if len(across) * len(down) > len(cells):
                yield from cells.values()
            else:
                for cx in across:
                    for cy in down:
                        if (cx, cy) in cells:
                            yield cells[cx, cy]

    def verdict(self, x: int, y: int, width: int, height: int, source: str | None) -> int:
        """Whether a kept box clashes, or else one that waits."""
        if width <= 0 or height <= 0:
            return CLEAR
        right, bottom, area, found = x + width, y + height, width * height, CLEAR
        for entries in self.near(x, y, right, bottom):
            for left, top, end, low, other, origin, waiting in entries:
                wide, tall = min(right, end) - max(x, left), min(bottom, low) - max(y, top)
                if wide <= 0 or tall <= 0 or (self.by_source and origin != source):
                    continue
                both = wide * tall
                if both / max(1, area + other - both if self.by_source else min(area, other)) > self.threshold:
                    if not waiting:
                        return DROPPED
                    found = WAITING
        return found


def _decided(rows: DataFrame, group: str, metric: str, threshold: float) -> DataFrame:
    """(group, pos, twin, verdict) of every undecided box in every region it lies in."""
    fields = ["x", "y", "width", "height", "source", "several", "kept", "pos", "twin"]
    ordered = rows.repartition(group, "rx", "ry").sortWithinPartitions(group, "rx", "ry", "order", "pos", "twin").select(group, "rx", "ry", *fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, grid = None, None
        for batch in batches:
            at, verdicts = [], []
            places = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            boxes = zip(*(batch.column(3 + i).to_pylist() for i in range(7)), strict=True)
            for row, (place, (x, y, width, height, source, several, kept)) in enumerate(zip(places, boxes, strict=True)):
                if place != now:
                    now, grid = place, LevelGrid(metric, threshold)
                if kept:
                    grid.add(x, y, width, height, source, False)
                    continue
                found = grid.verdict(x, y, width, height, source)
                at.append(row)
                verdicts.append(found)
                if found != DROPPED:
                    grid.add(x, y, width, height, source, several or found == WAITING)
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(taken) for i in (0, 10, 11)), pa.array(verdicts, pa.int32())], [group, "pos", "twin", "verdict"])

    kinds = rows.select(group, "pos", "twin").schema.add("verdict", "integer")
    return ordered.mapInArrow(run, kinds).groupBy(group, "pos", "twin").agg(F.max("verdict").alias("verdict"))


def walked_boxes(rows: DataFrame, group: str, metric: str, threshold: float) -> DataFrame:
    """The boxes kept in images small enough for one task each: dealt out once, walked, and written as they leave.

    Of exact copies the first counts; boxes without area are copies only under one ``pos``. Boxes without a place are
    left out, and those without ``pos`` drop others but are not given back.
    """
    fields = ["x", "y", "width", "height", "source", "pos"]
    twin = F.xxhash64("x", "y", "width", "height", "source")
    placed = rows.where(F.col(group).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())
    ordered = placed.repartition(group).sortWithinPartitions(group, -F.col("score"), "pos", twin).select(group, *fields, *[c for c in rows.columns if c not in (group, *fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, grid, seen = None, None, set()
        for batch in batches:
            kept = []
            for row, (image, *box, pos) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True)):
                if image != now:
                    now, grid, seen = image, LevelGrid(metric, threshold), set()
                mark = (*box, pos if (box[2] or 0) < 0 or (box[3] or 0) < 0 or 0 in (box[2], box[3]) else None)
                if mark in seen:
                    continue
                seen.add(mark)
                if grid.verdict(*box) == CLEAR:
                    grid.add(*box, False)
                    if pos is not None:
                        kept.append(row)
            yield batch.take(pa.array(kept, pa.int64()))

    return ordered.mapInArrow(run, ordered.schema).select(*rows.columns)


def kept_boxes(rows: DataFrame, group: str, metric: str, threshold: float, region_boxes: int = REGION_BOXES) -> DataFrame:
    """The boxes that a walk by falling score, then ``pos``, keeps: no kept one before them clashes.

    ``rows``: ``group, x, y, width, height, score, source, pos`` with whole pixels. Different boxes under one
    ``pos`` are told apart by what they cover.
    """
    rows = rows.withColumn("twin", F.xxhash64("x", "y", "width", "height", "source"))
    right, bottom = F.col("x") + F.greatest("width", F.lit(1)), F.col("y") + F.greatest("height", F.lit(1))
    sides = rows.groupBy(group).agg(
        F.avg(F.greatest("width", "height")).alias("usual"),
        F.sqrt((F.max(right) - F.min("x")) * (F.max(bottom) - F.min("y")).cast("double") * region_boxes / F.count("*")).alias("fair"))
    side = sides.select(F.col(group), F.greatest(F.lit(1.0), 8 * F.col("usual"), F.col("fair")).alias("side"))
    cell = lambda v: F.floor(v / F.col("side"))
    placed = rows.join(side, group).withColumn("order", -F.col("score"))
    x0, x1, y0, y1 = cell(F.col("x")), cell(right - 1), cell(F.col("y")), cell(bottom - 1)
    placed = placed.withColumn("several", (x0 != x1) | (y0 != y1)).withColumn("rx", F.explode(F.sequence(x0, x1))).withColumn("ry", F.explode(F.sequence(y0, y1))).drop("side")
    placed = durable_checkpoint(placed)
    key, region = [group, "pos", "twin"], [group, "rx", "ry"]
    open_ = placed.withColumn("kept", F.lit(False))
    kept = None
    while True:
        verdicts = durable_checkpoint(_decided(open_, group, metric, threshold))
        free = verdicts.where(F.col("verdict") == CLEAR).select(*key)
        kept = free if kept is None else kept.unionByName(free)
        waiting = verdicts.where(F.col("verdict") == WAITING).select(*key)
        if waiting.isEmpty():
            return rows.join(kept, key, "left_semi").drop("twin")
        still = placed.join(waiting, key, "left_semi")
        around = placed.join(kept, key, "left_semi").join(still.select(*region).distinct(), region, "left_semi")
        open_ = still.withColumn("kept", F.lit(False)).unionByName(around.withColumn("kept", F.lit(True)))
