"""Members of large JSON files cut in byte ranges, against the json module."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterforge.sources import readers
from rosterforge.sources.json_ranges import json_members


def _value(r, depth=0):
    odd = ['a"b', "\\", 'x\\"', "{[", "]},", "é,ü", "", '"records":[', "\\\\"]
    kind = r.randrange(6 if depth < 3 else 3)
    if kind == 0:
        return r.randrange(1000)
    if kind in (1, 2):
        return r.choice(odd) * r.randrange(4)
    if kind == 3:
        return [_value(r, depth + 1) for _ in range(r.randrange(4))]
    return {r.choice(["a", "records", 'k"', "z,"]): _value(r, depth + 1) for _ in range(r.randrange(4))}


def _shapes(r):
    items = [{"n": i, "v": _value(r)} for i in range(r.randrange(12))]
    return [items, {f"k{i}": v for i, v in enumerate(items)}, {"meta": [1, {"records": [2, 3]}, 4], "records": items, "end": [[5], 6]},
            {"pokemon": None, "records": items}, {"pokemon": 3, "records": items}, {"a": {"records": items}}, [], {}]


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 20])
def test_members_equal_the_parsed_file(spark, tmp_path, piece):
    r, want = random.Random(piece), {}
    for n, shape in enumerate(s for _ in range(3) for s in _shapes(r)):
        (tmp_path / f"f{n}.json").write_text(json.dumps(shape, indent=r.choice([None, 1]), ensure_ascii=r.random() < 0.5), encoding="utf-8")
        listed = isinstance(shape, list)
        if not listed and shape.get("pokemon") is None and isinstance(shape.get("records"), list):
            listed, shape = True, shape["records"]
        want[f"f{n}.json"] = (listed, shape)
    got = {}
    for m in json_members(spark, str(tmp_path), ("pokemon", "records"), piece, 8 * piece).collect():
        got.setdefault(m.path.rsplit("/", 1)[-1], []).append((m.pos, m.listed, m.member))
    for name, (listed, shape) in want.items():
        rows = sorted(got.get(name, []))
        assert [p for p, _, _ in rows] == list(range(len(shape))), name
        assert all(kind == listed for _, kind, _ in rows)
        if listed:
            assert [json.loads(t) for _, _, t in rows] == shape
        else:
            assert [next(iter(json.loads("{" + t + "}").items())) for _, _, t in rows] == list(shape.items())


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps([{"id": i, "name": "x" * (i % 50)} for i in range(20_000)]))
    out = json_members(spark, str(tmp_path / "one.json"), (), 1 << 14, 1 << 15)
    seen = out.withColumn("task", F.spark_partition_id()).agg(F.countDistinct("task").alias("tasks"), F.count("*").alias("n"), F.sum("pos").alias("s")).first()
    assert seen.tasks > 1 and seen.n == 20_000 and seen.s == 20_000 * 19_999 // 2


def test_keyed_records_keep_their_fields(spark, tmp_path):
    (tmp_path / "k.json").write_text('{"a": {"id": 1}, "b": [{"id": 2}, {"id": 3}], "c": null}')
    schema = T.StructType([T.StructField("id", T.LongType())])
    rows = readers.scan_keyed_json(spark, str(tmp_path), schema).orderBy("pos", "id").collect()
    assert [(x.key, x.pos, x.id) for x in rows if x.id] == [("a", 0, 1), ("b", 1, 2), ("b", 1, 3)]
    assert readers.scan_keyed_json(spark, str(tmp_path / "none"), schema).count() == 0
