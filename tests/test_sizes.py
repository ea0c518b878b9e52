"""Steps that must not grow with one task, one key or one batch; results against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rosterforge.functions import battle as B
from rosterforge.operators import clusters, curation, matchup, resolve
from rosterforge.operators.cells import pivot_cells
from rosterforge.sources import readers, writers

FIGHTER = "name string, types array<string>, moves array<struct<move string, move_type string, power int, attack int>>, defense int, hp int, level int, tier string"


def fighters(n, seed):
    dice, tags = random.Random(seed), ["fire", " Water", "grass", "ghost", "normal", "odd", None]
    return [(f"f{i % 7}", None if i % 11 == 0 else dice.sample(tags, 2),
             [(f"m{j}", dice.choice(tags), dice.choice([None, 0, 40, 90]), dice.randrange(20, 150)) for j in range(4)],
             dice.randrange(0, 120), dice.randrange(60, 200), 50, "OU") for i in range(n)]


@pytest.mark.parametrize(("mode", "size"), [("one-vs-all", 5), ("all-vs-one", 5), ("all-vs-one", 70)])
def test_matchups_of_one_scan_task_are_dealt_out(spark, mode, size):
    many, few = fighters(40, 1), fighters(size, 2)
    rows = spark.createDataFrame(many, FIGHTER).coalesce(1)
    out = matchup.matchup_matrix(rows, spark.createDataFrame(few, FIGHTER).coalesce(1), mode)
    parts = {r[0] for r in out.select(F.spark_partition_id()).distinct().collect()}
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    chart = {(a, d): f for a, d, f in B.CHART}

    def best(att, dfn):
        told = []
        for move, tag, power, attack in att[2]:
            factor = 1.0
            for t in dfn[1] or []:
                factor *= chart.get((tag and tag.strip().lower(), t and t.strip().lower()), 1.0)
            stab = 1.5 if tag is not None and tag in (att[1] or []) else 1.0
            base = None if power is None else 22 * power * attack // max(1, dfn[3]) // 50 + 2

            def hit(share, factor=factor, stab=stab, base=base, power=power):
                if factor == 0 or (power is not None and power <= 0):
                    return 0
                return 1 if base is None else max(1, int(int(int(base * share) * stab) * factor))
            told.append((-hit(1.0), len(told), hit(0.85), move))
        high, _, low, move = min(told)
        return att[0], dfn[0], move, low, -high

    pairs = [(b, a) if mode == "one-vs-all" else (a, b) for a in many for b in few]
    assert sorted(tuple(r)[:5] for r in out.collect()) == sorted(best(a, d) for a, d in pairs)


def test_rows_meet_a_crowded_name_in_shares(spark, monkeypatch):
    """Half of the rows have no name and a third one name; neither lands in one task."""
    monkeypatch.setattr(resolve, "NAME_ROWS", 100)
    names = [None if i % 2 else "One" if i % 3 else f"n{i % 40}" for i in range(4800)]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)] + [(7, None), (8, "One"), (8, "One")], "i int, name string")
    lookup = spark.createDataFrame([("one", ("R1",)), ("n6", ("R6",))], "key string, rec struct<title string>")
    out = resolve.resolve_names(rows, lookup, "name")
    assert out.columns == ["name", "i", "rec"]
    told = {"One": "R1", "n6": "R6"}
    wanted = [(i, n, told.get(n)) for i, n in [*enumerate(names), (7, None), (8, "One"), (8, "One")]]
    got = out.select("i", "name", "rec.title", F.spark_partition_id().alias("part")).collect()
    key = lambda r: (r[0], str(r[1]), str(r[2]))
    assert sorted((tuple(r)[:3] for r in got), key=key) == sorted(wanted, key=key)
    parts = [r.part for r in got]
    assert max(parts.count(p) for p in set(parts)) < 0.3 * len(parts)


def test_points_are_copied_once_per_group(spark):
    """Where no cell can be ruled out, copies follow the groups, not the cells, and leave in bounded batches."""
    dice = random.Random(5)
    rows = [(i, [dice.gauss(0, 1) for _ in range(16)]) for i in range(1200)]
    points = spark.createDataFrame(rows, "id long, vector array<double>").coalesce(1)
    cells = pivot_cells(points, "id", "vector", 16, 1200)
    placed = clusters.near_cells(points, cells, 50.0)
    assert len(cells.rows) == 34
    assert placed.count() <= 1200 * 22
    assert placed.where("home").count() == 1200


def test_documents_are_written_by_many_tasks(spark, tmp_path):
    texts = [f"text {i}\n\nwith ünï{i}" for i in range(60)] + [None, "", "same", "same"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    folder = str(tmp_path / "docs")
    assert writers.write_documents(rows, folder) == len(texts)
    assert len(list(tmp_path.glob("docs/part=*"))) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = readers.scan_documents(spark, folder)
    assert sorted(r.text for r in read.collect()) == sorted(t or "" for t in texts)
    assert all(p.read_bytes().endswith(b"\n") for p in tmp_path.glob("docs/part=*/*.txt"))
    assert writers.write_documents(rows.where("false"), str(tmp_path / "none")) == 0
    assert readers.scan_documents(spark, str(tmp_path / "none")).count() == 0


def test_the_sweep_reads_islands(spark):
    """A page of many lines in few islands: one row per island and block reaches the one sweeping task, bands are those of a plain sweep."""
    dice = random.Random(3)
    rows = [("page", k * 1000 + dice.randrange(0, 300), dice.randrange(20, 70)) for k in range(40) for _ in range(60)]
    lines = spark.createDataFrame([(i, y - 4, y + h) for i, y, h in rows], "image string, lo long, hi long")
    bands = curation.merge_bands(lines, "image")
    told = {r.lo: r.band for r in bands.collect()}
    assert set(told) == {y - 4 for _, y, _ in rows}
    top = bottom = None
    reach: dict = {}
    for _, y, h in rows:
        reach[y - 4] = max(reach.get(y - 4, 0), y + h)
    for lo, hi in sorted(reach.items()):
        if bottom is None or lo - bottom > (curation.MERGE_ROW - 0.5) * (bottom - top):
            top, bottom = lo, hi
        bottom = max(bottom, hi)
        assert told[lo] == top
    plan = bands._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "_island" in plan[plan.index("MapInArrow"):]


def test_merged_boxes_without_x_or_width(spark):
    rows = [("a", 0, 0, 40, 20), ("a", None, 2, 40, 20), ("a", 10, 4, None, 20), ("a", None, 6, None, 20), ("a", 500, 8, 40, 20), (None, 0, 0, 4, 4), ("b", 1, None, 4, 4), ("b", 1, 1, 4, None)]
    out = curation.merge_boxes(spark.createDataFrame(rows, "image string, x long, y long, width long, height long"))
    assert sorted(tuple(r) for r in out.collect()) == [("a", 0, 0, 40, 26), ("a", 500, 8, 40, 20)]


def test_stems_list_heads_of_names_not_all_their_lengths(spark):
    """Names of many lengths cost a stem its places, not places times lengths; the record is that of a plain search."""
    dice = random.Random(3)
    make = lambda n: "".join(dice.choice("ab") for _ in range(n))
    records = [(i, make(4 + i % 25), make(4 + i % 9) if i % 3 else None, make(3 + i % 7)) for i in range(120)] + [(120, "É1", "", None)]
    stems = [(i, f"{make(20)}-{make(20)}") for i in range(30)] + [(30, "x é1"), (31, None), (32, "")]
    rows = spark.createDataFrame(records, "pos int, display_name string, form_display_name string, species_display_name string")
    out = resolve.infer_by_containment(spark.createDataFrame(stems, "item int, stem string"), rows)

    def plain(stem):
        text = (stem or "").replace("-", "").replace(" ", "").lower()
        names = [(kind, -len(n) if kind == 0 else len(n), pos) for pos, *given in records
                 for kind, n in zip((0, 0, 1), given, strict=True) if n and n.lower() in text]
        return min(names)[2] if names else None

    assert {r["item"]: r.rec and r.rec.pos for r in out.collect()} == {i: plain(s) for i, s in stems}
    text = spark.createDataFrame([("s", "abcdefghijklmnop", [3, resolve.HEAD])], "stem string, _norm string, _lens array<int>")
    assert resolve.name_heads(text, "stem").count() == 14 + 17 - resolve.HEAD
    assert "_sizes" in out._jdf.queryExecution().analyzed().toString()


def test_hazards_make_no_shifted_totals(spark):
    """The class after hazards is that of the shifted totals; rolls are worked out once for all hit counts."""
    dice = random.Random(9)
    rows = [(None if i == 0 else [] if i == 1 else [dice.randrange(5, 60) for _ in range(8)], dice.randrange(1, 120), None if i == 2 else dice.randrange(60, 200),
             i % 2 == 0, i % 4, dice.sample(["fire", "flying", "rock", "water"], 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "totals array<long>, hp int, max_hp int, stealth_rock boolean, spikes_layers int, types array<string>").withColumn("grounded", F.lit(True))
    df = df.select("*", *[F.lit("").alias(c) for c in ("ability", "item", "status", "weather", "terrain")])
    out = matchup.hazard_residual(df)
    shifted = matchup.ko_class(F.transform("totals", lambda d: d + F.col("hazard_damage")), F.col("hp"))
    assert out.where(~F.col("ko_after_hazards").eqNullSafe(shifted)).count() == 0
    assert out.columns[:len(df.columns)] == df.columns and "_low" not in out.columns
    plan = out.select("ko_after_hazards")._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(totals" not in plan
    slow = F.transform(F.array(F.lit(1), F.lit(3)), lambda x: x * F.col("hp"))
    totals = matchup.pooled_totals(slow, F.array(F.lit(1), F.lit(2)))
    assert [r[0] for r in df.select(totals).limit(3).collect()] == [sorted(h * x * r[1] for h in (1, 2) for x in (1, 3)) for r in rows[:3]]


def test_the_driver_lists_no_document(spark, tmp_path):
    """Folders are listed and files read by tasks; what counts as a document and how it is named is what Spark's reader says."""
    for place, said in {"part=0/a b%é.txt": "one\r\ntwo", "part=0/empty.txt": "", "part=0/_x.txt": "x", "part=0/.y.txt": "y", "part=0/n.csv": "n", "part=1/in/c.txt": "c", "_part/d.txt": "d", "e.txt": "e"}.items():
        (tmp_path / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / place).write_bytes(said.encode())
    for folder in (tmp_path, tmp_path / "part=0", tmp_path / "_part"):
        raw = spark.read.option("pathGlobFilter", "*.txt").text(str(folder), wholetext=True).select("_metadata.file_path", "_metadata.file_name", "value")
        out = readers.scan_documents(spark, str(folder))
        assert out.inputFiles() == []
        got = sorted((r.source, r.filename, r.text) for r in out.collect())
        assert got == sorted((r.file_path, r.file_name, r.value.replace("\r", "")) for r in raw.collect()) and got
    assert readers.scan_documents(spark, str(tmp_path / "part=*")).count() == 1


def test_nested_rows_are_dealt_by_their_number(spark):
    """Partitions of payloads follow the rows, not the compressed size, and are no fewer than a shuffle has."""
    from rosterforge.session import dealt_by_rows
    rows = spark.range(1000)
    assert dealt_by_rows(rows, 1000, 10, "id").rdd.getNumPartitions() == 100
    assert dealt_by_rows(rows, 0, 10, "id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(r.id for r in dealt_by_rows(rows, 1000, 300, "id").collect()) == list(range(1000))
