"""Streams run twice over one checkpoint; sources and sinks on written files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterforge.plans import standins
from rosterforge.sources import readers, writers
from rosterforge.streaming import flows


def payload(i, date, fmt, page, pos):
    deck = [{"name": "Aa", "ability": "x", "item": "y", "tera": "z", "attacks": ["m1", "m2"]}]
    return {"id": i, "date": date, "format": fmt, "name": i.upper(), "players": 2, "page": page, "pos": pos,
            "standings": [{"player": "p", "name": "P", "placing": 1, "wins": 1, "losses": 0, "decklist": deck}],
            "pairings": [{"match": "1", "player1": "p", "player2": "q", "winner": "p"}]}


def test_ingest_twice_without_duplicates(spark, tmp_path):
    landing, target, ckpt = (str(tmp_path / n) for n in ("landing", "tables", "ckpt"))
    (tmp_path / "landing").mkdir()

    def land(name, rows):
        (tmp_path / "landing" / name).write_text("\n".join(json.dumps(r) for r in rows))

    def run():
        flows.ingest_stream(spark, landing, target, ckpt).awaitTermination()
        return {r["table"]: r["n"] for r in writers.table_counts(spark, {c: f"{target}/{c}" for c in ("tournaments", "standings", "teamlists", "matches")}).collect()}

    land("a.json", [payload("t1", "2026-05-10T00:00:00Z", "M-A", 0, 0), payload("t1", "2026-05-10T00:00:00Z", "M-A", 0, 1), payload("x", "2026-05-09T00:00:00Z", "I", 0, 2)])
    assert run() == {"tournaments": 1, "standings": 1, "teamlists": 1, "matches": 1}
    assert run() == {"tournaments": 1, "standings": 1, "teamlists": 1, "matches": 1}
    land("b.json", [payload("t2", "2026-05-12T00:00:00Z", "M-B", 0, 0), payload("t1", "2026-05-10T00:00:00Z", "M-A", 0, 1), payload("late", "2026-05-01T00:00:00Z", "M-A", 0, 2)])
    assert run() == {"tournaments": 2, "standings": 2, "teamlists": 2, "matches": 2}


def test_batch_replay_after_a_partial_write(spark, tmp_path):
    rows = spark.read.schema(flows.PAYLOAD).json(spark.sparkContext.parallelize([json.dumps(payload("t1", "2026-05-10", "M-A", 0, 0))]))
    target = str(tmp_path / "tables")
    stamp = flows.batch_stamp(rows)
    flows.write_batch(flows.ingest.flatten_standings(rows), f"{target}/standings", "standings", stamp)
    flows.ingest_batch(rows, target)
    flows.ingest_batch(rows, target)
    assert spark.read.parquet(f"{target}/standings").count() == 1 and spark.read.parquet(f"{target}/tournaments").count() == 1
    assert {r[0] for r in spark.read.parquet(f"{target}/matches").select("batch").distinct().collect()} == {stamp}


def test_a_batch_reads_no_flattened_table(spark, tmp_path):
    """Damaged standings, teamlists and matches of other batches do not disturb a batch."""
    target = tmp_path / "tables"
    for name in ("standings", "teamlists", "matches"):
        (target / name / "batch=b0").mkdir(parents=True)
        (target / name / "batch=b0" / "part-0.parquet").write_text("damaged")
    rows = spark.read.schema(flows.PAYLOAD).json(spark.sparkContext.parallelize([json.dumps(payload("t9", "2026-05-10", "M-A", 0, 0)) for _ in range(2)]))
    flows.ingest_batch(rows, str(target))
    stamp = flows.batch_stamp(rows)
    assert {n: spark.read.parquet(f"{target}/{n}/batch={stamp}").count() for n in ("standings", "teamlists", "matches")} == {"standings": 1, "teamlists": 1, "matches": 1}


@pytest.mark.parametrize("ttl", [None, "1 hour"])
def test_dedupe_state_survives_restart(spark, tmp_path, ttl):
    source, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    schema = "content string, at timestamp_ntz"
    write = lambda items: spark.createDataFrame([(c,) for c in items], "content string").withColumn(
        "at", F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(source)
    for items in (["a", "b", "a"], ["b", "c"]):
        write(items)
        rows = spark.readStream.schema(schema).parquet(source)
        flows.run_to_end(flows.dedupe_stream(rows, "content", ttl, "at"), out, ckpt)
    assert sorted(r["content"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_latest_survives_restart(spark, tmp_path):
    source, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    for rows in ([("a", 1, "x"), ("b", 2, "y")], [("a", 3, "z")]):
        spark.createDataFrame(rows, "k string, ts int, v string").coalesce(1).write.mode("append").parquet(source)
        flows.keep_latest(spark.readStream.schema("k string, ts int, v string").parquet(source), ["k"], ["ts"], out, ckpt)
    got = {(r["k"], r["ts"], r["v"]) for r in flows.latest_table(spark, out).collect()}
    assert got == {("a", 3, "z"), ("b", 2, "y")}


def test_a_batch_of_one_key_rewrites_one_bucket(spark, tmp_path):
    source, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    schema = "k string, ts int, v string"

    def land(rows, ckpt=ckpt):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        flows.keep_latest(spark.readStream.schema(schema).parquet(source), ["k"], ["ts"], out, ckpt, buckets=8)
        return {tuple(r) for r in spark.read.parquet(out).select("bucket", "epoch").distinct().collect()}

    first = land([(f"k{i}", 1, "x") for i in range(40)])
    assert first == {(b, 0) for b in range(8)}
    second = land([("k5", 2, "y"), ("k5", 1, "late")])
    ((bucket, epoch),) = second - first
    assert epoch == 1
    third = land([("k5", 3, "z")])
    assert {e for b, e in third if b == bucket} == {1, 2} and third - {(bucket, 1), (bucket, 2)} == first - {(bucket, 0)}
    got = {r["k"]: r["v"] for r in flows.latest_table(spark, out).collect()}
    assert got == {**{f"k{i}": "x" for i in range(40)}, "k5": "z"}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    """The commit of the last batch is lost; the restart runs it again over its own version."""
    source, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    schema = "k string, ts int, v string"
    for rows in ([("a", 1, "x"), ("b", 1, "x")], [("a", 2, "y"), ("c", 1, "x")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        flows.keep_latest(spark.readStream.schema(schema).parquet(source), ["k"], ["ts"], out, ckpt, buckets=2)
    before = sorted(map(tuple, flows.latest_table(spark, out).collect()))
    for name in ("1", ".1.crc"):
        (tmp_path / "ckpt" / "commits" / name).unlink(missing_ok=True)
    flows.keep_latest(spark.readStream.schema(schema).parquet(source), ["k"], ["ts"], out, ckpt, buckets=2)
    assert sorted(map(tuple, flows.latest_table(spark, out).collect())) == before == [("a", 2, "y"), ("b", 1, "x"), ("c", 1, "x")]


def test_document_folder(spark, tmp_path):
    (tmp_path / "b.txt").write_text(" hi\r\n")
    (tmp_path / "a.txt").write_text("x\n\n\n\ny")
    (tmp_path / "c.md").write_text("no")
    out = readers.scan_documents(spark, str(tmp_path)).orderBy("filename").collect()
    assert [(r["filename"], r["stem"], r["text"]) for r in out] == [("a.txt", "a", "x\n\ny"), ("b.txt", "b", "hi")]


def test_keyed_json_forms(spark, tmp_path):
    schema = T.StructType([T.StructField("n", T.StringType())])
    cases = {"obj": {"k1": {"n": "a"}, "k2": {"n": "b"}}, "many": {"0001": [{"n": "a"}, {"n": "b"}]}, "list": [{"n": "a"}, {"n": "b"}], "wrap": {"records": [{"n": "a"}, {"n": "b"}]}}
    for name, body in cases.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
        out = readers.scan_keyed_json(spark, str(tmp_path / f"{name}.json"), schema)
        assert sorted(r["n"] for r in out.collect()) == ["a", "b"]
    assert readers.scan_keyed_json(spark, str(tmp_path / "absent.json"), schema).count() == 0


def test_contract_csv_keeps_awkward_text(spark, tmp_path):
    path = str(tmp_path / "t")
    row = {c: "" for c in writers.CONTRACTS["tournaments"]} | {"name": 'a "quoted", name\nwith a break', "tournament_id": "1"}
    df = spark.createDataFrame([row])
    writers.append_table(df, path, "tournaments", "csv")
    writers.append_table(df, path, "tournaments", "csv")
    out = readers.scan_csv_contract(spark, path, "tournaments")
    assert out.count() == 2 and {r["name"] for r in out.collect()} == {row["name"]}
    counts = {r["table"]: r["n"] for r in writers.table_counts(spark, {"tournaments": path, "matches": str(tmp_path / "none")}, "csv").collect()}
    assert counts == {"tournaments": 2, "matches": 0}


def test_class_folders(spark, tmp_path):
    for name in ("root/cat/a.JPG", "root/cat/deep/b.png", "root/dog/c.txt"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x")
    out = readers.scan_labelled_files(spark, str(tmp_path / "root")).collect()
    assert sorted(r["label"] for r in out) == ["cat", "cat"] and all(len(r["source_id"]) == 16 for r in out)


def test_box_lines(spark):
    rows = spark.createDataFrame([("s", "1.0 0.5 0.5 0.1 0.2"), ("s", "1 2 3"), ("s", " 2\t0.1  0.2 0.3 0.4 ")], "stem string, value string")
    assert [r["class_id"] for r in readers.scan_box_labels(rows).collect()] == [1, 2]


def test_vector_index_refuses_bad_input(spark, tmp_path):
    ok = spark.createDataFrame([(1, [1.0, 2.0])], "id int, vector array<double>")
    for bad in (ok.where("id > 1"), ok.unionByName(spark.createDataFrame([(2, [1.0])], ok.schema)), ok.unionByName(spark.createDataFrame([(2, None)], ok.schema))):
        with pytest.raises(ValueError):
            writers.write_vector_index(bad, str(tmp_path / "bad"))
    writers.write_vector_index(ok, str(tmp_path / "ok"))
    assert readers.load_vector_index(spark, str(tmp_path / "ok")).count() == 1


def test_payloads_move_team_lists_once(spark, tmp_path):
    """One exchange of the lines by tournament and one of the orders; pairings are those of ``matches``."""
    spark.sql("""SELECT CAST(id % 3 AS BIGINT) AS l_orderkey, CAST(id % 4 AS BIGINT) AS l_suppkey, id AS l_partkey, 'A' AS l_returnflag, 'F' AS l_linestatus,
        CAST(id AS INT) AS l_linenumber, CAST(5 AS DOUBLE) AS l_quantity, DATE'2020-01-02' AS l_shipdate, 0.01D AS l_discount, 0.02D AS l_tax,
        CAST(id % 5 AS DOUBLE) AS l_extendedprice FROM range(40)""").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("""SELECT id AS o_orderkey, DATE'2020-01-01' AS o_orderdate, '1-URGENT' AS o_orderpriority, id AS o_custkey, 1000.0D AS o_totalprice,
        'O' AS o_orderstatus FROM range(4)""").write.parquet(f"{tmp_path}/orders.parquet")
    landed = standins.payloads(spark, str(tmp_path))
    assert landed._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    plan = landed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 2
    told = {(r.id, p.match, p.table, p.player1, p.player2, p.winner) for r in landed.collect() for p in r.pairings or []}
    assert told == {(r.tournament_id, r.match, r.table, r.player1, r.player2, r.winner) for r in standins.matches(spark, str(tmp_path)).collect()}


def test_ingest_reads_payloads_once_and_leaves_other_formats(spark, tmp_path):
    """Four tables come from one kept copy of the chosen payloads; a second listing of a tournament adds nothing."""
    rows = spark.sql("""SELECT CAST(id % 6 AS STRING) AS id, '2020-01-01' AS date, IF(id % 2 = 0, 'M-A', 'other') AS format, CONCAT('n', id) AS name, id AS page, id AS pos,
        ARRAY(NAMED_STRUCT('player', 'p')) AS standings FROM range(12)""")
    rows.write.json(f"{tmp_path}/in")
    batch = spark.read.schema(flows.PAYLOAD).json(f"{tmp_path}/in")
    reads = spark.sparkContext.accumulator(0)

    def seen(rows):
        for part in rows:
            reads.add(part.num_rows)
            yield part

    flows.ingest_batch(batch.mapInArrow(seen, batch.schema), f"{tmp_path}/out")
    kept = spark.read.parquet(f"{tmp_path}/out/tournaments")
    assert sorted((r.tournament_id, r.name) for r in kept.collect()) == [("0", "n0"), ("2", "n2"), ("4", "n4")]
    assert spark.read.parquet(f"{tmp_path}/out/standings").count() == 3
    assert reads.value <= 24, "the listing and the payloads, once each"
