"""Physical plans: no nested loops or cross products, few Python spots, pruned scans."""

from __future__ import annotations

import pytest

from rosterforge.plans import load_all

SF = "/root/testdata/sf0.001"
QUERIES, _ = load_all()
WRITES = {"scan_documents", "scan_keyed_json", "scan_csv_contract", "append_table", "write_table_counts", "write_vector_index",
          "write_split_dataset", "incremental_ingest", "dedupe_stream", "latest_stream", "cluster_vectors", "density_clusters",
          "suppress_overlaps", "suppress_overlaps_iou"}
PYTHON = {"embed_column", "knn_topk", "filtered_nearest", "arbitrate_matches", "rerank_by_tags", "best_variant", "candidate_gap",
          "rank_documents", "extract_answer", "grade_answers", "grade_counts", "expand_neighbours", "format_context", "build_prompt",
          "source_list", "merge_boxes", "merge_boxes_page", "ko_chance_n_hits", "ko_chance_two_hits"}
# Pairs of a fixed eighteen-word domain: the one join without an equality.
THETA = {"pair_combinations"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in WRITES])
def test_no_cross_products_and_no_stray_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    if name not in THETA:
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    if name not in PYTHON:
        assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


def test_top_k_is_cut_before_the_shuffle(spark):
    assert plan_of(QUERIES["top_items_per_entity"](spark, SF)).count("WindowGroupLimit") == 2


def test_scan_reads_only_needed_columns(spark):
    plan = plan_of(QUERIES["distinct_known_keys"](spark, SF))
    schema = plan.split("ReadSchema: ")[1].splitlines()[0]
    assert "o_orderdate" in schema and "o_totalprice" not in schema and "o_orderpriority" not in schema


def test_series_are_never_ordered_whole(spark):
    plan = plan_of(QUERIES["runs_above_threshold"](spark, SF))
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_b" in line.split("],")[-2] for line in windows)
