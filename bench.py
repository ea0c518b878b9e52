"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, or ``all``).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "usage_summary", "top_moves_per_entity", "top_teams_per_entity", "flatten_teamlists", "flatten_matches",
    "select_new_until_known", "dedupe_by_content_hash", "build_lookup", "resolve_names", "enrich_detected",
    "infer_by_containment", "type_multiplier", "damage_rolls", "damage_summary", "matchup_matrix",
    "ko_chance_n_hits", "chunk_documents", "rank_documents", "extract_answer", "knn_topk", "filtered_nearest",
    "arbitrate_matches", "staged_rerank", "suppress_overlaps", "rows_by_proximity", "merge_boxes",
    "runs_above_threshold", "image_summary", "train_val_split", "density_clusters",
]


def main() -> None:
    from rosterforge.plans import load_all
    from rosterforge.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    queries, _ = load_all()
    names = list(queries) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE

    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    timings: dict[str, float] = {}
    for name in names:
        started = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - started, 3)
        print(f"{name}: {timings[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, wall seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
