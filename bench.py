"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the folder of tables, ``BENCH_CPUS`` the cores. Each query is written to the no-op
sink, so every row is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from codelattice.plans import load
from codelattice.session import local_session

HEADLINE = [
    "edge_rollup", "graph_nodes", "view_elements", "khop_expand", "neighbourhood",
    "locate_enclosing_nearest", "locate_enclosing_narrowest", "callsite_to_edges",
    "file_delta_apply", "unit_diff", "upsert_keep_created", "overlay_clear",
    "restore_stats", "snapshot_reconcile_nodes", "path_tree", "compact_chains",
    "explode_lines", "body_fingerprint", "complexity_score", "segment_units", "symbol_table",
    "decision_points", "apply_edits_desc", "mask_changed_units", "marker_scan",
    "save_debounce", "usage_log_windows", "edge_append_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, memory="20g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.codelattice.textPartitions", str(spark.sparkContext.defaultParallelism))  # the tables are one file each
    queries, _ = load()
    queries["class_of_label"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm up
    took = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
