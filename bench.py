"""Times the headline queries: python bench.py prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose tables and cores."""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from grainline import catalog

HEADLINE = [
    "edges_build", "dense_ids", "adjacency_fwd", "topo_roundtrip", "packed_roundtrip", "learned_roundtrip_order_k", "attr_tree_roundtrip", "bfs_budget_fwd", "bfs_budget_bwd",
    "bfs_attributes", "reach_levels", "win_wordbag_l1", "knn_exact", "template_roundtrip", "record_vertices", "store_backward",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
    spark = builder.config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        t = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - t, 3)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else None}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
