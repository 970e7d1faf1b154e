"""Time the headline queries and print one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS] (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

from skuflow.plans.queries import QUERIES
from skuflow.session import build_session, drop_scratch

HEADLINE = (
    "reorder_alerts", "sku_features", "sku_summary", "rop", "supplier_recommend", "forecast_all", "zscore_anomaly",
    "contamination_sweep", "alerts", "classify_intent", "answer_queries", "chunk_documents", "near_dup_pairs",
    "dedup_keep_first", "knn_join", "text_retrieve", "iforest_score", "arima_by_sku", "extend_demand", "po_pricing",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "skuflow-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        drop_scratch(spark)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
