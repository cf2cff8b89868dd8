"""Headline queries, wall time each. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gavel.plans import load_all  # noqa: E402
from gavel.session import get_session  # noqa: E402

HEADLINE = [
    "flagship_deal_scores", "area_price_benchmark", "mad_outliers", "benchmark_gate", "rank_areas_resale", "rank_areas_rental", "kpi_rollup", "building_benchmark",
    "dedup_exact_broker", "cross_source_winners", "message_merge", "ingest_dedup_cascade", "rule_match_join", "price_amount", "split_blocks", "area_match",
    "ols_trend", "forecast_backtest", "health_daily", "funnel", "experiment_decision", "entity_search_cascade", "vector_topk_cosine", "contract_check", "stream_health",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    plans = load_all()
    plans["sync_summary"].plan(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        plans[name].plan(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
