"""Headline benchmark; prints one JSON line.

Every query is run to completion with its result discarded on the executors (noop sink).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quantloom.plans.catalog import all_queries  # noqa: E402
from quantloom.session import local_session  # noqa: E402

HEADLINE = ["flagship_rank_spread", "composed_features", "characteristics_pack", "trend_fingerprint", "volatility_pack", "trade_flow_features", "quote_features", "depth_features", "forward_returns",
            "book_backtest", "refreshed_long_short", "single_asset_backtest", "stress_scenarios", "signal_families", "grid_backtest", "pbo_cscv", "circular_bootstrap", "ridge_walk_forward",
            "bm25_top", "document_changes", "position_book", "strategy_benchmark"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    queries = all_queries()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").count().write.format("noop").mode("overwrite").save()  # start the engine
    times: dict[str, float] = {}
    only = sys.argv[1:]
    for name in only or HEADLINE:
        t = time.perf_counter()
        queries[name].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
