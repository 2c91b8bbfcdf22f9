"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from crosslane.plans import registered
from crosslane.session import build_session

HEADLINE = [
    "daily_bars",
    "flagship_feature_ic",
    "wide_universe_feature_ic",
    "feature_idio_vol_20",
    "feature_vol_ewm_20",
    "feature_momentum_60_sector_rel",
    "normalize_rank",
    "summarize_models",
    "cost_adjusted_summary",
    "rebalanced_book_stats",
    "bootstrap_ic",
    "shuffle_null",
    "neutralized_ic",
    "rank_average_ensemble",
    "walk_forward_softmax",
    "ridge_stack",
    "walk_forward_ols",
    "lasso_alpha_trace",
    "fama_macbeth",
    "fold_membership",
    "store_newest",
    "rank_in_groups",
    "exact_quantiles",
    "tabular_lags",
    "tabular_ewm",
    "tabular_time_stats",
    "target_encoding",
    "describe_numeric",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    names = sys.argv[1:] or HEADLINE
    registered.QUERIES["daily_bars"](spark, sf).count()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        registered.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": sf.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
