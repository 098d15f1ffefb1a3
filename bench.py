"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from tidemark.catalog import ENTRIES
from tidemark.session import local_session

HEADLINE = (
    "asof_price", "compute_targets", "choose_path", "win_52w", "history_view", "feat_pre_price", "feat_history", "feat_reaction",
    "detect_release", "resolve_t0", "nearest_date_match", "filing_acceptance_match", "bl_vol_scaled", "eval_cells", "agg_spearman",
    "bootstrap_blocks", "paired_compare", "trade_pnl", "win_peak_concurrency", "portfolio_metrics", "dedup_live_calls", "score_live",
    "pat_session_stats", "pat_follow_through", "upsert_append_dedup", "archive_coverage",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    names = sys.argv[1:] or HEADLINE
    took: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        ENTRIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": sf_dir.rstrip("/").rsplit("/", 1)[-1].removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
