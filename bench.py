"""Time the headline queries on one data folder and print one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (cores), BENCH_QUERIES
(comma list instead of the headline set, or ``all``).
"""

from __future__ import annotations

import json
import os
import re
import time

from quantspark.plans import REGISTRY
from quantspark.session import local_session

HEADLINE = [
    "dip_trades", "dip_summary", "daily_returns", "technicals", "volume_spikes", "compare_returns",
    "corr_pairs", "divergence", "beta", "overnight_summary", "weekday_effect", "intraday_path",
    "momentum_picks", "momentum_equity", "random_control", "perf_summary",
    "pead_beat", "earnings_streak", "insider_summary", "insider_flow_pit", "analyst_upside_pit", "analyst_summary",
    "cusip_agg", "holder_agg", "institutional_history", "derived_quarters", "ttm_asof", "yoy_ttm",
    "factor_table", "composite_rank", "factor_panel",
    "positions", "closed_trades", "trade_violations", "valuation_daily", "rule_fill", "position_candidates",
    "mentions", "html_text", "event_norm", "claims_norm", "critic_flags", "backfill",
    "macro_tiles", "narrative_upsert", "card_feed", "card_marks",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(REGISTRY) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = local_session(cores, "quantspark-bench")
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM, the readers and the Python workers before timing.
    REGISTRY["card_marks"].run(spark, folder).write.format("noop").mode("overwrite").save()
    spark.range(8).mapInPandas(lambda frames: frames, "id long").count()
    seconds = {}
    for name in names:
        began = time.perf_counter()
        REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale.group(1)) if scale else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
