"""Headline queries with wall-clock seconds; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local threads, BENCH_QUERIES (names, comma-separated)
another selection.
"""

from __future__ import annotations

import json
import os
import time

from boutline.plans import catalog
from boutline.session import build_session

HEADLINE = (
    "bout_features",
    "recency_features",
    "entity_state",
    "opponent_experience",
    "card_features",
    "matched_predictions",
    "backtest_summary",
    "bankroll_growth",
    "strategy_sweep",
    "bet_slip_lines",
    "link_in_degree",
    "page_stat_tables",
    "log_sections",
    "position_split",
    "elo_by_pool",
    "elo_by_period",
    "gbt_scores",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["experience"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up
    seconds = {}
    for name in names:
        begin = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    line = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
