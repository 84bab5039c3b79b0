"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pitspark.queries import QUERIES, load_all  # noqa: E402
from pitspark.session import local_session  # noqa: E402

HEADLINE = [
    "b1_equal_weight_backtest", "b1_random_weight_backtest", "j1_asof_latest", "j2_macro_latest", "j4_history_every_date",
    "w9_last_rows", "m4_sma_timing", "a10_return_risk", "a11_downside_risk", "a9_covariance", "m7_mean_variance", "a14_cointegration",
    "a3_segment_metrics", "j10_cotemporal_universe", "a8_data_sufficiency", "b4_regime_benchmark", "b8_multi_family_report",
    "a12_distribution", "w12_running_ladder", "a16_snapshot_gate", "s1_observation_csv", "t3_latest_revision_stream", "x2_learned_forecast",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="pitspark-bench")
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    QUERIES["p4_symbols"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
