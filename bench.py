"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (names, comma
separated), BENCH_REPEAT (default 2, best counts; the first run also warms the JVM up).
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tickloom.session import local_session  # noqa: E402
from tickloom.workload import load  # noqa: E402

HEADLINE = (
    "S1_W1_W2_W3_tick_extract D1_dc_events D4_dc_features D7_dc_features_wide A9_regime_stats "
    "J1_asof_backward W6_rolling_regime W13_market_context W14_windows T1_pair_fills T4_dc_trades "
    "T5_dc_trades_sweep A1_forecast_metrics A3_paired_statistics A5_trade_metrics A12_percentiles "
    "T11_score_leaders_v2 J11_fill_progress"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    spark = local_session(cpus, "16g")
    queries = load().QUERIES
    spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count().collect()
    times = {}
    for name in names:
        best = None
        for _ in range(repeat):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    total = round(sum(times.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
             "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale}
        )
    )


if __name__ == "__main__":
    main()
