"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The sweep is timed at 1, 50 and 500 variants, to report seconds a variant.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = f"{sys.path[0]}:{os.environ.get('PYTHONPATH', '')}"

HEADLINE = [
    "k20_rotation", "k20_rotation_chain", "k21_trend_portfolio", "k21_trend_chain", "k25_index_backtest", "m22_baseline_report", "k13_net_value", "w01_sma", "w05_quantile", "w08_rolling_corr", "w11_ema", "w12_kama", "w15_macd", "w17_rsi",
    "x08_top_k", "x18_correlations", "g02_donchian", "g08_entry_gate", "e02_trailing_stop", "m01_metrics", "m08_rolling_packs", "t01_trades",
    "l01_fifo", "l03_cash", "l07_holdings", "l07_daily_value", "f05_continuous", "r01_lead_lag", "r04_event_study", "r05_block_bootstrap", "r08_sign_flip", "r09_stratified_permutation", "r13_stitched", "r14_parameter_sweep", "z02_event_bars", "j01_union_calendar", "s17_fingerprint",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", folder).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from panelforge.operators import indicators, studies
    from panelforge.plans.registry import QUERIES
    from panelforge.plans.views import bars

    run = lambda df: df.write.format("noop").mode("overwrite").save()
    run(bars(spark, sf_dir))  # the JVM warms up once
    times: dict[str, float] = {}
    for name in HEADLINE:
        t = time.perf_counter()
        run(QUERIES[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - t, 3)
    panel = indicators.with_returns(bars(spark, sf_dir)).persist()
    run(panel)
    for n, exits in ((1, 1), (5, 10), (50, 10)):
        t = time.perf_counter()
        run(studies.sweep(panel, list(range(5, 5 + n)), [k / 100 for k in range(exits)]).groupBy("lookback", "exit").agg(F.avg("sharpe")))
        times[f"sweep_{n * exits}_variants"] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rpartition("/sf")[2], "seconds_per_variant": {k: times[f"sweep_{k}_variants"] / k for k in (1, 50, 500)}}))
    spark.stop()


if __name__ == "__main__":
    main()
