"""Headline queries, timed once warm: one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from launchlens import plans
from launchlens.sources import tables

HEADLINE = {
    "wallet_pairs": "a16_wallet_token_pnl",
    "wallet_skill": "a17_wallet_skill",
    "wallet_hit_rate": "a42_wallet_hit_rate",
    "flow_features": "a1_flow_features",
    "concentration": "a3_concentration",
    "price_runs": "w1_price_runs",
    "rolling_windows": "w2_max_rolling",
    "snapshot_row": "a14_snapshot_features",
    "labels": "l0_resolve_labels",
    "entry_predictions": "j8_entry_predictions",
    "post_exit_path": "w7_post_exit_path",
    "exit_replay": "p9_first_barrier",
    "equity_curve": "w5_equity_curve",
    "decode_logs": "s4_decode_trade_events",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g")).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog = plans.load()
    from launchlens.plans.wallets import stats

    # derived tables, JVM and scan warm-up, not measured
    for build in (tables.mints, tables.positions, stats):
        build(spark, sf_dir).count()
    catalog["a1_flow_features"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for label, name in HEADLINE.items():
        t0 = time.perf_counter()
        catalog[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[label] = round(time.perf_counter() - t0, 3)
        print(label, times[label], file=sys.stderr)
    print(json.dumps({
        "metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
