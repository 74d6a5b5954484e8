"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from quantloom.plans import QUERIES
from quantloom.session import session

HEADLINE = ("t05_low_vol_top_quintile", "g02_g03_session_close_value", "g04_realized_variance", "j09_w02_skeleton_ffill", "j13_b15_adjusted_close", "j16_j17_r28_offset_pairs", "w01_w05_w07_classic_signals", "w11_vol_ewma", "w13_trailing_betas", "w14_w15_rank_standardize", "f02_f13_moments", "r01_ic_series", "r02_w33_newey_west", "r29_r30_r31_event_response", "b05_g25_backtest", "m10_har", "m13_fhs", "t01_rank_universe")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the executors
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
