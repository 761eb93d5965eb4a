"""Benchmark: headline profiles at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.
Each query is timed from plan construction to the collected result (both the
dataset and the column profile), in one warm JVM; the first query also pays
code generation for the shared expressions.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from factsheet.plans import inputs as I  # noqa: E402
from factsheet.plans.profile import profile_table  # noqa: E402
from factsheet.session import local_session  # noqa: E402


def _profile(df, target, **kw):
    p = profile_table(df, target, **kw)
    out = p.dataset.collect(), p.columns.collect()
    p.release()
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=max(cpus, 8), app="factsheet-bench")
    # JVM warm-up, reported separately: class loading, JIT and Python worker
    # start-up are paid once per process, like the reference's warm interpreter
    t0 = time.perf_counter()
    _profile(I.table(spark, "/root/testdata/sf0.001", "orders"), "o_orderstatus")
    spark.range(64).repartition(cpus).mapInPandas(lambda it: it, "id long").count()  # start Python workers
    warmup = round(time.perf_counter() - t0, 3)

    cases = {
        # the reference's own timed shape: id, float, 3-level text, two-class target
        "profile_4col": lambda: _profile(
            I.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_returnflag",
                                                      "l_linestatus"), "l_linestatus"),
        "profile_lineitem": lambda: _profile(I.lineitem_nulls(spark, sf_dir), "l_linestatus"),
        "profile_lineitem_regression": lambda: _profile(I.lineitem_nulls(spark, sf_dir), "l_extendedprice"),
        "profile_orders_text": lambda: _profile(I.orders_text(spark, sf_dir), "o_orderstatus"),
        "profile_documents": lambda: _profile(I.documents_labelled(spark, sf_dir), "quality"),
        "profile_events": lambda: _profile(I.events_flagged(spark, sf_dir), "big_error"),
    }
    times: dict[str, float] = {}
    for name, fn in cases.items():
        t0 = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "profile_wall_time_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "warmup_sec": warmup,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
