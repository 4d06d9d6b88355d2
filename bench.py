"""Time the registered queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local cores,
``BENCH_QUERIES`` a comma-separated choice.  Each query is planned and run once to
warm up and then timed, planning included, into a sink that reads every column.
"""

from __future__ import annotations

import json
import os
import sys
import time

from lumisweep.plans.queries import QUERIES
from lumisweep.session import build_session

HEADLINE = [
    "cutoff_readout", "cutoff_readout_events", "cutoff_closed_plateau", "average_then_detect",
    "mean_over_repeats", "rollup_mean_of_ratios", "device_lookup", "part_operator_summary",
    "mean_curve_ci", "sweep_text_readout", "report_measured", "tolerance_sweep",
    "reflectance_grid", "envelope_all", "envelope_one_factor", "envelope_bands",
    "decile_bands", "decile_bands_sweep", "peak_row", "value_ecdf", "box_stats", "kde_1d",
    "kde_2d", "interpolate_linear", "spline_resample", "fit_lowpass2", "fit_layer_stack",
    "fit_rational",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    times: dict[str, float] = {}
    for name in names:
        run(spark, name, sf_dir)
        times[name] = round(run(spark, name, sf_dir), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
