"""Times the headline queries and prints one JSON line.

Inputs (precincts, plan rows, edges, draws) are written once before timing, as a
study would store them; each query then reads them and returns all its rows.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wardwise import fixtures as fx  # noqa: E402
from wardwise.operators import frames, inference, regression, report, waste  # noqa: E402
from wardwise.plans import contiguity, metrics, results  # noqa: E402
from wardwise.session import local_session  # noqa: E402

PLANS = int(os.environ.get("BENCH_PLANS", "100"))
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))


def scale_of(sf_dir: str) -> float | str:
    name = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    try:
        return float(name)
    except ValueError:
        return name


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "wardwise-bench", **{"spark.sql.shuffle.partitions": str(2 * int(cpus)) if cpus.isdigit() else "16"})
    precincts = fx.precincts(spark, sf_dir)
    plans = fx.assignments(spark, sf_dir, PLANS)
    ten = plans.where("map_id <= 10")
    edges, draws = fx.edges(spark, sf_dir), fx.draws(spark, sf_dir)
    units = frames.precinct_stats(plans, precincts)
    own = fx.stored(spark, sf_dir, "bench_results", lambda: results.district_results(
        frames.precinct_stats(fx.assignments(spark, sf_dir), precincts), draws, precincts))
    districts = frames.district_summary(units, frames.DISTRICT)
    queries = {
        "a01_district_truth": lambda: frames.district_truth(units),
        "a06_plan_summaries": lambda: frames.summarise_plans(plans, precincts)[1],
        "d05_packed_cracked": lambda: waste.packed_cracked(frames.district_truth(units)),
        "d06_precinct_waste": lambda: frames.precinct_stats(plans, waste.surplus_losing_precincts(precincts)),
        "d07_precinct_metrics": lambda: results.plan_precinct_results(fx.assignments(spark, sf_dir), precincts, own),
        "d08_ecological_regression": lambda: regression.ecological_regression(units),
        "d09_inference_from_draws": lambda: inference.summarise_draws(draws, precincts),
        "d10_grid_inference": lambda: inference.grid_inference(frames.precinct_stats(ten, precincts)),
        "d19_district_results": lambda: results.district_results(units, draws, precincts),
        "a10_metric_intervals": lambda: report.metric_intervals(report.plan_errors(own)),
        "a11_error_table": lambda: report.error_table(own),
        "g07_partisan_metrics": lambda: metrics.plan_metrics(districts),
        "g08_cut_edges": lambda: metrics.cut_edges(plans, edges),
        "g12_contiguity": lambda: contiguity.district_components(ten, edges),
    }
    only = os.environ.get("BENCH_ONLY")
    times = {}
    for name, run in queries.items():
        if only and not any(name.startswith(o) for o in only.split(",")):
            continue
        taken = []
        for i in range(REPEATS + 1):
            start = time.perf_counter()
            run().write.format("noop").mode("overwrite").save()
            if i:  # the first run warms the code up
                taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds_headline_queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": scale_of(sf_dir),
        "plans": PLANS, "plan_rows": plans.count(), "plans_d10_g12": 10, "plans_d07_d09": fx.N_PLANS,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
