"""Benchmark: build the warehouse from the star-schema tables, then run the dashboard queries.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Prints one JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf", ...}.
``value`` is the end-to-end time: full build (13 tables + staging) plus every query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from raceboard.plans import display
    from raceboard.plans import queries as q
    from raceboard.plans.registry import (BUMP_FOCUS, BUMP_RACE, BUMP_SEASON, SEASON_POINTS_CUM,
                                          SEASONS_CHAMPIONS, SEASONS_PODIUMS, SEASONS_POINTS)
    from raceboard.plans.warehouse import Warehouse
    from raceboard.session import get_spark, scratch_path

    spark = get_spark(f"local[{cpus}]", shuffle_partitions=cpus)
    timings: dict[str, float] = {}
    phases = {"work": 0.0, "staging": 0.0, "conformed": 0.0}

    # work tables written on the way to a conformed table or report count towards it
    owner = {"work/lap_rows": "conformed", "work/race_lap_rows": "report_race_metrics",
             "work/race_lap_data": "report_race_metrics", "season_totals": "report_seasons_metrics",
             "race_entries": "report_race_metrics", "work/race_order": "report_season_metrics", "work/race_context": "report_season_metrics",
             **{f"work/{g}_{n}": f"report_{g}_metrics" for g in ("seasons", "season") for n in ("placed", "shifts")}}

    def timer(name: str, sec: float) -> None:
        name = owner.get(name, name)
        if name.startswith("report_"):
            key = f"build_{name}"
            timings[key] = round(timings.get(key, 0.0) + sec, 3)
        else:
            phases[name.split("/")[0] if "/" in name else "conformed"] += sec

    t0 = time.perf_counter()
    wh = Warehouse.materialize(spark, sf_dir, scratch_path(spark, "bench"), timer=timer)
    build = time.perf_counter() - t0
    timings["build_adapter"] = round(phases["work"] + phases["staging"], 3)
    timings["build_conformed"] = round(phases["conformed"], 3)

    seasons = wh.table("report_seasons_metrics")
    season = wh.table("report_season_metrics")
    race = wh.table("report_race_metrics")
    totals = wh.table("season_totals")
    rr, races, drivers = wh.table("race_entries"), wh.table("dim_race"), wh.table("dim_driver")
    runs = {
        "q1_seasons_rank_cumulative": lambda: q.seasons_rank(seasons, *SEASONS_PODIUMS, totals),
        "q1_seasons_rank_points": lambda: q.seasons_rank(seasons, *SEASONS_POINTS, totals),
        "q1_seasons_rank": lambda: q.seasons_rank(seasons, *SEASONS_CHAMPIONS),
        "q2_season_rank_cumulative": lambda: q.season_rank(season, *SEASON_POINTS_CUM),
        "q3_race_bump": lambda: q.race_bump(race, BUMP_SEASON, BUMP_RACE),
        "q3_driver_series": lambda: display.driver_series(q.race_bump(race, BUMP_SEASON, BUMP_RACE), BUMP_FOCUS),
        "q4_race_options": lambda: q.race_options(rr, races, BUMP_SEASON),
        "q5_focus_options": lambda: q.focus_options(rr, races, drivers, BUMP_SEASON, BUMP_RACE),
    }
    t1 = time.perf_counter()
    for name, make in runs.items():
        started = time.perf_counter()
        make().collect()
        timings[name] = round(time.perf_counter() - started, 3)
    total = build + (time.perf_counter() - t1)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "build_and_query_wall_time",
        "value": round(total, 3),
        "unit": "sec",
        "queries": timings,
        "build_sec": round(build, 3),
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
