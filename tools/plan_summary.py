"""Physical-plan operator counts for the report builds and the dashboard queries.

usage: python tools/plan_summary.py [sf_dir]   (prints a markdown table)
"""

from __future__ import annotations

import collections
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

OPS = ("Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange SinglePartition", "BroadcastExchange",
       "SortMergeJoin", "BroadcastHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct", "HashAggregate",
       "ObjectHashAggregate", "SortAggregate", "Window ", "WindowGroupLimit", "Generate", "BatchEvalPython",
       "ArrowEvalPython")


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from raceboard.plans import queries as q
    from raceboard.plans import reports
    from raceboard.plans.registry import BUMP_RACE, BUMP_SEASON, SEASON_POINTS_CUM, SEASONS_PODIUMS
    from raceboard.plans.warehouse import built_warehouse
    from raceboard.session import get_spark, scratch_path
    spark = get_spark("local[8]", 8)
    wh = built_warehouse(spark, sf)
    scratch = scratch_path(spark, "plan-summary")

    def persist(name, df):  # the build's stage boundaries, as in Warehouse.materialize
        df.write.mode("overwrite").parquet(f"{scratch}/{name}")
        return spark.read.parquet(f"{scratch}/{name}")

    frames = {f"build {n}": b() for n, b in reports.builders(wh.conformed, persist=persist).items()}
    frames["Q1 seasons_rank (cumulative)"] = q.seasons_rank(wh.table("report_seasons_metrics"), *SEASONS_PODIUMS)
    frames["Q2 season_rank (cumulative)"] = q.season_rank(wh.table("report_season_metrics"), *SEASON_POINTS_CUM)
    frames["Q3 race_bump"] = q.race_bump(wh.table("report_race_metrics"), BUMP_SEASON, BUMP_RACE)
    print("| plan | " + " | ".join(o.strip() for o in OPS) + " |")
    print("| --- | " + " | ".join("---" for _ in OPS) + " |")
    for name, df in frames.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        counts = collections.Counter()
        for line in plan.splitlines():
            for op in OPS:
                if re.search(r"[+:-]\s*" + re.escape(op) if op != "Window " else r"[+:-]\s*Window \[", line):
                    counts[op] += 1
        print(f"| {name} | " + " | ".join(str(counts[o]) for o in OPS) + " |")


if __name__ == "__main__":
    main()
