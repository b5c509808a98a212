"""Command line: build the warehouse, then query it.

    python -m raceboard build --tables /root/testdata/sf0.1 --out <dir>
    python -m raceboard build --staging-csv <folder of name.csv files> --out <dir>
    python -m raceboard append --staging-csv <folder with some of the files> --warehouse <dir>
    python -m raceboard prune --warehouse <dir>
    python -m raceboard seasons-rank --warehouse <dir> --metric Points --cumulative --start-year 1998 --top 10
    python -m raceboard season-rank  --warehouse <dir> --metric Points --season 1999 --top 10
    python -m raceboard race-bump    --warehouse <dir> --season 1999 --race "Race 8"
    python -m raceboard race-options --warehouse <dir> --season 1999
    python -m raceboard focus-options --warehouse <dir> --season 1999 --race "Race 8"

Query commands print every result row as one JSON line, or write the result as Parquet
with ``--out <dir>``.
"""

from __future__ import annotations

import argparse

from raceboard.plans import queries as q
from raceboard.plans.append import append
from raceboard.plans.warehouse import Warehouse
from raceboard.session import get_spark
from raceboard.sources import csv_files
from raceboard.sources.versions import VersionedStore


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="raceboard")
    sub = ap.add_subparsers(dest="cmd", required=True)
    b = sub.add_parser("build")
    src = b.add_mutually_exclusive_group(required=True)
    src.add_argument("--tables", help="folder with the star-schema parquet tables")
    src.add_argument("--staging-csv", help="folder with <name>.csv staging files")
    b.add_argument("--out", required=True)
    b.add_argument("--database", help="register the tables in this catalog database, with statistics")
    b.add_argument("--multi-line", choices=["yes", "no"], help="cells of the staging files hold newlines (looked up per file, if not given)")
    a = sub.add_parser("append")
    a.add_argument("--staging-csv", required=True, help="folder with the <name>.csv files to add (any of the inputs)")
    a.add_argument("--warehouse", required=True)
    sub.add_parser("prune").add_argument("--warehouse", required=True)
    for name in ("seasons-rank", "season-rank", "race-bump", "race-options", "focus-options"):
        p = sub.add_parser(name)
        p.add_argument("--warehouse", required=True)
        p.add_argument("--out", help="write the result here as Parquet instead of printing it")
        if name in ("seasons-rank", "season-rank"):
            p.add_argument("--metric", default="Points")
            p.add_argument("--cumulative", action="store_true")
            p.add_argument("--top", type=int, default=10)
        if name == "seasons-rank":
            p.add_argument("--start-year", type=int, default=1950)
        else:
            p.add_argument("--season", type=int, required=True)
        if name in ("race-bump", "focus-options"):
            p.add_argument("--race", required=True)
    args = ap.parse_args(argv)
    spark = get_spark()

    if args.cmd == "build":
        if args.tables:
            Warehouse.materialize(spark, args.tables, args.out, database=args.database)
        else:
            multi_line = None if args.multi_line is None else args.multi_line == "yes"
            Warehouse.from_csv(spark, args.staging_csv, multi_line).write(args.out, database=args.database)
        print(f"built {args.out}")
        return
    if args.cmd == "append":
        append(spark, args.warehouse, csv_files.read_present(spark, args.staging_csv))
        print(f"appended to {args.warehouse}")
        return
    if args.cmd == "prune":
        print("\n".join(VersionedStore(spark, args.warehouse).prune()))
        return

    wh = Warehouse.open(spark, args.warehouse)
    if args.cmd == "seasons-rank":
        df = q.seasons_rank(wh.table("report_seasons_metrics"), args.metric, args.cumulative, args.start_year,
                            args.top, wh.table("season_totals"))
    elif args.cmd == "season-rank":
        df = q.season_rank(wh.table("report_season_metrics"), args.metric, args.cumulative, args.season,
                           args.top)
    elif args.cmd == "race-bump":
        df = q.race_bump(wh.table("report_race_metrics"), args.season, args.race)
    elif args.cmd == "race-options":
        df = q.race_options(wh.table("race_entries"), wh.table("dim_race"), args.season)
    else:
        df = q.focus_options(wh.table("race_entries"), wh.table("dim_race"), wh.table("dim_driver"),
                             args.season, args.race).orderBy("sort_key", "full_name")
    if args.out:
        df.write.mode("overwrite").parquet(args.out)
    else:
        for row in df.toJSON().toLocalIterator():
            print(row)


if __name__ == "__main__":
    main()
