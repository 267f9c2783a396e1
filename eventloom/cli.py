"""Command line: ``python -m eventloom.cli import ...`` and ``... refresh ...``."""

from __future__ import annotations

import argparse
import sys

from eventloom import config as conf


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="eventloom", description="Organise media files into event folders.")
    commands = p.add_subparsers(dest="command", required=True)
    i = commands.add_parser("import", help="plan and carry out an import")
    i.add_argument("-i", "--inbox-dir", help="folder with new media")
    i.add_argument("-o", "--output-dir", help="folder for event folders")
    i.add_argument("-w", "--watch-dir", action="append", help="library folder (repeat for several)")
    i.add_argument("-t", "--development-mode", action="store_true", help="development folders, copies instead of moves")
    i.add_argument("-n", "--no-operation", action="store_true", help="dry run")
    i.add_argument("-y", "--copy-mode", action="store_true", help="copy instead of moving")
    i.add_argument("-f", "--force-deep-scan", action="store_true", help="recompute library summaries")
    i.add_argument("-d", "--drop-duplicates", action="store_true", help="set files aside that a library has")
    i.add_argument("-c", "--use-existing-clusters", action="store_true", help="extend library events")
    i.add_argument("-r", "--restore-original-names", action="store_true", help="drop copy suffixes")
    i.add_argument("-g", "--gap-minutes", type=float, help="gap that separates events")
    i.add_argument("--catalogue", help="folder of the table of library summaries, kept between imports")
    r = commands.add_parser("refresh", help="write libraries' event summaries")
    r.add_argument("-l", "--library", action="append", required=True, help="library folder (repeat for several)")
    r.add_argument("-f", "--force", action="store_true", help="also where a summary exists")
    c = commands.add_parser("catalogue", help="write date;name lines of a library's events")
    c.add_argument("-l", "--library", required=True)
    c.add_argument("-o", "--output", required=True)
    y = commands.add_parser("sample", help="copy one photo of each event of a year")
    y.add_argument("-l", "--library", required=True)
    y.add_argument("-y", "--year", required=True)
    y.add_argument("-o", "--output", required=True)
    y.add_argument("-k", "--count", type=int, default=10)
    return p


def configured(args: argparse.Namespace) -> conf.Config:
    """Settings of an import from its arguments; flags that aren't given keep what the environment says."""
    from datetime import timedelta

    return conf.override(
        conf.load(args.development_mode),
        inbox=args.inbox_dir, outbox=args.output_dir,
        libraries=None if args.watch_dir is None else conf.library_arguments(args.watch_dir),
        no_operation=args.no_operation or None, copy=args.copy_mode or None, deep_scan=args.force_deep_scan or None,
        skip_duplicates=args.drop_duplicates or None, use_existing=args.use_existing_clusters or None,
        restore_names=args.restore_original_names or None,
        gap=None if args.gap_minutes is None else timedelta(minutes=args.gap_minutes), catalogue=args.catalogue,
    )


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from eventloom import runtime

    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("eventloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return _carry_out(spark, args)
    finally:
        runtime.drop_scratch(spark)


def _carry_out(spark, args: argparse.Namespace) -> int:
    if args.command == "refresh":
        from eventloom.sources.library import refresh

        done = refresh(spark, conf.library_arguments(args.library), conf.load(), args.force)
        print(f"{done.count()} event folders")
        return 0
    if args.command in ("catalogue", "sample"):
        from eventloom.plans import reports

        if args.command == "catalogue":
            reports.library_catalogue(spark, args.library).write.mode("overwrite").text(args.output)
        else:
            reports.export_sample(reports.year_sample(spark, args.library, args.year, args.count), args.output)
        return 0
    from eventloom.plans.importing import run

    print(run(spark, configured(args)).summary())
    return 0


if __name__ == "__main__":
    sys.exit(main())
