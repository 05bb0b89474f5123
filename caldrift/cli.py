"""Command lines: ``python -m caldrift.cli {analysis,backfill,collect,weekly} ...`` over Parquet tables and the devices' service."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caldrift.functions.expr import HOUR, parse_timestamp
from caldrift.operators import cycles as Y
from caldrift.operators import metrics as M
from caldrift.operators import studies as U
from caldrift.plans import analysis, backfill
from caldrift.sinks import files


def whole_numbers(text: str) -> tuple[int, ...]:
    return tuple(int(x) for x in text.split(",") if x.strip())


def positive(text: str) -> int:
    if (n := int(text)) <= 0:
        raise argparse.ArgumentTypeError(f"{text} is not positive")
    return n


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="caldrift", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    a = commands.add_parser("analysis", help="all outputs of the analysis as gzip CSV, with run_metadata.json")
    for name in ("observations", "status", "coverage", "output"):
        a.add_argument(f"--{name}", required=True)
    a.add_argument("--backends", help="comma-separated; all if not given")
    a.add_argument("--start", help="first instant of the study, ISO 8601")
    a.add_argument("--end", help="last instant of the study, ISO 8601")
    a.add_argument("--baseline-lookback-days", type=int, default=7)
    a.add_argument("--windows-hours", type=whole_numbers, default=analysis.WINDOWS)
    a.add_argument("--lags-hours", type=whole_numbers, default=analysis.LAGS)
    for name, default in (("event-tolerance-minutes", 15), ("grid-minutes", 60), ("max-load-staleness-minutes", 120), ("min-correlation-n", 8)):
        a.add_argument(f"--{name}", type=positive, default=default)

    b = commands.add_parser("backfill", help="poll metrics anew, in batches that a later call goes on with")
    b.add_argument("--root", required=True, help="folder of runs, items and metrics")
    b.add_argument("--cycles")
    b.add_argument("--properties")
    b.add_argument("--batch-size", type=positive, default=500)
    b.add_argument("--max-batches", type=positive)
    which = b.add_mutually_exclusive_group()
    which.add_argument("--run-id")
    which.add_argument("--new-run", action="store_true")
    b.add_argument("--max-retries", type=int, default=8)
    b.add_argument("--status", action="store_true", help="the last ten runs, and no more")
    b.add_argument("--dry-run", action="store_true", help="the whole job's results in number, and nothing written")

    c = commands.add_parser("collect", help="poll the devices' service and land the answers as JSON lines")
    for name in ("url", "backends", "target"):
        c.add_argument(f"--{name}", required=True)
    c.add_argument("--option", action="append", default=[], metavar="NAME=VALUE", help="another option of the device_service source")
    c.add_argument("--interval", type=positive, default=900)
    c.add_argument("--once", action="store_true")

    w = commands.add_parser("weekly", help="weekly extremes of edges' events as CSV")
    for name in ("events", "coverage", "output"):
        w.add_argument(f"--{name}", required=True)
    return top


def within(df: DataFrame, args: argparse.Namespace, lookback_days: int = 0) -> DataFrame:
    """Rows of the chosen backends and times; both reach the scan as filters."""
    if args.backends:
        df = df.where(F.col("backend").isin([x.strip() for x in args.backends.split(",") if x.strip()]))
    if args.start:
        df = df.where(F.col("t") >= parse_timestamp(F.lit(args.start)) - lookback_days * 24 * HOUR)
    return df.where(F.col("t") <= parse_timestamp(F.lit(args.end))) if args.end else df


def run_analysis(spark: SparkSession, args: argparse.Namespace) -> None:
    coverage = spark.read.parquet(args.coverage)
    if args.backends:
        coverage = coverage.where(F.col("backend").isin([x.strip() for x in args.backends.split(",") if x.strip()]))
    if args.start:
        coverage = coverage.withColumn("study_start", F.greatest("study_start", parse_timestamp(F.lit(args.start))))
    if args.end:
        coverage = coverage.withColumn("study_end", F.least("study_end", parse_timestamp(F.lit(args.end))))
    analysis.run_analysis(
        within(spark.read.parquet(args.observations), args, args.baseline_lookback_days), within(spark.read.parquet(args.status), args), coverage, windows=args.windows_hours, lags=args.lags_hours,
        tolerance_minutes=args.event_tolerance_minutes, grid_minutes=args.grid_minutes, max_staleness_minutes=args.max_load_staleness_minutes, min_n=args.min_correlation_n, output=args.output,
    )


def metrics_of(cycles: DataFrame, properties: DataFrame):  # noqa: ANN201
    """Results of a batch of items: its polls and those before them are all that is read of the properties."""

    def compute(items: DataFrame) -> DataFrame:
        wanted = Y.with_previous(items)
        some = properties.join(wanted, "cycle", "left_semi")
        found = Y.cycle_metrics(cycles.join(wanted, "cycle", "left_semi"), Y.latest_dates(some, "qubit"), Y.latest_dates(some, "edge_id"))
        return found.join(items.select("cycle"), "cycle", "left_semi")

    return compute


def run_backfill(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.status:
        for r in backfill.runs(spark, args.root).collect():
            print(json.dumps(r.asDict()))
        return
    cycles = spark.read.parquet(args.cycles)
    compute = metrics_of(cycles, spark.read.parquet(args.properties))
    if args.dry_run:
        print(json.dumps({"cycles": backfill.dry_run(cycles, compute).count()}))
        return
    options = {"run_id": args.run_id, "new_run": args.new_run}

    def step() -> str:
        try:
            return backfill.execute(spark, args.root, cycles, compute, args.batch_size, args.max_batches, **options)
        finally:
            options["new_run"] = False  # another try goes on with the run that this one began

    print(json.dumps({"run_id": backfill.with_retries(step, args.max_retries)}))


def run_collect(spark: SparkSession, args: argparse.Namespace) -> None:
    from caldrift.sources import rest

    spark.dataSource.register(rest.DeviceService)
    options = dict(x.split("=", 1) for x in args.option) | {"url": args.url, "backends": args.backends}
    if args.once:
        spark.read.format("device_service").options(**options).load().write.mode("append").json(f"{args.target}/polls")
        return
    stream = spark.readStream.format("device_service").options(poll_interval_seconds=str(args.interval), **options).load()
    stream.writeStream.format("json").option("checkpointLocation", f"{args.target}/checkpoint").trigger(processingTime=f"{args.interval} seconds").start(f"{args.target}/polls").awaitTermination()


def run_weekly(spark: SparkSession, args: argparse.Namespace) -> None:
    events, coverage = spark.read.parquet(args.events), spark.read.parquet(args.coverage)
    weekly = U.weekly_counts(events, coverage)
    extremes = U.weekly_extremes(weekly)
    out = {"weekly_counts": weekly, "weekly_extremes": extremes, "best_week": U.best_week(extremes), "full_period_ratio": U.full_period_ratio(M.cadence(events, coverage))}
    counts = {name: files.write_csv(df, f"{args.output}/{name}", compress=False) for name, df in out.items()}
    files.write_metadata(spark, f"{args.output}/run_metadata.json", {"events": args.events, "coverage": args.coverage}, counts, [])


COMMANDS = {"analysis": run_analysis, "backfill": run_backfill, "collect": run_collect, "weekly": run_weekly}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = parser()
    args = top.parse_args(argv)
    if args.command == "backfill" and not args.status and not (args.cycles and args.properties):
        top.error("backfill needs --cycles and --properties")
    COMMANDS[args.command](spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
