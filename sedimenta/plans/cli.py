"""Command line: run FILE, profile FILE [METRIC...], list FOLDER, schedule FILE (--cron LINE | --every SECONDS), adapters, capabilities."""

from __future__ import annotations

import argparse
import json
import sys

from sedimenta.errors import PipelineConfigError
from sedimenta.plans.config import EnvSecrets, build_connector, build_pipeline, list_configs, load_config, run_config
from sedimenta.plans.pipeline import capabilities, run_scheduled
from sedimenta.plans.schedule import CronTrigger, IntervalTrigger, Scheduler


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sedimenta")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="run a pipeline file")
    run.add_argument("file")
    run.add_argument("--end", default="today")
    profile = commands.add_parser("profile", help="profile the first source of a pipeline file")
    profile.add_argument("file")
    profile.add_argument("metrics", nargs="*")
    profile.add_argument("--limit", type=int)
    profile.add_argument("--html", action="store_true")
    commands.add_parser("capabilities", help="what this engine offers")
    commands.add_parser("adapters", help="destinations, state stores and run logs by name")
    listing = commands.add_parser("list", help="the pipeline files of a folder")
    listing.add_argument("folder")
    plan = commands.add_parser("schedule", help="run a pipeline file again and again")
    plan.add_argument("file")
    plan.add_argument("--cron", help="minute hour day month weekday")
    plan.add_argument("--every", type=float, help="seconds")
    plan.add_argument("--times", type=int)
    args = parser.parse_args(argv)
    if args.command == "capabilities":
        print(json.dumps(capabilities(), indent=2))
        return 0
    if args.command == "adapters":
        known = capabilities()
        print(json.dumps({k: known[k] for k in ("destinations", "state_stores", "run_logs")}, indent=2))
        return 0
    if args.command == "list":
        print(json.dumps(list_configs(args.folder), indent=2))
        return 0
    try:
        config = load_config(args.file)
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("sedimenta").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        if args.command == "schedule":
            if bool(args.cron) == bool(args.every):
                raise PipelineConfigError("a schedule has either --cron or --every")
            trigger = CronTrigger(args.cron) if args.cron else IntervalTrigger(args.every)
            Scheduler(lambda: run_scheduled(build_pipeline(config), spark), trigger).run(args.times)
            return 0
        if args.command == "run":
            result, _ = run_config(config, spark, args.end)
            for s in result.steps:
                print(f"{s.name}: {s.status}, {s.rows_loaded} rows" + (f", {s.error}" if s.error else ""))
            return 0 if result.success else 1
        source = (config.get("sources") or [config.get("connector")])[0]
        report = build_connector(source, None, EnvSecrets(), inspect=True).profile(spark, *args.metrics, scope="sample" if args.limit else "full", limit=args.limit)
        print(report.render_html() if args.html else report.render_text())
        return 0
    except PipelineConfigError as e:
        print(f"configuration: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
