"""Command line: audit a file under a config, or with an inferred one."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from tidemark import report as out
from tidemark.config import load_config
from tidemark.operators.audit import audit_dataset
from tidemark.operators.autodetect import auto_detect_config
from tidemark.sources import snapshots
from tidemark.sources.readers import read_table


def main(argv: list[str] | None = None) -> int:
    """0 if clean, 1 with warnings, 2 with blockers; 1 if the data can't be read."""
    parser = argparse.ArgumentParser(prog="tidemark")
    parser.add_argument("--data", required=True)
    parser.add_argument("--config")
    parser.add_argument("--snapshots", default="snapshots")
    parser.add_argument("--reports", default="reports")
    parser.add_argument("--no-snapshot", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        frame = read_table(spark, args.data)
    except Exception as e:  # any unreadable input ends the same way
        print(f"can't read {args.data}: {e}", file=sys.stderr)
        return 1
    config = load_config(args.config) if args.config else auto_detect_config(frame, Path(args.data).stem)
    before = None if args.no_snapshot else snapshots.load_snapshot(spark, args.snapshots, config["dataset_name"])
    report = audit_dataset(frame, config, before)
    print(out.render_console(report, sys.stdout.isatty()))
    if not args.no_snapshot:
        snapshots.save_snapshot(frame, args.snapshots, config["dataset_name"])
    Path(args.reports).mkdir(parents=True, exist_ok=True)
    out.write_json(report, Path(args.reports) / f"{config['dataset_name']}.json")
    return out.exit_code(report)


if __name__ == "__main__":
    sys.exit(main())
