"""Command line: inspect, preprocess, validate, summarize, export, merge, frames."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from pitwall import __version__
from pitwall.plans import dataset, frame_csv
from pitwall.sources import recording


def _show(value) -> None:
    print(json.dumps(value, ensure_ascii=False, indent=2, default=str))


def inspect(spark, a) -> int:
    _show([r.asDict() for r in recording.read(spark, a.replays, mode="header").orderBy("path", "car_index").collect()])
    return 0


def preprocess(spark, a) -> int:
    if a.config:
        specs, segment_path = dataset.session_specs(spark, a.config)
    elif a.replays:
        specs, segment_path = [{"replay": r, "setup": a.setup, "setup_sp": a.setup_sp, "setup_label": a.setup_label, "driver_name": a.driver_name} for r in a.replays], None
    else:
        raise ValueError("give recordings or --config")
    manifest = dataset.preprocess(spark, specs, a.output, a.segments or segment_path, storage=a.storage, overwrite=a.overwrite)
    _show({"status": "ok", "dataset_id": manifest["dataset_id"], "tables": manifest["tables"]})
    return 0


def validate(spark, a) -> int:
    found = dataset.validate(spark, a.dataset)
    _show(found)
    return 0 if found["status"] in ("ok", "warning") else 2


def summarize(spark, a) -> int:
    _show(dataset.summarise(spark, a.dataset))
    return 0


def export(spark, a) -> int:
    _show({"status": "ok", "rows": dataset.export(spark, a.dataset, a.table, a.output), "output": a.output})
    return 0


def merge(spark, a) -> int:
    _show({"status": "ok", "output": a.output, "tables": dataset.merge(spark, a.datasets, a.output, a.storage, a.overwrite)["tables"]})
    return 0


def frames(spark, a) -> int:
    """Convert recordings one by one; a file that fails is reported and the others go on."""
    failed = False
    for path in a.replays:
        try:
            for out in frame_csv.convert(spark, path, a.output, a.driver_name):
                print(out)
        except (OSError, recording.RecordingError, PySparkException) as error:  # what tasks raise arrives as Spark's
            failed = True
            print(f"{path}: {error}", file=sys.stderr)
    return 1 if failed else 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pitwall", description="Telemetry datasets on Spark.")
    top.add_argument("--version", action="version", version=f"pitwall {__version__}")
    sub = top.add_subparsers(dest="command", required=True)

    def command(run, *positional, **options):
        p = sub.add_parser(run.__name__)
        for name, count in positional:
            p.add_argument(name, nargs=count) if count else p.add_argument(name)
        for name, more in options.items():
            p.add_argument(f"--{name.replace('_', '-')}", **more)
        p.set_defaults(run=run)

    storage, overwrite = {"choices": [*dataset.FORMATS], "default": "auto"}, {"action": "store_true"}
    command(inspect, ("replays", "+"))
    command(preprocess, ("replays", "*"), config={}, setup={}, setup_sp={}, setup_label={}, driver_name={}, segments={}, output={"required": True}, storage=storage, overwrite=overwrite)
    command(validate, ("dataset", None))
    command(summarize, ("dataset", None))
    command(export, ("dataset", None), table={"required": True}, output={"required": True})
    command(merge, ("datasets", "+"), output={"required": True}, storage=storage, overwrite=overwrite)
    command(frames, ("replays", "+"), output={}, driver_name={})
    return top


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("pitwall").getOrCreate()
    try:
        return a.run(spark, a)
    except (OSError, ValueError, KeyError, PySparkException) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
