"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def configured(name: str, own: dict | None = None) -> dict:
    """The job's configuration file, with `own` values over it; unknown names are an error."""
    defaults = json.loads((ROOT / "jobs" / f"{name}.json").read_text())
    if unknown := set(own or {}) - set(defaults):
        raise ValueError(f"{name} has no setting {', '.join(sorted(unknown))}")
    return defaults | (own or {})


def main(name: str, about: str, paths: dict[str, str], run: Callable[..., dict]) -> None:
    """Reads arguments, starts a session, runs the job, logs what it says, and stops the session."""
    parser = argparse.ArgumentParser(prog=name, description=about)
    for path, help_ in paths.items():
        parser.add_argument(f"--{path}", required=True, help=help_)
    parser.add_argument("--config", help="a JSON file with settings that replace those beside the job")
    args = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
    own = json.loads(Path(args["config"]).read_text()) if args["config"] else None
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, *[args[p] for p in paths], config=own)
    finally:
        spark.stop()
