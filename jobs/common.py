"""What the jobs share: settings, the log, counts of what was written, and the command line."""

from __future__ import annotations

import argparse
import logging
import os
import tempfile
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from kymo.sources.tables import load_settings

HERE = Path(__file__).resolve().parent


def settings_of(job: str, path: str | None = None) -> dict[str, Any]:
    """The job's settings: those beside its code, replaced one by one by those of the file at path."""
    return load_settings(str(HERE / f"{job}.json")) | (load_settings(path) if path else {})


def logger(job: str) -> logging.Logger:
    return logging.getLogger(f"jobs.{job}")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all run in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.mkdtemp(prefix='jobs-')}"


def main(job: str, run: Callable[..., Any], about: str) -> None:
    """Command line: creates the session, runs the job, stops the session."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{job}", description=about)
    parser.add_argument("--input", required=True, help="path of the table to read")
    parser.add_argument("--output", required=True, help="folder of everything that the job writes")
    parser.add_argument("--settings", help=f"JSON or YAML settings that replace those of jobs/{job}.json")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (str(HERE.parent), os.environ.get("PYTHONPATH")) if p)
    spark = SparkSession.builder.appName(job).getOrCreate()
    try:
        run(spark, args.input, args.output, settings_of(job, args.settings))
    finally:
        spark.stop()

