"""What the jobs share: their config, their command line and their log."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import SparkSession

log = logging.getLogger("lexatlas.jobs")


def config(spark: SparkSession, path: str) -> dict:
    """A JSON file of settings, read by Spark, so that it may lie anywhere that Spark reads."""
    return json.loads(spark.read.option("wholetext", True).text(path).first()[0])


def command(name: str, work: Callable[[SparkSession, dict, dict], object], paths: dict[str, str], argv: list[str] | None = None) -> None:
    """``python -m jobs.<name> CONFIG --<path> PATH ...``: creates the session, runs ``work`` and stops it."""
    p = argparse.ArgumentParser(prog=name)
    p.add_argument("config", help="JSON file of settings")
    for path, what in paths.items():
        p.add_argument(f"--{path}", required=True, help=what)
    given = vars(p.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        work(spark, config(spark, given.pop("config")), given)
    finally:
        spark.stop()
