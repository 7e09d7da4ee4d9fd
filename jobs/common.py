"""What both jobs share: configuration, logging, command line."""

from __future__ import annotations

import argparse
import dataclasses
import json
import logging
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

LOG = logging.getLogger("jobs")
T = TypeVar("T")


def configured(kind: type[T], values: dict) -> T:
    """A configuration of the kind from the values; names it does not know are an error."""
    if unknown := set(values) - {f.name for f in dataclasses.fields(kind)}:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return kind(**values)


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON file, read with Spark, so that it may lie beside the data."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def told(event: str, **fields: object) -> None:
    """One log line of JSON."""
    LOG.info(json.dumps({"event": event} | fields, sort_keys=True, default=str))


def command(name: str, kind: type[T], run: Callable[[SparkSession, T], dict]) -> None:
    """Reads the settings of a file, replaced by those of the command line; makes and stops the session."""
    parser = argparse.ArgumentParser(name)
    parser.add_argument("--config", required=True, help="JSON file of settings")
    parser.add_argument("--set", nargs="*", default=[], metavar="NAME=VALUE", help="settings in place of the file's; values are JSON or else text")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        values = read_config(spark, args.config)
        for text in args.set:
            key, _, value = text.partition("=")
            try:
                values[key] = json.loads(value)
            except ValueError:
                values[key] = value
        run(spark, configured(kind, values))
    finally:
        spark.stop()
