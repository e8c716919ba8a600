"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

from pyspark.sql import SparkSession


def settings(name: str, about: str, argv: list[str] | None, **kinds: type) -> dict:
    """Values of a job's config file, over which those of the command line go; every one must be known."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=about)
    parser.add_argument("--config", default=os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{name}.json"), help="JSON file of the values below")
    for key, kind in kinds.items():
        parser.add_argument(f"--{key.replace('_', '-')}", type=kind)
    given = vars(parser.parse_args(argv))
    with open(given.pop("config"), encoding="utf-8") as f:
        values = json.load(f)
    if unknown := sorted(set(values) - set(kinds)):
        parser.error(f"the config file has unknown values: {', '.join(unknown)}")
    values |= {k: v for k, v in given.items() if v is not None}
    if missing := sorted(k for k in kinds if values.get(k) is None):
        parser.error(f"no value for {', '.join(missing)}")
    return values


def start(name: str) -> SparkSession:
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    return SparkSession.builder.appName(f"symgraph {name}").getOrCreate()
