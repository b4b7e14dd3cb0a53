"""What the jobs share: their configuration, settings held for a while, and counts of what was read and written."""

from __future__ import annotations

import argparse
import json
import logging
import uuid
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import Observation, SparkSession

from provspark.session import shared_dir

LOG = logging.getLogger("provspark.jobs")


def configured(description: str, default: str, paths: tuple[str, ...]) -> dict:
    """The job's configuration file with what the command line says about its paths."""
    parser = argparse.ArgumentParser(description=description)
    parser.add_argument("--config", default=str(Path(__file__).with_name(default)), help="a JSON file")
    for p in paths:
        parser.add_argument(f"--{p}")
    said = vars(parser.parse_args())
    config = json.loads(Path(said.pop("config")).read_text())
    config |= {k: v for k, v in said.items() if v is not None}
    if missing := [p for p in paths if not config.get(p)]:
        parser.error(f"no path given for {', '.join(missing)}")
    return config


@contextmanager
def settings(spark: SparkSession, held: dict[str, str]) -> Iterator[None]:
    """Holds settings and puts back what was there."""
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def seen(observation: Observation) -> dict:
    """What an observation counted; nothing where Spark found its table empty and left it out of the plan, so that it never came to count."""
    try:
        return observation.get
    except Py4JJavaError:
        return defaultdict(int)


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under the one that driver and executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
