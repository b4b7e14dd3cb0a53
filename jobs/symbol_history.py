"""When each symbol's versions began and ended, kept up to date as new events arrive.

A stream over files of events: each run takes the files that the checkpoint hasn't seen, moves the open version of each symbol on (keyed state), and appends what opened and
closed. The output's newest row of a version is the version (`history`).

    python -m jobs.symbol_history --events /data/events --out /data/history --checkpoint /data/history-checkpoint
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession

from jobs.common import LOG, configured, settings
from provspark.operators.temporal import VERSION
from provspark.plans.lenses import LENSES
from provspark.session import ship
from provspark.streaming.incremental import STATE_STORE, latest, stream_versions


def symbol_events(events: DataFrame) -> DataFrame:
    """Events of users as events of symbols in files."""
    return events.sparkSession.sql(LENSES["symbol_events"][1].replace("from events", "from {events}"), events=events)


def history(spark: SparkSession, out: str) -> DataFrame:
    """The versions as they stand in the output."""
    return latest(spark.read.schema(f"{VERSION}, state string").parquet(out)).drop("state")


def run(spark: SparkSession, events: str, out: str, checkpoint: str, max_files: int = 100) -> DataFrame:
    """Takes what is new in the folder (or the files of a pattern) `events`, and returns the whole history. Run again with nothing new it changes nothing.

    Events without a seq come first among those of their batch; no input files are an error of the reader, as the columns can't be known then.
    """
    with settings(spark, STATE_STORE):
        arriving = spark.readStream.schema(spark.read.parquet(events).schema).option("maxFilesPerTrigger", max_files).parquet(events)
        query = stream_versions(symbol_events(arriving), out, checkpoint)
        query.awaitTermination()
    batches = [p for p in query.recentProgress if p.numInputRows]
    LOG.info("%s: read %d events in %d batches", events, sum(p.numInputRows for p in batches), len(batches))
    for p in batches:
        LOG.info("%s: batch %d wrote %d rows, %d symbols are held in state", out, p.batchId, p.observedMetrics["written"]["n"], sum(s.numRowsTotal for s in p.stateOperators))
    return history(spark, out)


def main() -> None:
    logging.basicConfig(level=logging.INFO)
    config = configured(__doc__.splitlines()[0], "symbol_history.json", ("events", "out", "checkpoint"))
    spark = SparkSession.builder.appName("symbol-history").getOrCreate()
    try:
        run(ship(spark), **config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
