"""Incremental indexing: what is new since a checkpoint, folding in batches, and a file stream of symbol events."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.window import Window

from provspark.operators import temporal
from provspark.operators.temporal import VERSION, fold_versions, followed, version

EVENT = "file_path string, name string, seq long, ts long, sha string, line_start int, line_end int, text_hash long, gone boolean"
FIELDS = ["seq", "ts", "sha", "line_start", "line_end", "text_hash", "gone"]
#: Settings that a stream with keyed state needs: RocksDB, and only what changed written at each batch.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def pending(commits: DataFrame, head: str | None) -> DataFrame:
    """Commits newer than a saved head (smaller seq), oldest first; all of them if the head isn't known."""
    seen = commits.filter(F.col("sha") == F.lit(head or "")).agg(F.min("seq").alias("head"))
    return commits.join(F.broadcast(seen)).filter("head is null or seq < head").drop("head").orderBy(F.col("seq").desc())  # seen is one row


def open_as_events(versions: DataFrame, events: DataFrame) -> DataFrame:
    """The open version of each symbol as the event that opened it."""
    keys = ["file_path", "name", "seq"]
    return events.join(versions.filter("valid_to is null").select(*keys), keys, "left_semi")


def fold_in_batches(events: DataFrame, cuts: list[int]) -> DataFrame:
    """The versions of a stream of events taken in batches cut at some seq: each batch is folded behind the open versions of the one before, whose closed ones stay."""
    bounds = [None, *cuts, None]
    closed: list[DataFrame] = []
    carried = None
    for lo, hi in zip(bounds, bounds[1:]):
        batch = events.filter((F.lit(True) if lo is None else F.col("seq") >= lo) & (F.lit(True) if hi is None else F.col("seq") < hi))
        batch = batch if carried is None else carried.unionByName(batch)
        versions = fold_versions(batch)
        if hi is None:
            return reduce(DataFrame.unionByName, [*closed, versions])
        closed.append(versions.filter("valid_to is not null"))
        carried = open_as_events(versions, batch)
    raise AssertionError("unreachable")


def latest(versions: DataFrame) -> DataFrame:
    """One row for each version: closed if any batch closed it."""
    w = Window.partitionBy("file_path", "name", "seq").orderBy(F.col("valid_to").asc_nulls_last())
    return versions.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


class Versions(StatefulProcessor):
    """The open version of each symbol as keyed state; a batch's events move it on in the order of seq."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getValueState("live", "seq long, ts long, sha string, line_start int, line_end int, text_hash long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        # Plain tuples: pandas would turn whole numbers with nulls among them into floats.
        events = sorted((tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r) for f in rows for r in f[FIELDS].itertuples(index=False, name=None)), key=lambda r: r[0])
        before = live = self.live.get() if self.live.exists() else None
        out = []
        for event in events:
            ended, live = followed(live, event)
            if ended:
                out.append(ended)
        if live and live != before:
            out.append(version(live, None))
            self.live.update(live)
        elif before and not live:
            self.live.clear()
        yield pd.DataFrame([(*key, *v, "open" if v[2] is None else "closed") for v in out], columns=[*(c.split()[0] for c in VERSION.split(", ")), "state"]).astype({"valid_to": "Int64"})

    def close(self) -> None:
        pass


def version_changes(events: DataFrame) -> DataFrame:
    """Of a stream of symbol events: each version as it closes (`state` closed), and as it is left open by the batch that opened it (`state` open).

    What is kept between batches is the open version of each symbol, in Spark's state store, and what a batch writes there and to the output is in proportion to the
    batch. Events of a symbol are taken in the order of seq within a batch; one that comes in a later batch than its successors is passed over if it is older than the
    open version, as in fold_versions. A task holds the events that one symbol has in one batch, so bound a first run over a long history by maxFilesPerTrigger.
    """
    # The worker that Spark starts beside the driver doesn't get the files added to the session, so the processor goes there as code and not as the name of a module.
    for module in (temporal, sys.modules[__name__]):
        cloudpickle.register_pickle_by_value(module)
    return events.groupBy("file_path", "name").transformWithStateInPandas(Versions(), f"{VERSION}, state string", "Append", "None")


def stream_versions(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Starts a stream that appends version_changes of what is new to Parquet files at target, and ends once it has taken that; read them with `latest`.

    A run that fails is made good by the next one over the same checkpoint: the sink lists the files of each batch once.
    """
    changes = version_changes(events).observe("written", F.count("*").alias("n"))
    return changes.writeStream.format("parquet").partitionBy("state").option("checkpointLocation", checkpoint).option("path", target).outputMode("append").trigger(availableNow=True).start()
