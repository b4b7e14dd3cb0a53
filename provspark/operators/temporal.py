"""Versions in time: snapshots, diffs between snapshots, and the fold that opens and closes symbol versions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provspark.functions import paths

VERSION = "file_path string, name string, seq long, valid_from long, valid_to long, sha string, line_start int, line_end int"
CHANGE_RANK = {"added": 0, "changed": 1, "superseded": 2, "removed": 3}


def nodes_at(nodes: DataFrame, at: Column, scope: str | None = None) -> DataFrame:
    """Symbol versions that hold at an instant."""
    return nodes.filter(paths.valid_at(at) & paths.in_scope(F.col("file_path"), scope))


def _between_valid(edges: DataFrame, nodes: DataFrame, at: Column) -> DataFrame:
    valid = nodes.filter(paths.valid_at(at)).select("uid")
    return edges.join(valid.withColumnRenamed("uid", "from_uid"), "from_uid", "left_semi").join(valid.withColumnRenamed("uid", "to_uid"), "to_uid", "left_semi")


def edges_at(edges: DataFrame, nodes: DataFrame, at: Column, scope: str | None = None) -> DataFrame:
    """Edges in scope whose both ends hold at an instant."""
    return _between_valid(edges.filter(paths.in_scope(F.col("file_path"), scope)), nodes, at)


def edge_list_at(edges: DataFrame, nodes: DataFrame, at: Column, scope: str | None = None, limit: int = 400) -> DataFrame:
    """The first of the edges, in scope by path or by an end; ordered so that the cut is always the same."""
    return _between_valid(edges.filter(paths.edge_in_scope(scope)), nodes, at).orderBy("from_uid", "to_uid", "kind", "line").limit(limit)


def decisions_at(decisions: DataFrame, at: Column, scope: str | None = None) -> DataFrame:
    return decisions.filter((F.col("timestamp") <= at) & paths.decision_in_scope(F.col("file_path"), scope))


def decisions_by_day(decisions: DataFrame, day: str, zone: str = "UTC") -> DataFrame:
    """Decisions made on or before a local day."""
    return decisions.filter(local_day(F.col("timestamp"), zone) <= F.lit(day).cast("date"))


def local_day(instant: Column, zone: str = "UTC") -> Column:
    return F.to_date(instant if zone == "UTC" else F.from_utc_timestamp(instant, zone))


def local_day_end(day: Column, zone: str = "UTC") -> Column:
    """The last second of a local day, in UTC; null for what is no `yyyy-MM-dd` day."""
    end = F.try_to_timestamp(F.concat(F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day), F.lit(" 23:59:59")))
    return end if zone == "UTC" else F.to_utc_timestamp(end, zone)


def timeline(nodes: DataFrame, scope: str | None = None) -> DataFrame:
    """Days on which a symbol in scope changed."""
    return nodes.filter(paths.in_scope(F.col("file_path"), scope)).select(F.to_date("valid_from").alias("day")).distinct()


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Decisions added, superseded, changed or removed from one snapshot to another, one row each."""
    a, b = old.alias("a"), new.alias("b")
    kind = (
        F.when(F.col("a.uid").isNull(), "added").when(F.col("b.uid").isNull(), "removed")
        .when((F.col("a.status") != F.col("b.status")) & (F.col("b.status") == "superseded"), "superseded")
        .when((F.col("a.status") != F.col("b.status")) | (F.col("a.content") != F.col("b.content")) | (F.col("a.reason") != F.col("b.reason")), "changed")
    )
    both = a.join(b, F.col("a.uid") == F.col("b.uid"), "full_outer").select(
        kind.alias("kind"), F.coalesce("b.uid", "a.uid").alias("uid"), F.coalesce("b.content", "a.content").alias("content"), F.col("a.status").alias("old_status"), F.col("b.status").alias("new_status"),
        F.coalesce("b.file_path", "a.file_path").alias("file_path"), F.coalesce("b.timestamp", "a.timestamp").alias("timestamp"),
    )
    return both.filter("kind is not null")


def ranked_changes(found: DataFrame) -> DataFrame:
    rank = F.coalesce(*[F.when(F.col("kind") == k, r) for k, r in CHANGE_RANK.items()])
    return found.orderBy(rank, "content", "uid")


def change_counts(found: DataFrame) -> DataFrame:
    """One row with a count for each kind."""
    return found.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in CHANGE_RANK])


def tightest_first(nodes: DataFrame, limit: int = 8) -> DataFrame:
    """The tightest version of each (file, name), the first few in order of appearance (seq)."""
    w = Window.partitionBy("file_path", "name")
    best = nodes.withColumn("shown", F.min("seq").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.col("line_end") - F.col("line_start"), "seq"))).filter("rank = 1")
    return best.orderBy("shown").limit(limit).select(F.format_string("%s %s @ %s:%d-%d", "kind", "name", "file_path", "line_start", "line_end").alias("summary"), "shown")


def snapshot(nodes: DataFrame, edges: DataFrame, decisions: DataFrame, at: Column, day: str, scope: str | None = None) -> DataFrame:
    """One row: how many symbols, edges and visible decisions a snapshot holds."""
    shown = decisions_by_day(decisions.filter(paths.visible() & paths.starts_with(F.col("file_path"), scope)), day)
    counts = [nodes_at(nodes, at, scope).agg(F.count("*").alias("nodes")), edges_at(edges, nodes, at, scope).agg(F.count("*").alias("edges")), shown.agg(F.count("*").alias("decisions"))]
    out = counts[0]
    for c in counts[1:]:
        out = out.join(F.broadcast(c))  # one row each
    return out


def tombstones(snapshots: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_path, name, seq, ts, sha): where a symbol of a file's snapshot is missing in the file's next one.

    snapshots: (file_path, seq, ts, sha), one for each commit that touched the file, also if it emptied it; symbols: (file_path, name, seq).
    """
    follow = Window.partitionBy("file_path").orderBy("seq")
    nxt = snapshots.select("file_path", "seq", F.lead("seq").over(follow).alias("next_seq"), F.lead("ts").over(follow).alias("ts"), F.lead("sha").over(follow).alias("sha")).filter("next_seq is not null")
    names = symbols.select("file_path", "name", "seq").distinct()
    left = names.join(nxt, ["file_path", "seq"]).select("file_path", "name", F.col("next_seq").alias("seq"), "ts", "sha")
    return left.join(names, ["file_path", "name", "seq"], "left_anti")


def followed(live: tuple | None, event: tuple) -> tuple[tuple | None, tuple | None]:
    """What an event (seq, ts, sha, line_start, line_end, text_hash, gone) does to a symbol: (the version that it ends, the one open after it), none where there is none."""
    seq, ts, sha, start, end, text, gone = event
    if gone:
        return (version(live, ts) if live else None), None
    if live and (live[1] > ts or (live[3:5] == (start, end) and (live[2] == sha or live[5] == text))):
        return None, live
    return (version(live, ts) if live else None), (seq, ts, sha, start, end, text)


def version(live: tuple, until: int | None) -> tuple:
    """(seq, valid_from, valid_to, sha, line_start, line_end)."""
    seq, ts, sha, start, end, _ = live
    return seq, ts, until, sha, start, end


def fold_versions(events: DataFrame) -> DataFrame:
    """(file_path, name, seq, valid_from, valid_to, sha, line_start, line_end): the versions that a stream of symbol events opens, and when each closes.

    events: (file_path, name, seq, ordinal, ts long, sha, line_start, line_end, text_hash, gone). In the order of (seq, ordinal), a symbol's event opens a version unless
    the open one is younger than the event, or has its range and its commit or text; a `gone` event closes. Events come sorted and are folded as they pass, so a symbol
    with very many events takes no memory of its own.
    """
    fields = ["file_path", "name", "seq", "ts", "sha", "line_start", "line_end", "text_hash", "gone"]
    schema = VERSION
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32())
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)], names)
            out.clear()
            return batch

        for symbol, events_ in groupby(rows, key=lambda r: r[:2]):
            live = None
            for event in events_:
                ended, live = followed(live, event[2:])
                if ended:
                    out.append((*symbol, *ended))
            if live:
                out.append((*symbol, *version(live, None)))
            if len(out) > 5000:
                yield flush()
        yield flush()

    ordinal = "ordinal" if "ordinal" in events.columns else "seq"
    sorted_ = events.repartition("file_path", "name").sortWithinPartitions("file_path", "name", "seq", ordinal)
    return sorted_.select(*fields).mapInArrow(work, schema)
