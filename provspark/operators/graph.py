"""Edges between symbols: from what encloses what, and from calls to names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.operators import lookup, pairing
from provspark.session import kept

#: Edges that one deal of a callee's name makes.
PAIRS = 2_000_000


def hierarchy(nodes: DataFrame) -> DataFrame:
    """For each child with a stored parent, `contains` down and `defined_by` up, at the child's first line."""
    parents = nodes.select(F.col("uid").alias("parent")).distinct()
    held = nodes.join(parents, F.col("parent_uid") == F.col("parent"))
    down = held.select(F.col("parent").alias("from_uid"), F.col("uid").alias("to_uid"), F.lit("contains").alias("kind"), "file_path", F.col("line_start").alias("line"))
    up = held.select(F.col("uid").alias("from_uid"), F.col("parent").alias("to_uid"), F.lit("defined_by").alias("kind"), "file_path", F.col("line_start").alias("line"))
    return down.unionByName(up)


def callers(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """The tightest symbol of the caller's name about each call; calls outside any are dropped. calls: (call, caller, callee, file_path, line).

    Calls of one place have one answer, and of symbols of one name and stretch only the first can be it: places and stretches meet, each once.
    """
    at = ["caller", "file_path", "line"]
    spans = nodes.groupBy(F.col("name").alias("caller"), "file_path", "line_start", "line_end").agg(F.min("uid").alias("from_uid"))
    met = lookup.about_lines(calls.select(*at).distinct(), spans, ["caller", "file_path"])
    best = met.groupBy(*at).agg(F.min(F.struct((F.col("line_end") - F.col("line_start")).alias("span"), "from_uid")).alias("best"))
    return calls.join(best, at).select("call", F.col("best.from_uid").alias("from_uid"), "callee", "file_path", "line")


def call_edges(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """`uses` from each call's symbol to the symbols of the callee's name: those of its own file where there are any, else all. A uid has one name, so no edge is met twice."""
    # Calls repeat; each different one is looked up once, and what is found is read three times.
    different = calls.select("caller", "callee", "file_path", "line").distinct().withColumn("call", F.lit(None))
    found = kept(callers(different, nodes).select("from_uid", "callee", "file_path", "line").distinct(), "calls")
    to = nodes.select(F.col("uid").alias("to_uid"), F.col("name").alias("callee"), "file_path").distinct()
    # A call with a namesake in its file meets those of that file alone; only the others meet all of the name.
    local = pairing.all_with_all(found, to, ["callee", "file_path"], PAIRS)
    abroad = pairing.all_with_all(found.join(to.select("callee", "file_path").distinct(), ["callee", "file_path"], "left_anti"), to.drop("file_path").distinct(), ["callee"], PAIRS)
    cols = ["from_uid", "to_uid", F.lit("uses").alias("kind"), "file_path", "line"]
    return local.select(*cols).unionByName(abroad.select(*cols)).filter("from_uid <> to_uid")


def edges(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    return hierarchy(nodes).unionByName(call_edges(calls, nodes))
