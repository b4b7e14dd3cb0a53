"""Binding decisions to the lines they speak of: by the lines their commit changed, by their own line, or by what their prose names."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provspark.functions import paths, text
from provspark.operators import lookup

# How much a decision may bind to in the index.
MOST_CHANGED, MOST_PER_FILE_WHEN_HUGE = 1000, 200
MOST_FILES, MOST_LINES = 10, 250
GOVERNED_FILES, GOVERNED_NODES_PER_FILE, GOVERNED_NODES, NAME_FILES = 12, 60, 200, 3
_HUNK = re.compile(r"@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,[0-9]+)? @@")


def lines_added(patch: str | None) -> list[int]:
    """New-file numbers of the lines that a patch of one file adds, each once; a null patch has none."""
    at, told = None, {}
    for line in (patch or "").split("\n"):
        if m := _HUNK.match(line):
            at = int(m[1])
        elif at is not None and not line.startswith("\\") and (not line.startswith("-") or line.startswith("---")):
            if line.startswith("+") and not line.startswith("+++"):
                told[at] = None
            at += 1
    return list(told)


def changed_lines(patches: DataFrame) -> DataFrame:
    """(id, line): new-file numbers of the lines a unified diff adds. patches: (id, patch).

    A hunk header sets the counter; added and context lines move it, removed lines and `\\` notes don't. Lines that begin with +++ or --- count as context.
    A patch is read where it lies; only numbers are shuffled, for ids that have several patches.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, found = [], []
            for at, patch in enumerate(b.column("patch").to_pylist()):
                own = lines_added(patch)
                of += [at] * len(own)
                found += own
                if len(found) > 50_000:
                    yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(of, pa.int64())), pa.array(found, pa.int32())], ["id", "line"])
                    of, found = [], []
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(of, pa.int64())), pa.array(found, pa.int32())], ["id", "line"])

    # Dealt by id first, so that no task gathers what it has read of all ids before it hands it on.
    return patches.select("id", "patch").mapInArrow(work, f"id {patches.schema['id'].dataType.simpleString()}, line int").repartition("id").distinct()


def bind_lines(changed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(decision_uid, node_uid, file_path, line): every changed line with the tightest version about it, whenever that held, however many a decision has. changed: (decision_uid, file_path, line)."""
    # The tightest version hangs on file and line alone: each changed line asks once, and of spans with the same lines one answers.
    spans = nodes.groupBy("file_path", "line_start", "line_end").agg(F.min("uid").alias("node_uid"))
    met = lookup.about_lines(changed.select("file_path", "line").distinct(), spans, "file_path")
    tightest = met.groupBy("file_path", "line").agg(F.min(F.struct((F.col("line_end") - F.col("line_start")).alias("size"), "node_uid"))["node_uid"].alias("node_uid"))
    each = changed.select("decision_uid", "file_path", "line").repartition("decision_uid").distinct()
    return each.join(tightest, ["file_path", "line"]).select("decision_uid", "node_uid", "file_path", "line")


def bind_changed(changed: DataFrame, nodes: DataFrame) -> DataFrame:
    """bind_lines as the index keeps it: a huge change binds only the first lines of each file that lie in symbols."""
    huge = changed.select("decision_uid", "file_path", "line").distinct().groupBy("decision_uid").agg(F.count("*").alias("n")).filter(F.col("n") > MOST_CHANGED).select("decision_uid", F.lit(True).alias("huge"))
    nth = F.row_number().over(Window.partitionBy("decision_uid", "file_path").orderBy("line"))
    bound = bind_lines(changed, nodes).join(huge, "decision_uid", "left").withColumn("_k", nth)
    return bound.filter(F.col("huge").isNull() | (F.col("_k") <= MOST_PER_FILE_WHEN_HUGE)).select("decision_uid", "node_uid", "file_path", "line")


def capped(links: DataFrame, max_files: int = MOST_FILES, max_lines: int = MOST_LINES) -> DataFrame:
    """The links of decisions that don't claim too many files or lines."""
    fits = links.groupBy("decision_uid").agg(F.count_distinct("file_path").alias("files"), F.count("*").alias("lines")).filter(f"files <= {max_files} and lines <= {max_lines}").select("decision_uid")
    return links.join(fits, "decision_uid", "left_semi")


def bind_own_line(decisions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Decisions without a commit bind to the symbol about their own line."""
    own = decisions.filter((text.sha_of(F.col("source_ref")) == "") & (F.col("file_path") != "") & F.col("line").isNotNull()).select(F.col("uid").alias("decision_uid"), "file_path", "line")
    return bind_lines(own, nodes)


def bind_governed(prose: DataFrame, nodes: DataFrame) -> DataFrame:
    """(decision_uid, node_uid, file_path, line): symbols that a document governs or names. prose: (decision_uid, text); nodes: representatives, with seq."""
    in_file = nodes.withColumn("_n", F.row_number().over(Window.partitionBy("file_path").orderBy("line_start", "seq"))).filter(F.col("_n") <= GOVERNED_NODES_PER_FILE)
    files = nodes.select("file_path").distinct()
    said = prose.select("decision_uid", F.posexplode(F.array_distinct(F.concat(text.governed_paths(F.col("text")), text.backtick_paths(F.col("text"))))).alias("nth", "path")).filter("path <> ''")
    exact = said.join(files.withColumnRenamed("file_path", "path"), "path").select("decision_uid", "nth", "path", F.col("path").alias("file_path"), F.lit(1).alias("k"))
    # A folder stands for the files under it: each file is posted under its folders, so this too is an equality.
    parts = F.split("file_path", "/")
    under = files.select("file_path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("folder"))
    asked = said.join(exact.select("decision_uid", "path"), ["decision_uid", "path"], "left_anti").withColumn("folder", F.regexp_replace("path", "/+$", ""))
    nth_file = F.row_number().over(Window.partitionBy("decision_uid", "path").orderBy("file_path"))
    folders = asked.join(under.filter("folder <> file_path"), "folder").withColumn("k", nth_file).filter(F.col("k") <= GOVERNED_FILES).select("decision_uid", "nth", "path", "file_path", "k")
    by_path = exact.unionByName(folders).join(in_file.select("file_path", F.col("uid").alias("node_uid"), F.col("line_start").alias("line"), F.col("_n").alias("at")), "file_path")
    order = Window.partitionBy("decision_uid").orderBy("nth", "k", "at")
    by_path = by_path.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= GOVERNED_NODES + GOVERNED_NODES_PER_FILE - 1)
    return by_path.select("decision_uid", "node_uid", "file_path", "line").unionByName(_by_name(prose, nodes)).distinct()


def _by_name(prose: DataFrame, nodes: DataFrame) -> DataFrame:
    names = nodes.groupBy("name").agg(F.count_distinct("file_path").alias("files"))
    said = prose.select("decision_uid", F.explode(F.array_distinct(text.backtick_names(F.col("text")))).alias("said"))
    whole = said.join(names.withColumnRenamed("name", "said"), "said").withColumn("name", F.col("said"))
    last = said.filter("said like '%.%'").join(names.select(F.col("name").alias("said")), "said", "left_anti").withColumn("name", F.regexp_extract("said", r"([^.]*)$", 1)).join(names, "name")
    cols = ["decision_uid", "said", "name", "files"]
    meant = whole.select(*cols).unionByName(last.select(*cols)).filter((F.col("files") <= NAME_FILES) & (((F.col("files") == 1) & (F.length("said") >= 4)) | paths.is_distinctive(F.col("said"))))
    n = nodes.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("seq"))).filter(F.col("_n") <= GOVERNED_NODES_PER_FILE)
    return meant.select("decision_uid", "name").distinct().join(n.select("name", F.col("uid").alias("node_uid"), "file_path", F.col("line_start").alias("line")), "name").select("decision_uid", "node_uid", "file_path", "line")
