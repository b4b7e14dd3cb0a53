"""Reports over the graph, JSON rows of the public contract, and the context pack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provspark.functions import paths
from provspark.operators import selection, temporal

DECISION_KEYS = ("uid", "content", "reason", "alternatives", "status", "source", "source_ref", "timestamp", "author", "file_path", "line", "constraints", "confidence", "category", "tier")
NODE_KEYS = ("uid", "kind", "name", "file_path", "line_start", "line_end", "language", "commit_sha")


def decision_json(decisions: DataFrame) -> DataFrame:
    return decisions.select("uid", F.to_json(F.struct(*DECISION_KEYS), {"ignoreNullFields": "false"}).alias("json"))


def node_json(nodes: DataFrame) -> DataFrame:
    return nodes.select("uid", F.to_json(F.struct(*NODE_KEYS), {"ignoreNullFields": "false"}).alias("json"))


def conflict_rows(found: DataFrame, decisions: DataFrame) -> DataFrame:
    """Conflicts (type, uid_a, uid_b, place, matched, rank) with what both decisions say, and why they are held against each other."""
    said = decisions.select("uid", F.struct("uid", "content", "source_ref", "file_path", "status").alias("said"))
    both = found
    for side in "ab":
        both = both.join(said.select(F.col("uid").alias(f"uid_{side}"), F.col("said").alias(f"decision_{side}")), f"uid_{side}")
    terms = F.array_join("matched", " / ")
    told = F.when(F.col("type") == "supersede", "one claims to supersede the other, which still stands").when(F.col("type") == "temporal", F.concat(F.lit("turned around in one file within days: "), terms)).otherwise(F.concat(F.lit("opposite terms in one place: "), terms))
    return both.select("type", "decision_a", "decision_b", F.col("place").alias("location"), F.col("matched").alias("matched_words"), told.alias("explanation"), F.lit(1.0).alias("confidence"), "rank")


def change_rows(found: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes (kind, uid, old_status) with the decision as it is now, or was before it went."""
    cols = ["content", "reason", "source", "source_ref", "status", "file_path", "timestamp"]
    last = new.select("uid", *cols).unionByName(old.join(new.select("uid"), "uid", "left_anti").select("uid", *cols))
    return found.select("kind", "uid", "old_status").join(last, "uid").select("kind", "uid", "content", "reason", "source", "source_ref", "status", "old_status", "file_path", "timestamp")


def by_language(nodes: DataFrame) -> DataFrame:
    return nodes.filter(paths.is_live()).groupBy("language").agg(F.count("*").alias("n"))


def graph_summary(nodes: DataFrame) -> DataFrame:
    """One row of counts over the versions, in one pass."""
    return nodes.agg(
        F.count("*").alias("nodes"), F.count_if(F.col("valid_to").isNull()).alias("live"), F.count_if(F.coalesce("name", F.lit("")) == "").alias("nameless"),
        F.count_if(F.col("line_end") < F.col("line_start")).alias("bad_range"), F.count_distinct("file_path").alias("files"),
    )


def decision_summary(decisions: DataFrame) -> DataFrame:
    reason = F.coalesce("reason", F.lit(""))
    decided = F.count_if(F.col("tier") == "decision")
    return decisions.agg(
        F.count("*").alias("records"), decided.alias("decisions"), F.count_if(reason != "").alias("with_reason"), F.count_if((reason != "") & (F.length(reason) < 12)).alias("stub_reason"),
        F.round(decided / F.greatest(F.count("*"), F.lit(1)), 4).alias("share"),
    )


def counts_by(decisions: DataFrame, column: str) -> DataFrame:
    value = F.round(F.col(column), 2) if column == "confidence" else F.col(column)
    return decisions.groupBy(value.alias(column)).agg(F.count("*").alias("n"))


def bound_decisions(decisions: DataFrame, links: DataFrame) -> DataFrame:
    """How many decision-tier records have a link."""
    return decisions.filter("tier = 'decision'").join(links.select(F.col("decision_uid").alias("uid")), "uid", "left_semi").agg(F.count_distinct("uid").alias("bound"))


def governed_files(links: DataFrame) -> DataFrame:
    return links.select(F.col("decision_uid").alias("uid"), "file_path").distinct()


def verdicts(probes: DataFrame, answers: DataFrame, fallback: DataFrame) -> DataFrame:
    """(verdict, n): what probes get: a decision by its level, a governed record of the file, or nothing. answers: (probe, level)."""
    level = answers.groupBy("probe").agg(F.min("level").alias("level"))
    governed = fallback.select("probe").distinct().withColumn("governed", F.lit(True))
    said = F.when(F.col("level").isNotNull(), F.concat(F.lit("decision:"), "level")).when(F.col("governed"), "governed").otherwise("none")
    return probes.select("probe").join(level, "probe", "left").join(governed, "probe", "left").groupBy(said.alias("verdict")).agg(F.count("*").alias("n"))


def percentiles(values: DataFrame, column: str) -> DataFrame:
    """One row: p50, p95 and p99 by linear interpolation, exact, and the mean; nulls where there are no values."""
    p50, p95, p99 = selection.percentiles(values, column, (0.5, 0.95, 0.99))
    return values.agg(*[F.lit(p).cast("double").alias(name) for name, p in (("p50", p50), ("p95", p95), ("p99", p99))], F.avg(column).alias("mean"))


def sampled(links: DataFrame, nodes: DataFrame, n: int = 20, seed: int = 7) -> DataFrame:
    """(file_path, line, origin): n lines to ask about, half of them lines that have a link and half the middle lines of live symbols, spread over both alike each time.

    A bottom-k sample: each side's lines are ranked by a seeded digest, and its least few are kept; that is one heap of a few rows a task and one merge of those. A line
    that both sides offer counts as linked; where one side has too few, the other fills up.
    """
    linked = links.filter("line is not null").select("file_path", "line").distinct()
    middle = (F.col("line_start") + F.floor((F.col("line_end") - F.col("line_start")) / 2)).cast("int").alias("line")
    middles = nodes.filter(paths.is_live() & (F.col("line_end") >= F.col("line_start"))).select("file_path", middle).distinct()
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), "file_path", F.col("line").cast("string")))
    least = lambda rows, k: rows.withColumn("digest", key).orderBy("digest", "file_path", "line").limit(k)
    first = least(linked, n).withColumn("origin", F.lit("link"))
    second = least(middles.join(linked, ["file_path", "line"], "left_anti"), n).withColumn("origin", F.lit("symbol"))
    # At most 2n rows from here on. Ranks within each side first: the half, then what fills up.
    both = first.unionByName(second).withColumn("rank", F.row_number().over(Window.partitionBy("origin").orderBy("digest", "file_path", "line")))
    half = F.when(F.col("origin") == "link", n - n // 2).otherwise(n // 2)
    return both.orderBy(F.col("rank") > half, "rank", "origin").limit(n).select("file_path", "line", "origin")


def graph_payload(nodes: DataFrame, edges: DataFrame, decisions: DataFrame, links: DataFrame, at: Column, scope: str | None) -> DataFrame:
    """One row: symbols, edges, visible decisions in scope (their own path or a governed one), and those of them still accepted."""
    shown = paths.governed_scope(decisions.filter(paths.visible()), links, scope)
    counts = [
        temporal.nodes_at(nodes, at, scope).agg(F.count("*").alias("nodes")), temporal.edges_at(edges, nodes, at, scope).agg(F.count("*").alias("edges")),
        shown.agg(F.count("*").alias("decisions"), F.count_if(F.col("status") == "accepted").alias("accepted")),
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.join(F.broadcast(c))  # one row each
    return out


def graph_view(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...], limit: int = 250) -> tuple[DataFrame, DataFrame]:
    """The first symbols of some kinds, and the edges both of whose ends are among them."""
    shown = nodes.filter(F.col("kind").isin(*kinds)).orderBy("file_path", "line_start", "uid").limit(limit)
    ids = F.broadcast(shown.select("uid"))  # at most `limit` rows
    held = edges.join(ids.withColumnRenamed("uid", "from_uid"), "from_uid", "left_semi").join(ids.withColumnRenamed("uid", "to_uid"), "to_uid", "left_semi")
    return shown, held


def context_pack(nodes: DataFrame, decisions: DataFrame, nodes_per_file: int = 30, decisions_per_node: int = 3) -> DataFrame:
    """(file_path, markdown): for each file its first symbols, each with the first decisions of the file.

    A decision belongs to a file whose path its own begins with; that is an equality of whole paths here, and of path beginnings for the few decisions deeper than any file.
    """
    n = nodes.withColumn("_n", F.row_number().over(Window.partitionBy("file_path").orderBy("line_start", "uid"))).filter(F.col("_n") <= nodes_per_file)
    first = decisions.withColumn("_k", F.row_number().over(Window.partitionBy("file_path").orderBy("timestamp", "uid"))).filter(F.col("_k") <= decisions_per_node)
    line = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"  {label}: "), c))
    said = F.concat_ws("\n", F.concat(F.lit("- ["), F.substring("uid", 1, 12), F.lit("] "), "content"), line("Reason", F.substring("reason", 1, 160)), line("Source", F.col("source_ref")), line("Status", F.col("status")))
    about = first.groupBy("file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", said.alias("said")))), lambda x: x["said"]), "\n").alias("said"))
    body = F.when(F.col("said").isNull(), "Related decisions: (none indexed)").otherwise(F.concat(F.lit("Related decisions:\n"), "said"))
    block = F.concat(F.format_string("### CodeNode: %s (lines %d-%d)\n", "name", "line_start", "line_end"), body)
    blocks = n.join(about, "file_path", "left").select("file_path", F.struct("_n", block.alias("block")).alias("b"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x["block"]), "\n\n")
    return blocks.groupBy("file_path").agg(F.concat(F.lit("## File: "), F.first("file_path"), F.lit("\n\n"), joined).alias("markdown"))


def change_lines(summary: DataFrame, decisions: DataFrame, day: str) -> DataFrame:
    """Lines of a day's report: the structure, then the decisions dated that day."""
    shape = summary.select(F.concat(F.lit("Structure: "), "summary").alias("line"), F.lit(0).alias("part"))
    made = decisions.filter(F.to_date("timestamp") == F.lit(day).cast("date")).select(F.concat(F.lit("Decision: "), "content", F.lit(" ("), "source_ref", F.lit(")")).alias("line"), F.lit(1).alias("part"))
    return shape.unionByName(made)
