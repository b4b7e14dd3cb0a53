"""Lookups by line, name and file, one by one or for a table of probes, and the cascade that answers why a line is as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provspark.functions import paths
from provspark.operators import sweep

#: Rank -> the level that is reported.
REPORTED = ("line", "line", "line", "file", "commit", "dir")


def newest(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(F.col("timestamp").desc(), "uid").limit(limit)


def about_lines(points: DataFrame, spans: DataFrame, on: list[str] | str) -> DataFrame:
    """points (on, line) joined with the spans (on, line_start, line_end) that hold the line. They meet by a bin of lines as well, so a hot file is no crossing of all its lines with all its spans."""
    p = points.withColumn("_bin", F.explode(paths.line_bins(F.col("line"))))
    s = spans.withColumn("_bin", F.explode(paths.span_bins(F.col("line_start"), F.col("line_end"))))
    return p.join(s, [*([on] if isinstance(on, str) else on), "_bin"]).filter(paths.contains_line(F.col("line"))).drop("_bin")


def innermost(probes: DataFrame, nodes: DataFrame, at: Column | None = None) -> DataFrame:
    """For each of probes (probe, file_path, line) the live symbol about the line: open before closed, tightest, youngest."""
    live = nodes.filter(paths.is_live(at)) if at is not None else nodes.filter(paths.is_live())
    n = live.select("file_path", "uid", "name", "line_start", "line_end", "valid_from", "valid_to")
    met = about_lines(probes, n, "file_path")
    w = Window.partitionBy("probe").orderBy(F.col("valid_to").isNull().desc(), F.col("line_end") - F.col("line_start"), F.col("valid_from").desc(), "uid")
    return met.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("probe", "file_path", "line", "uid", "name", "line_start", "line_end")


def by_name(nodes: DataFrame, name: str, limit: int = 10) -> DataFrame:
    span = F.col("line_end") - F.col("line_start")
    return nodes.filter((F.col("name") == name) & paths.is_live()).orderBy("file_path", span, F.col("valid_from").desc(), "uid").limit(limit)


def near_names(nodes: DataFrame, name: str, limit: int = 3) -> DataFrame:
    """Live names that contain the asked-for one or lie in it, those that begin with it first."""
    needle = name.rsplit(".", 1)[-1].strip().lower()
    low = F.lower("name")
    close = low.contains(needle) | F.lit(needle).contains(low)
    found = nodes.filter(paths.is_live() & (F.length("name") >= 3) & close & F.lit(len(needle) >= 3)).select("name").distinct()
    return found.orderBy(F.lower("name").startswith(needle).desc(), F.abs(F.length("name") - len(needle)), "name").limit(limit)


def containing(probes: DataFrame, nodes: DataFrame, each: int = 5) -> DataFrame:
    """For each probe the few tightest versions about its line, whenever they held."""
    n = nodes.select("file_path", "uid", "line_start", "line_end")
    met = about_lines(probes, n, "file_path")
    w = Window.partitionBy("probe").orderBy(F.col("line_end") - F.col("line_start"), "uid")
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= each).select("probe", "uid", "rank")


def for_line(decisions: DataFrame, file_path: str, line: int, limit: int = 20) -> DataFrame:
    return newest(decisions.filter((F.col("file_path") == file_path) & (F.col("line") == line)), limit)


def for_file(decisions: DataFrame, file_path: str, limit: int = 20) -> DataFrame:
    return newest(decisions.filter(F.col("file_path") == file_path), limit)


def for_dir(decisions: DataFrame, file_path: str, limit: int = 5) -> DataFrame:
    """Decisions in or under the file's folder; a file at the root has none."""
    parent = file_path.rpartition("/")[0]
    return newest(decisions.filter(paths.within(F.col("file_path"), parent) if parent else F.lit(False)), limit)


def for_commit(decisions: DataFrame, sha: str, limit: int = 10) -> DataFrame:
    ref = F.col("source_ref")
    return newest(decisions.filter(ref.contains(sha) | ref.contains(sha[:10])), limit)


def for_line_links(decisions: DataFrame, links: DataFrame, file_path: str, line: int, limit: int = 20) -> DataFrame:
    """A row for each link on the line."""
    hit = links.filter((F.col("file_path") == file_path) & (F.col("line") == line)).select(F.col("decision_uid").alias("uid"))
    return newest(decisions.join(hit, "uid"), limit)


def for_node_lines(decisions: DataFrame, links: DataFrame, file_path: str, start: int, end: int, limit: int = 20) -> DataFrame:
    hit = links.filter((F.col("file_path") == file_path) & F.col("line").between(start, end)).select(F.col("decision_uid").alias("uid"))
    return newest(decisions.join(hit, "uid", "left_semi"), limit)


def for_file_links(decisions: DataFrame, links: DataFrame, file_path: str, limit: int = 20) -> DataFrame:
    hit = links.filter(F.col("file_path") == file_path).select(F.col("decision_uid").alias("uid"))
    return newest(decisions.join(hit, "uid", "left_semi"), limit)


def cascade(probes: DataFrame, nodes: DataFrame, decisions: DataFrame, links: DataFrame, limits: tuple[int, ...] = (20, 20, 20, 20, 10, 5)) -> DataFrame:
    """(probe, level, rank, uid): for each of probes (probe, file_path, line[, sha]) the decisions of the first level that has any, newest first.

    Levels: linked lines of the innermost symbol (each decision once), the linked line (a row for each link), the line itself, the file, the commit (where a sha is given),
    the folder. An answer hangs on file and line alone, so each asked line is answered once, the first four levels in one pass over its file (`sweep`); whatever
    a line, file, commit or folder holds is cut to its newest few before it meets anything.
    """
    d = decisions.select("uid", "timestamp", "file_path", "line", "source_ref")
    stood = links.filter("line is not null").select(F.col("decision_uid").alias("uid"), "file_path", "line").join(d.select("uid", "timestamp"), "uid")
    # Links hardly repeat, so counting them before the shuffle would only hold all of a split in one map.
    n_links = links.count()
    dealt = sweep.dealt(stood, n_links, "file_path", "line", "uid")
    linked = _newest_of(dealt.groupBy("file_path", "line", "uid", "timestamp").agg(F.count("*").alias("n")), ["file_path", "line"], max(limits[:2]))
    made = _newest_of(d, ["file_path", "line"], max(limits[2:4]))
    live = nodes.filter(paths.is_live()).select("file_path", F.col("line_start").alias("line"), F.col("line_end").alias("stop"), F.col("valid_from").alias("timestamp"), "uid").filter("stop >= line")
    rows = [
        _newest_of(live, ["file_path", "line", "stop"], 1).withColumn("kind", F.lit(sweep.SPAN)), linked.withColumn("kind", F.lit(sweep.LINK)), made.withColumn("kind", F.lit(sweep.DECISION)),
        probes.select("file_path", "line").distinct().withColumn("kind", F.lit(sweep.ASK)),
    ]
    kind = {"stop": "int", "timestamp": d.schema["timestamp"].dataType, "uid": "string", "n": "long"}
    wide = [r.select("file_path", F.col("line").cast("int").alias("line"), "kind", *[(F.col(c) if c in r.columns else F.lit(None).cast(kind[c])).alias(c) for c in kind]) for r in rows]
    every = wide[0]
    for w in wide[1:]:
        every = every.unionByName(w)
    found = sweep.answers(every.filter("file_path is not null"), limits, n_links + nodes.count() + decisions.count() + probes.count())

    at = F.coalesce("line", F.lit(-1))
    folder = F.when(F.col("file_path").contains("/"), F.regexp_replace("file_path", r"/[^/]*$", ""))
    asked = probes.withColumns({"_line": at, "_folder": folder}).join(found.select("file_path", at.alias("_line"), "k", "uids"), ["file_path", "_line"])
    # Keys of what is answered already are null and meet nothing.
    unanswered = lambda c: F.when(F.col("k").isNull(), c)
    under = d.select("uid", "timestamp", F.explode(_folders(F.col("file_path"))).alias("key"))
    asked = asked.withColumn("_key", unanswered(F.col("_folder"))).join(_few(under, limits[5], "_key", "_in"), "_key", "left").drop("_key")
    commit = F.array()
    if "sha" in probes.columns:
        words = d.select("uid", "timestamp", F.explode(F.split("source_ref", r"[^0-9A-Za-z]+")).alias("word"))
        said = words.select("uid", "timestamp", F.explode(F.array_distinct(F.array("word", F.substring("word", 1, 10)))).alias("key")).distinct()
        for name, token in (("_full", F.col("sha")), ("_short", F.substring("sha", 1, 10))):
            asked = asked.withColumn("_key", unanswered(F.when(token != "", token))).join(_few(said, limits[4], "_key", name), "_key", "left").drop("_key")
        none = F.array().cast("array<struct<uid:string,timestamp:" + d.schema["timestamp"].dataType.simpleString() + ">>")
        both = F.array_distinct(F.concat(F.coalesce("_full", none), F.coalesce("_short", none)))
        commit = F.transform(F.slice(F.array_sort(both, _newer), 1, limits[4]), lambda x: x["uid"])
    inside = F.transform(F.coalesce("_in", F.array()), lambda x: x["uid"])
    answer = asked.withColumn("_uids", F.when(F.col("k").isNotNull(), F.col("uids")).otherwise(F.when(F.size(commit) > 0, commit).otherwise(inside)))
    k = F.coalesce("k", F.when(F.size(commit) > 0, 4).otherwise(5))
    return answer.select("probe", F.element_at(F.array(*map(F.lit, REPORTED)), k + 1).alias("level"), F.posexplode("_uids").alias("rank", "uid")).withColumn("rank", F.col("rank") + 1)


def _newer(a: Column, b: Column) -> Column:
    """Below 0 where a (uid, timestamp) comes before b: newest first, without a time last, then by uid."""
    at = lambda x: F.struct(x["timestamp"].isNotNull(), x["timestamp"])
    return F.when(at(a) > at(b), -1).when(at(a) < at(b), 1).when(a["uid"] < b["uid"], -1).when(a["uid"] > b["uid"], 1).otherwise(0)


def _few(rows: DataFrame, limit: int, key: str, name: str) -> DataFrame:
    """(key, name): the newest few (uid, timestamp) of each key of rows (key, uid, timestamp), in their order."""
    held = F.array_sort(F.collect_list(F.struct("uid", "timestamp")), _newer)  # at most `limit` of them
    return _newest_of(rows, ["key"], limit).groupBy(F.col("key").alias(key)).agg(held.alias(name))


def _folders(path: Column) -> Column:
    """All folders above a path, and the path itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def _newest_of(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The newest few rows of each key, cut in each task before the shuffle: a key's millions never meet."""
    w = Window.partitionBy(*keys).orderBy(F.col("timestamp").desc(), "uid")
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")


def governed_fallback(unanswered: DataFrame, decisions: DataFrame, links: DataFrame, limit: int = 2) -> DataFrame:
    """(probe, rank, uid): for probes without an answer, the newest visible decisions linked anywhere in the file."""
    shown = decisions.filter(paths.visible()).select("uid", "timestamp")
    pairs = links.select("file_path", F.col("decision_uid").alias("uid")).distinct().join(shown, "uid")
    w = Window.partitionBy("file_path").orderBy(F.col("timestamp").desc(), "uid")
    best = pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return unanswered.select("probe", "file_path").join(best, "file_path").select("probe", "rank", "uid")
