"""The engine over a store, and a command line: index, why, graph, decisions, conflicts, diff, export.

JSON keys follow the public contract of the query language; exit codes are 0 for an answer, 1 for none, 2 for a bad argument.
"""

from __future__ import annotations

import argparse
import json
import re
import sys
import uuid
from collections.abc import Callable
from datetime import date, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark import schema
from provspark.functions import paths, text
from provspark.operators import bind, conflicts, graph, lookup, records, reports, store, temporal
from provspark.session import drop_folder, local_session, shared_dir, ship
from provspark.sources import enrichment, files, git, parsers
from provspark.streaming import incremental

SHOWN = 10
#: Records that an answer tells at most, unless asked for more; counts and summaries are of all.
MOST_ROWS = 1000


class BadArgument(ValueError):
    pass


def _record(row) -> dict:
    return json.loads(row["json"])


class Engine:
    def __init__(self, spark: SparkSession, warehouse: str):
        self.spark, self.store = ship(spark), store.Store(spark, warehouse)

    def _t(self, name: str) -> DataFrame:
        return self.store.table(name)

    # ---- writing

    def index(self, repo: str, depth: int | None = None, full: bool = False, ask: Callable[[str], str] | None = None, jobs: int = 0) -> dict:
        """Reads a repository (or, without one, a working tree) into the store: versions, edges, decisions and links; incremental behind the checkpoint unless full.

        ask: a language model that is asked about messages in which the rules find no reason, by `jobs` tasks at a time (`enrichment`).
        """
        self._scratch = f"{shared_dir(self.spark)}/index-{uuid.uuid4().hex}"
        try:
            return self._index(repo, depth, full, ask, jobs)
        finally:
            drop_folder(self.spark, self._scratch)

    def _held(self, df: DataFrame, name: str) -> DataFrame:
        """df written to the shared folder and read again, so that what follows is planned from files; they go when indexing ends."""
        path = f"{self._scratch}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _index(self, repo: str, depth: int | None, full: bool, ask: Callable[[str], str] | None, jobs: int) -> dict:
        self.store.begin()
        state = {} if full else self.store.checkpoint()
        nodes = self._t("nodes")
        if not state or store.needs_rebuild(nodes, state.get("node_count", 0)):
            state = {}
        try:
            commits = self._held(git.commits(self.spark, repo, depth), "commits")
            head = git.run_git(repo, "rev-parse", "HEAD").strip()
        except ValueError:
            commits, head = None, ""
        if commits is None:
            parsed, calls, versions = self._tree(repo)
            found, n_commits = versions, 0
        else:
            fresh = self._held(incremental.pending(commits, state.get("head")), "fresh")
            n_commits = fresh.count()
            parsed, calls, found = self._history(repo, fresh, nodes if state else None)
        edges = self._edges(found, calls)
        if state:
            stored = nodes.join(found.select("uid"), "uid", "left_anti").withColumn("seq", F.lit(0).cast("long"))
            found = stored.unionByName(found.select(*stored.columns))
            edges = self._t("edges").unionByName(edges)
        found = self._held(store.repaired(store.merge_by_uid(found)), "nodes")
        # An incremental run reads the new commits and all documents; what is stored of anything else stays as it is.
        read = fresh if state else commits
        documents = self._documents(repo)
        decisions = self._held(self._decisions(read, documents, ask, jobs), "decisions")
        links = self._links(repo, read, decisions, found, documents)
        if state:
            fresh_uids = decisions.select(F.col("uid").alias("decision_uid")).distinct()
            links = self._t("links").drop("commit_sha").join(fresh_uids, "decision_uid", "left_anti").unionByName(links.select("decision_uid", "node_uid", "file_path", "line"))
            decisions = store.replaced(self._t("decisions"), decisions)
        store.guard(found.count(), state.get("node_count", 0), not state)
        edges = store.merge_edges(store.without_dangling(edges.withColumn("seq", F.xxhash64("from_uid", "to_uid", "kind", "line")), found))
        counts = self.store.write({"nodes": found, "edges": edges, "decisions": decisions, "links": links.withColumn("commit_sha", F.lit(""))})
        self.store.save_checkpoint(head, counts["nodes"])
        return {"root": repo, "commits": n_commits, "nodes": counts["nodes"], "edges": counts["edges"], "decisions": counts["decisions"]}

    def _tree(self, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        tree = self._held(files.working_tree(self.spark, root), "tree")
        parsed = self._held(parsers.parse_files(tree), "parsed")
        nodes = parsed.withColumns({"valid_from": F.current_timestamp(), "valid_to": F.lit(None).cast("timestamp"), "commit_sha": F.lit("WORKTREE")})
        return parsed, parsers.calls_of(tree), nodes

    def _history(self, repo: str, commits: DataFrame, stored: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        top = commits.agg(F.max("seq")).first()[0] or 0
        order = (F.lit(top) - F.col("seq")).cast("long")
        touched = commits.select(order.alias("seq"), "sha", F.col("timestamp").alias("ts"), F.explode("changed_files").alias("raw")).withColumn("file_path", paths.normal(F.col("raw"))).drop("raw").distinct()
        wanted = touched.filter(parsers.language_of(F.col("file_path")).isNotNull() & ~paths.is_skipped(F.col("file_path")))
        snaps = self._held(git.snapshots(wanted, repo), "snapshots")
        parsed = self._held(parsers.parse_files(snaps), "parsed")
        calls = parsers.calls_of(snaps)
        stamps = snaps.select("file_path", "seq", "sha", F.unix_micros("ts").alias("ts"))
        events = parsed.join(stamps, ["file_path", "seq"]).select("file_path", "name", "seq", "ordinal", "ts", "sha", "line_start", "line_end", "text_hash", F.lit(False).alias("gone"))
        last = F.lit(1 << 30)
        gone = temporal.tombstones(stamps, parsed.select("file_path", "name", "seq"))
        if stored is not None:
            open_ = stored.filter(paths.is_live()).join(stamps.select("file_path").distinct(), "file_path", "left_semi")
            # What an open version's lines say is read from the commit that opened it.
            was = open_.select(F.lit(0).cast("long").alias("seq"), F.col("commit_sha").alias("sha"), F.current_timestamp().alias("ts"), "file_path").distinct()
            hashes = parsers.parse_files(git.snapshots(was, repo)).select("uid", "text_hash").distinct()
            carried = open_.join(hashes, "uid", "left").select("file_path", "name", F.lit(-1).cast("long").alias("seq"), F.lit(0).alias("ordinal"), F.unix_micros("valid_from").alias("ts"), F.col("commit_sha").alias("sha"), "line_start", "line_end", "text_hash", F.lit(False).alias("gone"))
            first = stamps.groupBy("file_path").agg(F.min("seq").alias("seq"))
            at_first = stamps.join(first, ["file_path", "seq"])
            missing = open_.select("file_path", "name").join(at_first, "file_path").join(parsed.select("file_path", "name", "seq"), ["file_path", "name", "seq"], "left_anti")
            gone = gone.unionByName(missing.select("file_path", "name", "seq", "ts", "sha"))
            events = events.unionByName(carried)
        stops = gone.select("file_path", "name", "seq", last.alias("ordinal"), "ts", "sha", F.lit(0).alias("line_start"), F.lit(0).alias("line_end"), F.lit(0).cast("long").alias("text_hash"), F.lit(True).alias("gone"))
        versions = temporal.fold_versions(events.unionByName(stops))
        shape = parsed.select("file_path", "name", "seq", "line_start", "uid", "kind", "language", "parent_uid", "ordinal")
        opened = versions.filter("seq >= 0").join(shape, ["file_path", "name", "seq", "line_start"]).select(
            "uid", "kind", "name", "file_path", "line_start", "line_end", "language", "parent_uid", F.timestamp_micros("valid_from").alias("valid_from"), F.timestamp_micros("valid_to").alias("valid_to"), F.col("sha").alias("commit_sha"), "seq")
        if stored is not None:
            shut = versions.filter("seq < 0 and valid_to is not null").select("file_path", "name", F.timestamp_micros("valid_to").alias("shut"))
            closed = open_.join(shut, ["file_path", "name"]).withColumn("valid_to", F.col("shut")).withColumn("seq", F.lit(-1).cast("long"))
            opened = opened.unionByName(closed.select(*opened.columns))
        return parsed, calls, self._held(opened, "versions")

    def _edges(self, nodes: DataFrame, calls: DataFrame) -> DataFrame:
        """Edges of the versions opened at each commit; callees are those that hold at that commit's time."""
        opened = nodes.filter("seq >= 0")
        found = graph.callers(calls.join(opened.select("file_path", "seq").distinct(), ["file_path", "seq"], "left_semi"), opened)
        when = opened.select(F.col("uid").alias("from_uid"), F.col("valid_from").alias("at"))
        to = nodes.select(F.col("uid").alias("to_uid"), F.col("name").alias("callee"), F.col("file_path").alias("to_path"), "valid_from", "valid_to")
        asked = found.join(when, "from_uid")
        holds = "valid_from <= at and (valid_to is null or valid_to > at)"
        # A call with a namesake in its file at that time meets those of that file alone; only the others meet all of the name.
        local = asked.join(to.withColumnRenamed("to_path", "file_path"), ["callee", "file_path"]).filter(holds)
        abroad = asked.join(local.select("call").distinct(), "call", "left_anti").join(to.drop("to_path"), "callee").filter(holds)
        cols = ["from_uid", "to_uid", F.lit("uses").alias("kind"), "file_path", "line"]
        uses = local.select(*cols).unionByName(abroad.select(*cols)).filter("from_uid <> to_uid").distinct()
        return graph.hierarchy(opened).unionByName(uses)

    def _documents(self, repo: str) -> dict[str, DataFrame]:
        """Kind -> (seq, file_path, text, modified) of the documents beside the code; a repository without a folder for a kind has none of it."""
        readers = {"adr": (files.design_documents, f"{repo.rstrip('/')}/{files.DESIGN}"), "changelog": (files.changelog, repo)}
        return {kind: read(self.spark, repo) for kind, (read, folder) in readers.items() if files.exists(self.spark, folder)}

    def _decisions(self, commits: DataFrame | None, documents: dict[str, DataFrame], ask: Callable[[str], str] | None = None, jobs: int = 0) -> DataFrame:
        parts = []
        if commits is not None:
            said = commits.select("seq", "sha", "message", F.coalesce(F.try_element_at("changed_files", F.lit(1)), F.lit("")).alias("file_path"))
            by_rules = records.from_messages(said)
            found = by_rules if ask is None else by_rules.unionByName(enrichment.enriched(said.repartition(jobs) if jobs else said, ask).withColumn("nth", F.lit(999)))
            parts.append(found.join(commits.select("seq", "timestamp", "author"), "seq").withColumn("constraints", F.array().cast("array<string>")).withColumn("part", F.lit(0)))
        for k, (kind, docs) in enumerate(documents.items(), 1):
            parts.append(records.from_documents(docs, kind).join(docs.select("seq", F.col("modified").alias("timestamp")), "seq").withColumn("author", F.lit("")).withColumn("part", F.lit(k)))
        if not parts:
            return self.spark.createDataFrame([], schema.ddl(schema.DECISION))
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        ordered = every.withColumn("seq", F.col("part").cast("long") * (1 << 50) + F.col("seq") % (1 << 40) * 1000 + F.col("nth"))
        return records.deduped(ordered).withColumn("line", F.lit(None).cast("int")).select(*schema.DECISION)

    def _links(self, repo: str, commits: DataFrame | None, decisions: DataFrame, nodes: DataFrame, documents: dict[str, DataFrame]) -> DataFrame:
        own = bind.bind_own_line(decisions, nodes)
        plain = decisions.filter((text.sha_of(F.col("source_ref")) == "") & F.col("line").isNull() & (F.col("tier") == "decision"))
        said = plain.select(F.col("uid").alias("decision_uid"), "file_path", F.concat_ws("\n", "content", "reason", F.concat_ws("\n", "alternatives"), F.concat_ws("\n", "constraints")).alias("text"))
        # What a record quotes is clipped, and markers stand anywhere in a document: the whole of it is read along.
        for docs in documents.values():
            body = docs.filter(F.lower("file_path").endswith(".md")).select("file_path", F.col("text").alias("body"))
            said = said.join(body, "file_path", "left").select("decision_uid", "file_path", F.concat_ws("\n", "text", "body").alias("text"))
        governed = bind.bind_governed(said.select("decision_uid", "text"), store.representatives(nodes))
        out = own.unionByName(governed)
        if commits is not None:
            of = decisions.select(F.col("uid").alias("decision_uid"), text.sha_of(F.col("source_ref")).alias("sha")).filter("sha <> ''")
            changed = of.join(git.diffs(commits.join(of.select("sha").distinct(), "sha", "left_semi"), repo), "sha").select("decision_uid", "file_path", "line")
            out = bind.capped(bind.bind_changed(changed, nodes)).unionByName(out)
        return store.merge_links(out.withColumn("seq", F.xxhash64("node_uid")))

    # ---- reading

    def _shown(self, rows: DataFrame, limit: int | None = None) -> list[dict]:
        return [_record(r) for r in (reports.decision_json(rows.limit(limit)) if limit else reports.decision_json(rows)).collect()]

    def location(self, raw: str) -> tuple[str, int]:
        m = re.fullmatch(r"(.+):(\d+)", raw)
        if m:
            if int(m[2]) < 1:
                raise BadArgument("lines count from 1")
            return paths.normal_text(m[1]), int(m[2])
        row = lookup.by_name(self._t("nodes"), raw, 1).first()
        if row is None:
            near = ", ".join(r["name"] for r in lookup.near_names(self._t("nodes"), raw).collect())
            raise BadArgument(f"no symbol {raw}" + (f"; did you mean {near}?" if near else ""))
        return row["file_path"], row["line_start"]

    def why(self, location: str, include_events: bool = False, include_dependency: bool = False) -> dict:
        file_path, line = self.location(location)
        out = {"file": file_path, "line": line, "node": None, "decisions": [], "binding": "none", "related": []}
        nodes, decisions, links = self._t("nodes"), self._t("decisions"), self._t("links")
        if not self.store.exists() or (nodes.isEmpty() and decisions.isEmpty()):
            return out | {"error": "nothing is indexed"}
        probe = self.spark.createDataFrame([(0, file_path, line)], "probe long, file_path string, line int")
        found = lookup.innermost(probe, nodes).first()
        if found:
            node = nodes.filter(F.col("uid") == found["uid"]).limit(1)
            out["node"] = json.loads(reports.node_json(node).first()["json"])
        probe = probe.withColumn("sha", F.lit(out["node"]["commit_sha"] if out["node"] else ""))
        answer = lookup.cascade(probe, nodes, decisions, links).cache()
        level = answer.select("level").first()
        out["binding"] = level["level"] if level else "none"
        shown = answer.select("uid", "rank").join(decisions, "uid").filter(paths.visible(include_events, include_dependency)).orderBy("rank")
        out["decisions"] = self._shown(shown, SHOWN)
        if not out["decisions"]:
            out["related"] = self._shown(lookup.governed_fallback(probe, decisions, links).select("uid", "rank").join(decisions, "uid").orderBy("rank"), 2)
        return out

    def why_many(self, probes: DataFrame) -> DataFrame:
        """(probe, level, rank, uid) for a table of probes (probe, file_path, line)."""
        return lookup.cascade(probes, self._t("nodes"), self._t("decisions"), self._t("links"))

    def _end_of(self, day: str, zone: str) -> tuple[str, F.Column]:
        try:
            date.fromisoformat(day)
        except ValueError:
            raise BadArgument(f"not a day: {day}") from None
        return day, temporal.local_day_end(F.lit(day), zone).cast("timestamp")

    def graph_at(self, day: str, scope: str = "", zone: str = "UTC") -> dict:
        day, at = self._end_of(day, zone)
        nodes, decisions = self._t("nodes"), self._t("decisions")
        shown = temporal.decisions_by_day(decisions.filter(paths.visible() & paths.starts_with(F.col("file_path"), scope)), day, zone).orderBy("timestamp", "uid").limit(MOST_ROWS)
        held = temporal.nodes_at(nodes, at, scope)
        row = temporal.snapshot(nodes, self._t("edges"), decisions, at, day, scope).first()
        summary = temporal.tightest_first(held.withColumn("seq", F.xxhash64("uid")))
        lines = [r["line"] for r in reports.change_lines(summary, shown, day).orderBy("part", "line").collect()]
        return {"date": day, "scope": scope, "nodes": row["nodes"], "edges": row["edges"], "decisions": row["decisions"], "summary": lines or [f"No nodes valid at {day} for this scope"], "decision_records": self._shown(shown)}

    def health(self) -> dict:
        """Whether there is something to ask."""
        ready = self.store.exists()
        return {"status": "ok" if ready else "empty", "nodes": self._t("nodes").count() if ready else 0, "decisions": self._t("decisions").count() if ready else 0}

    def payload(self, day: str | None = None, scope: str = "", zone: str = "UTC") -> dict:
        """What a web page shows of a snapshot: counts, then at most 50 decisions and 400 edges. No day, or one of blanks, is now."""
        day, at = self._end_of((day or "").strip() or datetime.now().date().isoformat(), zone)
        nodes, edges, decisions, links = (self._t(t) for t in schema_names())
        row = reports.graph_payload(nodes, edges, decisions, links, at, scope).first().asDict()
        shown = paths.governed_scope(decisions.filter(paths.visible()), links, scope).orderBy(F.col("timestamp").desc(), "uid")
        return {"stats": row, "decisions": self._shown(shown, 50), "edges": [r.asDict() for r in temporal.edge_list_at(edges, nodes, at, scope).collect()]}

    def timeline(self, scope: str = "") -> list[str]:
        return [str(r["day"]) for r in temporal.timeline(self._t("nodes"), scope).orderBy("day").collect()]

    def decisions(self, file: str | None = None, newest_first: bool = False, include_events: bool = False, include_dependency: bool = False, limit: int = MOST_ROWS) -> dict:
        """count is of all; of the records at most `limit` are told."""
        rows = self._t("decisions").filter(paths.starts_with_normal(F.col("file_path"), file) & paths.visible(include_events, include_dependency))
        when = F.col("timestamp").desc() if newest_first else F.col("timestamp").asc()
        return {"file": file, "count": rows.count(), "decisions": self._shown(rows.orderBy(when, "uid"), limit)}

    def conflicts_found(self, scope: str = "") -> DataFrame:
        """(type, decision_a, decision_b, location, matched_words, explanation, confidence, rank) of all conflicts, for any sink."""
        rows = self._t("decisions").filter((F.col("status") == "accepted") & paths.conflict_scope(F.col("file_path"), scope)).withColumn("seq", F.xxhash64("uid"))
        return reports.conflict_rows(conflicts.detect(rows), rows)

    def conflicts(self, scope: str = "", limit: int = MOST_ROWS) -> dict:
        """summary is of all conflicts; at most `limit` are told."""
        found = self.conflicts_found(scope).cache()
        by_type = {r["type"]: r["count"] for r in found.groupBy("type").count().orderBy("type").collect()}
        told = found.orderBy("rank", "location", "decision_a.uid", "decision_b.uid").drop("rank").limit(limit)
        out = [json.loads(x["json"]) for x in told.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json")).collect()]
        found.unpersist()
        return {"scope": scope, "conflicts": out, "summary": {"total": sum(by_type.values()), "by_type": by_type}}

    def diff(self, repo: str, old: str, new: str, scope: str = "", zone: str = "UTC", limit: int = MOST_ROWS) -> dict:
        """summary is of all changes; at most `limit` are told."""
        ends = []
        for ref in (old, new):
            try:
                ends.append(git.resolve(self.spark, repo, ref, zone)[1])
            except ValueError as e:
                raise BadArgument(str(e)) from None
        if ends[0] > ends[1]:
            raise BadArgument("the first instant lies after the second")
        both = [temporal.decisions_at(self._t("decisions"), F.timestamp_micros(F.lit(at)), scope).filter(paths.visible()) for at in ends]
        found = temporal.changes(*both)
        told = temporal.ranked_changes(reports.change_rows(found, *both)).limit(limit)
        out = [json.loads(x["json"]) for x in told.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json")).collect()]
        return {"from": old, "to": new, "scope": scope, "changes": out, "summary": temporal.change_counts(found).first().asDict()}

    def export(self, scope: str = "") -> DataFrame:
        """(file_path, markdown) of the context pack; write it with any Spark sink."""
        nodes = self._t("nodes").filter(paths.is_live() & paths.starts_with_normal(F.col("file_path"), scope))
        return reports.context_pack(nodes, self._t("decisions").filter(paths.visible()))


def find_store(start: str, name: str = ".provspark") -> str:
    """The store of the nearest folder upwards from start, or the one that start itself would have."""
    at = Path(start).resolve()
    for folder in (at, *at.parents):
        if (folder / name / store.MANIFESTS).is_dir() or (folder / name / "current").is_file():
            return str(folder / name)
    return str(at / name)


def located(raw: str, root: str | None) -> str:
    """A location with its absolute path made relative to the root, where it lies under it."""
    path, line = m.groups() if (m := re.fullmatch(r"(.+?)(:\d+)", raw)) else (raw, "")
    if not root or not Path(path).is_absolute():
        return raw
    try:
        return Path(path).resolve().relative_to(Path(root).resolve()).as_posix() + line
    except ValueError:
        raise BadArgument(f"{path} is not under {root}") from None


#: List of an answer -> (heading, what a record shows under it); other lists show all that their records hold.
COLUMNS = {
    "conflicts": (("Type", "type"), ("Decision A", "decision_a"), ("Decision B", "decision_b"), ("Location", "location")),
    "changes": (("Change", "kind"), ("Decision", "content"), ("Source", "source_ref"), ("Date", "timestamp"), ("Scope", "file_path")),
}


def _cell(value: object) -> str:
    if isinstance(value, dict):
        value = value.get("content")
    return " ".join(str("" if value is None else value).split())


def _counts(found: dict) -> str:
    flat = {k: v for name, value in found.items() for k, v in (value.items() if isinstance(value, dict) else [(name, value)])}
    return " · ".join(f"{v} {k}" for k, v in flat.items())


def _tables(out: dict | list) -> list[tuple[str, list[list[str]]]]:
    """(name, heading and rows) of each list of an answer."""
    found = {k: v for k, v in ({"": out} if isinstance(out, list) else out).items() if isinstance(v, list) and v}
    tables = []
    for name, rows in found.items():
        rows = [r if isinstance(r, dict) else {name: r} for r in rows]
        columns = COLUMNS.get(name) or [(k, k) for k in dict.fromkeys(k for r in rows for k in r)]
        tables.append((name, [[h for h, _ in columns], *([_cell(r.get(k)) for _, k in columns] for r in rows)]))
    return tables


def _single(out: dict | list) -> tuple[list[str], list[str]]:
    """Lines for what is single, and for the summary."""
    if isinstance(out, list):
        return [], []
    return [f"{k}: {v}" for k, v in out.items() if not isinstance(v, list | dict)], [f"Summary: {_counts(v)}" for k, v in out.items() if k == "summary"]


def as_table(out: dict | list) -> str:
    """An answer as lines of text: a heading for what is single, a table for each list of records, and the summary."""
    lines, last = _single(out)
    for name, cells in _tables(out):
        cells = [[x[:60] for x in row] for row in cells]
        widths = [max(len(row[i]) for row in cells) for i in range(len(cells[0]))]
        lines += ["", *([name] if name else []), *(" | ".join(x.ljust(w) for x, w in zip(row, widths, strict=True)).rstrip() for row in cells)]
    return "\n".join([*lines, *(["", *last] if last else [])]).strip() or "nothing"


def as_markdown(out: dict | list) -> str:
    """The same in Markdown, nothing clipped."""
    lines, last = _single(out)
    lines = [f"- {x}" for x in lines]
    for name, cells in _tables(out):
        rows = ["| " + " | ".join(x.replace("\\", "\\\\").replace("|", "\\|") for x in row) + " |" for row in cells]
        lines += ["", *([f"## {name}", ""] if name else []), rows[0], "|" + " --- |" * len(cells[0]), *rows[1:]]
    return "\n".join([*lines, *(["", *last] if last else [])]).strip() or "nothing"


def schema_names() -> tuple[str, ...]:
    return tuple(store.TABLES)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="provspark")
    p.add_argument("--store", help="folder of the store; else the nearest .provspark from here (or --root) upwards")
    p.add_argument("--format", choices=("json", "table", "markdown"), default="json")
    p.add_argument("--zone", default="UTC")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("health")
    c = sub.add_parser("index")
    c.add_argument("path")
    c.add_argument("--depth", type=int)
    c.add_argument("--full", action="store_true")
    c.add_argument("--use-llm", action="store_true", help="ask a local model about messages in which the rules find no reason")
    c.add_argument("--llm-model", default="llama3.2")
    c.add_argument("--llm-url", default=enrichment.LOCAL)
    c.add_argument("--jobs", type=int, default=0, help="tasks that ask at a time")
    c = sub.add_parser("why")
    c.add_argument("location")
    c.add_argument("--root", help="where the repository lies, for an absolute location")
    for x in (c, d := sub.add_parser("decisions")):
        x.add_argument("--include-events", action="store_true")
        x.add_argument("--include-dependency", action="store_true")
    d.add_argument("--file")
    d.add_argument("--timeline", action="store_true")
    c = sub.add_parser("graph")
    c.add_argument("--at", required=True)
    c.add_argument("--scope", default="")
    conflicts_ = sub.add_parser("conflicts")
    conflicts_.add_argument("--scope", default="")
    c = sub.add_parser("diff")
    for name in ("old", "new"):
        c.add_argument(name)
    c.add_argument("--repo", default=".")
    c.add_argument("--scope", default="")
    for x in (d, conflicts_, c):
        x.add_argument("--limit", type=int, default=MOST_ROWS, help="records told at most; counts and summaries are of all")
    c = sub.add_parser("export")
    c.add_argument("--scope", default="")
    c.add_argument("--output", required=True)
    a = p.parse_args(argv)
    root = getattr(a, "root", None) or getattr(a, "path", None) or "."
    engine = Engine(spark or local_session(), a.store or find_store(root))
    code = 0
    try:
        if a.command == "index":
            out = engine.index(a.path, a.depth, a.full, enrichment.local_model(a.llm_model, a.llm_url) if a.use_llm else None, a.jobs)
        elif a.command == "why":
            out = engine.why(located(a.location, a.root), a.include_events, a.include_dependency)
            code = 0 if out["decisions"] else 1
        elif a.command == "decisions":
            out = engine.decisions(a.file, not a.timeline, a.include_events, a.include_dependency, a.limit)
            code = 0 if out["count"] else 1
        elif a.command == "health":
            out = engine.health()
        elif a.command == "graph":
            out = engine.graph_at(a.at, a.scope, a.zone)
        elif a.command == "conflicts":
            out = engine.conflicts(a.scope, a.limit)
        elif a.command == "diff":
            out = engine.diff(a.repo, a.old, a.new, a.scope, a.zone, a.limit)
        else:
            engine.export(a.scope).select("markdown").write.mode("overwrite").text(a.output)
            out = {"written": a.output}
    except BadArgument as e:
        out, code = {"error": str(e)}, 2
    except (store.GraphShrinkError, store.ConcurrentWriteError) as e:
        out, code = {"error": str(e)}, 4
    print({"table": as_table, "markdown": as_markdown}.get(a.format, lambda x: json.dumps(x, ensure_ascii=False, default=str))(out))
    return code


if __name__ == "__main__":
    sys.exit(main())
