"""Versions, store, lookups, conflicts, binding, parsers and the engine on a small repository."""

import os
import subprocess
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from provspark import schema
from provspark.functions import paths
from provspark.operators import bind, conflicts, graph, lookup, store, temporal
from provspark.sources import parsers
from provspark.streaming import incremental

EVENT = incremental.EVENT


def events(spark, rows):
    return spark.createDataFrame([("f.py", "a", i, ts, f"s{i}", lo, hi, h, gone) for i, (ts, lo, hi, h, gone) in enumerate(rows)], EVENT)


def versions(df):
    return [(r["valid_from"], r["valid_to"]) for r in df.orderBy("seq").collect()]


def test_fold(spark):
    assert versions(temporal.fold_versions(events(spark, [(1, 1, 5, 7, False), (2, 1, 5, 7, False), (3, 1, 6, 7, False), (4, 0, 0, 0, True), (5, 1, 6, 7, False)]))) == [(1, 3), (3, 4), (5, None)]


def test_fold_late_commit_is_passed_over(spark):
    assert versions(temporal.fold_versions(events(spark, [(5, 1, 5, 7, False), (3, 1, 9, 8, False)]))) == [(5, None)]


def test_fold_empty(spark):
    assert temporal.fold_versions(events(spark, [])).count() == 0


def test_batches_equal_whole(spark):
    e = events(spark, [(i, 1, 5 + i % 3, i % 2, i % 7 == 0) for i in range(40)])
    whole, parts = temporal.fold_versions(e), incremental.fold_in_batches(e, [13, 27])
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, parts.collect()), key=str)


def test_merge_rules(spark):
    e = spark.createDataFrame([("a", "b", "uses", "f", 42, 0), ("a", "b", "uses", "f", 99, 1), ("a", "b", "contains", "f", 1, 2)], "from_uid string, to_uid string, kind string, file_path string, line int, seq long")
    assert sorted(r["line"] for r in store.merge_edges(e).collect()) == [1, 42]
    assert store.merge_edges(e.limit(0)).count() == 0
    n = spark.createDataFrame([("u1", "f", "a", datetime(2024, 1, 1), None, 0), ("u2", "f", "a", datetime(2024, 1, 5), None, 1), ("u3", "f", "a", datetime(2023, 1, 1), datetime(2023, 2, 1), 2)], "uid string, file_path string, name string, valid_from timestamp, valid_to timestamp, seq long")
    fixed = {r["uid"]: r["valid_to"] for r in store.repaired(n).collect()}
    assert fixed == {"u1": datetime(2024, 1, 5), "u2": None, "u3": datetime(2023, 2, 1)}
    assert [r["uid"] for r in store.representatives(n).collect()] == ["u2"]


def test_caps(spark):
    wide = spark.createDataFrame([("d1", "n", f"f{i}", 1) for i in range(11)] + [("d2", "n", "f", i) for i in range(5)], "decision_uid string, node_uid string, file_path string, line int")
    assert {r["decision_uid"] for r in bind.capped(wide).collect()} == {"d2"}


def test_guard():
    store.guard(60, 100)
    store.guard(1, 100, replace=True)
    with pytest.raises(store.GraphShrinkError):
        store.guard(49, 100)


def test_store_round_trip(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "wh"))
    assert not s.exists() and s.table("nodes").count() == 0 and s.checkpoint() == {}
    empty = {t: spark.createDataFrame([], schema.ddl(c)) for t, c in store.TABLES.items()}
    node = spark.createDataFrame([("u", "function", "a", "f.py", 1, 2, "python", None, datetime(2024, 1, 1), None, "WORKTREE")], schema.ddl(schema.NODE))
    assert s.write(empty | {"nodes": node})["nodes"] == 1
    s.save_checkpoint("abc", 1)
    assert s.checkpoint()["head"] == "abc"
    assert store.needs_rebuild(s.table("nodes"), 1)
    assert s.write(empty)["nodes"] == 0 and s.table("nodes").count() == 0


def test_legacy_decisions(spark):
    raw = spark.createDataFrame([("u", "odd", 0.0)], "uid string, status string, confidence double")
    r = schema.read_decisions(raw).first()
    assert (r["status"], r["confidence"], r["tier"], r["category"], r["alternatives"]) == ("accepted", 0.5, "decision", "design", [])


DECISION = "uid string, content string, reason string, file_path string, line int, status string, source_ref string, timestamp timestamp, category string, tier string, seq long"


def decided(spark, rows):
    base = ("", None, "accepted", "", datetime(2024, 1, 1), "design", "decision")
    return spark.createDataFrame([(u, c, r, p, *base[1:], i) for i, (u, c, r, p) in enumerate(rows)], DECISION)


def test_directory_fallback(spark):
    d = decided(spark, [("c", "x", "", "CHANGELOG.md"), ("r", "x", "", "README.md"), ("k", "x", "", "src/app/core.py"), ("u", "x", "", "src/app/util.py")])
    assert lookup.for_dir(d, "LICENSE").count() == 0
    assert {r["uid"] for r in lookup.for_dir(d, "src/app/main.py").collect()} == {"k", "u"}


def test_cascade_levels(spark):
    nodes = spark.createDataFrame([("u1", "a", "src/a.py", 1, 10, datetime(2024, 1, 1), None), ("u2", "b", "src/a.py", 4, 6, datetime(2024, 1, 1), datetime(2024, 1, 2))], "uid string, name string, file_path string, line_start int, line_end int, valid_from timestamp, valid_to timestamp")
    d = decided(spark, [("d1", "x", "", "docs/adr/1.md"), ("d2", "y", "", "src/b.py"), ("d3", "z", "", "src/c.py")])
    links = spark.createDataFrame([("d1", "u1", "src/a.py", 3)], "decision_uid string, node_uid string, file_path string, line int")
    probes = spark.createDataFrame([(0, "src/a.py", 5), (1, "src/b.py", 9), (2, "src/zz.py", 1), (3, "LICENSE", 1)], "probe long, file_path string, line int")
    got = {}
    for r in lookup.cascade(probes, nodes, d, links).collect():
        got.setdefault(r["probe"], (r["level"], set()))[1].add(r["uid"])
    assert got == {0: ("line", {"d1"}), 1: ("file", {"d2"}), 2: ("dir", {"d2", "d3"})}
    assert lookup.innermost(probes, nodes).filter("probe = 0").first()["uid"] == "u1"
    shas = probes.filter("probe = 3").withColumn("sha", F.lit("abcdef1234567"))
    by_commit = lookup.cascade(shas, nodes, d.withColumn("source_ref", F.when(F.col("uid") == "d3", "commit abcdef1234567")), links).collect()
    assert [(r["level"], r["uid"]) for r in by_commit] == [("commit", "d3")]


def kinds(spark, rows):
    return sorted((r["type"], *sorted((r["uid_a"], r["uid_b"]))) for r in conflicts.detect(decided(spark, rows)).collect())


def test_conflicts(spark):
    assert kinds(spark, [("a", "keep the service stateful", "", "docs/adr/1.md"), ("b", "make the api stateless now", "", "docs/adr/2.md")]) == [("opposite", "a", "b")]
    assert kinds(spark, [("a", "SQLite is our store", "", "docs/adr/1.md"), ("b", "go stateless", "", "docs/adr/2.md")]) == []
    assert kinds(spark, [("a", "async writer", "", "x/1.md"), ("b", "synchronous reader", "", "x/2.md")]) == []
    assert kinds(spark, [("a", "enable the token cache", "", "x/1.py"), ("b", "disable the token cache for good and all time", "", "x/1.py")]) == [("temporal", "a", "b")]
    assert kinds(spark, [("a", "Supersedes Use a file store", "", "x/1.md"), ("b", "Use a file store", "", "y/2.md")]) == [("supersede", "a", "b")]
    assert kinds(spark, []) == []


def test_diff_kinds(spark):
    old = decided(spark, [("a", "x", "", "f"), ("b", "x", "", "f"), ("c", "x", "", "f")])
    new = decided(spark, [("a", "y", "", "f"), ("b", "x", "", "f"), ("d", "x", "", "f")]).withColumn("status", F.when(F.col("uid") == "b", "superseded").otherwise(F.col("status")))
    assert [(r["kind"], r["uid"]) for r in temporal.ranked_changes(temporal.changes(old, new)).collect()] == [("added", "d"), ("changed", "a"), ("superseded", "b"), ("removed", "c")]


def test_governed_binding(spark):
    nodes = spark.createDataFrame([("n1", "redirect", "src/app.py", 10, 0), ("n2", "send", "src/a.py", 1, 1), ("n3", "send", "src/b.py", 1, 2), ("n4", "request_context", "src/a.py", 5, 3), ("n5", "request_context", "src/b.py", 5, 4), ("n6", "route", "lib/r.py", 2, 5)], "uid string, name string, file_path string, line_start int, seq long")
    prose = spark.createDataFrame([("d1", "<!-- governs: src/app.py -->"), ("d2", "use ``redirect``"), ("d3", "`send`"), ("d4", "`request_context`"), ("d5", "`app.route`"), ("d6", "`unknown`"), ("d7", "governs: src/")], "decision_uid string, text string")
    got = {}
    for r in bind.bind_governed(prose, nodes).collect():
        got.setdefault(r["decision_uid"], set()).add(r["node_uid"])
    assert got == {"d1": {"n1"}, "d2": {"n1"}, "d4": {"n4", "n5"}, "d5": {"n6"}, "d7": {"n1", "n2", "n3", "n4", "n5"}}


def test_patch_lines(spark):
    patch = "@@ -1,2 +1,3 @@\n a\n+b\n-c\n+d\n\\ No newline\n@@ -9 +20 @@\n+e"
    assert sorted(r["line"] for r in bind.changed_lines(spark.createDataFrame([(1, patch)], "id long, patch string")).collect()) == [2, 3, 20]


def test_scope_borders(spark):
    p = F.col("p")
    row = spark.createDataFrame([("src2/x.py",)], "p string").select(paths.in_scope(p, "src/").alias("a"), paths.starts_with(p, "src").alias("d"), paths.in_scope(p, ".").alias("all")).first()
    assert tuple(row) == (False, True, True)
    assert paths.normal_text("./../a/b") == "a/b" and paths.normal_text(".github/x") == "github/x"


PROGRAMS = {
    "s.py": "def add(a, b):\n    return a + b\n\n\ndef multiply(a, b):\n    return add(a, b)\n\n\nclass Calculator:\n    def compute(self):\n        return multiply(1, 2)\n",
    "s.ts": "export function add(a: number, b: number): number {\n  return a + b;\n}\nfunction multiply(a: number) {\n  return add(a, 1);\n}\nclass Calculator {\n  compute(x: number): number {\n    return multiply(x);\n  }\n}\n",
    "s.java": "class Calculator {\n  static int add(int a) { return a; }\n  static int multiply(int a) { return add(a); }\n  int compute() {\n    return multiply(2);\n  }\n}\n",
    "s.go": "package m\n\nfunc add(a int) int {\n\treturn a\n}\n\nfunc multiply(a int) int {\n\treturn add(a)\n}\n\ntype Calculator struct{}\n\nfunc (c *Calculator) compute() int {\n\treturn multiply(1)\n}\n",
    "s.rs": "fn add(a: i32) -> i32 {\n    a\n}\n\nfn multiply(a: i32) -> i32 {\n    add(a)\n}\n\nstruct Calculator;\n\nimpl Calculator {\n    fn compute(&self) -> i32 {\n        multiply(1)\n    }\n}\n",
    "s.cpp": "int add(int a) { return a; }\n\nint multiply(int a) {\n  return add(a);\n}\n\nclass Calculator {\n public:\n  int compute() {\n    return multiply(1);\n  }\n};\nint MACRO(x) { }\n",
}


@pytest.mark.parametrize("path", sorted(PROGRAMS))
def test_parsers(path):
    p = parsers.parse(path, PROGRAMS[path])
    found = {s.name: s for s in p.symbols}
    assert {"add", "multiply", "compute", "Calculator"} == set(found)
    assert {(a, b) for a, b, _ in p.calls} == {("multiply", "add"), ("compute", "multiply")}
    assert found["compute"].parent.name == "Calculator" and found["Calculator"].kind == "class"


def test_javascript_and_broken_python():
    js = "﻿function add(a) {\n  return a;\n}\nfunction multiply(a) {\n  return add(a); // call(x)\n}\nvar x = 1;\n"
    assert [(s.kind, s.name) for s in parsers.parse("s.js", js).symbols] == [("function", "add"), ("function", "multiply"), ("variable", "x")]
    broken = parsers.parse("b.py", "def a():\n    b()\n\nclass C(:\n    def d(self):\n        a()\n")
    assert [s.name for s in broken.symbols] == ["a", "C", "d"] and ("a", "b", 2) in broken.calls


def test_edges(spark):
    nodes = spark.createDataFrame([("f1", "run", "a.py", 1, 9, None), ("f2", "helper", "a.py", 3, 4, "f1"), ("f3", "helper", "b.py", 1, 2, None)], "uid string, name string, file_path string, line_start int, line_end int, parent_uid string")
    calls = spark.createDataFrame([("c1", "run", "helper", "a.py", 6), ("c2", "gone", "helper", "a.py", 6)], "call string, caller string, callee string, file_path string, line int")
    assert {(r["from_uid"], r["to_uid"], r["kind"]) for r in graph.edges(calls, nodes).collect()} == {("f1", "f2", "contains"), ("f2", "f1", "defined_by"), ("f1", "f2", "uses")}


def git(repo, *args, when="2024-01-01T10:00:00Z"):
    env = os.environ | {"GIT_COMMITTER_DATE": when, "GIT_AUTHOR_DATE": when, "GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null"}
    subprocess.run(["git", "-C", repo, "-c", "user.name=dev", "-c", "user.email=dev@example.com", *args], check=True, capture_output=True, env=env)


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    r = tmp_path_factory.mktemp("repo")
    (r / "src").mkdir()
    (r / "src/app.py").write_text("def helper(x):\n    return x\n\n\ndef a():\n    return helper(1)\n")
    git(str(r), "init", "-q")
    git(str(r), "add", "-A")
    git(str(r), "commit", "-qm", "feat: add helper because it removes duplication")
    return r


def test_index_why_and_again(spark, repo, tmp_path):
    from provspark.api import BadArgument, Engine

    e = Engine(spark, str(tmp_path / "wh"))
    first = e.index(str(repo))
    assert (first["commits"], first["nodes"], first["edges"], first["decisions"]) == (1, 2, 1, 1)
    why = e.why("src/app.py:1")
    assert set(why) == {"file", "line", "node", "decisions", "binding", "related"}
    assert why["node"]["name"] == "helper" and why["binding"] == "line" and why["decisions"][0]["content"] == "Add helper"
    assert len(why["decisions"][0]) == 15 and len(why["node"]) == 8
    assert e.index(str(repo))["commits"] == 0 and e._t("nodes").count() == 2
    (repo / "src/app.py").write_text("def helper(x):\n    return x\n\n\ndef a():\n    return helper(2)\n")
    git(str(repo), "commit", "-qam", "fix: use two to avoid one", when="2024-01-05T10:00:00Z")
    assert e.index(str(repo))["commits"] == 1
    held = sorted((r["name"], r["valid_to"] is None) for r in e._t("nodes").collect())
    assert held == [("a", False), ("a", True), ("helper", True)]
    full = Engine(spark, str(tmp_path / "wh2"))
    full.index(str(repo))
    cols = ["uid", "name", "line_start", "valid_from", "valid_to"]
    assert sorted(map(str, full._t("nodes").select(*cols).collect())) == sorted(map(str, e._t("nodes").select(*cols).collect()))
    graph_ = e.graph_at("2024-01-03")
    assert (graph_["nodes"], graph_["decisions"]) == (2, 1)
    changed = e.diff(str(repo), "2024-01-01", "HEAD")
    assert [(c["kind"], c["content"], c["source"]) for c in changed["changes"]] == [("added", "Use two", "commit")] and changed["summary"] == {"added": 1, "changed": 0, "superseded": 0, "removed": 0}
    assert e.timeline() == ["2024-01-01", "2024-01-05"]
    assert e.decisions()["count"] == 2 and e.conflicts() == {"scope": "", "conflicts": [], "summary": {"total": 0, "by_type": {}}}
    assert len(e.decisions(limit=1)["decisions"]) == 1 and e.decisions(limit=1)["count"] == 2
    assert "### CodeNode: helper (lines 1-2)" in e.export().first()["markdown"]
    with pytest.raises(BadArgument):
        e.why("nothing_like_it")


def test_working_tree(spark, tmp_path):
    from provspark.api import Engine

    tree = tmp_path / "tree"
    (tree / "node_modules").mkdir(parents=True)
    (tree / "a.py").write_text("def one():\n    return two()\n\n\ndef two():\n    return 2\n")
    (tree / "node_modules/x.js").write_text("function skipped() {}\n")
    e = Engine(spark, str(tmp_path / "wh"))
    assert {k: e.index(str(tree))[k] for k in ("nodes", "edges", "commits")} == {"nodes": 2, "edges": 1, "commits": 0}


def test_model_answers(spark):
    from provspark.sources.enrichment import enriched, parse_answer

    assert parse_answer("no json", "commit x") is None and parse_answer('{"content": ""}', "r") is None
    r = parse_answer('Sure: {"content": "Use x", "confidence": 0.95}', "commit x")
    assert (r["confidence"], r["reason"], r["tier"]) == (0.7, "Use x", "decision")
    m = spark.createDataFrame([(1, "a", "tidy up", ""), (2, "b", "use x because y", "")], "seq long, sha string, message string, file_path string")
    assert [x["seq"] for x in enriched(m, lambda said: '{"content": "' + said + '"}').collect()] == [1]


def test_local_model_over_http_and_without(spark):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from provspark.sources.enrichment import enriched, local_model

    class Model(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            said = asked["prompt"].rsplit("\n\n", 1)[1]
            body = json.dumps({"response": json.dumps({"content": f"{asked['model']}: {said}"})}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    m = spark.createDataFrame([(1, "a", "tidy up", ""), (2, "b", "use x because y", ""), (3, "c", None, "")], "seq long, sha string, message string, file_path string")
    url = f"http://127.0.0.1:{server.server_port}"
    got = [(r["seq"], r["content"]) for r in enriched(m.filter("seq < 3"), local_model("tiny", url)).collect()]
    server.shutdown()
    assert got == [(1, "tiny: tidy up")]
    assert enriched(m, local_model("tiny", "http://127.0.0.1:9", 2)).collect() == []


def test_conflict_and_change_rows(spark):
    from provspark import api
    from provspark.operators import reports

    rows = [("d1", "enable the cache", "a.py", "accepted"), ("d2", "disable the cache | now", "a.py", "accepted"), ("d3", "gone", "b.py", "accepted")]
    d = spark.createDataFrame([(u, c, "why", "commit", f"commit {u}", p, s, datetime(2024, 1, 1)) for u, c, p, s in rows], "uid string, content string, reason string, source string, source_ref string, file_path string, status string, timestamp timestamp")
    found = spark.createDataFrame([("opposite", "d1", "d2", "a.py", ["disable", "enable"], 2)], "type string, uid_a string, uid_b string, place string, matched array<string>, rank int")
    r = reports.conflict_rows(found, d).first().asDict(True)
    assert (r["decision_a"]["content"], r["decision_b"]["status"], r["location"]) == ("enable the cache", "accepted", "a.py") and "disable / enable" in r["explanation"]
    new = d.filter("uid <> 'd3'").withColumn("status", F.when(F.col("uid") == "d2", "superseded").otherwise(F.col("status")))
    changed = {x["uid"]: (x["kind"], x["status"], x["old_status"]) for x in reports.change_rows(temporal.changes(d, new), d, new).collect()}
    assert changed == {"d2": ("superseded", "superseded", "accepted"), "d3": ("removed", "accepted", "accepted")}
    out = {"scope": "x", "conflicts": [r], "summary": {"total": 1, "by_type": {"opposite": 1}}}
    assert api.as_table(out).split("\n")[-1] == "Summary: 1 total · 1 opposite" and "Decision A" in api.as_table(out)
    marked = api.as_markdown(out).split("\n")
    assert marked[0] == "- scope: x" and "| opposite | enable the cache | disable the cache \\| now | a.py |" in marked and api.as_markdown([]) == "nothing"
