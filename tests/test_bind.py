"""Binding and patches at size: what is asked of a file's lines grows with its lines, and a patch is read where it lies."""

from types import SimpleNamespace

from provspark.operators import bind, lookup
from provspark.plans import catalogue


def test_a_line_asks_once_whoever_changed_it(spark, monkeypatch):
    """Thirty decisions that change the same lines, and versions with equal lines: a row for each different line and stretch meets."""
    met, about = [], lookup.about_lines

    def counted(points, spans, on):
        met.append(about(points, spans, on))
        return met[-1]

    monkeypatch.setattr(lookup, "about_lines", counted)
    nodes = [(f"n{k:02d}", "a.py", *span) for k in range(20) for span in ((1, 9), (4, 6))]
    nodes = spark.createDataFrame([(f"{uid}@{a}", f, a, b) for uid, f, a, b in nodes], "uid string, file_path string, line_start int, line_end int")
    rows = [(f"d{k}", "a.py", line) for k in range(30) for line in (2, 5, 5, 40)] + [("d0", None, 2), ("d0", "a.py", None)]
    got = bind.bind_changed(spark.createDataFrame(rows, "decision_uid string, file_path string, line int"), nodes)
    assert sorted(map(tuple, got.collect())) == sorted((f"d{k}", uid, "a.py", line) for k in range(30) for uid, line in (("n00@1", 2), ("n00@4", 5)))
    assert met[0].count() == 3  # line 2 in one stretch, line 5 in two


def test_a_huge_change_counts_its_lines_and_keeps_the_first(spark, monkeypatch):
    monkeypatch.setattr(bind, "MOST_CHANGED", 4)
    monkeypatch.setattr(bind, "MOST_PER_FILE_WHEN_HUGE", 2)
    nodes = spark.createDataFrame([("n", "a.py", 3, 9)], "uid string, file_path string, line_start int, line_end int")
    changed = spark.createDataFrame([("huge", "a.py", k) for k in (1, 3, 4, 5, 6)] + [("four", "a.py", k) for k in (3, 4, 5, 6)], "decision_uid string, file_path string, line int")
    got = {(r["decision_uid"], r["line"]) for r in bind.bind_changed(changed, nodes).collect()}
    assert got == {("huge", 3), ("huge", 4), *(("four", k) for k in (3, 4, 5, 6))}


def test_every_line_of_a_huge_change_is_bound(spark, monkeypatch):
    """A decision with 1,300 lines in one file: none is left out of the query, nor of a decision's own lines."""
    lines = [("d1", "n", "src/m1/f1.py", k) for k in range(1, 1301)]
    links = spark.createDataFrame(lines, "decision_uid string, node_uid string, file_path string, line int")
    nodes = spark.createDataFrame([("wide", "src/m1/f11.py", 1, 2000), ("tight", "src/m1/f11.py", 900, 1300)], "uid string, file_path string, line_start int, line_end int")
    monkeypatch.setattr(catalogue, "Lenses", lambda *_: SimpleNamespace(links=links, nodes=nodes))
    got = catalogue.queries()["bind_changed_lines"](spark, "")
    want = sorted(("d1", "wide" if k < 900 else "tight", "src/m1/f11.py", k) for k in range(1, 1301))
    assert sorted(map(tuple, got.select("decision_uid", "node_uid", "file_path", "line").collect())) == want
    own = links.selectExpr("decision_uid as uid", "'' as source_ref", "'src/m1/f11.py' as file_path", "line")
    assert sorted(map(tuple, bind.bind_own_line(own, nodes).collect())) == want


def test_a_patch_is_read_where_it_lies(spark):
    """No row for a line and no sort of all lines by their patch; ids that have several patches tell each line once."""
    patch = "+early\n@@ -1,2 +7,3 @@ f\n same\n+new\n-old\n--- a\n+++ b\n\\ No newline\n+more\n@@ -9 +8 @@\n+again"
    patches = spark.createDataFrame([("a", patch), ("a", patch), ("a", "@@ -1 +2 @@\n+x"), (None, "@@ -1 +2 @@\n+x"), ("b", None), ("c", "")], "id string, patch string")
    got = bind.changed_lines(patches)
    assert sorted(map(tuple, got.collect()), key=str) == [("a", 11), ("a", 2), ("a", 8), (None, 2)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan
