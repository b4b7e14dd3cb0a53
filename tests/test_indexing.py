"""Indexing for real: what an incremental run keeps, what documents bind to, where the store is found."""

import json
import os

from test_engine import git

from provspark import api
from provspark.api import Engine


def commit(repo, n, when):
    (repo / "src/pool.py").write_text("def pool():\n    return " + str(n) + "\n")
    git(str(repo), "add", "-A")
    git(str(repo), "commit", "-qm", f"feat: use pool {n} because it reduces latency", when=when)


def begun(tmp_path):
    repo = tmp_path / "repo"
    (repo / "src").mkdir(parents=True)
    git_init = lambda: git(str(repo), "init", "-q")
    git_init()
    for n in (1, 2):
        commit(repo, n, f"2024-01-0{n}T10:00:00Z")
    return repo


def test_what_an_incremental_run_keeps_and_documents_bind(spark, tmp_path):
    repo, e = begun(tmp_path), Engine(spark, str(tmp_path / "wh"))
    said = lambda: sorted(r["content"] for r in e._t("decisions").select("content").collect())
    linked = lambda: {(r["decision_uid"], r["file_path"]) for r in e._t("links").select("decision_uid", "file_path").distinct().collect()}
    e.index(str(repo), depth=2)
    assert said() == ["Use pool 1", "Use pool 2"]
    before = linked()
    assert len(before) == 2
    for n in (3, 4):
        commit(repo, n, f"2024-01-0{n}T10:00:00Z")
    (repo / "docs/adr").mkdir(parents=True)
    filler = "This paragraph says nothing of note. " * 40
    (repo / "docs/adr/0001-pool.md").write_text(f"# Pool\n\n## Status\n\nAccepted\n\n## Decision\n\nWe keep one pool.\n\n## Context\n\n{filler}\n\n## Notes\n\n<!-- governs: src/pool.py -->\n")
    e.index(str(repo), depth=2)
    assert said() == [*(f"Use pool {n}" for n in (1, 2, 3, 4)), "We keep one pool."]
    assert before < linked() and len(linked()) == 5
    assert ("docs/adr/0001-pool.md::decision::adr@1", "src/pool.py") in linked()
    # One version back is kept for those who read it.
    assert len([x for x in os.listdir(tmp_path / "wh") if x.startswith("v-")]) == 2


def test_store_location_and_tables(spark, tmp_path, capsys):
    repo = begun(tmp_path)
    deep = repo / "src/deep"
    deep.mkdir()
    assert api.find_store(str(deep)) == str(deep / ".provspark")
    assert api.main(["index", str(repo)], spark) == 0
    assert api.find_store(str(deep)) == str(repo / ".provspark")
    capsys.readouterr()
    assert api.main(["why", f"{repo}/src/pool.py:1", "--root", str(repo)], spark) == 0
    assert json.loads(capsys.readouterr().out)["file"] == "src/pool.py"
    assert api.main(["why", "/elsewhere/pool.py:1", "--root", str(repo)], spark) == 2
    capsys.readouterr()
    assert api.main(["--store", str(repo / ".provspark"), "--format", "table", "decisions"], spark) == 0
    out = capsys.readouterr().out
    assert out.startswith("file: None\ncount: 2\n\ndecisions\n") and "Use pool 1" in out
    assert api.main(["--store", str(repo / ".provspark"), "health"], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"status": "ok", "nodes": 2, "decisions": 2}
    assert api.as_table([]) == "nothing"
