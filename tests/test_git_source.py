"""The git log as a data source: ranges, merges, renames, streams, and diffs against git asked commit by commit."""

import re
import subprocess

import pytest
from test_engine import git

from provspark.operators.bind import changed_lines
from provspark.sources import git as source
from pyspark.sql import functions as F


def said(repo, *args):
    return subprocess.run(["git", "-C", repo, "-c", "core.quotepath=off", *args], check=True, capture_output=True, text=True).stdout


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    """Edits, a rename, a deletion, odd names and messages, a branch and its merge, a commit without changes."""
    r = tmp_path_factory.mktemp("repo")
    path = str(r)
    git(path, "init", "-q", "-b", "main")
    at = iter(range(1, 60))

    def commit(message, **files):
        for name, text in files.items():
            f = r / name.replace("__", "/").replace("_py", ".py")
            f.parent.mkdir(exist_ok=True)
            f.unlink() if text is None else f.write_text(text)
        git(path, "add", "-A")
        git(path, "commit", "-q", "--allow-empty", "-m", message, when=f"2024-01-{next(at) % 28 + 1:02}T10:00:00Z")

    commit("first", a_py="one\ntwo\nthree\n", b_py="x\n" * 30)
    commit("edit\n\n- because of this\n- and that", a_py="one\n2\nthree\nfour\n")
    git(path, "mv", "b.py", "c d é.py")
    commit("rename with an edit")
    git(path, "checkout", "-q", "-b", "side")
    commit("side", src__s_py="side\n")
    git(path, "checkout", "-q", "main")
    commit("main goes on", a_py="zero\none\n2\nthree\nfour\n")
    git(path, "merge", "-q", "--no-ff", "-m", "merge side", "side", when="2024-02-01T10:00:00Z")
    commit("empty")
    for i in range(6):
        commit(f"edit {i} \u00e9\n\nbody | with , odd % signs", a_py="".join(f"line {j * (j % (i + 2) > 0)}\n" for j in range(20)))
    commit("delete", a_py=None)
    return path


def rows(df):
    return sorted((r["sha"], r["parent"], r["timestamp"], r["author"], r["message"], tuple(r["changed_files"])) for r in df.collect())


def test_commits_are_what_git_says(spark, repo):
    got = source.commits(spark, repo).orderBy("seq").collect()
    assert [r["sha"] for r in got] == said(repo, "log", "--format=%H").split() and [r["seq"] for r in got] == list(range(len(got)))
    for r in got:
        assert (r["parent"] or "") == said(repo, "log", "-1", "--format=%P", r["sha"]).split(" ")[0].strip()
        assert r["message"] == said(repo, "log", "-1", "--format=%B", r["sha"]).strip() and int(r["timestamp"].timestamp()) == int(said(repo, "log", "-1", "--format=%ct", r["sha"]))
        empty = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"
        assert sorted(r["changed_files"]) == sorted(said(repo, "diff", "--name-only", "-M", r["parent"] or empty, r["sha"]).split("\n")[:-1])
    assert source.commits(spark, repo, depth=3).count() == 3


@pytest.mark.parametrize("per_task", [1, 4, 1000])
def test_ranges_agree_however_they_are_cut(spark, repo, per_task):
    source.register(spark)
    cut = spark.read.format("git_log").option("per_task", per_task).load(repo)
    n = int(said(repo, "rev-list", "--count", "HEAD"))
    assert cut.rdd.getNumPartitions() == -(-n // per_task)
    assert rows(cut) == rows(source.commits(spark, repo))
    since = said(repo, "rev-parse", "HEAD~5").strip()
    assert [r["sha"] for r in spark.read.format("git_log").options(since=since, per_task=per_task).load(repo).orderBy("seq").collect()] == said(repo, "rev-list", f"{since}..HEAD").split()


def test_lines_of_each_commit_as_git_diffs_it(spark, repo):
    found = source.commits(spark, repo)
    got = {(r["sha"], r["file_path"], r["line"]) for r in source.diffs(found, repo).collect()}
    want = set()
    for r in found.collect():
        patch = said(repo, "diff", "-M", "--no-color", r["parent"] or "4b825dc642cb6eb9a060e54bf8d69288fbee4904", r["sha"])
        for part in patch.split("diff --git ")[1:]:
            path, at = re.search(r"^\+\+\+ b/(.+?)\t?$", part, re.M), 0
            for line in part.split("\n@@ ", 1)[-1].join(["@@ ", ""]).split("\n") if path else []:
                if m := re.match(r"@@ -\S+ \+(\d+)", line):
                    at = int(m[1])
                elif line[:1] == "+":
                    want.add((r["sha"], path[1], at))
                    at += 1
                elif line[:1] == " ":
                    at += 1
    assert got == want and len(want) > 40
    # The log's own patches say the same.
    patches = spark.read.format("git_log").options(table="patches", per_task=3).load(repo)
    lines = changed_lines(patches.select(F.struct("sha", "file_path").alias("id"), "patch")).select("id.sha", "id.file_path", "line")
    assert {tuple(r) for r in lines.collect()} == want


def test_stream_takes_what_is_new_and_agrees_with_a_batch(spark, repo, tmp_path):
    clone, out, mark = (str(tmp_path / x) for x in ("clone", "out", "mark"))
    said(repo, "clone", "-q", repo, clone)
    said(clone, "reset", "-q", "--hard", "HEAD~4")
    source.register(spark)
    seen = []
    for _ in range(3):
        query = spark.readStream.format("git_log").option("per_task", 3).load(clone).writeStream.format("parquet").option("checkpointLocation", mark).option("path", out).trigger(availableNow=True).start()
        query.awaitTermination()
        stored = spark.read.schema(source.COMMITS).parquet(out)
        assert rows(stored) == rows(source.commits(spark, clone))
        seen.append(stored.count())
        said(clone, "merge", "-q", "--ff-only", "origin/main")
    assert seen[1] == seen[0] + 4 and seen[2] == seen[1]


def test_no_repository(spark, tmp_path):
    with pytest.raises(ValueError):
        source.commits(spark, str(tmp_path))
    git(str(tmp_path), "init", "-q")
    with pytest.raises(ValueError):
        source.commits(spark, str(tmp_path))


def test_an_unknown_base_counts_as_none(spark, repo):
    source.register(spark)
    assert spark.read.format("git_log").option("since", "0" * 40).load(repo).count() == source.commits(spark, repo).count()
