"""The jobs: against plain Python, run again, and over input that grows."""

import logging
import os
import subprocess
import sys
from collections import defaultdict

import pytest
from helpers import DATA, plain

from jobs import line_provenance, registry, symbol_history
from provspark.functions import text
from provspark.operators import temporal
from provspark.streaming import incremental

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DOCS = "doc_id long, text string, source string, n int"
SAID = [
    (1, "Use pools because they are cheap. Keep it  small.\n- Keep it small.", "a"), (2, "Keep it small.\nPrefer lists rather than maps.", "a"), (2, "Keep it small.", "a"),
    (3, None, "a"), (4, "", "b"), (5, "  \n \n", "b"), (None, "Keep it small.", "b"), (7, "Keep it small.", None), (8, "Keep it small.", ""), (9, "007", "007"), (10, "word " * 40_000, "b"),
]


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_matches_sql(spark, oracle, name):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.sources.partitionOverwriteMode", *incremental.STATE_STORE)}
    ours, theirs = registry.queries()[name](spark, DATA).toPandas(), oracle(registry.oracle_sql()[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)
    assert {k: spark.conf.get(k, None) for k in before} == before


def lines_by_hand(rows):
    import re

    found = defaultdict(list)
    for doc, said, source, *_ in rows:
        for s in re.split(r"(?<=[.!?])\s+|\n+", said or ""):
            line = " ".join(re.sub(r"^\s*[-*+]\s+", "", s).split())
            if line:
                found[source or None, line].append(doc)
    ids = lambda docs: [d for d in docs if d is not None]
    return {k: (min(ids(d), default=None), max(ids(d), default=None), len(set(ids(d))), len(d)) for k, d in found.items()}


def register(df):
    return {(r["source"], r["line"]): (r["first_doc"], r["last_doc"], r["n_docs"], r["n_places"]) for r in df.collect()}


def test_lines_of_odd_documents_and_a_rerun(spark, tmp_path, caplog):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(*r, 1) for r in SAID]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(src)
    with caplog.at_level(logging.INFO, "provspark.jobs"):
        got = line_provenance.run(spark, src, out)
    assert register(got) == lines_by_hand(rows) and got.count() == len(lines_by_hand(rows))
    assert f"read {len(rows)} documents" in caplog.text and f"wrote {got.count()} lines, 2 of them decisions" in caplog.text
    said = {r["line"]: (r["decides"], r["content"], r["reason"], r["alternatives"], r["tier"]) for r in got.collect()}
    assert said["Use pools because they are cheap."] == (True, "Use pools", "because they are cheap.", [], "decision")
    assert said["Prefer lists rather than maps."] == (True, "Prefer lists", "", ["maps"], "decision") and said["Keep it small."][4] == "event"
    assert register(line_provenance.run(spark, src, out)) == lines_by_hand(rows)


@pytest.mark.parametrize("repeat", [False, True])
def test_lines_are_shuffled_by_their_documents_only_where_ids_repeat(spark, repeat):
    rows = [r for r in SAID if repeat or r[0] != 2] + [(11, "b. a. b.\n- a\nb", "a"), (11, "b", "b"), (None, "b", "a"), (None, "b.", "a")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOCS)
    assert line_provenance.ids_repeat(docs) == repeat
    found = line_provenance.lines(docs, 1, line_provenance.ids_repeat(docs))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1 + repeat
    assert register(found) == lines_by_hand(rows)


def test_only_lines_with_a_keyword_are_searched_for_markers(spark):
    said = ["Use pools because they are cheap.", "Keep it small.", "BECAUSE", "x" * 500, "we chose lists"]
    parted = line_provenance.decided(spark.createDataFrame([(s,) for s in said], "line string"))
    assert {r["line"]: r["p"] is not None for r in parted.collect()} == {s: text.says_decision(s) for s in said}
    got = {r["line"]: (r["content"], r["reason"], r["alternatives"]) for r in line_provenance.in_columns(parted).collect()}
    assert got == {s: text.parts_of_sentence(s) for s in said}


def test_sources_that_are_not_read_keep_their_lines(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([(1, "old a", "a", 1), (2, "old b", "b", 1)], [(1, "new a", "a", 1), (3, "newer a", "a", 1)]):
        spark.createDataFrame(rows, DOCS).write.mode("overwrite").parquet(src)
        got = line_provenance.run(spark, src, out)
    assert set(register(got)) == {("a", "new a"), ("a", "newer a"), ("b", "old b")}


@pytest.mark.parametrize("rows", [[], [(1, None, "a", 1), (2, " ", None, 1)]])
def test_no_documents_and_no_lines(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "in"))
    assert line_provenance.run(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect() == []


def test_history_of_growing_input(spark, tmp_path, caplog):
    """Each run takes the new files alone; what stands after each is the fold of all events so far."""
    src, out, mark = (str(tmp_path / x) for x in ("events", "out", "mark"))
    events = spark.read.parquet(f"{DATA}/events.parquet")
    cuts = [0, 400, 700, 700, 1000]
    for lo, hi in zip(cuts, cuts[1:]):
        new = events.filter(f"event_id >= {lo} and event_id < {hi}")
        if lo < hi:
            new.coalesce(1).write.mode("append").parquet(src)
        caplog.clear()
        with caplog.at_level(logging.INFO, "provspark.jobs"):
            got = symbol_history.run(spark, src, out, mark)
        assert f"read {new.count()} events" in caplog.text
        want = temporal.fold_versions(symbol_history.symbol_events(events.filter(f"event_id < {hi}")))
        assert plain(got.toPandas()) == plain(want.toPandas())
    assert spark.read.parquet(out).count() <= 2 * 1000  # no batch writes more than its own events end and leave open


def test_history_passes_over_late_events(spark, tmp_path):
    """An event that comes a batch after younger ones is passed over, as in one fold over the order of arrival."""
    e = [("f.py", "a", i, ts, f"s{i}", 1, end, h, gone) for i, (ts, end, h, gone) in enumerate([(5, 5, 7, False), (3, 9, 8, False), (6, 9, None, False), (7, 0, 0, True), (2, 4, 1, False)])]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    before = {k: spark.conf.get(k, None) for k in incremental.STATE_STORE}
    try:
        for k, v in incremental.STATE_STORE.items():
            spark.conf.set(k, v)
        for event in e:
            spark.createDataFrame([event], incremental.EVENT).coalesce(1).write.mode("append").parquet(src)
            incremental.stream_versions(spark.readStream.schema(incremental.EVENT).parquet(src), out, str(tmp_path / "mark")).awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want = temporal.fold_versions(spark.createDataFrame(e, incremental.EVENT))
    assert plain(symbol_history.history(spark, out).toPandas()) == plain(want.toPandas()) and want.count() == 3


@pytest.mark.parametrize(("job", "args"), [("line_provenance", ("documents", "out")), ("symbol_history", ("events", "out", "checkpoint"))])
def test_command_line(spark, tmp_path, job, args):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    spark.read.parquet(f"{DATA}/{args[0]}.parquet").limit(50).write.parquet(str(tmp_path / args[0]))
    said = [x for a in args for x in (f"--{a}", str(tmp_path / a))]
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.sql.shuffle.partitions=2 --conf spark.ui.enabled=false pyspark-shell"}
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", *said], cwd=ROOT, env=env, capture_output=True, text=True, timeout=200)
    assert done.returncode == 0 and "read 50" in done.stderr, done.stderr[-2000:]
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}"], cwd=ROOT, env=env, capture_output=True, text=True, timeout=200)
    assert done.returncode == 2 and "no path given" in done.stderr
