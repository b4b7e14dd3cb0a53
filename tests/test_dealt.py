"""Work that costs more than reading is dealt out, however few parts its table comes in."""

from helpers import DATA

from provspark.operators import lookup, records, sweep
from provspark.plans.lenses import Lenses
from provspark.sources import parsers


def test_files_are_dealt_before_they_are_parsed(spark):
    files = spark.createDataFrame([(k, f"src/m{k}.py", f"def f{k}():\n    return g{k}()\n") for k in range(80)], "seq long, file_path string, text string").coalesce(1)
    for found in (parsers.parse_files(files), parsers.calls_of(files)):
        assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert sorted(r["seq"] for r in found.collect()) == list(range(80))


def test_changelogs_are_dealt_before_they_are_read(spark):
    said = "Version 1\n---------\n- use a pool rather than threads.\n"
    found = records.from_documents(spark.createDataFrame([(k, "CHANGES.rst", said) for k in range(80)], "seq long, file_path string, text string").coalesce(1), "changelog")
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted((r["seq"], *r["alternatives"]) for r in found.collect()) == [(k, "threads") for k in range(80)]


def test_rows_of_the_cascade_are_dealt_by_their_number(spark, monkeypatch):
    """Whatever the session's number of tasks, no task gets more and more links and lines to sort; answers stay the same."""
    v = Lenses(spark, DATA)
    answers = lambda: lookup.cascade(v.probes, v.nodes, v.decisions, v.links)
    want = sorted(answers().collect())
    monkeypatch.setattr(sweep, "ROWS_A_TASK", 500)
    many = answers()
    n = v.links.count()
    tasks = [-(-k // 500) for k in (n, n + v.nodes.count() + v.decisions.count() + v.probes.count())]
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert all(f", {k}), REPARTITION_BY_NUM" in plan for k in tasks)
    assert sorted(many.collect()) == want
