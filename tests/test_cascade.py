"""The cascade and its sweep, against the levels as they are defined, probe by probe."""

import random
from datetime import datetime, timedelta

import pytest

from provspark.operators import lookup, sweep

DAY = datetime(2024, 1, 1)


def tables(rng, n):
    """Few files and lines, so that nearly everything meets: repeated links, equal spans, ended symbols, nulls, decisions without a time."""
    files = ["src/a.py", "src/b.py", "src/sub/c.py", "root.py", "empty/d.py"]
    line = lambda: rng.choice([None, *range(1, 13)])
    when = lambda: rng.choice([None, *(DAY + timedelta(days=i) for i in range(6))])
    decisions = [(f"d{i}", when(), rng.choice(files[:4] + [None, "src/sub"]), line(), f"commit {rng.choice('abc') * 12}" if rng.random() < 0.3 else "PR #1") for i in range(n)]
    links = [(f"d{rng.randrange(n + 3)}", "n", rng.choice(files), line()) for _ in range(3 * n)]
    links += rng.sample(links, n // 2)
    nodes = []
    for i in range(n):
        lo = rng.randrange(1, 11)
        nodes.append((f"n{i:03}", "f", rng.choice(files), lo, lo + rng.choice([-1, 0, 0, 1, 3, 6]), DAY + timedelta(days=rng.randrange(3)), None if rng.random() < 0.6 else DAY))
    probes = [(i, rng.choice([*files, "src/new.py", None]), line(), rng.choice([None, "", "a" * 12, "b" * 10 + "zz", "a" * 10])) for i in range(3 * n)]
    return probes, nodes, decisions, links


def by_hand(probes, nodes, decisions, links, limits):
    stamp = {}
    for uid, ts, *_ in decisions:
        stamp.setdefault(uid, []).append(ts)
    newest = lambda rows: sorted(rows, key=lambda r: (r[1] is None, -(r[1] or DAY).timestamp(), r[0]))
    linked = [(u, ts, f, at) for u, _, f, at in links for ts in stamp.get(u, []) if at is not None]
    out = {}
    for probe, path, line, sha in probes:
        spans = [(e - s, -v.timestamp(), u, s, e) for u, _, f, s, e, v, until in nodes if f == path and until is None and line is not None and s <= line <= e]
        s, e = min(spans)[3:] if spans else (1, 0)
        here = lambda f, at: f is not None and f == path and line is not None and at == line
        folder = path.rpartition("/")[0] if path else ""
        words = lambda ref: {t for w in __import__("re").split("[^0-9A-Za-z]+", ref) for t in (w, w[:10])}
        levels = [
            {(u, ts) for u, ts, f, at in linked if f == path and s <= at <= e}, [(u, ts) for u, ts, f, at in linked if here(f, at)], [(u, ts) for u, ts, f, at, _ in decisions if here(f, at)],
            [(u, ts) for u, ts, f, _, _ in decisions if path and f == path], {(u, ts) for u, ts, _, _, ref in decisions if path and sha and words(ref) & {sha, sha[:10]}},
            [(u, ts) for u, ts, f, _, _ in decisions if folder and f and (f == folder or f.startswith(folder + "/"))],
        ]
        for k, rows in enumerate(levels):
            if rows:
                out[probe] = (lookup.REPORTED[k], [u for u, _ in newest(rows)[: limits[k]]])
                break
    return out


@pytest.mark.parametrize(("n", "limits", "sha"), [(12, (20, 20, 20, 20, 10, 5), True), (60, (3, 4, 2, 3, 2, 2), True), (60, (20, 20, 20, 20, 10, 5), False), (4, (3, 4, 2, 3, 2, 2), False)])
def test_levels_as_defined(spark, n, limits, sha):
    probes, nodes, decisions, links = tables(random.Random(n + sha), n)
    p = spark.createDataFrame(probes, "probe long, file_path string, line int, sha string")
    got = lookup.cascade(
        p if sha else p.drop("sha"), spark.createDataFrame(nodes, "uid string, name string, file_path string, line_start int, line_end int, valid_from timestamp, valid_to timestamp"),
        spark.createDataFrame(decisions, "uid string, timestamp timestamp, file_path string, line int, source_ref string"), spark.createDataFrame(links, "decision_uid string, node_uid string, file_path string, line int"), limits,
    )
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r["probe"], r["rank"])):
        level, uids = found.setdefault(r["probe"], (r["level"], []))
        assert level == r["level"] and r["rank"] == len(uids) + 1
        uids.append(r["uid"])
    want = by_hand(probes if sha else [(*q[:3], None) for q in probes], nodes, decisions, links, limits)
    assert found == want and len(want) > n


def test_repeated_links_count_on_the_line_but_not_in_the_symbol(spark):
    probes = spark.createDataFrame([(1, "f.py", 5), (2, "f.py", 50)], "probe long, file_path string, line int")
    nodes = spark.createDataFrame([("n", "f", "f.py", 1, 9, DAY, None)], "uid string, name string, file_path string, line_start int, line_end int, valid_from timestamp, valid_to timestamp")
    decisions = spark.createDataFrame([("d1", DAY, "x.py", 1, "")], "uid string, timestamp timestamp, file_path string, line int, source_ref string")
    links = spark.createDataFrame([("d1", "n", "f.py", line) for line in (5, 5, 50, 50)], "decision_uid string, node_uid string, file_path string, line int")
    got = sorted(map(tuple, lookup.cascade(probes, nodes, decisions, links).collect()))
    assert got == [(1, "line", 1, "d1"), (2, "line", 1, "d1"), (2, "line", 2, "d1")]


def test_nothing_to_ask_or_to_answer(spark):
    empty = [spark.createDataFrame([], s) for s in ("probe long, file_path string, line int", "uid string, name string, file_path string, line_start int, line_end int, valid_from timestamp, valid_to timestamp", "uid string, timestamp timestamp, file_path string, line int, source_ref string", "decision_uid string, node_uid string, file_path string, line int")]
    assert lookup.cascade(*empty).collect() == []
    asked = spark.createDataFrame([(1, "f.py", 1)], "probe long, file_path string, line int")
    assert lookup.cascade(asked, *empty[1:]).collect() == []


def test_tops_of_any_range():
    rng = random.Random(2)
    for _ in range(60):
        most, lines = rng.randrange(1, 6), sorted(rng.sample(range(60), rng.randrange(0, 40)))
        held = {n: [sweep.item(rng.choice([None, *range(9)]), f"u{rng.randrange(12)}") for _ in range(rng.randrange(1, 9))] for n in lines}
        tops = sweep.LineTops(most)
        for n in lines:
            tops.add(n, held[n])
        for _ in range(40):
            lo, hi = rng.randrange(-3, 62), rng.randrange(-3, 62)
            assert tops.within(lo, hi) == sorted({x for n in lines if lo <= n <= hi for x in held[n]})[:most]


def test_a_hot_line_is_cut_before_the_shuffle(spark):
    """The plan cuts a line's rows in each task, before they meet."""
    d = spark.range(1000).selectExpr("cast(id as string) as uid", "cast(id as timestamp) as timestamp", "concat('f', id % 2) as file_path", "cast(id % 3 as int) as line")
    plan = lookup._newest_of(d, ["file_path", "line"], 20)._jdf.queryExecution().executedPlan().toString()
    partial = plan.index("Partial")
    assert "WindowGroupLimit" in plan and plan.index("Exchange") < partial, plan
