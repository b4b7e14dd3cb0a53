"""Call edges against plain Python, and how many rows meet on the way."""

import random

import pytest

from pyspark.sql import functions as F

from provspark.operators import graph, lookup, pairing

CALLS, NODES = "call string, caller string, callee string, file_path string, line int", "uid string, name string, file_path string, line_start int, line_end int"


@pytest.mark.parametrize("pairs", [2_000_000, 3])
def test_call_edges_like_plain_python(spark, monkeypatch, pairs):
    monkeypatch.setattr(graph, "PAIRS", pairs)
    rng = random.Random(5)
    name, file = lambda: rng.choice("abcd"), lambda: rng.choice(["x.py", "y.py", "z.py"])
    nodes = [(f"u{i}", name(), file(), start, start + rng.choice([0, 3, 3, 9])) for i, start in enumerate(rng.choices(range(1, 12), k=40))]
    calls = [(f"c{i}", name(), rng.choice("abcde"), file(), rng.choice([None, *range(1, 20)])) for i in range(150)]
    want = set()
    for _, caller, callee, at, line in calls:
        about = [(e - s, u) for u, n, f, s, e in nodes if n == caller and f == at and line is not None and s <= line <= e]
        named = [(u, f) for u, n, f, *_ in nodes if n == callee]
        for u, _ in [x for x in named if x[1] == at] or named:
            if about and u != min(about)[1]:
                want.add((min(about)[1], u, "uses", at, line))
    got = [tuple(r) for r in graph.call_edges(spark.createDataFrame(calls, CALLS), spark.createDataFrame(nodes, NODES)).collect()]
    assert sorted(got) == sorted(want)


def test_equal_calls_and_stretches_meet_once(spark, monkeypatch):
    """300 symbols of one stretch and 400 calls on one line are one row each where lines meet."""
    met, about = [], lookup.about_lines
    monkeypatch.setattr(lookup, "about_lines", lambda p, s, on: met.append(p.count() * s.count()) or about(p, s, on))
    calls = spark.createDataFrame([(f"c{i}", "a", "b", "x.py", 4) for i in range(400)], CALLS)
    nodes = spark.createDataFrame([(f"u{i:03}", "a", "x.py", 1, 9) for i in range(300)] + [("v", "b", "x.py", 20, 21)], NODES)
    assert [tuple(r) for r in graph.call_edges(calls, nodes).collect()] == [("u000", "v", "uses", "x.py", 4)]
    assert met == [2]  # one place, two stretches


@pytest.mark.parametrize(("x", "y"), [(400, 300), (300, 400), (1, 900), (900, 1)])
def test_both_sides_of_a_key_are_dealt(spark, x, y):
    """Each pair once, no more rows than some twice the root of deals and pairs, and no deal far over its pairs."""
    a, b = spark.range(x).selectExpr("1 as k", "id as a"), spark.range(y).selectExpr("1 as k", "id as b")
    assert pairing.all_with_all(a, b, ["k"], 1000).distinct().count() == x * y
    p, q = spark.range(1).select(*pairing.grid(F.lit(x), F.lit(y), 1000)).first()
    assert p * q <= 2 * x * y / 1000 + 2 and -(-x // p) * -(-y // q) <= 1500
    sent = x * q + y * p
    assert sent <= (2.5 * (x * y * (x * y / 1000)) ** 0.5 if min(x, y) > 1 else x + y + 1)


def test_calls_that_repeat_are_looked_up_once(spark, monkeypatch):
    """90 equal calls are one row where calls meet the symbol about them, and where edges are told."""
    asked, callers = [], graph.callers
    monkeypatch.setattr(graph, "callers", lambda c, n: asked.append(c.count()) or callers(c, n))
    calls = spark.createDataFrame([(f"c{i}", "a", "b", "x.py", 4) for i in range(90)], CALLS)
    nodes = spark.createDataFrame([("u", "a", "x.py", 1, 9), ("v", "b", "y.py", 20, 21)], NODES)
    assert [tuple(r) for r in graph.call_edges(calls, nodes).collect()] == [("u", "v", "uses", "x.py", 4)]
    assert asked == [1]
