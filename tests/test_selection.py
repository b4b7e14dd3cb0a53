"""Order statistics and samples against sorting everything."""

import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from provspark.operators import reports, selection

NAN, INF = float("nan"), float("inf")


def values(spark, vs):
    return spark.createDataFrame([(v, "x") for v in vs], "v double, part string")


@pytest.mark.parametrize("shape", ["spread", "steep", "few", "one", "ends"])
def test_ranks_as_sorted(spark, monkeypatch, shape):
    monkeypatch.setattr(selection, "FETCHED", 20)
    rng = random.Random(4)
    vs = {
        "spread": lambda: rng.uniform(-5, 5), "steep": lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300), "few": lambda: float(rng.randrange(3)), "one": lambda: 7.0,
        "ends": lambda: rng.choice([NAN, INF, -INF, 0.0, 5e-324, rng.random()]),
    }[shape]
    vs = [vs() for _ in range(1500)]
    ranks = [0, 1, 40, 700, 701, 749, 1300, 1498, 1499]
    got = selection.at_ranks(values(spark, [*vs, None, None]), "v", ranks)
    want = sorted(vs, key=lambda x: (math.isnan(x), x))
    assert list(got) == ranks and all(str(got[r]) == str(want[r]) for r in ranks)


def test_percentiles_as_numpy(spark):
    vs = [float(x) for x in np.random.default_rng(1).normal(size=777)]
    row = reports.percentiles(values(spark, [*vs, None]), "v").first()
    assert [row["p50"], row["p95"], row["p99"]] == pytest.approx(list(np.percentile(vs, [50, 95, 99])), rel=1e-12) and row["mean"] == pytest.approx(np.mean(vs))
    none = reports.percentiles(values(spark, [None]), "v").first()
    assert list(none) == [None] * 4
    assert selection.at_ranks(values(spark, [1.0]), "v", [-1, 1]) == {}


def test_sample_of_links_and_middles(spark):
    links = spark.createDataFrame([("d", "n", f"f{i % 7}", i) for i in range(100)] * 3 + [("d", "n", "f", None)], "decision_uid string, node_uid string, file_path string, line int")
    nodes = spark.createDataFrame([(f"n{i}", f"g{i % 5}", i, i + 8, None if i % 2 else datetime(2024, 1, 1)) for i in range(60)] + [("bad", "g", 9, 3, None)], "uid string, file_path string, line_start int, line_end int, valid_to timestamp")
    take = lambda a, b, n: [tuple(r) for r in reports.sampled(a, b, n).collect()]
    got = take(links, nodes, 21)
    assert len(set(got)) == 21 and sum(o == "link" for *_, o in got) == 11
    assert all((path, line) in {(f"f{i % 7}", i) for i in range(100)} if o == "link" else (line - 4) % 2 == 1 and path == f"g{(line - 4) % 5}" for path, line, o in got)
    assert sorted(take(links.repartition(5), nodes.repartition(3), 21)) == sorted(got)
    assert {o for *_, o in take(links, nodes.limit(0), 20)} == {"link"} and len(take(links, nodes.limit(0), 20)) == 20
    assert len(take(links.filter("line < 4"), nodes, 20)) == 20 and take(links.limit(0), nodes.limit(0), 20) == []
    # A line that has a link and is the middle of a symbol is asked about once.
    both = spark.createDataFrame([("d", "n", "g0", 5 * i + 4) for i in range(12)], links.schema)
    lines = take(both, nodes.filter("file_path = 'g0'").withColumn("valid_to", F.lit(None).cast("timestamp")), 40)
    assert len(lines) == len({x[:2] for x in lines}) == 12
