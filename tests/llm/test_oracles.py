"""Queries against their SQL twins over the smallest tables."""

import pytest
from helpers import DATA, plain

from provspark.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, oracle, name):
    ours, theirs = registry.queries()[name](spark, DATA).toPandas(), oracle(registry.oracle_sql()[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


def test_all_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 13))
