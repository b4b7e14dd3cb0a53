"""The join by automata against looking for each key in each text; table functions against the column forms."""

import random

import pytest

from provspark.functions import tables
from provspark.operators import bind, contains


@pytest.mark.parametrize(("keys_a_part", "texts_a_task"), [(50_000, 50_000), (7, 50_000), (3, 4)])
def test_every_key_in_every_text(spark, monkeypatch, keys_a_part, texts_a_task):
    """One automaton, many, and split ones; keys in keys, shorter than a head, empty, repeated and null; heads that many keys share."""
    monkeypatch.setattr(contains, "KEYS", keys_a_part)
    monkeypatch.setattr(contains, "TEXTS", texts_a_task)
    rng = random.Random(keys_a_part)
    word = lambda n: "".join(rng.choice("abé \U0001f600") for _ in range(n))
    keys = ["", None, "a", "ab", "abab", "supersede", *(word(rng.randrange(1, 8)) for _ in range(40)), *("aaaa" + word(rng.randrange(5)) for _ in range(20))]
    texts = [(str(i), t) for i, t in enumerate([None, "", "a", *(word(rng.randrange(60)) + rng.choice(["", "aaaaab", "supersede"]) for _ in range(40))])]
    got = contains.hits(spark.createDataFrame(texts, "id string, text string"), spark.createDataFrame([(k,) for k in keys + keys], "key string")).collect()
    want = {(i, k) for i, t in texts for k in keys if t is not None and k is not None and k in t}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_a_text_gives_no_row_for_what_other_keys_share(spark, monkeypatch):
    """However many keys begin alike, a text gives a row for each place and length that a key may have: here one of its own, besides the short key."""
    monkeypatch.setattr(contains, "KEYS", 7)
    keys = spark.createDataFrame([(f"supersede d{k}",) for k in range(1000, 1400)] + [("d1",)], "key string")
    texts = spark.createDataFrame([((f"c{k}", k), f"we supersede d{k} by 取代") for k in range(900, 1100)], "id struct<uid:string,seq:long>, text string")
    found = [(r["id"]["seq"], r["key"]) for r in contains.pieces(texts, keys).collect()]
    assert len(found) == len(set(found)) <= 2 * 200
    assert {(k, f"supersede d{k}") for k in range(1000, 1100)} <= set(found) and {(r["id"]["seq"], r["key"]) for r in contains.hits(texts, keys).collect()} == {(k, key) for k in range(1000, 1100) for key in (f"supersede d{k}", "d1")}


def test_no_keys_or_texts(spark):
    some, none = spark.createDataFrame([(1, "ab")], "id long, text string"), spark.createDataFrame([], "id long, text string")
    keys = spark.createDataFrame([("a",)], "key string")
    assert contains.hits(some, keys.limit(0)).collect() == [] and contains.hits(none, keys).collect() == []
    assert [tuple(r) for r in contains.hits(some, keys).collect()] == [(1, "a")]
    assert [tuple(r) for r in contains.hits(some, spark.createDataFrame([("",)], "key string")).collect()] == [(1, "")]


def test_table_functions_in_sql(spark):
    tables.register(spark)
    rng = random.Random(3)
    lines = ["+new", "-old", " same", "+++ b/f", "--- a/f", "\\ No newline", "@@ -1,2 +7,3 @@ f", "@@ -5 +40 @@", "", "@@ odd"]
    patches = spark.createDataFrame([(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(14)))) for i in range(120)] + [(999, None)], "id int, patch string")
    got = spark.sql("select p.id, l.line from {patches} p, lateral changed_lines(p.patch) l", patches=patches)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, bind.changed_lines(patches).collect())) and got.count() > 30
    assert [tuple(r) for r in spark.sql("select * from sentences('One. Two!\n- three')").orderBy("nth").collect()] == [(0, "One."), (1, "Two!"), (2, "three")]
    assert spark.sql("select * from sentences(null)").collect() == [] and spark.sql("select * from changelog_items(null)").collect() == []
    row = spark.sql("select * from decisions_in('Use lists rather than maps. Nothing here.')").first()
    assert tuple(row) == (0, "Use lists", "", ["maps"], "decision")
