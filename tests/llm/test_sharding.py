"""The two-pass shuffle: every row once, even shards, the same order however the rows lie."""

import zlib
from collections import Counter

import pytest
from conftest import LONG
from pyspark.sql import functions as F

from provspark.llm import sharding


def many(frame, odd):
    return frame([*odd, *[(100 + i, f"text {i}") for i in range(900)], *[(None, "no id at all")] * 500, *[(50, "again")] * 333])


def placed(df):
    return sorted((r["shard"], r["slot"], -1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"]) for r in df.collect())


@pytest.mark.parametrize("shards", [8, 1, 3])
def test_every_row_once_and_even_shards(frame, odd, shards):
    docs = many(frame, odd)
    got = placed(sharding.shard_documents(docs, shards))
    want = Counter((-1 if r["doc_id"] is None else r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter(g[2:] for g in got) == want
    sizes = Counter(g[0] for g in got)
    assert set(sizes) == set(range(shards)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert [g[:2] for g in got] == [(s, i) for s in range(shards) for i in range(sizes[s])]


def test_order_depends_on_rows_and_seed_alone(spark, frame, odd):
    docs = many(frame, odd)
    once = placed(sharding.shard_documents(docs))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert placed(sharding.shard_documents(docs.repartition(17, F.rand()))) == once
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    places = lambda seed: [r["doc_id"] for r in sharding.shuffled(docs.select("doc_id"), seed).orderBy("place").collect()]
    assert places(1) == places(1) != places(2)


def test_hot_rows_fill_no_bucket(frame):
    docs = frame([(None, "same")] * 3000 + [(i, "x") for i in range(300)])
    held = [r["count"] for r in sharding.shuffled(docs, least=16).groupBy("bucket").count().collect()]
    assert len(held) == 16 and max(held) < 3300 / 16 * 1.5


def test_shuffle_is_uniform(spark):
    """Where the first of 50 rows lands, and which row comes right after it, over many seeds; more than one row a bucket."""
    rows = spark.range(50).coalesce(1)
    first, after = Counter(), Counter()
    for seed in range(60):
        order = [r["id"] for r in sharding.shuffled(rows, seed * 10, least=4).orderBy("place").collect()]
        assert sorted(order) == list(range(50))
        at = order.index(0)
        first[at // 10] += 1
        after[order[(at + 1) % 50] // 10] += 1
    for found in (first, after):
        assert len(found) == 5 and max(found.values()) <= 26, found  # 12 expected of each, 26 is over four deviations away


def test_rows_come_whole_with_clashing_columns(spark, frame, odd, tmp_path):
    docs = frame(odd).withColumns({c: F.lit(c) for c in ("h", "copies", "j", "m", "offset", "place", "slot", "shard", "bucket")})
    kept = [c for c in docs.columns if c not in ("place", "slot", "shard", "bucket")]
    out = str(tmp_path / "shards")
    key = lambda rows: Counter(tuple(r[c] for c in kept) for r in rows)
    runs = []
    for _ in range(2):
        sharding.write_shards(docs, out, 3)
        back = spark.read.parquet(out)
        assert key(back.collect()) == key(docs.collect())
        runs.append(sorted((r["shard"], r["slot"], str(r["doc_id"]), r["text"] or "") for r in back.collect()))
    assert runs[0] == runs[1] and any(r[3] == LONG for r in runs[0])


def test_no_rows_and_too_many_buckets(frame):
    assert sharding.shard_documents(frame([])).collect() == []
    with pytest.raises(ValueError, match="raise bucket_bytes"):
        sharding.bucket_count(frame([(1, "x" * 10_000)] * 40), bucket_bytes=1)
    with pytest.raises(ValueError, match="at least one"):
        sharding.dealt(frame([]), 0)


def test_buckets_follow_the_bytes(frame):
    docs = frame([(i, "x" * 1000) for i in range(100)])
    assert sharding.bucket_count(docs, 10_000, 1) >= 10 and sharding.bucket_count(docs.select("doc_id"), 10_000, 1) < 3
