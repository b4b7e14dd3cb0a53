"""The store: writers that meet, readers meanwhile, and layouts of before."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from provspark import schema
from provspark.operators.store import ConcurrentWriteError, Store


def tables(spark, n):
    """n rows in each table, so that a reader sees whether they belong together."""
    def of(columns):
        return spark.range(n).select(*[F.col("id").cast("string").cast(k).alias(c) if not k.startswith("array") else F.array().cast(k).alias(c) for c, k in columns.items()])

    nodes = of(schema.NODE | {"valid_from": "string", "valid_to": "string"}).withColumns({"valid_from": F.lit(None), "valid_to": F.lit(None)})
    return {"nodes": nodes, "edges": of(schema.EDGE), "decisions": of(schema.DECISION | {"timestamp": "string"}).withColumn("timestamp", F.lit(None)), "links": of(schema.LINK)}


def test_second_of_two_writers_is_refused(spark, tmp_path):
    root = str(tmp_path / "s")
    a, b = Store(spark, root), Store(spark, root)
    a.begin(), b.begin()
    a.write(tables(spark, 1))
    with pytest.raises(ConcurrentWriteError, match="read the store again"):
        b.write(tables(spark, 2))
    assert b.table("edges").count() == 1 and len([x for x in os.listdir(root) if x.startswith("v-")]) == 1
    b.begin()
    assert b.write(tables(spark, 2))["edges"] == 2 and a.table("edges").count() == 2
    # Without a begin, it counts from the first table read.
    a._seen = None
    a.table("nodes")
    Store(spark, root).write(tables(spark, 3))
    with pytest.raises(ConcurrentWriteError):
        a.write(tables(spark, 4))
    assert len([x for x in os.listdir(root) if x.startswith("v-")]) == 2


def test_readers_see_whole_versions_alone(spark, tmp_path):
    root = str(tmp_path / "s")
    writer = Store(spark, root)
    writer.write(tables(spark, 1))
    seen, stop = [], threading.Event()

    def read():
        reader = Store(spark, root)
        while not stop.is_set():
            seen.append(reader._in_force()[1])

    t = threading.Thread(target=read)
    t.start()
    for n in (2, 3, 4):
        writer.write(tables(spark, n))
    stop.set()
    t.join()
    assert len(seen) > 4 and None not in seen and len(set(seen)) > 1
    assert Store(spark, root).table("links").count() == 4


def test_a_manifest_half_written_is_not_in_force(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.write(tables(spark, 2))
    (tmp_path / "s/manifests/00000002").write_text("")
    assert s.table("edges").count() == 2 and s.exists()


def test_a_store_without_manifests_is_read_and_moved_on(spark, tmp_path):
    """The first layout: a pointer file, links without a commit, decisions without category and tier, nodes without an end."""
    root = tmp_path / "s"
    old = tables(spark, 3)
    drop = {"links": ["commit_sha"], "decisions": ["category", "tier"], "nodes": ["valid_to", "commit_sha"], "edges": []}
    for name, df in old.items():
        df.drop(*drop[name]).write.parquet(str(root / "v-old" / name))
    (root / "current").write_text("v-old\n")
    s = Store(spark, str(root))
    assert s.exists() and [r["commit_sha"] for r in s.table("links").collect()] == [""] * 3
    d = s.table("decisions").first()
    assert (d["category"], d["tier"], s.table("nodes").first()["valid_to"]) == ("design", "decision", None)
    s.write({name: s.table(name) for name in old})
    assert s.table("links").count() == 3 and (root / "v-old").is_dir()
    s.write({name: s.table(name) for name in old})
    assert s.table("links").count() == 3 and not (root / "v-old").exists() and not (root / "current").exists()


def test_nothing_stored(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    assert not s.exists() and s.table("nodes").count() == 0 and s.checkpoint() == {}
