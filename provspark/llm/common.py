"""What several training-data operators share: tables cut from their lineage, word hashing, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Rows and bytes of an Arrow batch that a Python stage gets; both ends hold a batch whole. A row that is longer by itself comes alone.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Rows up to which a table may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 20_000
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (local tests only) one made here."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="provspark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: later plans start from files that outlive any executor.

    The shuffle files of the write are dropped as soon as it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop_cut(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote and nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.cut_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that df has no columns of."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n in taken:
            n += "_"
        taken.add(n)
        out.append(n)
    return out


def small_batches(spark: SparkSession) -> None:
    """Has the JVM send at most BATCH_ROWS rows and about BATCH_BYTES at a time, unless the session asks for less: texts can be long.

    The settings stay, for a plan reads them when it runs, and that is after its caller has it.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:  # Spark gives bytes back with their unit
            spark.conf.set(key, str(most))


def in_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow over batches of at most BATCH_ROWS rows and about BATCH_BYTES."""

    small_batches(df.sparkSession)

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return work(b.slice(i, BATCH_ROWS) for b in batches for i in range(0, b.num_rows, BATCH_ROWS))

    return df.mapInArrow(sliced, schema)


def small_join(big: DataFrame, small: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """Joins with a broadcast if the other side has at most BROADCAST_ROWS rows (it is counted first), else by a shuffle, which AQE splits where a key is hot."""
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return big.join(small, on, how)


def place_among(column: F.Column, cuts: list) -> F.Column:
    """How many of the ascending cuts are at most the column: among every s-th first, then among the s behind it (s: root of their number)."""
    if not cuts:
        return F.lit(0)
    s = int(np.ceil(np.sqrt(len(cuts))))
    every, coarse = (F.array(*map(F.lit, c)) for c in (cuts, cuts[::s]))
    count = lambda held: F.aggregate(held, F.lit(0), lambda n, c: n + (column >= c).cast("int"))
    before = F.greatest(count(coarse) - 1, F.lit(0)) * s
    return before + count(F.slice(every, before + 1, F.lit(s)))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


class WordTable(dict):
    """word (bytes) -> 64-bit hash, kept for the words met lately; bounded."""

    def __init__(self, most: int = 300_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lower_ascii(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased and nothing else changed."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the edges; component: the smallest node reachable.

    Alternates large-star and small-star (Kiveris et al., 2014) until the edges form stars about their smallest nodes. Each half is an aggregate with partial
    sums and a join, so a node that a third of all edges touch is never gathered in one task. At most BROADCAST_ROWS edges, as many as a broadcast may hold, lie in
    one partition, where no step shuffles: a loop over a few rows would else cost the driver a full round of tasks for each of its shuffles.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    few = e.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # no step makes more edges of them
    at = lambda t: t.coalesce(1) if few else t
    while _not_stars(at(e)):
        least = _both_ways(at(e)).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = at(e).select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = cut(large, "large-star")
        least = at(large).groupBy("u").agg(F.min("v").alias("m"))
        small = at(large).join(least, "u").select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
        nxt = cut(small.filter("u <> v").distinct(), "small-star")
        drop_cut(e, large)
        e = nxt
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def _both_ways(e: DataFrame) -> DataFrame:
    return e.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))


def _not_stars(e: DataFrame) -> bool:
    ends = e.select(F.inline(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))))
    odd = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)")
    return not odd.isEmpty()
