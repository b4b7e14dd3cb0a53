"""Two-pass external shuffle: rows are scattered by seeded hashes into buckets that a task can hold, then each bucket is shuffled (Fisher-Yates) and dealt out to shards.

Only DataFrame functions are used. The first pass is one shuffle of Spark's, a bucket a partition; the second works on a bucket at a time and moves nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from provspark.llm.common import free_names

#: Bytes of rows in a bucket (a task holds one as objects), the fewest buckets, and the most (their offsets are broadcast: 16 bytes each).
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 16 << 20, 64, 1 << 17


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def row_bytes(field: T.StructField) -> Column | None:
    """About what a value takes beyond its fixed part."""
    c = quoted(field.name)
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    return F.greatest(F.size(c), F.lit(0)).cast("long") * 16 if isinstance(field.dataType, T.ArrayType) else None


def bucket_count(rows: DataFrame, bucket_bytes: int = BUCKET_BYTES, least: int = LEAST_BUCKETS) -> int:
    """How many buckets of bucket_bytes the rows fill; rows without texts or arrays are counted only."""
    parts = [b for f in rows.schema if (b := row_bytes(f)) is not None]
    found = rows.agg(F.count("*").alias("n"), *[F.sum(b).alias(f"b{i}") for i, b in enumerate(parts)]).first()
    held = found["n"] * (32 + 16 * len(rows.columns)) + sum(v or 0 for v in found[1:])
    buckets = max(least, -(-held // bucket_bytes))
    if buckets > MOST_BUCKETS:
        raise ValueError(f"{held} bytes fill {buckets} buckets of {bucket_bytes} bytes, more than {MOST_BUCKETS}: raise bucket_bytes")
    return buckets


def shuffled(rows: DataFrame, seed: int = 7, bucket_bytes: int = BUCKET_BYTES, least: int = LEAST_BUCKETS) -> DataFrame:
    """rows with `bucket` and `place`, the row's number (from 0, gapless) in a uniformly shuffled order; present columns of these names are replaced.

    Which row comes where depends on the seed, the rows and the number of buckets alone, not on files, partitions or lost executors. Rows equal in every column can't
    be told apart: they are counted, and their copies go to as many buckets as there are, in turn from a hashed one, so no hot row fills a bucket. Nulls are values like
    others; no rows give no rows. Columns must be orderable (no maps).
    """
    rows = rows.drop("bucket", "place")
    buckets = bucket_count(rows, bucket_bytes, least)
    h, copies, j, m, row, offset = free_names(rows, "h", "copies", "j", "m", "row", "offset")
    cols = [quoted(c) for c in rows.columns]
    # A hash skips nulls, so which columns are null is hashed as well.
    nulls = F.concat(F.lit("n"), *[F.when(c.isNull(), "1").otherwise("0") for c in cols])
    counted = rows.groupBy(*cols).agg(F.count("*").alias(copies)).withColumn(h, F.xxhash64(F.lit(seed), nulls, *cols))
    turns = counted.withColumn(j, F.explode(F.sequence(F.lit(0), F.least(F.col(copies), F.lit(buckets)).cast("int") - 1)))
    share = F.expr(f"{copies} div {buckets}").cast("int") + (F.col(j) < F.col(copies) % buckets).cast("int")
    start = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(h)), F.lit(buckets))
    scattered = turns.select(*cols, h, share.alias(m), ((start + F.col(j)) % buckets).cast("int").alias("bucket"))

    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # over the buckets, at most MOST_BUCKETS
    offsets = scattered.groupBy("bucket").agg(F.sum(m).alias("n")).select("bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias(offset))
    each = scattered.repartitionById(buckets, F.col("bucket")).select("bucket", F.struct(h, *cols).alias(row), F.explode(F.sequence(F.lit(1), F.col(m))).alias(m))
    # Spark's shuffle() is Fisher-Yates from the seed and the number of the partition, and that is the bucket's; sorting makes what it starts from the same every time.
    mixed = each.groupBy("bucket").agg(F.shuffle(F.sort_array(F.collect_list(row)), F.lit(seed)).alias(row))
    placed = mixed.join(F.broadcast(offsets), "bucket").select("bucket", offset, F.posexplode(row).alias(j, row))
    return placed.select(*[F.col(row).getField(c).alias(c) for c in rows.columns], "bucket", (F.col(offset) + F.col(j)).alias("place"))


def dealt(rows: DataFrame, shards: int = 8, seed: int = 7, bucket_bytes: int = BUCKET_BYTES, least: int = LEAST_BUCKETS) -> DataFrame:
    """shuffled rows with `shard` (0 to shards - 1) and `slot` (gapless from 0 in a shard): the shuffled order is dealt out in turn, so shards differ by one row at most."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    return shuffled(rows.drop("shard", "slot"), seed, bucket_bytes, least).withColumns({"shard": (F.col("place") % shards).cast("int"), "slot": F.expr(f"place div {int(shards)}")})


def write_shards(rows: DataFrame, path: str, shards: int = 8, seed: int = 7, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Writes the shards as folders `shard=s`: a file for each bucket and shard, each sorted by slot. A run again replaces them by the same rows."""
    dealt(rows, shards, seed, bucket_bytes).sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, bucket) of every row; only these few numbers of a text are shuffled. The law is `rows`.

    A null text has size 1 and the checksum of no bytes (0), a null doc_id is kept, rows that repeat each other each have a slot of their own, no rows give no rows.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    return dealt(narrow, shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "bucket")
