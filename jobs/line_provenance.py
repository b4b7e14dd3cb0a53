"""Which document brought each line in, how far it has spread, and what decision it states.

The blame table of a corpus: a source is a project, its documents in order of doc_id are its history. For each distinct line (or sentence) of a source it tells the first and
the last document that has it, in how many documents and places it stands, and, read off the line, the decision with its reason and alternatives.

    python -m jobs.line_provenance --documents /data/documents.parquet --out /data/provenance
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, configured, seen, settings
from provspark.functions import text
from provspark.session import ship

#: Sources that a task writes without sorting by them; with more it sorts the rest.
OPEN_FILES = 20


def _source() -> Column:
    """A document's source; an empty one is none."""
    return F.nullif("source", F.lit("")).alias("source")


def ids_repeat(documents: DataFrame) -> bool:
    """Whether some document of a source has more than one row."""
    return not documents.filter("doc_id is not null").groupBy("doc_id", _source()).count().filter("count > 1").isEmpty()


def lines(documents: DataFrame, least_chars: int = 1, repeat: bool = True) -> DataFrame:
    """(source, line, first_doc, last_doc, n_docs, n_places): a row for each distinct line of a source.

    Sums are partial before each shuffle, so a line in a third of all documents is one row a task. A null text has no lines, an empty source is none, and documents
    without an id count as places only. Where no document has more than one row (`repeat` is false), it is counted in its own row, and lines are not shuffled by their documents.
    """
    docs = documents.select("doc_id", _source(), F.sort_array(F.transform(text.sentences(F.col("text")), text.collapsed_value)).alias("said"))
    # In order, so that the line before it tells whether a line is the first of its kind in its row.
    told = F.transform("said", lambda line, i: F.struct(line.alias("line"), ((i == 0) | (line != F.get("said", i - 1))).alias("new")))
    each = docs.select("doc_id", "source", F.inline(told)).filter(F.length("line") >= least_chars)
    n_docs = F.count_distinct("doc_id") if repeat else F.count_if(F.col("new") & F.col("doc_id").isNotNull())
    return each.groupBy("source", "line").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), n_docs.alias("n_docs"), F.count("*").alias("n_places"))


def decided(found: DataFrame) -> DataFrame:
    """Lines with what they decide in parts. Each distinct line is looked at once, and the patterns run only on those that hold a keyword; p is null for the others, which have no marker."""
    return found.withColumn("decides", text.looks_like_decision(F.col("line"))).withColumn("p", F.when(F.col("decides"), text.decision_parts(F.col("line"))))


def in_columns(parted: DataFrame) -> DataFrame:
    """The parts of `decided` as columns."""
    with_parts = parted.withColumn("p", F.coalesce("p", text.whole_part(F.col("line"))))
    return with_parts.withColumns({"content": F.col("p.content"), "reason": F.col("p.reason"), "alternatives": F.col("p.alternatives"), "tier": text.tier(F.col("p"))}).drop("p")


def run(spark: SparkSession, documents: str, out: str, least_chars: int = 1) -> DataFrame:
    """Writes the register, partitioned by source, and returns it read back. A run again writes the same; sources that the input doesn't have keep what was written of them."""
    read, wrote = Observation("documents read"), Observation("lines written")
    docs = spark.read.parquet(documents).select("doc_id", "source", "text")
    observed = docs.observe(read, F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    # Rebalancing deals a hot source to several tasks and small ones to one, so that there are few files, none of them large. A line and its content, mostly the same, go as one.
    register = in_columns(decided(lines(observed, least_chars, ids_repeat(docs))).hint("rebalance", "source")).observe(wrote, F.count("*").alias("n"), F.count_if("decides").alias("decisions"))
    with settings(spark, {"spark.sql.sources.partitionOverwriteMode": "dynamic", "spark.sql.maxConcurrentOutputFileWriters": str(OPEN_FILES)}):
        register.write.mode("overwrite").partitionBy("source").parquet(out)
    LOG.info("%s: read %s documents, %s bytes", documents, seen(read)["n"], seen(read)["bytes"])
    LOG.info("%s: wrote %s lines, %s of them decisions", out, seen(wrote)["n"], seen(wrote)["decisions"])
    return spark.read.schema(register.schema).parquet(out)


def main() -> None:
    logging.basicConfig(level=logging.INFO)
    config = configured(__doc__.splitlines()[0], "line_provenance.json", ("documents", "out"))
    spark = SparkSession.builder.appName("line-provenance").getOrCreate()
    try:
        run(ship(spark), **config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
