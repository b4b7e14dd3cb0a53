"""Files of a working tree: source files, design documents and the changelog, through Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provspark.functions import paths
from provspark.operators.records import CHANGELOGS
from provspark.sources.parsers import language_of


#: Where design documents lie.
DESIGN = "docs/adr"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _files(spark: SparkSession, root: str, pattern: str, deep: bool) -> DataFrame:
    """(file_path under root, name, modified, content) of the files whose name matches."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", deep).load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    path = F.regexp_replace(F.substring_index("path", ":", -1), "^/+", "/")
    under = F.expr(f"substr({{0}}, instr({{0}}, '{base}/') + {len(base) + 1})".replace("{0}", "p"))
    return raw.withColumn("p", path).select(under.alias("file_path"), F.substring_index("p", "/", -1).alias("name"), F.col("modificationTime").alias("modified"), "content")


def working_tree(spark: SparkSession, root: str) -> DataFrame:
    """(seq, sha, ts, file_path, text) of the source files under a folder that are UTF-8; commit WORKTREE, now."""
    found = _files(spark, root, "*.*", True).filter(language_of(F.col("file_path")).isNotNull() & ~paths.is_skipped(F.col("file_path")))
    text = F.decode("content", "UTF-8")
    return found.filter(F.encode(text, "UTF-8") == F.col("content")).select(F.lit(0).cast("long").alias("seq"), F.lit("WORKTREE").alias("sha"), F.current_timestamp().alias("ts"), "file_path", text.alias("text"))


def design_documents(spark: SparkSession, root: str, folder: str = DESIGN) -> DataFrame:
    """(seq, file_path, text, modified) of the Markdown files of a folder."""
    found = _files(spark, f"{root.rstrip('/')}/{folder}", "*.md", False)
    return found.select(F.xxhash64("name").alias("seq"), F.concat(F.lit(folder + "/"), "name").alias("file_path"), F.decode("content", "UTF-8").alias("text"), "modified")


def changelog(spark: SparkSession, root: str) -> DataFrame:
    """(seq, file_path, text, modified) of the one changelog: the first of the conventional names, in any case."""
    rank = F.coalesce(*[F.when(F.lower("name") == n.lower(), k) for k, n in enumerate(CHANGELOGS)])
    found = _files(spark, root, "*.{md,MD,rst,RST,txt,TXT}", False).withColumn("rank", rank).filter("rank is not null")
    first = found.withColumn("_n", F.row_number().over(Window.orderBy("rank", "name"))).filter("_n = 1")  # of ten names at most
    return first.select(F.lit(0).cast("long").alias("seq"), F.col("name").alias("file_path"), F.decode("content", "UTF-8").alias("text"), "modified")
