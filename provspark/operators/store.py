"""The store: a folder of Parquet tables, the merge rules of each, its guard and its checkpoint."""

from __future__ import annotations

import json
import uuid
from pathlib import PurePosixPath

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provspark import schema

MANIFESTS = "manifests"
TABLES = {"nodes": schema.NODE, "edges": schema.EDGE, "decisions": schema.DECISION, "links": schema.LINK}


class GraphShrinkError(RuntimeError):
    """An incremental write would lose most of the stored graph."""


def last_of(df: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """Upsert: the last row of each key by seq."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(seq).desc()))).filter("_n = 1").drop("_n")


def first_of(df: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """Insert or ignore: the first row of each key by seq."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(seq))).filter("_n = 1").drop("_n")


def merge_edges(edges: DataFrame) -> DataFrame:
    return first_of(edges, ["from_uid", "to_uid", "kind"])


def merge_links(links: DataFrame) -> DataFrame:
    return first_of(links, ["decision_uid", "file_path", "line"])


def merge_by_uid(rows: DataFrame) -> DataFrame:
    return last_of(rows, ["uid"])


def without_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are stored."""
    ids = nodes.select("uid").distinct()
    return edges.join(ids.withColumnRenamed("uid", "from_uid"), "from_uid", "left_semi").join(ids.withColumnRenamed("uid", "to_uid"), "to_uid", "left_semi")


def replaced(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The stored rows whose uid isn't written anew, and the new ones."""
    return stored.join(fresh.select("uid").distinct(), "uid", "left_anti").unionByName(fresh)


def link_lines(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of wanted (decision_uid, file_path, lines array) that links lack, one a line from 1 on."""
    new = wanted.select("decision_uid", "file_path", F.explode("lines").alias("line")).filter("line > 0").distinct()
    return new.join(links.select("decision_uid", "file_path", "line"), ["decision_uid", "file_path", "line"], "left_anti")


def repaired(nodes: DataFrame) -> DataFrame:
    """Closes all open versions of a (file, name) but the youngest, at the youngest's start."""
    w = Window.partitionBy("file_path", "name", F.col("valid_to").isNull())
    youngest = F.row_number().over(w.orderBy(F.col("valid_from").desc(), "seq")) == 1
    fix = F.col("valid_to").isNull() & ~F.col("_youngest")
    return nodes.withColumn("_youngest", youngest).withColumn("_from", F.max("valid_from").over(w)).withColumn("valid_to", F.when(fix, F.col("_from")).otherwise(F.col("valid_to"))).drop("_youngest", "_from")


def representatives(nodes: DataFrame) -> DataFrame:
    """One version of each (file, name): open before closed, then the youngest, then the first."""
    w = Window.partitionBy("file_path", "name").orderBy(F.col("valid_to").isNull().desc(), F.col("valid_from").desc(), "seq")
    return nodes.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def guard(new: int, stored: int, replace: bool = False) -> None:
    """Refuses an incremental write that would leave under half of what is stored."""
    if not replace and stored > 0 and new < 0.5 * stored:
        raise GraphShrinkError(f"{stored} versions are stored and {new} would be left; index again from scratch if that is meant")


def needs_rebuild(nodes: DataFrame, recorded: int) -> bool:
    """True where all stored versions come from a working tree, or fewer are stored than were recorded."""
    row = nodes.agg(F.count("*").alias("n"), F.bool_and(F.col("commit_sha") == "WORKTREE").alias("flat")).first()
    return bool(row["n"] and row["flat"]) or 0 < row["n"] < recorded


class ConcurrentWriteError(RuntimeError):
    """Another writer has put a version in force since this one read the store."""


#: Layout of the stored tables. What a version of an older layout lacks is added as it is read, step by step.
LAYOUT = 2
DEFAULTS_SINCE: dict[int, dict[str, dict[str, object]]] = {
    2: {"links": {"commit_sha": ""}, "nodes": {"valid_to": None, "commit_sha": ""}, "decisions": {"category": schema.DEFAULTS["category"], "tier": schema.DEFAULTS["tier"]}},
}


def migrated(name: str, raw: DataFrame, layout: int) -> DataFrame:
    """A stored table in today's layout."""
    for step in range(layout + 1, LAYOUT + 1):
        for column, value in DEFAULTS_SINCE[step].get(name, {}).items():
            kind = TABLES[name][column]
            default = F.lit(value).cast(kind)
            raw = raw.withColumn(column, F.coalesce(F.col(column).cast(kind), default) if column in raw.columns else default)
    return raw


class Store:
    """Tables in versioned folders under a root on any file system Spark writes.

    A version is in force once its manifest is there: a small file with the next number, created only where no other has that number. So a write shows whole or not at all,
    and of two writers that started from one version the second is refused. On file systems whose create isn't atomic (some object stores) keep to one writer.
    A writer that dies between creating a manifest and filling it leaves an empty one; nothing is lost, but writers are refused until it is deleted.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, str(PurePosixPath(root)) if "://" not in root else root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._seen: int | None = None

    def _read(self, name: str) -> str | None:
        p = self._path(f"{self.root}/{name}")
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str, overwrite: bool = True) -> None:
        stream = self._fs.create(self._path(f"{self.root}/{name}"), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def _manifests(self) -> list[int]:
        """Numbers of the manifests, newest first."""
        folder = self._path(f"{self.root}/{MANIFESTS}")
        if not self._fs.exists(folder):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(folder))
        return sorted((int(n) for n in names if n.isdigit()), reverse=True)

    def _in_force(self) -> tuple[int, str | None, int]:
        """(number, folder, layout) of the version in force. A manifest that is still being written isn't."""
        for number in self._manifests():
            try:
                found = json.loads(self._read(f"{MANIFESTS}/{number:08}") or "")
            except ValueError:
                continue
            return number, found["folder"], found["layout"]
        before = self._read("current")  # the layout without manifests
        return 0, before.strip() if before else None, 1

    def exists(self) -> bool:
        return self._in_force()[1] is not None

    def table(self, name: str) -> DataFrame:
        """A stored table, empty where nothing is stored; older layouts get what they lack."""
        number, folder, layout = self._in_force()
        self._seen = number if self._seen is None else self._seen
        if folder is None:
            return self.spark.createDataFrame([], schema.ddl(TABLES[name]))
        raw = migrated(name, self.spark.read.parquet(f"{self.root}/{folder}/{name}"), layout)
        if name == "decisions":
            return schema.read_decisions(raw)
        return raw.select(*[(F.col(c) if c in raw.columns else F.lit(None).cast(kind)).alias(c) for c, kind in TABLES[name].items()])

    def begin(self) -> None:
        """A write that begins here is refused if anyone else puts a version in force before it does; without, it counts from the first table read since the last write."""
        self._seen = self._in_force()[0]

    def write(self, tables: dict[str, DataFrame]) -> dict[str, int]:
        """Writes all four tables as a new version and puts it in force. The one before stays for those who read it; the one before that is deleted."""
        base = self._in_force()[0] if self._seen is None else self._seen
        folder = f"v-{uuid.uuid4().hex}"
        for name in TABLES:
            df = tables[name].select(*[F.col(c).cast(kind).alias(c) for c, kind in TABLES[name].items()])
            if name == "nodes":
                df = df.sortWithinPartitions("file_path", "line_start")
            df.write.parquet(f"{self.root}/{folder}/{name}")
        counts = {name: self.spark.read.parquet(f"{self.root}/{folder}/{name}").count() for name in TABLES}
        try:
            if self._in_force()[0] != base:
                raise ConcurrentWriteError(f"version {base + 1} is there already")
            self._write(f"{MANIFESTS}/{base + 1:08}", json.dumps({"folder": folder, "layout": LAYOUT}), overwrite=False)
        except (ConcurrentWriteError, Py4JJavaError) as e:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)
            if isinstance(e, Py4JJavaError) and "AlreadyExists" not in str(e.java_exception):
                raise
            raise ConcurrentWriteError(f"another writer was first to version {base + 1}; read the store again and repeat") from None
        self._seen = None
        self._drop_old(base + 1)
        return counts

    def _drop_old(self, number: int) -> None:
        """Deletes versions before the one before `number`."""
        for old in (n for n in self._manifests() if n < number - 1):
            found = json.loads(self._read(f"{MANIFESTS}/{old:08}") or "{}")
            if found:
                self._fs.delete(self._path(f"{self.root}/{found['folder']}"), True)
            self._fs.delete(self._path(f"{self.root}/{MANIFESTS}/{old:08}"), False)
        if number > 1:
            for name in ("current", "previous"):  # of the layout without manifests
                if folder := self._read(name):
                    self._fs.delete(self._path(f"{self.root}/{folder.strip()}"), True)
                    self._fs.delete(self._path(f"{self.root}/{name}"), False)

    def save_checkpoint(self, head: str, node_count: int) -> None:
        self._write("checkpoint.json", json.dumps({"head": head, "tool": "provspark", "node_count": node_count}))

    def checkpoint(self) -> dict:
        """The last state, empty where it is missing or unreadable."""
        try:
            found = json.loads(self._read("checkpoint.json") or "{}")
        except ValueError:
            return {}
        return found if isinstance(found, dict) else {}
