"""A Git repository as tables: commits, trees, snapshots of files and changed lines, through the git command line.

The repository must be readable where tasks run. `git_log` is a Spark data source, for batches and streams: the driver asks git for a number of commits and a tip, no more;
each task runs one git process over a range of the log and passes on what it prints.
"""

from __future__ import annotations

import re
import subprocess
import sys
import threading
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from provspark import schema
from provspark.operators.bind import changed_lines

COMMITS = schema.ddl(schema.COMMIT)
PATCHES = "sha string, file_path string, patch string"
#: Commits a task reads.
PER_TASK = 2000


def run_git(repo: str, *args: str, check: bool = True) -> str:
    done = subprocess.run(["git", "-C", repo, "-c", "core.quotepath=off", *args], capture_output=True, check=False)
    if check and done.returncode:
        raise ValueError(done.stderr.decode(errors="replace").strip() or f"git {args[0]} failed")
    return done.stdout.decode(errors="replace")


def records_of(repo: str, *args: str, feed: str = "") -> Iterator[str]:
    """What a git process prints, record by record (each begins with \x1e), never all at once."""
    git = subprocess.Popen(["git", "-C", repo, "-c", "core.quotepath=off", *args], stdin=subprocess.PIPE, stdout=subprocess.PIPE)

    def put() -> None:  # beside the reading, as both pipes are small
        git.stdin.write(feed.encode())
        git.stdin.close()

    feeder = threading.Thread(target=put)
    feeder.start()
    held = b""
    try:
        while chunk := git.stdout.read(1 << 20):
            *full, held = (held + chunk).split(b"\x1e")
            yield from (f.decode("utf-8", "replace") for f in full if f.strip())
        if held.strip():
            yield held.decode("utf-8", "replace")
    finally:
        git.stdout.close()
        feeder.join()
        if git.wait() > 0:
            raise ValueError(f"git {args[0]} failed in {repo}")


def file_patches(patch: str) -> Iterator[tuple[str, str]]:
    """(new path, hunks) of each file of a commit's patch that has lines there."""
    for part in re.split(r"^diff --git .*$", patch, flags=re.M)[1:]:
        head, hunk, rest = part.partition("\n@@ ")
        path = re.search(r"^\+\+\+ b/(.+?)\t?$", head, re.M)
        if path and hunk:
            yield path[1], "@@ " + rest


@dataclass
class Range(InputPartition):
    """`count` commits of the log of tip without what base reaches, behind the first `skip`."""

    tip: str
    base: str
    skip: int
    count: int


class Log:
    """What batch and stream share: ranges of the log, and reading one."""

    def __init__(self, options: dict[str, str]):
        self.repo, self.patches = options["path"], options.get("table", "commits") == "patches"
        self.renames = ["-M"] if options.get("renames", "true").lower() == "true" else ["--no-renames"]
        self.options = options

    def knows(self, sha: str) -> bool:
        return bool(sha) and subprocess.run(["git", "-C", self.repo, "cat-file", "-e", f"{sha}^{{commit}}"], capture_output=True, check=False).returncode == 0

    def ranges(self, tip: str, base: str, most: int | None = None) -> list[Range]:
        """A base that the repository doesn't know (any more) counts as none."""
        base = base if self.knows(base) else ""
        n = int(run_git(self.repo, "rev-list", "--count", tip, *([f"^{base}"] if base else [])))
        n, each = min(n, most or n), int(self.options.get("per_task", PER_TASK))
        return [Range(tip, base, i, min(each, n - i)) for i in range(0, n, each)]

    def read(self, part: Range) -> Iterator[tuple]:
        asked = ["log", part.tip, *([f"^{part.base}"] if part.base else []), f"--skip={part.skip}", f"--max-count={part.count}", "--diff-merges=first-parent", "--root", *self.renames]
        if self.patches:
            for record in records_of(self.repo, *asked, "-p", "--no-color", "--no-ext-diff", "--format=%x1e%H"):
                sha, _, patch = record.partition("\n")
                yield from ((sha.strip(), path, hunks) for path, hunks in file_patches(patch))
            return
        for seq, record in enumerate(records_of(self.repo, *asked, "--name-only", "--format=%x1e%H%x1f%P%x1f%ct%x1f%an%x1f%B%x1d"), part.skip):
            head, _, files = record.partition("\x1d")
            sha, parents, when, author, message = head.split("\x1f", 4)
            yield seq, sha, parents.split(" ")[0] or None, datetime.fromtimestamp(int(when), UTC), author, message.strip(), [f for f in files.split("\n") if f]


class LogReader(Log, DataSourceReader):
    def partitions(self) -> list[Range]:
        return self.ranges(run_git(self.repo, "rev-parse", self.options.get("tip", "HEAD")).strip(), self.options.get("since", ""), int(self.options.get("depth", 0)) or None)


class LogStream(Log, DataSourceStreamReader):
    """An offset is the sha of a tip; a batch is what its tip reaches and the one before doesn't. seq counts from the batch's newest."""

    def initialOffset(self) -> dict:
        return {"sha": self.options.get("since", "")}

    def latestOffset(self) -> dict:
        return {"sha": run_git(self.repo, "rev-parse", self.options.get("tip", "HEAD")).strip()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.ranges(end["sha"], start["sha"])


class GitLog(DataSource):
    """`spark.read.format("git_log").load(path)` or readStream. Options: table (commits, or patches: the hunks of each changed file), tip, since (a sha), depth, renames, per_task.

    A task walks the log up to its range, which is cheap beside reading the changes; take larger ranges (per_task) for histories of millions.
    """

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return PATCHES if self.options.get("table", "commits") == "patches" else COMMITS

    def reader(self, schema: object) -> DataSourceReader:
        return LogReader(dict(self.options))

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return LogStream(dict(self.options))


def register(spark: SparkSession) -> None:
    # The workers that plan a Python source beside the driver don't get files added to the session: the source goes there as code.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(GitLog)


def commits(spark: SparkSession, repo: str, depth: int | None = None, since: str | None = None, renames: bool = True) -> DataFrame:
    """Commits reachable from HEAD as it is now, newest first (seq from 0), with the files each changed against its first parent; since: a day, applied after depth."""
    register(spark)
    tip = run_git(repo, "rev-parse", "HEAD").strip()
    out = spark.read.format("git_log").options(tip=tip, depth=depth or 0, renames=renames).load(repo)
    return out.filter(F.col("timestamp") >= F.lit(since).cast("timestamp")) if since else out


def touching(found: DataFrame, path: str) -> DataFrame:
    return found.filter(F.array_contains("changed_files", path))


def resolve_day(found: DataFrame, day: str, zone: str = "UTC") -> DataFrame:
    """The latest commit of a local day; of several at one instant the newest (smallest seq)."""
    when = F.col("timestamp") if zone == "UTC" else F.from_utc_timestamp("timestamp", zone)
    return found.filter(F.to_date(when) == F.lit(day).cast("date")).orderBy(F.col("timestamp").desc(), "seq").limit(1)


def resolve(spark: SparkSession, repo: str, ref: str, zone: str = "UTC") -> tuple[str, int]:
    """(sha, microseconds since 1970) of a day or a revision; an error names some tags."""
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", ref):
        row = resolve_day(commits(spark, repo), ref, zone).select("sha", F.unix_micros("timestamp").alias("at")).first()
        if row is None:
            raise ValueError(f"no commit on {ref}")
        return row["sha"], row["at"]
    try:
        sha = run_git(repo, "rev-parse", "--verify", f"{ref}^{{commit}}").strip()
    except ValueError:
        tags = ", ".join(run_git(repo, "tag", "--list", check=False).split()[:12])
        raise ValueError(f"unknown revision {ref}" + (f"; tags: {tags}" if tags else "")) from None
    return sha, int(run_git(repo, "show", "-s", "--format=%ct", sha)) * 1_000_000


def files_at(repo: str, sha: str) -> list[str]:
    return [f for f in run_git(repo, "ls-tree", "-r", "--name-only", "-z", sha).split("\0") if f]


def snapshots(touched: DataFrame, repo: str) -> DataFrame:
    """(seq, sha, ts, file_path, text) of touched (seq, sha, ts, file_path); a file that isn't there has an empty text."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cat = subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        try:
            for f in frames:
                texts = []
                for sha, path in zip(f["sha"], f["file_path"], strict=True):
                    cat.stdin.write(f"{sha}:{path}\n".encode())
                    cat.stdin.flush()
                    head = cat.stdout.readline().split()
                    if len(head) == 3 and head[1] == b"blob":
                        texts.append(cat.stdout.read(int(head[2])).decode("utf-8", "replace"))
                        cat.stdout.read(1)
                    else:
                        if len(head) == 3:
                            cat.stdout.read(int(head[2]) + 1)
                        texts.append("")
                yield f.assign(text=texts)
        finally:
            cat.stdin.close()
            cat.wait()

    return touched.select("seq", "sha", "ts", "file_path").mapInPandas(work, "seq long, sha string, ts timestamp, file_path string, text string")


def diffs(found: DataFrame, repo: str) -> DataFrame:
    """(sha, file_path, line): lines that each commit added or changed, against its first parent. One git process a batch of commits."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            asked = "".join(f"{sha} {parent}".strip() + "\n" for sha, parent in zip(f["sha"], f["parent"], strict=True))
            for record in records_of(repo, "diff-tree", "--stdin", "--root", "-p", "-M", "--no-color", "--no-ext-diff", "--format=%x1e%H", feed=asked):
                sha, _, patch = record.partition("\n")
                yield pd.DataFrame([(sha.strip(), *p) for p in file_patches(patch)], columns=["sha", "file_path", "patch"])

    patches = found.select("sha", F.coalesce("parent", F.lit("")).alias("parent")).distinct().mapInPandas(work, PATCHES)
    keyed = patches.select(F.struct("sha", "file_path").alias("id"), "patch")
    return changed_lines(keyed).select("id.sha", "id.file_path", "line")
