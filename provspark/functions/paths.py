"""Path normalisation, the seven scope tests and other predicates, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folders that are never read.
SKIPPED = ("node_modules", ".git", "dist", "build", ".venv", "venv", "__pycache__", ".provspark", ".pytest_cache", ".mypy_cache", ".ruff_cache", "target", ".cargo", "vendor")


def normal_text(path: str) -> str:
    """A path as stored: forward slashes, without the dots and slashes it begins with."""
    return re.sub(r"^[./]+", "", path.replace("\\", "/"))


def normal(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^[./]+", "")


def scope_prefix(scope: str | None) -> str:
    p = (scope or "").replace("\\", "/").rstrip("/")
    return "" if p == "." else p


def within(path: Column, prefix: str) -> Column:
    """The path itself or anything under it."""
    return (path == prefix) | path.startswith(prefix + "/")


def in_scope(path: Column, scope: str | None) -> Column:
    """Variant A (nodes, edge counts): at a folder border."""
    p = scope_prefix(scope)
    return within(path, p) if p else F.lit(True)


def edge_in_scope(scope: str | None, path: str = "file_path", from_uid: str = "from_uid", to_uid: str = "to_uid") -> Column:
    """Variant B (edge lists): A, or an end that belongs to the very file."""
    p = scope_prefix(scope)
    return within(F.col(path), p) | F.col(from_uid).startswith(p + "::") | F.col(to_uid).startswith(p + "::") if p else F.lit(True)


def decision_in_scope(path: Column, scope: str | None) -> Column:
    """Variant C (decisions at an instant): A, or no path at all."""
    p = scope_prefix(scope)
    return within(path, p) | (path == "") if p else F.lit(True)


def starts_with(path: Column, scope: str | None) -> Column:
    """Variant D (snapshot lists): plain text prefix, so src2/x is in src."""
    p = scope_prefix(scope)
    return path.startswith(p) if p else F.lit(True)


def starts_with_normal(path: Column, scope: str | None) -> Column:
    """Variant E (exports, timelines): prefix after normalisation."""
    p = normal_text(scope or "")
    return path.startswith(p) if p else F.lit(True)


def conflict_scope(path: Column, scope: str | None) -> Column:
    """Variant F (conflicts): prefix, or the scope as a whole folder anywhere."""
    p = normal_text(scope or "").rstrip("/")
    return path.startswith(p) | F.concat(F.lit("/"), path).contains("/" + p + "/") if p else F.lit(True)


def governed_scope(decisions: DataFrame, links: DataFrame, scope: str | None) -> DataFrame:
    """Variant G (web): decisions whose own path or any governed path lies in scope."""
    p = scope_prefix(scope)
    if not p:
        return decisions
    governed = links.filter(within(F.col("file_path"), p)).select(F.col("decision_uid").alias("uid")).distinct().withColumn("governed", F.lit(True))
    return decisions.join(governed, "uid", "left").filter(within(F.col("file_path"), p) | F.col("governed")).drop("governed")


def location(path: Column) -> Column:
    """The folder of a path, the path of a file at the root, `(global)` for none."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).when(F.coalesce(path, F.lit("")) == "", "(global)").otherwise(path)


def is_skipped(path: Column) -> Column:
    return F.arrays_overlap(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), F.array(*map(F.lit, SKIPPED)))


def contains_line(line: Column, start: str = "line_start", end: str = "line_end") -> Column:
    return line.between(F.col(start), F.col(end))


#: Sizes of line bins: a span lies in one or two bins of the least size that is not under its length, so a line is met by its bin of each size.
BINS = (64, 1024, 16384, 1 << 40)


def span_bins(start: Column, end: Column) -> Column:
    """Bins (size, at) of a span of lines; to be exploded and met by line_bins. A span that ends before it starts has none."""
    size = F.lit(BINS[-1])
    for s in reversed(BINS[:-1]):
        size = F.when(end - start < s, F.lit(s).cast("long")).otherwise(size)
    bins = _in_bins(size, lambda n: F.sequence(F.floor(start / n).cast("long"), F.floor(end / n).cast("long")))
    return F.when(end >= start, bins).otherwise(F.array().cast("array<struct<size:bigint,at:bigint>>"))


def _in_bins(size: Column, places: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(F.array(size), lambda n: F.transform(places(n), lambda at: F.struct(n.alias("size"), at.alias("at")))))


def line_bins(line: Column) -> Column:
    return F.array(*[F.struct(F.lit(s).cast("long").alias("size"), F.floor(line / s).cast("long").alias("at")) for s in BINS])


def has_rationale() -> Column:
    return (F.trim(F.coalesce("reason", F.lit(""))) != "") | (F.size("alternatives") > 0)


def is_distinctive(name: Column) -> Column:
    """An identifier that is unlikely to be an ordinary word."""
    return (F.length(name) >= 6) & (name.contains("_") | name.rlike(r"^\p{Lu}") | (F.length(name) >= 10))


def is_live(at: Column | None = None) -> Column:
    """Open, or closed at `at` or later; lookups ask nothing about valid_from."""
    open_ = F.col("valid_to").isNull()
    return open_ if at is None else open_ | (F.col("valid_to") >= at)


def valid_at(at: Column) -> Column:
    """The closed interval: at a change both versions hold."""
    return (F.col("valid_from") <= at) & is_live(at)


def visible(include_events: bool = False, include_dependency: bool = False) -> Column:
    """Decision-tier rows that are no dependency bumps; events only on demand, whatever their category."""
    return F.when(F.col("tier") != "decision", F.lit(include_events)).otherwise((F.col("category") != "dependency") | F.lit(include_dependency))
