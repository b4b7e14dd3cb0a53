"""Typed schemas of the four relations, the commit source and the allowed values of their enumerations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


Columns = dict[str, str]


def _columns(spec: str) -> Columns:
    return dict(c.split(" ", 1) for c in spec.split(", "))


def ddl(columns: Columns) -> str:
    return ", ".join(f"{k} {v}" for k, v in columns.items())


NODE = _columns("uid string, kind string, name string, file_path string, line_start int, line_end int, language string, parent_uid string, valid_from timestamp, valid_to timestamp, commit_sha string")
EDGE = _columns("from_uid string, to_uid string, kind string, file_path string, line int")
DECISION = _columns(
    "uid string, content string, reason string, alternatives array<string>, status string, source string, source_ref string, timestamp timestamp, author string, "
    "file_path string, line int, constraints array<string>, confidence double, category string, tier string"
)
LINK = _columns("decision_uid string, node_uid string, file_path string, line int, commit_sha string")
COMMIT = _columns("seq bigint, sha string, parent string, timestamp timestamp, author string, message string, changed_files array<string>")
CALL_SITE = _columns("caller string, callee string, line int, file_path string")

STATUSES = ("accepted", "superseded", "rejected")
SOURCES = ("pr", "issue", "adr", "commit", "comment")
TIERS = ("decision", "event")
NODE_KINDS = ("function", "class", "variable")
EDGE_KINDS = ("uses", "defined_by", "contains")
#: What stands for a value that is missing or unknown on read.
DEFAULTS = {"status": "accepted", "source": "commit", "tier": "decision", "category": "design"}


def read_decisions(raw: DataFrame) -> DataFrame:
    """Rows of a decision table as written by any version: missing columns added, unknown enumeration values replaced, a confidence of 0 or none read as 0.5."""
    have = set(raw.columns)
    known = {"status": STATUSES, "source": SOURCES, "tier": TIERS}
    out = []
    for name, kind in DECISION.items():
        c = (F.col(name) if name in have else F.lit(None)).cast(kind)
        if name in known:
            c = F.when(c.isin(*known[name]), c).otherwise(DEFAULTS[name])
        elif name == "category":
            c = F.when(F.coalesce(c, F.lit("")) == "", DEFAULTS["category"]).otherwise(c)
        elif name == "confidence":
            c = F.when(F.coalesce(c, F.lit(0.0)) == 0, 0.5).otherwise(c)
        elif kind.startswith("array"):
            c = F.coalesce(c, F.array().cast(kind))
        out.append(c.alias(name))
    return raw.select(*out)


def read_edges(raw: DataFrame) -> DataFrame:
    """Edges with lines of at least 1."""
    return raw.withColumn("line", F.greatest(F.coalesce(F.col("line"), F.lit(1)), F.lit(1)))
