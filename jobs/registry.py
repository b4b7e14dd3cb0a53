"""The jobs as queries over the driver's tables: each runs its job twice into a new folder of the shared one and returns the output as it stands then; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import line_provenance, symbol_history
from jobs.common import own_folder
from provspark.functions import text
from provspark.plans import catalogue


def job1_line_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = own_folder(spark, "line-provenance")
    line_provenance.run(spark, f"{sf_dir}/documents.parquet", out)
    return line_provenance.run(spark, f"{sf_dir}/documents.parquet", out)


def job2_symbol_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A pattern, as the file stream takes folders and patterns but no single file.
    events, out = f"{sf_dir}/events.parque[t]", own_folder(spark, "symbol-history")
    symbol_history.run(spark, events, f"{out}/versions", f"{out}/checkpoint")
    return symbol_history.run(spark, events, f"{out}/versions", f"{out}/checkpoint")


_LINES = f"""with e as (select doc_id, nullif(source, '') as source, {catalogue.ONE_LINE.format("s")} as line from (
  select doc_id, source, trim(regexp_replace(unnest(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+')), '^\\s*[-*+]\\s+', '')) as s from documents) x where s <> ''),
g as (select source, line, min(doc_id) as first_doc, max(doc_id) as last_doc, count(distinct doc_id) as n_docs, count(*) as n_places from e where length(line) >= 1 group by 1, 2),
m as (select distinct line as seq, line as s from g), {catalogue.parts_sql()}
select g.*, {" or ".join(f"contains(lower(line), '{k}')" for k in text.KEYWORDS)} as decides, p.content, p.reason, p.alternatives,
  case when trim(p.reason) <> '' or len(p.alternatives) > 0 then 'decision' else 'event' end as tier from g join p on p.seq = g.line"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_line_provenance, job2_symbol_history)}


def oracle_sql() -> dict[str, str]:
    return {"job1_line_provenance": _LINES, "job2_symbol_history": catalogue.oracle_sql()["symbol_versions_scd2"]}
