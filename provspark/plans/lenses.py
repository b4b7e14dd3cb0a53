"""Views that give the driver's tables the shape of the relations, in SQL that Spark and DuckDB read alike.

nodes and symbol_events come from events, edges from neighbouring nodes of a file, decisions, messages and commits from orders, links and call_sites from lineitem, source files from part. Commits are numbered within their day behind the sum of later days, so the one window without a key is over days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from provspark.plans import modules

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

#: name -> (views and tables it reads, SQL over them)
LENSES: dict[str, tuple[tuple[str, ...], str]] = {
    "nodes": (
        ("events",),
        """
select file_path || '::function::' || name || '@' || cast(line_start as string) || '::' || lpad(cast(seq as string), 12, '0') as uid,
  'function' as kind, name, file_path, line_start, line_end, case seq % 3 when 0 then 'python' when 1 then 'go' else 'rust' end as language,
  valid_from, valid_to, md5(cast(seq as string)) as commit_sha, seq
from (
  select event_id as seq, 'src/m' || cast(user_id % 10 as string) || '/f' || cast(user_id as string) || '.py' as file_path, event_type as name,
    cast(1 + event_id % 200 as int) as line_start, cast(1 + event_id % 200 + event_id % 37 as int) as line_end,
    ts as valid_from, lead(ts) over (partition by user_id, event_type order by ts, event_id) as valid_to
  from events) e""",
    ),
    "edges": (
        ("nodes",),
        """
select from_uid, to_uid, kind, file_path, cast(line + d.extra as int) as line, seq * 2 + d.extra as seq
from (
  select uid as from_uid, lead(uid) over (partition by file_path order by seq) as to_uid,
    case seq % 3 when 0 then 'uses' when 1 then 'contains' else 'defined_by' end as kind, file_path, line_start as line, seq
  from nodes) n
cross join (values (0), (1)) as d(extra)
where to_uid is not null""",
    ),
    "decisions": (
        ("orders",),
        """
select 'd' || cast(o_orderkey as string) as uid,
  case o_orderkey % 9 when 0 then 'enable session cache for token service' when 1 then 'disable session cache for token service'
    when 2 then 'use async writer for event store' when 3 then 'use sync writer for event store'
    when 4 then 'supersede d' || cast(o_orderkey - 9 * (o_orderkey % 5) as string) || ' by a strict parser' when 5 then 'keep lenient parser for imports'
    when 6 then 'bump parser from 1 to 2' when 7 then 'add retry to upload path' else 'remove upload path' end as content,
  case when o_orderkey % 3 = 0 then 'because it reduces load on the store' when o_orderkey % 3 = 1 then '' else 'to avoid stale tokens' end as reason,
  case o_orderkey % 10 when 9 then 'superseded' when 8 then 'rejected' else 'accepted' end as status,
  case o_orderkey % 5 when 0 then 'pr' when 1 then 'adr' else 'commit' end as source,
  'commit ' || md5(cast(o_orderkey % 2000 as string)) as source_ref, o_orderdate as timestamp, 'a' || cast(o_custkey % 17 as string) as author,
  case when o_custkey % 11 = 0 then '' when o_custkey % 7 = 0 then 'docs/adr/' || cast(o_custkey as string) || '.md'
    else 'src/m' || cast(o_custkey % 10 as string) || '/f' || cast(o_custkey % 150 as string) || '.py' end as file_path,
  case when o_orderkey % 4 = 0 then null else cast(1 + o_orderkey % 200 as int) end as line,
  cast(case o_orderkey % 4 when 0 then 0.7 when 1 then 0.55 when 2 then 0.6 else 0.8 end as double) as confidence,
  case when o_orderkey % 9 = 6 then 'dependency' else 'design' end as category,
  case when o_orderkey % 3 = 1 then 'event' else 'decision' end as tier, o_orderkey as seq
from orders""",
    ),
    "disputes": (
        ("orders",),
        """
select 'd' || cast(o_orderkey as string) as uid,
  case (o_orderkey * 7 + o_custkey) % 9 when 0 then 'enable session cache for token service' when 1 then 'disable session cache for token service'
    when 2 then 'use async writer for event store' when 3 then 'use sync writer for event store'
    when 4 then 'supersede d' || cast(o_orderkey - o_orderkey % 9 as string) || ' by a strict parser' when 5 then 'keep lenient parser for imports'
    when 6 then 'never cache the tokens' when 7 then 'add retry to upload path' else 'remove upload path' end as content,
  case when o_orderkey % 3 = 0 then 'because it reduces load on the store' when o_orderkey % 3 = 1 then '' else 'to avoid stale tokens' end as reason,
  case o_orderkey % 10 when 9 then 'superseded' when 8 then 'rejected' else 'accepted' end as status, 'commit ' || md5(cast(o_orderkey as string)) as source_ref,
  o_orderdate - cast(o_orderkey % 3 as int) * interval 1 day as timestamp,
  case when o_custkey % 50 = 0 then '' else 'src/c' || cast(o_custkey as string) || '/f' || cast(o_orderkey % 2 as string) || '.py' end as file_path, o_orderkey as seq
from orders""",
    ),
    "links": (
        ("lineitem",),
        """
select 'd' || cast(l_orderkey as string) as decision_uid, 'n' || cast(l_partkey as string) as node_uid,
  case when l_linenumber = 7 then 'gen' else 'src/m' || cast(l_suppkey % 10 as string) end || '/f' || cast(l_suppkey % 150 as string) || '.py' as file_path, cast(1 + l_partkey % 200 as int) as line,
  l_orderkey * 1000000 + l_partkey * 10 + l_linenumber as seq
from lineitem""",
    ),
    "probes": (
        ("events",),
        """
select event_id as probe, case event_id % 10 when 3 then 'gen/f' || cast(user_id % 200 as string) else 'src/m' || cast(user_id % 10 as string) || '/f' || cast(user_id as string) end || '.py' as file_path,
  cast(1 + (event_id * 7) % 240 as int) as line
from events""",
    ),
    "symbol_events": (
        ("events",),
        """
select 'src/f' || cast(user_id % 40 as string) || '.py' as file_path, event_type as name, event_id as seq, event_id as ts, md5(cast(event_id as string)) as sha,
  cast(1 + cast(floor(value) as bigint) % 4 as int) as line_start, cast(5 + cast(floor(value) as bigint) % 3 as int) as line_end,
  cast(cast(floor(value) as bigint) % 2 as bigint) as text_hash, event_id % 17 = 0 as gone
from events""",
    ),
    "messages": (
        ("orders",),
        """
select o_orderkey as seq, md5(cast(o_orderkey as string)) as sha, o_orderdate as timestamp,
  case o_orderkey % 10 when 0 then 'fix: tidy module ' || cast(o_custkey as string)
    when 1 then 'feat(core): use pool ' || cast(o_custkey as string) || ' because it reduces latency'
    when 2 then 'refactor: use ring:queue instead of linked-queue (#' || cast(o_orderkey as string) || ')'
    when 3 then 'bump lz4 from 1.8.0 to 1.8.' || cast(o_custkey % 10 as string)
    when 4 then 'chore(deps): bump codec-core to fix CVE-2031-' || cast(o_custkey as string)
    when 5 then 'Switch to batched writes so that imports finish early.'
    when 6 then 'Reword guide' when 7 then 'Prefer sqlite rather than a server for local graphs.'
    when 8 then 'perf: cache tokens for performance reasons in module ' || cast(o_custkey as string) else 'docs: explain scopes' end as subject,
  case o_orderkey % 6 when 0 then '' when 1 then '- use locks because writers race
- typo'
    when 2 then 'We chose batches in order to limit memory. It is fine.' when 3 then 'governs: src/a' || cast(o_custkey % 10 as string) || '.py, src/b/'
    when 4 then 'See `src/m' || cast(o_custkey % 10 as string) || '/f' || cast(o_custkey % 150 as string) || '.py` and `load_nodes` here.' else 'Reviewed by nobody' end as body,
  case o_orderkey % 4 when 0 then 'commit ' || md5(cast(o_orderkey as string)) when 1 then 'PR #' || cast(o_orderkey as string) when 2 then 'ADR 0' || cast(o_orderkey % 90 as string) else 'v1:' || substr(md5(cast(o_orderkey as string)), 1, 8) end as source_ref
from orders""",
    ),
    "commits": (
        ("orders",),
        """
select cast(before + row_number() over (partition by day order by o_orderdate desc, o_orderkey desc) as bigint) as seq, md5(cast(o_orderkey as string)) as sha, o_orderdate as timestamp, o_orderkey as id
from (
  select o.o_orderkey, o.o_orderdate, d.day, d.before from (select o_orderkey, o_orderdate, cast(o_orderdate as date) as day from orders) o join (
    select day, coalesce(sum(n) over (order by day desc rows between unbounded preceding and 1 preceding), 0) as before from (select day, count(*) as n from (select cast(o_orderdate as date) as day from orders) x group by day) c) d
  on o.day = d.day) e""",
    ),
    "call_sites": (
        ("lineitem",),
        """
select cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' || cast(l_partkey as string) || '-' || cast(l_suppkey as string) as call, 'fn' || cast(l_partkey % 300 as string) as caller, 'fn' || cast((l_suppkey * 7 + l_linenumber) % 300 as string) as callee,
  'src/p' || cast(l_orderkey % 40 as string) || '.py' as file_path, cast(1 + l_orderkey % 90 as int) as line
from lineitem""",
    ),
    "sources": (("part",), modules.sources()),
    "functions": (
        ("part",),
        """
select 'u' || cast(p_partkey as string) as uid, 'fn' || cast(p_partkey % 300 as string) as name, 'src/p' || cast(p_partkey % 40 as string) || '.py' as file_path,
  cast(1 + p_partkey % 50 as int) as line_start, cast(20 + p_partkey % 80 as int) as line_end,
  case when p_partkey % 4 = 0 then null else 'u' || cast(p_partkey - p_partkey % 4 as string) end as parent_uid, p_partkey as seq
from part""",
    ),
    "patches": (
        ("orders",),
        """
select o_orderkey as id, '@@ -' || cast(1 + o_orderkey % 50 as string) || ',3 +' || cast(1 + o_custkey % 70 as string) || ',4 @@ ctx
 same
+added ' || cast(o_orderkey as string) || '
-gone
+more
' || chr(92) || ' No newline
 tail
@@ -90,1 +' || cast(100 + o_custkey % 9 as string) || ',2 @@
+last' as patch
from orders""",
    ),
}


def build_order(name: str) -> list[str]:
    """The lenses that one reads, itself last."""
    out: list[str] = []
    for need in LENSES[name][0]:
        if need in LENSES:
            out += [x for x in build_order(need) if x not in out]
    return [*out, name]


class Lenses:
    """Lens views and tables of one folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in LENSES:
            needs, sql = LENSES[name]
            sql = sql.replace("{", "{{").replace("}", "}}")
            for n in needs:
                sql = sql.replace(f"from {n}", "from {" + n + "}")
            return self.spark.sql(sql, **{n: getattr(self, n) for n in needs})
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)


def with_lenses(sql: str, *names: str) -> str:
    """A DuckDB query whose `with` defines the lenses it reads; sql may begin with further `name as (...)` parts and a comma-free `select` last."""
    order: list[str] = []
    for n in names:
        order += [x for x in build_order(n) if x not in order]
    views = ", ".join(f"{n} as ({LENSES[n][1]})" for n in order)
    sql = sql.strip()
    if sql.startswith("recursive "):
        return f"with recursive {views}, {sql.removeprefix('recursive ')}"
    return f"with {views} {sql}" if sql.lower().startswith("select") else f"with {views}, {sql.removeprefix('with ')}"
