"""Mixing sources to target weights along a curriculum.

A source's target is its share of all words by weight, at most REPEATS times what it has; what is cut off goes to the others by weight until nobody is above
(`targets`). Each source lays its documents end to end in the order of a hash, as often as the target needs, and stops at the target, so the words taken meet it to the
word; the document at the stop is taken in part.

When its words come is set by the source's schedule, a weight that varies over training time 0..1. The schedule's integral is the share of the target demanded up to a
time; inverting it at the middle of a document's words gives the document's training position. Documents are then sorted by range of position.

Running sums are taken in two steps, within hash ranges of a bounded size and over the ranges' totals, so a source that holds a third of all rows is spread like any
other. Sources are a catalogue: their weights are set over one row for each of them.

Defined results: null text: 0 words; null source: a source of its own, last; null doc_id: hashed as empty; a document of 0 words takes 0 and has no position;
repeated rows count each; ties in the hash go by doc_id, then size; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provspark.llm.common import cut, free_names, small_join

WEIGHTS = (1, 2, 3)
REPEATS = 3
#: Schedules by the place of a source among its fellows, repeating like the weights: (time, weight) knots, linear between them.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
#: Documents of a source that are summed up in one go.
RANGE_DOCS = 4096


def words(text: str = "text") -> F.Column:
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def time_of(share: F.Column, knots: tuple[tuple[float, float], ...]) -> F.Column:
    """The time by which a schedule has demanded a share of its target: the inverse of its integral, scaled to 1."""
    pieces, total = [], 0.0
    for (t0, g0), (t1, g1) in zip(knots, knots[1:], strict=False):
        pieces.append((t0, g0, (g1 - g0) / (t1 - t0), total))
        total += (g0 + g1) / 2 * (t1 - t0)
    if total <= 0 or any(g < 0 for _, g in knots):
        raise ValueError("a schedule needs weights of 0 or more and an integral above 0")
    out = None
    for t0, g0, slope, before in pieces:
        q = share * total - before if (total, before) != (1.0, 0.0) else share
        root = F.sqrt(F.greatest(F.lit(g0 * g0) + F.lit(2 * slope) * q, F.lit(0.0)))
        here = F.lit(t0) + F.when(q > 0, F.lit(2.0) * q / (F.lit(g0) + root)).otherwise(0.0)
        out = here if out is None else F.when(share * total >= before, here).otherwise(out)
    return out


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, n_docs, place, target) of each source of sizes (source, size)."""
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    placed = each.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = placed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    # Sources reach their ceilings in this order as everyone's share rises; `level` is the share of weight 1 while all before are at theirs.
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everyone) - repeats * F.coalesce(F.sum("source_size").over(upto), F.lit(0))) / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
    leveled = weighed.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= repeats * F.col("source_size"))
    final = leveled.withColumn("level", F.min(F.when(F.col("free"), F.struct(F.col("source_size") / F.col("weight"), "place", "level"))).over(everyone)["level"])
    capped = F.col("level").isNull() | (F.col("level") * F.col("weight") > repeats * F.col("source_size"))
    return final.select("source", "source_size", "n_docs", "place", F.when(capped, (repeats * F.col("source_size")).cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def place(docs: DataFrame, extra: tuple[str, ...] = (), schedules: tuple = SCHEDULES) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies (array of (position, taken)) for each row of docs (doc_id, text, source), with the columns `extra`, which settle ties."""
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key")
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sizes = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", key, words().alias("size"), order.alias("order"), *extra), "sizes")
    goals = cut(targets(sizes), "targets").withColumn("key", key)
    d = small_join(sizes, goals.drop("source"), "key")
    ranges = F.ceil(F.col("n_docs") / RANGE_DOCS)
    d = d.withColumn("range", F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("double") / 2.0**32 * ranges).cast("long"))
    by_range = d.groupBy("key", "range").agg(F.sum("size").alias("sum"))
    before = F.sum("sum").over(Window.partitionBy("key").orderBy("range")) - F.col("sum")
    d = small_join(d, by_range.select("key", "range", before.alias("before")), ["key", "range"])
    start = F.col("before") + F.sum("size").over(Window.partitionBy("key", "range").orderBy("order", "doc_id", "size", *extra).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    d = d.withColumn("start", start).withColumn("goal", F.floor("target").cast("long"))
    kind = F.col("place") % len(schedules)
    copies = []
    for k in range(REPEATS):
        at = F.lit(k) * F.col("source_size") + F.col("start")
        taken = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("goal") - at))
        share = (at + taken / 2.0) / F.col("goal")
        position = F.coalesce(*[F.when(kind == c, time_of(share, s)) for c, s in enumerate(schedules)])
        copies.append(F.when(taken > 0, F.struct(position.alias("position"), taken.alias("taken"))))
    d = d.withColumn("copies", F.array_compact(F.array(*copies)))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda s, c: s + c["taken"])
    return d.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "copies", *extra)


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, position (of the first copy, to 6 places), n_copies; in the order of training."""
    out = place(docs).select("doc_id", "size", "source_size", "target", "taken", F.round(F.try_element_at("copies", F.lit(1))["position"], 6).alias("position"), F.size("copies").cast("long").alias("n_copies"))
    return out.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, in the order of training, each as often as it is taken: whole copies, and the copy taken in part if half of it or more is.

    Placing works on narrow rows; the texts then meet their copies by a digest of the whole row. Rows that are equal in every column are one text with the copies of all of
    them: they are merged in each task before they meet, so a row that is repeated a million times is one row a task, and none is numbered.
    """
    identity, position = free_names(docs, "identity", "position")
    rows = docs.withColumn(identity, F.sha2(F.to_json(F.struct(*docs.columns)), 256))
    placed = place(rows.select("doc_id", "text", "source", identity), (identity,))
    copies = placed.select(identity, "size", F.explode("copies").alias("copy")).filter("copy.taken * 2 >= size").select(identity, F.col("copy.position").alias(position))
    out = rows.dropDuplicates([identity]).join(copies, identity)
    return out.repartitionByRange(position, identity).sortWithinPartitions(position, identity).select(*docs.columns)


def oracle() -> str:
    weights, (c0, c1, c2) = ", ".join(map(str, WEIGHTS)), SCHEDULES
    return f"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size, md5(coalesce(doc_id::varchar, '')) as o from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as place from d group by source),
w as (select *, ([{weights}])[place % {len(WEIGHTS)} + 1] as weight from s),
l as (select *, (sum(source_size) over () - {REPEATS} * coalesce(sum(source_size) over (order by source_size / weight, place rows between unbounded preceding and 1 preceding), 0))::double
    / (sum(weight) over () - coalesce(sum(weight) over (order by source_size / weight, place rows between unbounded preceding and 1 preceding), 0))::double as level from w),
f as (select arg_min(level, (source_size / weight, place)) filter (where level * weight <= {REPEATS} * source_size) as level from l),
t as (select w.source, w.source_size, w.place, case when f.level is null or f.level * weight > {REPEATS} * source_size then ({REPEATS} * source_size)::double else f.level * weight end as target from w, f),
p as (select d.*, t.source_size, t.place, t.target, floor(t.target)::bigint as goal,
    (sum(size) over (partition by d.source order by o, doc_id, size rows between unbounded preceding and current row) - size)::bigint as start
  from d join t on d.source is not distinct from t.source),
k as (select *, greatest(0, least(size, goal - start)) as t0, greatest(0, least(size, goal - start - source_size)) as t1, greatest(0, least(size, goal - start - 2 * source_size)) as t2 from p),
g as (select *, (start + t0 / 2.0::double) / goal as share from k)
select doc_id, size, source_size, target, (t0 + t1 + t2)::bigint as taken,
  round(case when t0 > 0 then case place % 3
    when 0 then 2.0::double * share / ({c0[0][1]}::double + sqrt({c0[0][1] ** 2}::double + {2 * (c0[1][1] - c0[0][1])}::double * share))
    when 1 then 2.0::double * share / ({c1[0][1]}::double + sqrt({c1[0][1] ** 2}::double))
    else 2.0::double * share / ({c2[0][1]}::double + sqrt({c2[0][1] ** 2}::double + {2 * (c2[1][1] - c2[0][1])}::double * share)) end end, 6) as position,
  ((t0 > 0)::int + (t1 > 0)::int + (t2 > 0)::int)::bigint as n_copies
from g
"""
