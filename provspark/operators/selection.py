"""Exact order statistics of a column without sorting it: sketches say where a rank lies, counts say so exactly, and only what is left there is looked at."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that a stretch of values is cut into in each round, and the values left from which on they are fetched.
PARTS, FETCHED = 64, 10_000


def _part(v: Column, cuts: list[float]) -> Column:
    """How many of the cuts are at most v."""
    return sum(((v >= c).cast("int") for c in cuts), F.lit(0))


def at_ranks(values: DataFrame, column: str, ranks: list[int]) -> dict[int, float]:
    """The values that would stand at these ranks (from 0) if the column, without its nulls, were sorted; NaN comes last.

    Each round cuts the stretches that hold a rank at their own approximate quantiles and counts the parts: sums, a few hundred numbers for the driver. What a rank's
    part holds shrinks about PARTS times a round, however the values lie, until its values are all equal or few enough to fetch. No task holds more than a sketch.
    """
    v = F.col(column).cast("double")
    rows = values.select(v.alias("v")).filter("v is not null")
    finite = rows.filter((F.col("v") > -math.inf) & (F.col("v") < math.inf))  # NaN is above all numbers
    ends = rows.agg(F.count("*").alias("n"), F.count_if(F.col("v") == -math.inf).alias("low"), F.count_if(F.col("v") == math.inf).alias("high"), F.count_if(F.isnan("v")).alias("none")).first()
    n, low, top = ends["n"], ends["low"], ends["n"] - ends["high"] - ends["none"]
    found = {r: -math.inf if r < low else math.nan if r >= n - ends["none"] else math.inf for r in ranks if 0 <= r < n and not low <= r < top}
    # Stretches of values that hold ranks: (first, last) -> (values below, values inside, ranks).
    open_ = {}
    if todo := [r for r in ranks if low <= r < top]:
        first = finite.agg(F.min("v").alias("a"), F.max("v").alias("b")).first()
        open_ = {(first["a"], first["b"]): (low, top - low, todo)}
    while open_:
        for (a, b), (_, _, held) in list(open_.items()):
            if a == b:
                found |= dict.fromkeys(held, a)
                del open_[a, b]
        few = {k: s for k, s in open_.items() if s[1] <= FETCHED}
        if few:
            inside = finite.filter(_any_of(few))
            at = sorted(r["v"] for r in inside.collect())  # FETCHED a stretch at most, and as many stretches as ranks
            for (a, b), (below, _, held) in few.items():
                start = next(i for i, x in enumerate(at) if x >= a)
                found |= {r: at[start + r - below] for r in held}
                del open_[a, b]
        if open_:
            open_ = _narrowed(finite, open_)
    return {r: found[r] for r in ranks if r in found}


def _any_of(stretches: dict) -> Column:
    out = F.lit(False)
    for a, b in stretches:
        out = out | F.col("v").between(a, b)
    return out


def _narrowed(finite: DataFrame, open_: dict) -> dict:
    which = F.coalesce(*[F.when(F.col("v").between(a, b), F.lit(i)) for i, (a, b) in enumerate(open_)])
    inside = finite.filter(_any_of(open_)).withColumn("i", which)
    sketch = F.percentile_approx("v", [k / PARTS for k in range(1, PARTS)], 100 * PARTS).alias("cuts")
    cuts = {r["i"]: sorted(set(r["cuts"])) for r in inside.groupBy("i").agg(sketch).collect()}
    part = F.coalesce(*[F.when(F.col("i") == i, _part(F.col("v"), c)) for i, c in cuts.items()])
    # Equal values share a part; a cut's own value begins its part, so a value that fills several parts ends up alone in one.
    counted = inside.groupBy("i", part.alias("part"), (F.col("v") == F.get(F.coalesce(*[F.when(F.col("i") == i, F.array(*map(F.lit, c))) for i, c in cuts.items()]), part - 1)).alias("at_cut"))
    held = sorted(counted.agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect(), key=lambda r: (r["i"], r["a"]))
    out = {}
    for i, (below, _, ranks) in enumerate(open_.values()):
        for r in (r for r in held if r["i"] == i):
            if mine := [k for k in ranks if below <= k < below + r["n"]]:
                out[r["a"], r["b"]] = (below, r["n"], mine)
            below += r["n"]
    return out


def percentiles(values: DataFrame, column: str, shares: tuple[float, ...]) -> list[float | None]:
    """By linear interpolation between the ranks about each share; none where there are no values."""
    n = values.filter(F.col(column).isNotNull()).count()
    if not n:
        return [None] * len(shares)
    places = [q * (n - 1) for q in shares]
    at = at_ranks(values, column, sorted({r for p in places for r in (math.floor(p), math.ceil(p))}))
    between = lambda lo, hi, p: at[lo] if lo == hi or at[lo] == at[hi] else (hi - p) * at[lo] + (p - lo) * at[hi]
    return [between(math.floor(p), math.ceil(p), p) for p in places]
