"""Embedding near-duplicates by cosine: a PCA-ordered, tiled comparison that stops early.

Vectors are scaled to length 1, turned into principal coordinates (from the second moments of all rows, gathered as one matrix) and cut into tiles by ranges of the first AXES
of them. A tile, and in a task each CHUNK rows of it, has a box: least and greatest value of each of the first BOX coordinates, and the greatest length of the rest behind them. Two boxes
bound every cosine between them from above (the largest products coordinate by coordinate, and the product of the rests); pairs of boxes under the threshold
are never met, of tiles nor of chunks. Of the others the leading coordinates are multiplied first; with the length of each vector's rest as one more coordinate, that product bounds the
cosine from above, and pairs below the threshold end there. The next coordinates join for those left, and what comes through all stages is compared whole, in double precision.

A tile is sent once to each tile that its box meets, so tiles are as large as TILE_BYTES allows. Vectors without structure in their leading coordinates rule nothing out, and
then both the comparison and what is sent grow with the square of their number.

Equal vectors are one row with a count before they are compared. A tile pair gives counts and a spanning star for each of its groups, never its pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do vectors of different lengths with each other; a
row whose vec_id is null is compared but has null as component_id where it stands alone; rows that repeat a vec_id are vectors of their own; other columns
are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import components, cut, drop_cut, in_arrow, place_among

THRESHOLD = 0.9
#: Bytes of a tile's vectors, and rows of a chunk of it. A task holds two tiles and a product of one chunk with the other tile.
TILE_BYTES, CHUNK = 8 << 20, 512
#: Coordinates by whose ranges tiles are cut, and those that a box has.
AXES, BOX = 3, 8
#: So many tiles at least where there are rows for them: pairs of tiles are the tasks.
LEAST_TILES, LEAST_ROWS = 6, 256
#: Axes are worked out for the commonest dimensions, so many and no longer ones; others are compared by their coordinates as they come.
MOST_DIMENSIONS, LONGEST = 16, 1024
#: Leading coordinates after which a pair may end.
STAGES = (16, 32)
#: Slack of the bounds against rounding; pairs this close to the threshold are worked out from the vectors as they came.
SLACK = 1e-9


def _valid(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    fine = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    return vectors.select("row_id", e.alias("embedding")).filter(fine)


def principal_axes(reps: DataFrame) -> dict[int, np.ndarray]:
    """dimension -> axes as columns, the strongest first. What comes to the driver is at most MOST_DIMENSIONS matrices of LONGEST rows."""
    sizes = reps.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).filter(F.col("d") <= LONGEST)
    common = [r["d"] for r in sizes.orderBy(F.col("n").desc(), "d").limit(MOST_DIMENSIONS).collect()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in _by_dimension(b.column(0)):
                u = _unit(x)
                sums[d] = sums.get(d, 0) + u.T @ u
        for d, m in sums.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d)), pa.array(i), pa.array(j), pa.array(m[i, j])], ["d", "i", "j", "s"])

    rows = in_arrow(reps.filter(F.size("embedding").isin(common)).select("embedding"), work, "d long, i long, j long, s double").groupBy("d", "i", "j").agg(F.sum("s").alias("s")).toPandas()
    axes = {}
    for d, part in rows.groupby("d"):
        m = np.zeros((d, d))
        m[part["i"], part["j"]] = m[part["j"], part["i"]] = part["s"]
        axes[int(d)] = np.ascontiguousarray(np.linalg.eigh(m)[1][:, ::-1])
    return axes


def _by_dimension(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield int(d), at, flat[(ends[at] - d)[:, None] + np.arange(d)]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def turned(unit: np.ndarray, axes: np.ndarray | None) -> np.ndarray:
    return unit if axes is None else unit @ axes


def box_of(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) of the first BOX coordinates and of the length behind them."""
    lead = np.zeros((len(p), BOX + 1))
    k = min(BOX, p.shape[1])
    lead[:, :k] = p[:, :k]
    lead[:, BOX] = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", p[:, :k], p[:, :k])))
    return lead.min(axis=0), lead.max(axis=0)


def box_bound(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> np.ndarray:
    """The most that a cosine between two boxes can be; the last axis of each is the coordinates."""
    return np.maximum.reduce([low_a * low_b, low_a * high_b, high_a * low_b, high_a * high_b]).sum(axis=-1)


def tiles(reps: DataFrame, axes: dict[int, np.ndarray], n: int) -> DataFrame:
    """(tile, d, n, low, high, ids, weights, vectors) of n rows: tiles of rows sorted by ranges of their leading coordinates; low, high: their boxes."""
    rows_of = lambda d: max(LEAST_ROWS, TILE_BYTES // (8 * d))
    least = max(1, min(LEAST_TILES, n // LEAST_ROWS))

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, dim = np.zeros((AXES, b.num_rows)), np.zeros(b.num_rows, np.int64)
            for d, at, x in _by_dimension(b.column(2)):
                first[: min(AXES, d), at], dim[at] = turned(_unit(x), axes.get(d))[:, :AXES].T, d
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dim), *map(pa.array, first)], ["id", "weight", "embedding", "d", *leads])

    leads = [f"lead{k}" for k in range(AXES)]
    led = cut(in_arrow(reps.select("id", "weight", "embedding"), lead, "id long, weight long, embedding array<double>, d long, " + ", ".join(f"{c} double" for c in leads)), "leads")
    wanted = max(least, -(-n * 8 * (led.agg(F.max("d")).first()[0] or 1) // TILE_BYTES))
    each, cell = max(1, round(wanted ** (1 / AXES))), F.lit(0)
    shares = [-(-wanted // each ** (AXES - 1)), *[each] * (AXES - 1)]  # ranges of each coordinate, about `wanted` cells in all
    levels = sorted({k / m for m in shares for k in range(1, m)})
    cuts = led.stat.approxQuantile(leads, levels, 0.01) if levels else []
    for c, m, at in zip(leads, shares, cuts):
        borders = {k / m for k in range(1, m)}
        cell = cell * m + place_among(F.col(c), sorted(v for v, q in zip(at, levels) if q in borders))  # no rows, no quantiles
    dealt = led.withColumn("cell", cell).repartition(max(least, wanted // 4), "d", "cell").sortWithinPartitions("d", "cell", *leads, "id")
    numbered = dealt.select("id", "weight", "embedding", "d", F.spark_partition_id().alias("part"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        k = 0

        def tile() -> pa.RecordBatch:
            nonlocal k
            ids, weights, vecs, d, part = zip(*held, strict=True)
            x = np.array(vecs, np.float64)
            low, high = box_of(turned(_unit(x), axes.get(d[0])))
            row = [part[0] << 32 | k, d[0], len(ids), low.tolist(), high.tolist(), np.array(ids, np.int64).tobytes(), np.array(weights, np.int64).tobytes(), x.tobytes()]
            k += 1
            held.clear()
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], ["tile", "d", "n", "low", "high", "ids", "weights", "vectors"])

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (len(held) >= rows_of(held[0][3]) or held[0][3] != r[3]):
                    yield tile()
                held.append(r)
        if held:
            yield tile()

    return in_arrow(numbered, pack, "tile long, d long, n long, low array<double>, high array<double>, ids binary, weights binary, vectors binary")


def star(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """label of each of n nodes: the smallest index reachable over the links (i, j)."""
    label = np.arange(n)
    while True:
        m = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def compare(a: np.ndarray, b: np.ndarray, axes: np.ndarray | None, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (rows of a, rows of b) by chunks of a. same: a is b, each pair once and none of a row with itself."""
    ua, ub = _unit(a), _unit(b)
    pa_, pb = turned(ua, axes), turned(ub, axes)
    d = pa_.shape[1]
    stages = [s for s in STAGES if s < d]
    rest = lambda p, s: np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", p[:, :s], p[:, :s])))
    joined = [(np.column_stack([pa_[:, :s], rest(pa_, s)]), np.column_stack([pb[:, :s], rest(pb, s)])) for s in stages]
    chunks = [slice(i, min(i + CHUNK, len(b))) for i in range(0, len(b), CHUNK)]
    low, high = (np.array(x) for x in zip(*(box_of(pb[c]) for c in chunks), strict=True))
    for lo in range(0, len(a), CHUNK):
        rows = slice(lo, lo + CHUNK)
        meets = box_bound(*box_of(pa_[rows]), low, high) >= threshold - SLACK
        if same:
            meets[: lo // CHUNK] = False
        others = np.concatenate([np.zeros(0, np.int64), *(np.arange(c.start, c.stop) for c, m in zip(chunks, meets, strict=True) if m)])
        if not len(others):
            continue
        if joined:
            x, y = joined[0]
            i, j = np.nonzero(x[rows] @ y[others].T >= threshold - SLACK)
        else:
            i, j = (k.ravel() for k in np.indices((len(pa_[rows]), len(others))))
        i, j = i + lo, others[j]
        if same:
            i, j = i[i < j], j[i < j]
        for x, y in joined[1:]:
            i, j = _met(x, y, i, j, threshold - SLACK)
        found_i, found_j = [], []
        for k in range(0, len(i), 1 << 16):
            p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            c = np.einsum("ij,ij->i", ua[p], ub[q])
            for near in np.flatnonzero(np.abs(c - threshold) < SLACK):
                v, w = a[p[near]], b[q[near]]
                c[near] = np.dot(v, w) / (np.sqrt(np.dot(v, v)) * np.sqrt(np.dot(w, w)))
            found_i.append(p[c >= threshold])
            found_j.append(q[c >= threshold])
        if found_i:
            yield np.concatenate(found_i), np.concatenate(found_j)


def _met(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    keep = [np.einsum("ij,ij->i", x[i[k : k + (1 << 16)]], y[j[k : k + (1 << 16)]]) >= least for k in range(0, len(i), 1 << 16)]
    k = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[k], j[k]


def links(blocks: DataFrame, axes: dict[int, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """(id, root, n_links): for each row with links within a pair of tiles, how many, and the smallest row of its group there."""
    reach = float(np.sqrt(2 - 2 * threshold))  # how far apart two coordinates of linked vectors of length 1 can be
    ends = blocks.select("tile", "d", "low", "high")
    cell = lambda c: F.floor(c / reach).cast("long")
    first, last = F.col("low")[0], F.col("high")[0]
    cells = ends.select("*", F.explode(F.sequence(cell(first), cell(last))).alias("cell"))
    around = ends.select(F.col("tile").alias("other"), "d", F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.explode(F.sequence(cell(first) - 1, cell(last) + 1)).alias("cell"))
    bound = sum((F.greatest(*[F.col(x)[k] * F.col(y)[k] for x in ("low", "high") for y in ("low_b", "high_b")]) for k in range(BOX + 1)), F.lit(0.0))
    pairs = cells.join(around, ["d", "cell"]).filter("tile <= other").filter(bound >= threshold - SLACK).select("tile", "other").distinct()
    sides = pairs.select("tile", F.struct("tile", "other").alias("pair")).unionByName(pairs.filter("tile <> other").select(F.col("other").alias("tile"), F.struct("tile", "other").alias("pair")))
    met = blocks.select("tile", "d", "ids", "weights", "vectors").join(sides, "tile").select("pair.tile", "pair.other", F.col("tile").alias("own"), "d", "ids", "weights", "vectors")

    def work(table: pa.Table) -> pa.Table:
        sides_ = sorted(table.select(["own", "d", "ids", "weights", "vectors"]).to_pylist(), key=lambda r: r["own"])
        read = [(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["weights"], np.int64), np.frombuffer(r["vectors"], np.float64).reshape(-1, r["d"])) for r in sides_]
        (ids_a, w_a, a), (ids_b, w_b, b) = read[0], read[-1]
        same, n = len(read) == 1, len(ids_a)
        ids, weights = (ids_a, w_a) if same else (np.concatenate([ids_a, ids_b]), np.concatenate([w_a, w_b]))
        count, si, sj = np.zeros(len(ids), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in compare(a, b, axes.get(sides_[0]["d"]), threshold, same):
            j = j if same else j + n
            count += np.bincount(i, weights[j], len(ids)).astype(np.int64) + np.bincount(j, weights[i], len(ids)).astype(np.int64)
            label = star(i, j, len(ids))  # a chunk's links become a star before the next chunk
            moved = np.flatnonzero(label != np.arange(len(ids)))
            si.append(moved)
            sj.append(label[moved])
        label = star(np.concatenate(si), np.concatenate(sj), len(ids))
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, label, ids)
        at = np.flatnonzero(count)
        return pa.table({"id": ids[at], "root": least[label[at]], "n_links": count[at]})

    return met.groupBy("tile", "other").applyInArrow(work, "id long, root long, n_links long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding)."""
    base = cut(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"), F.monotonically_increasing_id().alias("row_id")), "vectors")
    valid = _valid(base)
    key = F.xxhash64("embedding")
    # Equal vectors (and there may be a third of all) are one row: its id is the smallest row_id.
    reps = cut(valid.groupBy("embedding").agg(F.min("row_id").alias("id"), F.count("*").alias("weight")), "distinct-vectors")
    axes = principal_axes(reps)
    n = reps.count()
    blocks = cut(tiles(reps, axes, n), "tiles")
    found = cut(links(blocks, axes, threshold), "tile-links")
    counts = found.groupBy("id").agg(F.sum("n_links").alias("linked"))
    groups = components(found, "id", "root")
    classes = cut(
        reps.join(counts, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
        .select(F.xxhash64("embedding").alias("mark"), "embedding", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("group")),
        "classes",
    )
    rows = valid.withColumn("mark", key).join(classes, ["mark", "embedding"]).select("row_id", "n_links", "group")
    all_rows = cut(base.select("row_id", "vec_id").join(rows, "row_id", "left"), "rows")
    smallest = all_rows.filter("group is not null").groupBy("group").agg(F.min("vec_id").alias("component_id"))
    out = cut(all_rows.join(smallest, "group", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")), "components")
    drop_cut(base, reps, blocks, found, classes, all_rows)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
