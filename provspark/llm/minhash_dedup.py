"""MinHash near-duplicates through an inverted join of signature coordinates, with exact links.

A text's set holds its distinct word shingles (64-bit hashes). Equal sets are one row from the start. A signature has COORDINATES values, each of MINIMA minima
together; a text is posted under its (coordinate, value) pairs. Two texts agree in at least LEAST coordinates, or their likeness is taken to be under the threshold (at a
likeness of exactly 0.8 that is wrong for two pairs in ten million, less above). From that count follow two cuts that lose nothing further:
- skip: a pair only one text has meets nobody, so texts with fewer than LEAST shared pairs are left out whole;
- skip: so are texts of which too few shingles are met in another text that is left;
- prefix: of a text's pairs, rarest first, only the first COORDINATES - LEAST + 1 are posted; two texts that agree in LEAST pairs share one of these.

A posting list is merged about its smallest text instead of into all pairs: every member is counted and checked against that one. Then members of a list that are still in
different groups are dealt into random handfuls, compared within them, and joined, ROUNDS times; and last, whoever is still apart is counted and checked
against everyone else in the list, block by block. Who is in one group already needs no further link, so a dense list costs a few comparisons a member, and none is left out.

Counted pairs at or over LEAST are confirmed on full sets: 100 * common >= PERCENT * union.

Defined results: null text: no words; a text without words has the empty set and links with nothing; with fewer words than a shingle has, the words in a row are
the one shingle; rows that repeat each other are linked; null doc_ids take part and get null where they stand alone; other columns are ignored; no rows give
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import U64, WordTable, components, cut, drop_cut, free_names, in_arrow, mix

SHINGLE, PERCENT = 5, 80
COORDINATES, MINIMA, LEAST = 32, 2, 7
_RNG = np.random.default_rng(20240229)
_FACTORS = _RNG.integers(1, 1 << 62, COORDINATES * MINIMA, dtype=np.uint64) * U64(2) + U64(1)
_SHIFTS = _RNG.integers(0, 1 << 62, COORDINATES * MINIMA, dtype=np.uint64)
#: How often lists are dealt into handfuls of about so many before what is left apart is compared in full.
ROUNDS, HANDFUL = 2, 8
#: Members of a list that are compared at once with as many others.
BLOCK = 1024
#: Shingles that are hashed into signatures at once.
STEP = 1 << 18


def shingle_set(text: str | None, k: int, table: WordTable) -> np.ndarray:
    """Distinct shingles of k words, ascending; words are runs without ASCII white space, A-Z lower-cased."""
    h = table.hashes((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not len(h):
        return h
    s = h[: max(1, len(h) - k + 1)]
    for i in range(1, min(k, len(h))):
        s = mix(s * U64(0x9E3779B97F4A7C15) + h[i : i + len(s)])
    return np.unique(s)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of COORDINATES values (31 bits) for each set; sets are not empty."""
    out = np.zeros((len(sets), COORDINATES), np.int32)
    x, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    for c in range(COORDINATES):
        value = np.zeros(len(sets), U64)
        for m in range(c * MINIMA, (c + 1) * MINIMA):
            value = mix(value * U64(0x9E3779B97F4A7C15) + np.minimum.reduceat(x * _FACTORS[m] + _SHIFTS[m], starts))
        out[:, c] = value >> U64(33)
    return out


def signed(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, h (hash of the text), n (size of the set), d1, d2 (its digest), sig for each row of docs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable()
        for b in batches:
            n, d, sig = [], [], []
            held: list[np.ndarray] = []

            def flush() -> None:
                full = [s for s in held if len(s)]
                rows = iter(signatures(full) if full else ())
                sig.extend(next(rows) if len(s) else None for s in held)
                held.clear()

            size = 0
            for t in b.column(2).to_pylist():
                s = shingle_set(t, k, table)
                n.append(len(s))
                d.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64))
                held.append(s)
                size += len(s)
                if size >= STEP:
                    flush()
                    size = 0
            flush()
            d1, d2 = np.array(d, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(d1), pa.array(d2), pa.array(sig, pa.list_(pa.int32()))], ["doc_id", "h", "n", "d1", "d2", "sig"])

    return in_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(text) h", "text"), work, "doc_id long, h long, n long, d1 long, d2 long, sig array<int>")


def set_table(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(id, set) for wanted (id, doc_id, h, d1, d2): full sets as longs, made again from the texts. A set is met by doc_id and hash of the text, so rows that share a doc_id, or have none, meet only their own."""
    none = F.lit(-(1 << 63)).cast("long")
    w = wanted.select("id", F.coalesce("doc_id", none).alias("key"), "h", "d1", "d2")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), none).alias("key"), F.xxhash64("text").alias("h"), "text")
    rows = keyed.join(w, ["key", "h"]).select("id", "d1", "d2", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable()
        for b in batches:
            ids, sets = [], []
            for i, d1, d2, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = shingle_set(t, k, table)
                if tuple(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)) == (d1, d2):
                    ids.append(i)
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["id", "set"])

    return in_arrow(rows, work, "id long, set array<long>").dropDuplicates(["id"])


def shareable(sets: DataFrame) -> DataFrame:
    """(id, known): how many shingles of each set any other of them has. Nobody has more in common with it."""
    each = sets.select("id", F.explode("set").alias("shingle"))
    met = each.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1").select("shingle")
    return each.join(met, "shingle", "left_semi").groupBy("id").agg(F.count("*").alias("known"))


def counted(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow the likeness and whose signatures agree in LEAST coordinates."""
    a = pairs.join(reps.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a")), "a")
    both = a.join(reps.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b")), "b")
    agree = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return both.filter((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (agree >= LEAST)).select("a", "b")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and where each row's begin."""
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the likeness."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            (x, i), (y, j) = (_flat(b.column(c)) for c in (2, 3))
            for r in range(b.num_rows):
                u, v = x[i[r] : i[r + 1]], y[j[r] : j[r + 1]]
                common = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * common >= percent * (len(u) + len(v) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return in_arrow(both.select("a", "b", "set_a", "set_b"), work, "a long, b long")


def split_lists(posts: DataFrame, groups: DataFrame) -> DataFrame:
    """(token, id, n, known, g, size) of the posting lists whose members are in several groups; size: members of the list."""
    held = posts.join(groups.withColumnRenamed("node", "id"), "id", "left").select("token", "id", "n", "known", F.coalesce("component", "id").alias("g"))
    split = held.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count("*").alias("size")).filter("lo < hi").select("token", "size")
    return cut(held.join(split, "token"), "split-lists")


def _can_reach(percent: int) -> str:
    """Whether two sets can reach the likeness, given that they have at most `known` in common (and so n as well)."""
    return f"({100 + percent}) * least(known, known_b) >= {percent} * (n + n_b)"


def handfuls(mixed: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different groups within random handfuls of the lists, dealt anew each turn; as many as HANDFUL for each row on average at most."""
    hand = F.pmod(F.xxhash64("id", F.lit(turn)), F.ceil(F.col("size") / HANDFUL))
    dealt = mixed.select("token", hand.alias("hand"), "id", "n", "known", "g")
    other = dealt.withColumnsRenamed({"id": "b", "n": "n_b", "known": "known_b", "g": "g_b"})
    both = dealt.join(other, ["token", "hand"]).filter(f"id < b and g <> g_b and {_can_reach(percent)}")
    return both.select(F.col("id").alias("a"), "b").distinct()


def apart(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different groups that share a list and may reach the likeness.

    Lists are compared block against block in place: a set's shingles, cut to 16 bits, are marked in a table and another's marked shingles counted, which can only be too many.
    Pairs that even so fall short are never given out.
    """
    cut_down = F.transform("set", lambda x: F.shiftrightunsigned(x, 48).cast("int"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    spread = mixed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = spread.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "n", "g").join(sets.select("id", cut_down.alias("bits")), "id")
    sorted_ = dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").select("token", "i", "j", "own", "id", "n", "g", "bits")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, held, out = np.zeros(1 << 16, bool), [], []

        def close() -> None:
            if len({r[6] for r in held}) > 1:
                out.extend(_within(held, marked, percent))
            held.clear()

        for b in batches:
            bits, starts = _flat(b.column(7))
            for r, row in enumerate(zip(*(b.column(c).to_pylist() for c in range(7)), strict=True)):
                if held and held[0][:3] != row[:3]:
                    close()
                held.append((*row, bits[starts[r] : starts[r + 1]]))
            if out:
                yield pairs_of(out)
        close()
        yield pairs_of(out)

    def pairs_of(out: list) -> pa.RecordBatch:
        a, c = zip(*out, strict=True) if out else ((), ())
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    return in_arrow(sorted_, work, "a long, b long").distinct()


def _within(rows: list[tuple], marked: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of one pair of blocks that may reach the likeness: those outside the largest group against everybody of another group."""
    own, ids, n, g = (np.array([r[c] for r in rows], np.int64) for c in (3, 4, 5, 6))
    flat, starts = np.concatenate([r[7] for r in rows]), np.cumsum([0, *(len(r[7]) for r in rows[:-1])])
    kinds, counts = np.unique(g, return_counts=True)
    main = kinds[counts.argmax()]
    across = rows[0][1] != rows[0][2]
    for x in np.flatnonzero(g != main):
        marked[rows[x][7]] = True
        common = np.minimum(np.add.reduceat(marked[flat], starts, dtype=np.int64), n[x])
        marked[rows[x][7]] = False
        near = (100 * common >= percent * (n + n[x] - common)) & (g != g[x]) & ((g == main) | (ids > ids[x]))
        if across:
            near &= own != own[x]
        for y in np.flatnonzero(near):
            yield (int(ids[x]), int(ids[y])) if ids[x] < ids[y] else (int(ids[y]), int(ids[x]))


def grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, h (hash of the text), n (size of the set), g (its group, null for an empty set) for each row of docs (doc_id, text)."""
    base = cut(signed(docs, k).withColumn("row_id", F.monotonically_increasing_id()), "signed")
    reps = cut(base.filter("n > 0").groupBy("d1", "d2").agg(F.min("row_id").alias("id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("of"), F.first("n").alias("n"), F.first("sig").alias("sig")).select("d1", "d2", "id", "of.doc_id", "of.h", "n", "sig"), "distinct-sets")
    each = reps.select("id", "n", F.posexplode("sig").alias("c", "v")).select("id", "n", (F.shiftleft(F.col("c").cast("long"), 32) + F.col("v")).alias("token"))
    seen = each.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    known = each.join(seen, "token").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("known"))  # at most COORDINATES
    rare = known.filter(F.size("known") >= LEAST).select("id", "n", F.explode(F.slice("known", F.lit(1), F.size("known") - LEAST + 1)).alias("k"))
    listed = cut(rare.select("id", "n", F.col("k.token").alias("token")), "listed")
    sets = cut(set_table(docs, reps.select("id", "doc_id", "h", "d1", "d2").join(listed.select("id").distinct(), "id"), k), "sets")
    posts = cut(listed.join(shareable(sets), "id").filter(f"100 * known >= {percent} * n"), "postings")
    hubs = posts.groupBy("token").agg(F.min("id").alias("b"))
    about = posts.select(F.col("id").alias("a"), "token").join(hubs, "token").filter("a <> b").select("a", "b").distinct()
    links = cut(confirmed(counted(about, reps, percent), sets, percent), "links")
    for turn in range(ROUNDS + 1):
        groups = components(links)
        mixed = split_lists(posts, groups)
        more = cut(confirmed(counted(handfuls(mixed, turn, percent) if turn < ROUNDS else apart(mixed, sets, percent), reps, percent), sets, percent), "links")
        links, old = cut(groups.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), "links"), links
        drop_cut(old, mixed, more)
    final = components(links)
    classes = reps.join(final.withColumnRenamed("node", "id"), "id", "left").select("d1", "d2", F.coalesce("component", "id").alias("g"))
    rows = cut(base.select("doc_id", "h", "n", "d1", "d2").join(classes, ["d1", "d2"], "left").select("doc_id", "h", "n", "g"), "rows")
    drop_cut(base, reps, listed, posts, sets, links)
    return rows


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept for each row of docs (doc_id, text)."""
    rows = grouped(docs, k, percent)
    smallest = rows.filter("g is not null").groupBy("g").agg(F.min("doc_id").alias("least"))
    out = cut(rows.join(smallest, "g", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id")), "components")
    drop_cut(rows)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, that stand for their groups: the one with the smallest doc_id (null last), then hash of the text, and one of the rows that repeat it.

    Rows are told apart by doc_id and text, so rows with one doc_id and texts of different groups stay, and of rows without a doc_id those with a group's text go. Texts without words stay.
    """
    none, (key, h) = F.lit(-(1 << 63)).cast("long"), free_names(docs, "key", "h")
    of = F.coalesce(F.col("doc_id").cast("long"), none)
    marked = grouped(docs, k, percent).filter("g is not null").select("g", F.struct(F.col("doc_id").isNull().alias("last"), of.alias("key"), "h").alias("mark"))
    best = marked.groupBy("g").agg(F.min("mark").alias("best"))
    gone = marked.join(best, "g").filter("mark <> best").select(F.col("mark.key").alias(key), F.col("mark.h").alias(h)).distinct()
    left = docs.select("*", of.alias(key), F.xxhash64("text").alias(h)).join(gone, [key, h], "left_anti")
    # Rows that are left and share a key repeat each other; what is kept of them is picked before the shuffle as well, so that no group of them is gathered.
    return left.dropDuplicates([key, h]).select(*docs.columns)
