"""Removal of repeated passages: every byte covered by a LENGTH-byte string that also starts somewhere else in the corpus.

One suffix array of all texts can't be cut up, but equal strings can be brought together first. Each LENGTH-byte window has a core: of the CORE-byte strings in it the
one with the least hash, the leftmost if there are several. Equal windows have equal cores at equal places, so windows that follow each other with the same core
form a piece, and only pieces with the same core need comparing:
1. Cores met once hold no repeat. Pieces of one core that are all equal are repeats from end to end.
2. Of the others, each distinct piece comes together with those of its core. Parts that no neighbour shares are trimmed off; what is left goes, the core as one symbol,
   into blocks of at most about BLOCK symbols, whose suffix arrays (`suffix_array`) put equal windows side by side.
3. A core with more than CROWD distinct pieces is refined instead: its windows are halved by where the core lies in them, each half has a longer core, equal pieces
   become one, and so on until a crowd fits; windows with no room left are whole strings, which are equal or not. So nothing is gathered beyond a bound and nothing is dropped.
Spans go back to the texts by a digest of doc_id and text, and the bytes between them are kept.

Defined results: null text: empty; texts under LENGTH bytes lose nothing; matches never cross texts; rows that repeat each other lose all their bytes if long enough;
other columns are ignored; no rows give no rows. Digests of rows, cores and pieces have 64 bits; pieces are only compared by digest within one core.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import U64, cut, drop_cut, in_arrow, small_batches
from provspark.llm.suffix_array import suffix_array

LENGTH, CORE = 200, 80
#: Core starts within a window, less one: a piece has up to SLACK + 1 windows.
SLACK = LENGTH - CORE
BLOCK, CROWD = 30_000, 1024
#: Windows of a text that are hashed at once.
STRETCH = 1 << 19
_LOW = U64(0xFFFFF)


def core_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the CORE bytes from each place on, by doubling; data: bytes, at least CORE."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    h = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]).view(np.uint64)[:, 0]
    h = (h ^ (h >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    size = 8
    while size < CORE:
        step = min(size, CORE - size)
        h = h[:-step] * U64(0x9E3779B97F4A7C15 + 2 * step) + (h[step:] ^ (h[step:] >> U64(31)))
        size += step
    h = h[: n - CORE + 1]
    h = (h ^ (h >> U64(32))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(29))


def pieces(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(core hash, core start, first window, last window) of the pieces of a text, a stretch at a time."""
    everything = np.frombuffer(data, np.uint8)
    for at in range(0, len(data) - LENGTH + 1, STRETCH):
        h = core_hashes(everything[at : at + STRETCH + LENGTH - 1])
        key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        least, have = key, 1
        while have * 2 <= SLACK + 1:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have <= SLACK:
            step = SLACK + 1 - have
            least = np.minimum(least[:-step], least[step:])
        core = (least & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], core[1:] != core[:-1])))
        last = np.append(first[1:] - 1, len(core) - 1)
        yield h[core[first]].view(np.int64), core[first] + at, first + at, last + at


def all_pieces(docs: DataFrame) -> DataFrame:
    """(core, row, place, print) of every piece; place: core start, and how far before it the first and the last window start; print: digest of its bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cores, rows, places, prints = [], [], [], []

            def out() -> pa.RecordBatch:
                arrays = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (cores, rows, places)]
                batch = pa.RecordBatch.from_arrays([*arrays, pa.array(np.array(prints, np.uint64).view(np.int64))], ["core", "row", "place", "print"])
                for x in (cores, rows, places, prints):
                    x.clear()
                return batch

            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for h, p, lo, hi in pieces(data):
                    cores.append(h)
                    rows.append(np.full(len(h), row, np.int64))
                    places.append(p << 16 | (p - lo) << 8 | (p - hi))
                    prints += [xxhash.xxh3_64_intdigest(data[i : j + LENGTH]) for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]
                    if len(prints) > 50_000:
                        yield out()
            yield out()

    return in_arrow(docs.filter("text is not null").select("row", "text"), work, "core long, row long, place long, print long")


PIECE = "key long, print long, single boolean, row long, start long, before int, from_ int, width int, bytes binary"
PIECE_NAMES = [c.split()[0] for c in PIECE.split(", ")]
PIECE_KINDS = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())


def cut_out(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pieces with their bytes. wanted: row, and of it an array of (core, print, single, place). before: bytes in front of the core; windows hold the core from_ to from_ + width bytes behind their start."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for row, text, want in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for w in want:
                    p = w["place"] >> 16
                    lo, hi = p - (w["place"] >> 8 & 0xFF), p - (w["place"] & 0xFF)
                    rows.append((w["core"], w["print"], w["single"], row, lo, p - lo, 0, SLACK, data[lo : hi + LENGTH]))
                if len(rows) > 20_000:
                    yield _piece_batch(rows)
                    rows = []
            yield _piece_batch(rows)

    return in_arrow(docs.join(wanted, "row").select("row", "text", "want"), work, PIECE)


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(PIECE_KINDS), PIECE_KINDS, strict=True)], PIECE_NAMES)


def halves(crowded: DataFrame) -> DataFrame:
    """Each piece by halves of the places its core has in a window; a half's core is longer and is its new key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, _, single, row, start, before, from_, width, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                anchor, windows = before + from_, len(data) - LENGTH + 1
                mid = from_ + width // 2
                for lo, hi in ((from_, mid), (mid + 1, from_ + width)):
                    first, last = max(0, anchor - hi), min(windows - 1, anchor - lo)
                    if first > last:
                        continue
                    core = data[anchor - lo : anchor - hi + LENGTH]
                    part = data[first : last + LENGTH]
                    new = _signed(xxhash.xxh3_64_intdigest(core, seed=(key * 31 + lo * 256 + hi) & 0xFFFFFFFFFFFFFFFF))
                    rows.append((new, _signed(xxhash.xxh3_64_intdigest(part)), single, row, start + first, anchor - lo - first, lo, hi - lo, part))
            yield _piece_batch(rows)

    return in_arrow(crowded.select(*PIECE_NAMES), work, PIECE)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shared(a: bytes, b: bytes) -> int:
    """Bytes that a and b begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def reach(sides: list[bytes]) -> list[int]:
    """How many bytes each shares with the one most like it."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    out = [0] * len(sides)
    for i, j in zip(order, order[1:]):
        k = shared(sides[i], sides[j])
        out[i], out[j] = max(out[i], k), max(out[j], k)
    return out


class Block:
    """Strings of several crowds, each with its core as one symbol, for one suffix array."""

    def __init__(self) -> None:
        self.strings: list[tuple[bytes, bytes, int, int, list]] = []  # bytes before and behind the core, crowd, windows' symbols, (row, start) of single pieces
        self.crowds = self.size = 0

    def add(self, group: list[tuple]) -> None:
        """Takes the pieces of one key, trimmed to what another of them shares. A form that several pieces have comes in twice, so that the array finds it repeated."""
        width = group[0][7]
        core = LENGTH - width
        left = [g[8][: g[5]][::-1] for g in group]
        right = [g[8][g[5] + core :] for g in group]
        forms: dict[tuple[bytes, bytes], list] = {}
        for g, x, y, i, j in zip(group, left, right, reach(left), reach(right), strict=True):
            if i + j >= width:  # else no window has an equal
                forms.setdefault((x[:i][::-1], y[:j]), []).append((g[2], g[3], g[4] + g[5] - i))
        self.crowds += 1
        for (x, y), who in forms.items():
            for singles in [[(row, start) for single, row, start in who if single], []][: len(who)]:
                self.strings.append((x, y, self.crowds, width + 1, singles))
                self.size += len(x) + len(y) + 2

    def repeats(self) -> Iterator[tuple[int, int, int]]:
        """(row, start, stop) of the windows of single pieces that lie side by side with an equal one."""
        n = len(self.strings)
        if n < 2:
            return
        parts, starts, at = [], [], 0
        for k, (x, y, crowd, _, _) in enumerate(self.strings):
            whole = np.empty(len(x) + len(y) + 2, np.int64)
            whole[: len(x)] = np.frombuffer(x, np.uint8)
            whole[len(x)] = 256 + crowd
            whole[len(x) + 1 : -1] = np.frombuffer(y, np.uint8)
            whole[:-1] += n + 1
            whole[-1] = k + 1
            parts.append(whole)
            starts.append(at)
            at += len(whole)
        text = np.concatenate([*parts, [0]])
        sa = suffix_array(text)
        begin, owner, need = np.zeros(len(text), bool), np.zeros(len(text), np.int64), np.array([s[3] for s in self.strings])
        for k, (start, part) in enumerate(zip(starts, parts, strict=True)):
            owner[start : start + len(part)] = k
            begin[start : start + max(0, len(part) - need[k])] = True
        sa = sa[begin[sa]]
        hit = np.zeros(len(text), bool)
        same_need = need[owner[sa[:-1]]] == need[owner[sa[1:]]]
        for w in np.unique(need):
            at_ = np.flatnonzero(same_need & (need[owner[sa[:-1]]] == w))
            for k in range(0, len(at_), 4096):
                i, j = sa[at_[k : k + 4096]], sa[at_[k : k + 4096] + 1]
                cols = np.arange(w)
                equal = (text[i[:, None] + cols] == text[j[:, None] + cols]).all(axis=1)
                hit[i[equal]] = hit[j[equal]] = True
        for k, (start, part) in enumerate(zip(starts, parts, strict=True)):
            if not self.strings[k][4]:
                continue
            windows = hit[start : start + len(part)]
            edge = np.flatnonzero(np.diff(np.concatenate(([0], windows.view(np.int8), [0]))))
            for row, first in self.strings[k][4]:
                yield from ((row, first + i, first + j - 1 + LENGTH) for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def repeats(fitting: DataFrame) -> DataFrame:
    """(row, start, stop) of the repeats among pieces with the same key. A task reads its pieces sorted by key and holds one block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, group, out = Block(), [], []

        def close() -> None:
            nonlocal block
            if len(group) > 1:
                block.add(group)
            group.clear()
            if block.size >= BLOCK:
                out.extend(block.repeats())
                block = Block()

        def spans() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * 3
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["row", "start", "stop"])

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group and group[0][0] != r[0]:
                    close()
                group.append(r)
            if len(out) > 10_000:
                yield spans()
        close()
        out.extend(block.repeats())
        yield spans()

    return in_arrow(fitting.select(*PIECE_NAMES).repartition("key").sortWithinPartitions("key"), work, "row long, start long, stop long")


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(row, start, stop) of repeated bytes of docs (row, text), and the tables it reads from."""
    every = cut(all_pieces(docs), "all-pieces")
    # Cores met twice or more; the spans of pieces that are all equal need nothing else. As a table, so that the join can split the rows of a core that is met very often.
    met = cut(every.groupBy("core").agg(F.count("*").alias("c"), (F.min("print") == F.max("print")).alias("equal")).filter("c > 1").drop("c"), "met-cores")
    flagged = cut(every.join(met, "core"), "met-pieces")
    drop_cut(every, met)
    start, stop = F.shiftright("place", 16) - F.shiftright("place", 8).bitwiseAND(255), F.shiftright("place", 16) - F.col("place").bitwiseAND(255) + LENGTH
    spans = [flagged.filter("equal").select("row", start.alias("start"), stop.alias("stop"))]
    mixed = flagged.filter("not equal")
    # first() of all three comes from one and the same row.
    distinct = cut(mixed.groupBy("core", "print").agg(F.count("*").alias("c"), F.first("row").alias("row"), F.first("place").alias("place")), "distinct-pieces")
    want = distinct.select("row", F.struct("core", "print", (F.col("c") == 1).alias("single"), "place").alias("w")).groupBy("row").agg(F.collect_list("w").alias("want"))  # of one text
    several = distinct.filter("c > 1").select("core", "print")
    spans.append(mixed.join(several, ["core", "print"]).select("row", start.alias("start"), stop.alias("stop")))
    here = cut(cut_out(docs, want), "pieces")
    tables = [flagged, distinct, here]
    while True:
        crowds = here.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("key")
        crowded = here.join(crowds, "key", "left_semi")
        if crowds.isEmpty():
            spans.append(repeats(here))
            break
        spans.append(repeats(here.join(crowds, "key", "left_anti")))
        split = cut(halves(crowded), "halves")
        kinds = split.groupBy("key", "print").agg(F.count("*").alias("c"), F.min("single").alias("single"))
        several = kinds.filter("c > 1").select("key", "print")
        spans.append(split.filter("single").join(several, ["key", "print"]).select("row", "start", F.expr("start + length(bytes)").alias("stop")))
        alone = split.groupBy("key", "print").agg(F.count("*").alias("c"), F.min("single").alias("single"), *(F.first(x).alias(x) for x in PIECE_NAMES[3:]))
        lonely = kinds.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
        here = cut(alone.withColumn("single", F.col("single") & (F.col("c") == 1)).select(*PIECE_NAMES).join(lonely, "key", "left_semi"), "pieces")
        tables += [split, here]
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    return out, tables


def merged(spans: list[int]) -> Iterator[tuple[int, int]]:
    """Maximal runs of spans, each start << 32 | length."""
    lo = hi = -1
    for s in sorted(spans):
        i, j = s >> 32, (s >> 32) + (s & 0xFFFFFFFF)
        if i > hi:
            if hi >= 0:
                yield lo, hi
            lo, hi = i, j
        else:
            hi = max(hi, j)
    if hi >= 0:
        yield lo, hi


def with_spans(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """docs with `_spans` (start << 32 | length, null for none), and the tables it was made from."""
    rows = docs.withColumn("_row", F.xxhash64(F.col("doc_id").cast("long"), "text"))
    spans, tables = repeated_spans(rows.select(F.col("_row").alias("row"), "text"))
    by_row = spans.select("row", F.shiftleft("start", 32).bitwiseOR(F.col("stop") - F.col("start")).alias("span")).groupBy(F.col("row").alias("_row")).agg(F.collect_set("span").alias("_spans"))  # of one text
    return rows.join(cut(by_row, "spans"), "_row", "left"), tables


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs (doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data, at, digest, gone, n = (text or "").encode("utf-8", "surrogatepass"), 0, hashlib.sha256(), 0, 0
                for i, j in merged(spans or []):
                    digest.update(data[at:i])
                    at, gone, n = j, gone + j - i, n + 1
                digest.update(data[at:])
                rows.append((doc_id, len(data), gone, n, digest.hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    whole, tables = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    drop_cut(*tables)
    return in_arrow(whole.select("doc_id", "text", "_spans"), work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without the repeated bytes of text; a character cut in two goes whole. n_chars follows, where there is one."""

    @F.pandas_udf("string")
    def kept(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(text: str | None, found: object) -> str | None:
            if text is None or found is None:
                return text
            data, at, out = text.encode("utf-8", "surrogatepass"), 0, []
            for i, j in merged([int(s) for s in found]):
                out.append(data[at:i])
                at = j
            return b"".join([*out, data[at:]]).decode("utf-8", "ignore")

        return pd.Series([one(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    small_batches(docs.sparkSession)
    whole, tables = with_spans(docs)
    drop_cut(*tables)
    out = whole.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(kept("text", "_spans")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return out.select(*docs.columns)
