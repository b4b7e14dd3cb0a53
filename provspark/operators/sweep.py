"""One pass over the lines of each file that answers every asked line of it at once."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame

#: Kinds of rows, in the order in which they take effect on a line.
SPAN, LINK, DECISION, ASK = range(4)
ROWS = "file_path string, line int, kind int, stop int, stamp timestamp, uid string, n long"
ANSWERS = "file_path string, line int, k int, uids array<string>"
#: Rows that one task sorts, on average, before rows are dealt to more tasks.
ROWS_A_TASK = 1 << 19

Item = tuple[bool, int, str]
"""Sorts newest first, without a time last, then by uid."""


def item(stamp: int | None, uid: str) -> Item:
    return stamp is None, -(stamp or 0), uid


class LineTops:
    """The newest few of any range of lines: each line's few, and those of every aligned block of 2, 4, 8 ... lines that have any, made as the blocks fill up."""

    def __init__(self, most: int):
        self.most, self.lines, self.blocks = most, [], [[]]

    def add(self, line: int, items: list[Item]) -> None:
        """Lines come in ascending order."""
        self.lines.append(line)
        level = 0
        self.blocks[0].append(sorted(set(items))[: self.most])
        while len(self.blocks[level]) % 2 == 0:
            left, right = self.blocks[level][-2:]
            level += 1
            if level == len(self.blocks):
                self.blocks.append([])
            self.blocks[level].append(sorted({*left, *right})[: self.most])

    def within(self, first: int, last: int) -> list[Item]:
        """Two blocks of each size at most are looked at."""
        lo, hi, level, found = bisect_left(self.lines, first), bisect_right(self.lines, last), 0, set()
        while lo < hi:
            if lo % 2:
                found.update(self.blocks[level][lo])
                lo += 1
            if hi % 2:
                hi -= 1
                found.update(self.blocks[level][hi])
            lo, hi, level = lo // 2, hi // 2, level + 1
        return sorted(found)[: self.most]


def of_file(rows: Iterator[tuple], limits: tuple[int, ...]) -> Iterator[tuple[int | None, int | None, list[str]]]:
    """(line, level, uids) of each asked line. rows: (line, kind, stop, stamp, uid, n) by line (none first) and kind.

    The spans that have begun wait in a heap, innermost first; one that has ended is dropped when it comes to the top, as no later line can want it. What a span holds
    may stand on lines below the asked one, so answers are given once the file is through.
    """
    open_: list[tuple] = []
    tops, whole = LineTops(limits[0]), []
    asked: list[tuple] = []
    for line, here in groupby(rows, key=itemgetter(0)):
        linked, made, wanted = [], [], False
        for _, kind, stop, stamp, uid, n in here:
            if kind == SPAN:
                heappush(open_, (stop - line, *item(stamp, uid), line, stop))
            elif kind == LINK:
                linked.append((*item(stamp, uid), n))
            elif kind == DECISION:
                made.append(item(stamp, uid))
            else:
                wanted = True
        linked.sort()
        made.sort()
        if linked:
            tops.add(line, [x[:3] for x in linked])
        whole = sorted(whole + made)[: limits[3]]
        if wanted:
            while open_ and open_[0][-1] < line:
                heappop(open_)
            repeated = [x[2] for x in linked for _ in range(min(x[3], limits[1]))][: limits[1]]
            asked.append((line, open_[0][-2:] if open_ and line is not None else None, repeated, [x[2] for x in made[: limits[2]]] if line is not None else []))
    told: dict[tuple[int, int], list[str]] = {}
    for line, span, at_line, made_here in asked:
        if span and span not in told:
            told[span] = [x[2] for x in tops.within(*span)]
        levels = (told[span] if span else [], at_line, made_here, [x[2] for x in whole])
        k = next((k for k, uids in enumerate(levels) if uids), None)
        yield line, k, [] if k is None else levels[k]


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """Rows, at most n, dealt by the keys: to more tasks than the session has it where these would get over ROWS_A_TASK each."""
    tasks = -(-n // ROWS_A_TASK)
    return rows.repartition(tasks, *keys) if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(*keys)


def answers(rows: DataFrame, limits: tuple[int, ...], n: int = 0) -> DataFrame:
    """(file_path, line, k, uids) for each ASK among rows: the first level with an answer (0 the symbol's links, 1 the line's, 2 decisions on the line, 3 in the file), none if there is none.

    rows: as ROWS, one shuffle by file; links (n: how often it stands there) and decisions already cut to the newest few of their line, asked lines and spans without
    repeats. So what a file holds, however hot, is in proportion to its lines. n: how many rows there may be.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def plain(b: pa.RecordBatch) -> Iterator[tuple]:
            columns = [c.cast(pa.int64()) if pa.types.is_timestamp(c.type) else c for c in b.columns]
            return zip(*(c.to_pylist() for c in columns), strict=True)

        out: list[tuple] = []
        for path, group in groupby((r for b in batches for r in plain(b)), key=itemgetter(0)):
            out += [(path, *a) for a in of_file((r[1:] for r in group), limits)]
            if len(out) > 5000:
                yield _batch(out)
                out = []
        yield _batch(out)

    return dealt(rows, n, "file_path").sortWithinPartitions("file_path", "line", "kind").mapInArrow(work, ANSWERS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], ["file_path", "line", "k", "uids"])
