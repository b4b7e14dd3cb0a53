"""Chat formatting: conversations through a compiled template, with the spans a model is trained on, and the way back.

A conversation is a stream of rows sorted by turn. It is rendered piece by piece and given out in parts of about PART characters, so one that holds a third of all
rows needs no more memory than any other; its pieces follow each other, so it stays in one task, sorted on disk.

Control strings inside texts are broken by `\\.` behind their first character, and a backslash is doubled; `unescape` undoes both.

Defined results: rows of a conversation go by turn (nulls last), then role, then text; null role or text: empty; a null conv_id is a conversation of its own;
repeated rows stay; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import in_arrow
from provspark.llm.template import compile_template

START, TURN, BODY, END = "<s>", "[TURN]", "[TEXT]", "</s>"
#: Strings that a text must not hold as they are.
CONTROLS = (START, END, TURN, BODY, "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
TEMPLATE = (
    "{# marks turns; what the assistant says is generated #}" + START + "{% for m in messages %}" + TURN + "{{ m.role | escape }}" + BODY
    + "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}" + END + "{% endfor %}"
)
PART = 1 << 18
_STARTS = re.compile("(?=" + "|".join(map(re.escape, CONTROLS)) + ")(.)", re.S)
_BROKEN = re.compile(r"\\(.)", re.S)


def escape(text: str | None) -> str:
    t = text or ""
    if "\\" in t:
        t = t.replace("\\", "\\\\")
    return _STARTS.sub(r"\1\\.", t) if "<" in t or "[" in t else t


def unescape(text: str) -> str:
    return _BROKEN.sub(lambda m: "" if m[1] == "." else m[1], text) if "\\" in text else text


PARTS = "conv_id long, part long, text string, starts array<long>, stops array<long>"


def format_conversations(conversations: DataFrame, source: str = TEMPLATE) -> DataFrame:
    """(conv_id, part, text, starts, stops): the formatted text in parts, one after the other within a partition; starts and stops: code points of generated spans, counted over the whole text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = compile_template(source, {"escape": escape})
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
        out: list[tuple] = []
        weight = 0

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "part", "text", "starts", "stops"])

        for conv, group in groupby(rows, key=lambda r: r[0]):
            messages = ({"role": role or "", "text": text or ""} for _, role, text in group)
            part, at, held, size, starts, stops = 0, 0, [], 0, [], []
            for piece, generated in template.render(messages):
                if generated:
                    starts.append(at)
                    stops.append(at + len(piece))
                at += len(piece)
                size += len(piece)
                held.append(piece)
                if size >= PART:
                    out.append((conv, part, "".join(held), starts, stops))
                    yield batch()
                    out, weight = [], 0
                    part, held, size, starts, stops = part + 1, [], 0, [], []
            out.append((conv, part, "".join(held), starts, stops))
            weight += size
            if weight >= PART:
                yield batch()
                out, weight = [], 0
        if out:
            yield batch()

    d = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    order = [F.col(c).asc_nulls_last() for c in ("conv_id", "turn", "role", "text")]
    return in_arrow(d.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text"), work, PARTS)


class Reader:
    """Turns out of formatted text that comes in parts."""

    def __init__(self) -> None:
        self.held, self.open = "", False

    def turns(self, text: str) -> Iterator[tuple[str, str]]:
        self.held += text
        if not self.open:
            if not self.held.startswith(START):
                raise ValueError("a formatted conversation begins with its start mark")
            self.held, self.open = self.held[len(START) :], True
        *whole, self.held = self.held.split(END)
        for w in whole:
            role, mark, body = w.removeprefix(TURN).partition(BODY)
            if not mark or not w.startswith(TURN):
                raise ValueError("a turn lacks its marks")
            yield unescape(role), unescape(body)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, read from the output of format_conversations as it comes (its parts in order)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out = []

        def batch() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for conv, parts in groupby(rows, key=lambda r: r[0]):
            reader, n, turns, loss, loss_chars, at = Reader(), 0, hashlib.sha256(), hashlib.sha256(), 0, 0
            for _, _, text, starts, stops in parts:
                for role, body in reader.turns(text):
                    n += 1
                    turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for i, j in zip(starts, stops, strict=True):
                    said = unescape(text[i - at : j - at])
                    loss_chars += len(said)
                    loss.update(said.encode("utf-8", "surrogatepass"))
                at += len(text)
            out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), at))
            if len(out) >= 1000:
                yield batch()
                out = []
        if out:
            yield batch()

    return in_arrow(formatted, work, READ)


#: The conversation of the contract that speaks control strings.
PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"


def with_probe(conversations: DataFrame) -> DataFrame:
    probe = conversations.sparkSession.createDataFrame([(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)], "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)


def oracle() -> str:
    """The digests straight from the rows, in DuckDB's SQL; the length from the template's marks and the escapes."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    extra = lambda c: f"(length({c}) - length(replace({c}, '\\', '')))" + "".join(f" + 2 * (length({c}) - length(replace({c}, {quoted(k)}, ''))) // {len(k)}" for k in CONTROLS)
    marks = len(TURN + BODY + END)
    return f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, role as r0, text as t0 from conversations
  union all select * from (values ({PROBE_ID}, 0, 'user', {quoted(PROBE_TEXT)}, 'user', {quoted(PROBE_TEXT)}), ({PROBE_ID}, 1, 'assistant', {quoted(PROBE_TEXT)}, 'assistant', {quoted(PROBE_TEXT)})))
select conv_id::bigint as conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls last, r0 nulls last, t0 nulls last)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls last, r0 nulls last, t0 nulls last) filter (where role = 'assistant'), '')) as loss_sha256,
  ({len(START)} + sum({marks} + length(role) + length(text) + {extra("role")} + {extra("text")}))::bigint as formatted_chars
from c group by conv_id
"""
