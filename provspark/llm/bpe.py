"""Byte-level BPE as a bounded-lookahead streaming transducer, and its incremental decoder.

Encoding. A text is pushed in chunks of CHUNK characters through an automaton (`Encoder`). Its states are the borders between pre-tokens, or the kind of pre-token it is in together
with a window of that one's bytes. Inside a pre-token merges run on the window; a token is emitted once `lookahead` more bytes than it covers have been read, for
then no later byte can change it, and the window starts anew behind it. A border emits what the window still holds. `lookahead` comes from the merge list alone (`sufficient_lookahead`).
What is held is a window and a few characters that may yet begin a special token or move a border, however long the text or one pre-token of it is. What the automaton emits
from border to border is kept in a bounded table (`Steps`), so a word met again is one step.

Decoding. Ids go, as they are emitted, through a table id -> bytes into a byte-to-text state machine that holds at most an unfinished character.

Defined results: a null text is an empty one (0 tokens, empty decoded text); every row gives one row, repeated rows and doc_ids included; other columns are
ignored. Strings of special tokens inside a text become those tokens.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from provspark.llm.common import in_arrow

#: Fixed pattern of the byte-level pre-tokenizer.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTION = regex.compile("'(?:s|t|re|ve|m|ll|d)")
#: How a pre-token of a kind goes on.
MORE = {"letters": r"\p{L}*", "digits": r"\p{N}*", "space": r"\s*", "others": r"[^\s\p{L}\p{N}]*"}
#: Characters that are pushed at once.
CHUNK = 1 << 13
#: Characters behind a place that can still move a border there: a contraction has two behind its apostrophe.
BEHIND = 2


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return [out[b] for b in range(256)]


def sufficient_lookahead(merges: list[tuple[int, int, int]], length: list[int]) -> int:
    """Bytes behind a token that, once read, fix it. merges: (left, right, result) by rank; length: bytes of each id.

    Take two texts that agree up to some byte and run the merges by rank on both. The place up to which the runs agree moves left only when a merge (l, r)
    fires in one run across it, by the bytes of l. The next such merge ranks later, and its right part begins either with the result just made or, in the other
    run, with l itself: one of the two lies on the left edge of its right part. The longest chain of such merges bounds the way back.
    """
    parts = {z: (x, y) for x, y, z in merges}
    best: dict[int, int] = {}
    most = 0
    for x, y, z in merges:
        back, t = 0, y
        while True:
            back = max(back, best.get(t, 0))
            if t not in parts:
                break
            t = parts[t][0]
        back += length[x]
        for t in (x, z):
            best[t] = max(best.get(t, 0), back)
        most = max(most, back)
    return most


class Transducer:
    """Merge list, tables and patterns of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        chars = byte_chars()
        back = {c: b for b, c in enumerate(chars)}
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.first = [vocab[c] for c in chars]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        merges = [(vocab[x], vocab[y], vocab[x + y]) for x, y in pairs]
        self.rank = {x << 32 | y: (r << 32 | z) for r, (x, y, z) in reversed([*enumerate(merges)])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.pieces = regex.compile(PIECES)
        self.more = {kind: regex.compile(p) for kind, p in MORE.items()}
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.most_special = max(map(len, self.special), default=1)
        self.lookahead = sufficient_lookahead(merges, [len(b) for b in self.bytes_of])
        self.window = self.lookahead + 2 * max(map(len, self.bytes_of))
        self.steps = Steps(self)

    def merged(self, data: bytes) -> list[int]:
        """Tokens of a whole stretch: the lowest-ranked pair, leftmost first, until none is left."""
        ids, rank = [self.first[b] for b in data], self.rank
        none = 1 << 62
        ranks = [rank.get(x << 32 | y, none) for x, y in zip(ids, ids[1:])]
        while ranks:
            r = min(ranks)
            if r == none:
                break
            i = ranks.index(r)
            ids[i : i + 2] = [r & 0xFFFFFFFF]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get(ids[i - 1] << 32 | ids[i], none)
            if i < len(ranks):
                ranks[i] = rank.get(ids[i] << 32 | ids[i + 1], none)
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, packed."""
        e = Encoder(self)
        return b"".join([*(e.push(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)), e.end()])


class Window:
    """The bytes of one pre-token whose tokens may still change."""

    def __init__(self, of: Transducer):
        self.of, self.held = of, b""

    def push(self, data: bytes) -> list[int]:
        """Takes bytes; gives the tokens that are stable now."""
        of, out, at = self.of, [], 0
        held = self.held + data
        while len(held) - at > of.window:
            end = at + of.window - of.lookahead
            for t in of.merged(held[at : at + of.window]):
                if at + len(of.bytes_of[t]) > end:
                    break
                at += len(of.bytes_of[t])
                out.append(t)
        self.held = held[at:]
        return out

    def border(self) -> list[int]:
        """The pre-token ends: so do its tokens."""
        held, self.held = self.held, b""
        return self.of.merged(held) if held else []


class Steps(dict):
    """pre-token -> what the automaton emits from border to border, packed; bounded in bytes."""

    def __init__(self, of: Transducer, most: int = 32 << 20):
        self.of, self.most, self.size = of, most, 0

    def __missing__(self, piece: str) -> bytes:
        data, w = piece.encode("utf-8", "surrogatepass"), Window(self.of)
        out = packed([*w.push(data), *w.border()])
        self.size += 100 + len(data) + len(out)
        if self.size > self.most:
            self.clear()
            self.size = 100 + len(data) + len(out)
        self[piece] = out
        return out


def packed(ids: Iterable[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.fromiter(ids, "<u4").tobytes()


class Encoder:
    """One text on its way through the automaton."""

    def __init__(self, of: Transducer):
        self.of, self.held, self.kind, self.window = of, "", None, Window(of)

    def push(self, chunk: str, last: bool = False) -> bytes:
        """Takes characters; gives the ids that are stable now, packed."""
        of, s, pos, out = self.of, self.held + chunk, 0, []
        settled = len(s) if last else max(0, len(s) - max(BEHIND, of.most_special - 1))  # no special token that is yet to come begins before this
        while True:
            special = of.specials.search(s, pos) if of.specials else None
            if special and not last and special.start() >= settled:
                special = None  # a longer one may begin there
            pos = self._part(s, pos, special.start() if special else len(s), bool(special) or last, settled, out)
            if not special:
                break
            out.append(packed([of.special[special.group()]]))
            pos = special.end()
        self.held = s[pos:]
        return b"".join(out)

    def end(self) -> bytes:
        return self.push("", True)

    def _part(self, s: str, pos: int, stop: int, closed: bool, settled: int, out: list[bytes]) -> int:
        """Goes on from pos up to stop, which is the end of a part if closed, or as far as borders are settled; gives the place reached."""
        of = self.of
        if self.kind:
            end = of.more[self.kind].match(s, pos, stop).end()
            if self.kind == "space" and end < stop:
                end -= 1  # the last one goes with what follows
            if not closed and end > settled:
                return self._into(s, pos, settled, out)
            out.append(packed([*self.window.push(s[pos:end].encode("utf-8", "surrogatepass")), *self.window.border()]))
            self.kind, pos = None, end
        found = of.pieces.findall(s, pos, stop)
        open_ = None
        if not closed:
            at = stop
            while found and at > settled:
                open_ = found.pop()
                at -= len(open_)
        out.extend(map(of.steps.__getitem__, found))
        pos += sum(map(len, found))
        if open_ is None or pos >= settled or CONTRACTION.fullmatch(open_):  # a contraction never goes on: it waits until its end is settled
            return pos
        end = open_[-1]
        self.kind = "letters" if of.more["letters"].fullmatch(end) else "digits" if of.more["digits"].fullmatch(end) else "space" if end.isspace() and of.more["space"].fullmatch(end) else "others"
        return self._into(s, pos, settled, out)

    def _into(self, s: str, pos: int, settled: int, out: list[bytes]) -> int:
        """Goes on to the last settled place within a pre-token."""
        if settled <= pos:
            return pos
        out.append(packed(self.window.push(s[pos:settled].encode("utf-8", "surrogatepass"))))
        return settled


class TextDecoder:
    """Byte-to-text state machine: push ids, get the text that is complete; bytes that are no UTF-8 give U+FFFD."""

    def __init__(self, of: Transducer):
        self.bytes_of, self.state = of.bytes_of, codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def end(self) -> str:
        return self.state.decode(b"", True)


_LOADED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = Transducer(path)
    return _LOADED[path]


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the text decoded from them, for each row of docs (doc_id, text). One pass, no shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            n, ids_hex, text_hex = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                encoder, decoder, n_ids, of_ids, of_text = Encoder(t), TextDecoder(t), 0, hashlib.sha256(), hashlib.sha256()
                for i in range(0, len(text) + 1, CHUNK):  # as ids come out they go into their digest and on to the decoder
                    ids = encoder.push(text[i : i + CHUNK], i + CHUNK > len(text))
                    n_ids += len(ids) // 4
                    of_ids.update(ids)
                    of_text.update(decoder.push(memoryview(ids).cast("I")).encode("utf-8", "surrogatepass"))
                of_text.update(decoder.end().encode())
                n.append(n_ids)
                ids_hex.append(of_ids.hexdigest())
                text_hex.append(of_text.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return in_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), work, SCHEMA)
