import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from provspark.llm import bpe, registry

PATH = registry.tokenizer_path()


@pytest.fixture(scope="module")
def ours():
    return bpe.Transducer(PATH)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids(t, text):
    return list(memoryview(t.encode(text)).cast("I"))


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=80))
def test_like_the_library(ours, library, text):
    assert ids(ours, text) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", " ", "  a  b\n\n c ", "don't we'll", "<|endoftext|>x<|endoftext|>", "a" * 5000, "ab" * 3000, "é" * 2000, "!" * 3000, " \t" * 900, "12345 6789", "日本語のテキスト" * 200])
def test_cases(ours, library, text):
    found = ids(ours, text)
    assert found == library.encode(text, add_special_tokens=False).ids
    d = bpe.TextDecoder(ours)
    assert "".join([*(d.push([i]) for i in found), d.end()]) == library.decode(found, skip_special_tokens=False) == text


def chunked(t, text, sizes, rng):
    """Ids of a text pushed in chunks of random sizes, and the most that was held between them."""
    e, out, most, i = bpe.Encoder(t), [], 0, 0
    while i < len(text):
        k = rng.choice(sizes)
        out.append(e.push(text[i : i + k]))
        most = max(most, len(e.held.encode()) + len(e.window.held))
        i += k
    out.append(e.end())
    return list(memoryview(b"".join(out)).cast("I")), most


LONG = ["a" * 60_000, " " * 40_000 + "x", "'" * 9000 + "re", "\n \t" * 9000 + "\n", "ab1" * 9000, "é!" * 9000, "<|endoftext" * 3000 + "|>", "don't 'll 've''re " * 900, " <|endoftext|> " * 900, "日本" * 9000]


@pytest.mark.parametrize("text", LONG)
def test_any_chunks_in_constant_memory(ours, library, text):
    rng = random.Random(8)
    want = library.encode(text, add_special_tokens=False).ids
    for sizes in ([1], [1, 2, 3, 17], [5000]):
        got, most = chunked(ours, text[:3000] if sizes == [1] else text, sizes, rng)
        assert got == (library.encode(text[:3000], add_special_tokens=False).ids if sizes == [1] else want)
        assert most <= ours.window + 4 * (ours.most_special + bpe.BEHIND)


@settings(max_examples=200, deadline=None)
@given(parts=st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "\t ", "'", "'re", "'l", "l", "1", "<|endoftext|>", "<|endo", "|>", "é", "!?", "don't"]), max_size=30), seed=st.integers(0, 99))
def test_borders_in_any_chunks(ours, library, parts, seed):
    text = "".join(parts)
    assert chunked(ours, text, [1, 2, 3, 5], random.Random(seed))[0] == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("said", ["'re", "'s", "'ll", "'t", "'re'", "'rex", " 're", "''re", "a're"])
def test_contractions_at_every_border(ours, library, said):
    """A contraction that lies across the place up to which borders are settled, at any chunk size, and at the chunks that texts come in."""
    for n in range(16):
        text = "x " * n + said + "don'tdon't and more of it"
        want = library.encode(text, add_special_tokens=False).ids
        for size in range(1, 16):
            assert chunked(ours, text, [size], random.Random(0))[0] == want, (text, size)
    for n in range(-30, 4):
        text = "y" * (bpe.CHUNK + n) + said + "don't so on and on and on"
        assert ids(ours, text) == library.encode(text, add_special_tokens=False).ids, n


def test_all_bytes_go_through_the_window(ours, monkeypatch):
    """Without the table of steps, each byte of a text is pushed into a window once."""
    seen = []
    push = bpe.Window.push
    monkeypatch.setattr(bpe.Window, "push", lambda self, data: seen.append(len(data)) or push(self, data))
    text = "the quick brown fox, it's 12 o'clock\n\n  " * 500 + "a" * 20_000
    monkeypatch.setattr(bpe.Steps, "__setitem__", lambda *a: None)
    monkeypatch.setattr(ours, "steps", bpe.Steps(ours))
    ours.encode(text)
    assert sum(seen) == len(text.encode())


class Small:
    """A made-up merge list over a few letters, in the shape that Window needs."""

    def __init__(self, rng, letters, n):
        self.bytes_of, self.first = [bytes([97 + i]) for i in range(letters)], {97 + i: i for i in range(letters)}
        self.merges = []
        while len(self.merges) < n:
            x, y = rng.randrange(len(self.bytes_of)), rng.randrange(len(self.bytes_of))
            whole = self.bytes_of[x] + self.bytes_of[y]
            if len(whole) <= 5 and whole not in self.bytes_of:
                self.merges.append((x, y, len(self.bytes_of)))
                self.bytes_of.append(whole)
        self.rank = {x << 32 | y: r << 32 | z for r, (x, y, z) in enumerate(self.merges)}
        self.lookahead = bpe.sufficient_lookahead(self.merges, [len(b) for b in self.bytes_of])
        self.window = self.lookahead + 1

    merged = bpe.Transducer.merged


def needed(of, longest):
    """The least lookahead that is right for every text up to a length, by trying all: how far before the end a token of a beginning can still be wrong."""
    most = 0
    texts = [b""]
    for _ in range(longest):
        texts = [t + bytes([c]) for t in texts for c in of.first]
    ends = {t: [] for t in texts}
    for t in texts:
        at, whole = 0, set()
        for x in of.merged(t):
            whole.add((at, at + len(of.bytes_of[x]), x))
            at += len(of.bytes_of[x])
        ends[t] = whole
    for t in texts:
        for n in range(1, longest):
            at = 0
            for x in of.merged(t[:n]):
                span = (at, at + len(of.bytes_of[x]), x)
                if span not in ends[t]:
                    most = max(most, n - span[1] + 1)
                    break
                at = span[1]
    return most


def test_lookahead_suffices_and_is_needed():
    """Over all texts of small merge lists: streaming gives what whole texts give, and the bound is never under what trying all shows to be needed."""
    rng, tight, positive = random.Random(21), 0, 0
    for _ in range(60):
        of = Small(rng, rng.choice([2, 3]), rng.randrange(1, 7))
        least = needed(of, 9 if len(of.first) == 2 else 6)
        assert least <= of.lookahead
        tight += least == of.lookahead
        positive += least > 0
        for _ in range(40):
            data = bytes(97 + rng.randrange(len(of.first)) for _ in range(60))
            w, got = bpe.Window(of), []
            of.window = of.lookahead + max(map(len, of.bytes_of))  # the least with which every step emits
            for i in range(0, 60, 7):
                got += w.push(data[i : i + 7])
            assert got + w.border() == of.merged(data)
    assert positive > 40 and tight > 10
    assert bpe.sufficient_lookahead([], [1]) == 0


def test_decoder_holds_half_characters(ours):
    d = bpe.TextDecoder(ours)
    first, second = ours.first["é".encode()[0]], ours.first["é".encode()[1]]
    assert (d.push([first]), d.push([second]), d.end()) == ("", "é", "")
    assert d.push([first]) + d.end() == "�"


def test_rows(spark, frame, odd, library):
    got = bpe.encode_documents(frame(odd), PATH).collect()
    want = []
    for doc_id, text in odd:
        i = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(i), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in i)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe.encode_documents(frame([]), PATH).count() == 0
