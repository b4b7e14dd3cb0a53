"""Texts and pairs that were left out."""

import random
import re
import time
import numpy as np
import pytest

from provspark.llm import minhash_dedup, spotsigs, warc


@pytest.mark.parametrize(("least", "over", "under"), [(0.8, 4, 5), (0.55, 11, 20), (0.3, 3, 10)])
def test_reaches_at_exactly_the_bound(least, over, under):
    for k in range(1, 80):
        a, b = np.arange(over * k), np.arange(under * k)
        assert spotsigs.reaches(a, b, least) == spotsigs.reaches(b, a, least) == spotsigs.likeness(a, b), k
        assert spotsigs.reaches(a[1:], b, least) is None


@pytest.mark.parametrize(("least", "over", "under"), [(0.8, 4, 5), (0.55, 11, 20)])
def test_near_pairs_at_exactly_the_bound(spark, least, over, under):
    sizes = [3, 5, 6, 7, 9, 10]
    rows = [(2 * k + big, [1000 * k + x for x in range((under if big else over) * k)]) for k in sizes for big in (0, 1)]
    prints = spark.createDataFrame([(i, len(s), s) for i, s in rows], "doc_id long, n_sigs long, sigs array<long>")
    assert sorted((r["a"], r["b"]) for r in spotsigs.near_pairs(prints, least).collect()) == [(2 * k, 2 * k + 1) for k in sizes]


def test_one_of_each_tells_rows_of_one_id_apart(spark, frame):
    """Rows with one doc_id and different texts, near copies among them, and rows without a doc_id."""
    words = [f"w{i}" for i in range(60)]
    a, near, b, c = " ".join(words), " ".join([*words[:-1], "x"]), "quite another text than the first one", "a third text that nobody else has"
    rows = [(1, a), (5, near), (5, b), (5, b), (6, c), (6, c + " or so it says here at least"), (7, b), (None, a), (None, "free standing text of seven words here"), (None, "free standing text of seven words here"), (8, ""), (8, " "), (8, "")]
    got = sorted(((r["doc_id"], r["text"]) for r in minhash_dedup.one_of_each(frame(rows)).collect()), key=str)
    assert got == sorted([(1, a), (5, b), (6, c), (6, c + " or so it says here at least"), (None, "free standing text of seven words here"), (8, ""), (8, " ")], key=str)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<head><title>T</title><p>all of it<p>and more", "T\nall of it\nand more"),
        ("<html><head><title>T</title><meta name=k content=v>bare text<p>more", "T\nbare text\nmore"),
        ("<head><title>T</title><style>p{}</style><script>x</script><link href=x></head><body><p>body</p>", "T\nbody"),
        ("<head>1 < 2", "1 < 2"),
        ("<p>a</p><noscript>no script</noscript><p>b", "a\nno script\nb"),
        ("<noscript>open <p>b", "open\nb"),
        ("<p>a <textarea>x <b>y</b> &amp; z</TEXTAREA> c", "a x <b>y</b> & z c"),
        ("<textarea>open", "open"),
        ("<title>T</title><p>a <svg><title>drawn</title><style>s</style><text>label</text></svg> b", "T\na\ndrawn\nlabel b"),
        ("<svg>open <p>b", "open\nb"),
        ("<p>a<script>x</script><style>y</style><template>z</template><!-- c -->", "a"),
    ],
)
def test_page_text_is_whole(page, text):
    assert warc.read_page(page)[0] == text


def test_title_of_a_drawing_is_not_the_page_title():
    assert warc.read_page("<head><title>T</title></head><svg><title>drawn</title></svg>")[1] == "T"


def test_tags_end_where_quotes_allow():
    """Ends of tags in random scraps of markup, against a pattern that says the same."""
    tag = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
    rng = random.Random(6)
    for _ in range(3000):
        page = "".join(rng.choice(["<", "<a", "</p", ">", '"', "'", " ", "=", "x", "/", "\n", "é", "<img src="]) for _ in range(rng.randrange(25)))
        tags = warc.Tags(page)
        for lt in (i for i, c in enumerate(page) if c == "<"):
            m, got = tag.match(page, lt), tags.at(lt)
            assert got == (m and (bool(m[1]), m[2].lower(), m.end(2), m.end() - 1)), (page, lt)


@pytest.mark.parametrize("scrap", ["<a ", "<a '", '<a "x', "<a<", "<a' >", "<!--", "<script>", "<textarea>", "<a b='", "</", "<a b c=d ", "&amp"])
def test_broken_pages_take_time_by_their_length(scrap):
    began = time.perf_counter()
    warc.read_page(scrap * (600_000 // len(scrap)) + " >")
    assert time.perf_counter() - began < 8
