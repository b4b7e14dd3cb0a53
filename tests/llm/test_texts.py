"""Licenses, SpotSigs, toxicity, mixing and WARC derivatives."""

import hashlib
import re
import zlib
from html.parser import HTMLParser
from itertools import combinations

import numpy as np
import pytest

from provspark.llm import licenses, mixing, notices, spotsigs, toxicity, warc


def test_license_rows(spark, frame, odd):
    opening = notices.OPENINGS["mit-notice"].split()
    notice = " ".join(opening[:6] + ["really"] + opening[6:])
    df = frame([*odd, (20, "CC-BY, cc by! All Rights Reserved"), (21, "x " * 500 + notice), (22, "general public"), (23, "GENERAL Public license general public LICENSE")])
    got = {}
    for r in licenses.scan(df).collect():
        got.setdefault(r["doc_id"], []).append(r)
    rows = {k: v[0] for k, v in got.items()}
    assert len(got[8]) == 2 and sum(map(len, got.values())) == len(odd) + 4
    assert rows[1]["n_words"] == rows[2]["n_words"] == rows[3]["n_words"] == 0 and rows[1]["score"] == 0 and rows[1]["labels"] == ""
    assert (rows[20]["n_base"], rows[20]["first_word"], rows[20]["last_word"], rows[20]["base_labels"], rows[20]["score"]) == (3, 0, 4, "cc-by,reserved", 1.0)
    assert rows[21]["base_labels"] == "" and rows[21]["labels"] == "mit-notice" and rows[21]["score"] >= licenses.COVER
    assert rows[22]["n_base"] == 0 and rows[22]["first_word"] is None
    assert (rows[23]["n_base"], rows[23]["last_word"]) == (2, 3)
    assert licenses.scan(frame([])).count() == 0


def test_license_texts(spark, frame):
    """Whole texts, with every twentieth word left out, are known by their labels; only A-Z are lower-cased."""
    rows, want = [], {}
    for i, (label, said) in enumerate(notices.TEXTS.items()):
        words = said.split()
        rows += [(2 * i, "Before it. " + said), (2 * i + 1, " ".join(w for k, w in enumerate(words) if k % 20 != 19))]
        want |= {2 * i: label, 2 * i + 1: label}
    got = {r["doc_id"]: r for r in licenses.scan(frame([*rows, (90, "\u212aelvin A\u0130B"), (91, "\u0130general public license")])).collect()}
    assert all(want[i] in got[i]["labels"].split(",") for i in want)
    assert all(got[2 * i]["score"] == 1.0 for i in range(len(notices.TEXTS)))
    assert got[90]["labels"] == "" and got[90]["n_words"] == 2 and got[91]["n_base"] == 0


def test_license_base_by_reading(spark, frame):
    """n_base, first_word, last_word and base_labels against phrases looked up word by word."""
    rng = np.random.default_rng(12)
    pool = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "x", "CC", "By", "licens\u00e9"]
    docs = [(i, rng.choice([" ", "-", ", "]).join(rng.choice(pool, rng.integers(0, 60)))) for i in range(150)]
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.scan(frame(docs)).collect()}
    for i, text in docs:
        words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text)) if w]
        hits = [(k, label) for phrase, label in licenses.PHRASES.items() for p in [phrase.split()] for k in range(len(words)) if words[k : k + len(p)] == p]
        at = [k for k, _ in hits]
        assert got[i] == (len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits})))


def brute_edits(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    s = spotsigs.Spots()
    out = []
    for k, (doc_id, text) in enumerate(order):
        text, nxt = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 4
        e = text[: len(text) - n] + nxt[:n] if n else text
        a, b, c = (s.signatures(x) for x in (text, e, nxt))
        j = lambda x, y: 1.0 if not len(x) and not len(y) else len(set(x) & set(y)) / len(set(x) | set(y))
        out.append((doc_id, len(text), hashlib.sha256(e.encode()).hexdigest(), spotsigs.printed(a), spotsigs.printed(b), round(j(a, b), 9), round(j(a, c), 9)))
    return sorted(map(str, out))


def test_spotsigs_rows(spark, frame, odd):
    for rows in (odd, [(5, "only one document here and the end")]):
        got = [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in spotsigs.with_edits(frame(rows)).collect()]
        assert sorted(map(str, got)) == brute_edits(rows)
    assert spotsigs.with_edits(frame([])).count() == 0


def test_spotsigs_pairs(spark, frame):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(60)] + ["the", "a", "of", "and", "is"] * 6
    rows = [(i, " ".join(rng.choice(words, 80))) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " the very last words") for i in range(15)]
    s = spotsigs.Spots()
    sets = {i: set(s.signatures(t).tolist()) for i, t in rows}
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and sets[a] != sets[b]}
    got = {(r["a"], r["b"]) for r in spotsigs.near_pairs(spotsigs.fingerprints(frame(rows)), 0.8).collect()}
    assert got == want and want


def toxic_rows(n=600):
    rng = np.random.default_rng(3)
    words, bad = [f"w{i}" for i in range(200)], ["awful", "vile", "scum"]
    docs, labels = [], []
    for i in range(n):
        t = list(rng.choice(words, 30))
        toxic = i % 5 == 0
        if toxic:
            t[rng.integers(30)], t[rng.integers(30)] = rng.choice(bad), rng.choice(bad)
        docs.append((i, " ".join(t)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_held_out(spark, frame):
    docs, labels = toxic_rows()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    m = toxicity.fit(frame(docs), lab)
    got = {r["doc_id"]: r for r in toxicity.score(frame(docs), m).collect()}
    held = [i for i in got if got[i]["held_out"]]
    assert set(held) == {i for i, *_ in labels if zlib.crc32(str(i).encode()) % 3 == 1}
    right = [got[i]["predicted"] == labels[i][2] for i in held]
    assert np.mean(right) > 0.95
    flipped = spark.createDataFrame([(i, q, 1 - t if got[i]["held_out"] else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    again = {r["doc_id"]: r["score"] for r in toxicity.score(frame(docs), toxicity.fit(frame(docs), flipped)).collect()}
    assert again == {i: r["score"] for i, r in got.items()}  # held-out labels change nothing
    kept = toxicity.keep_clean(frame(docs), m)
    assert kept.columns == frame(docs).columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}


def test_toxicity_odd(spark, frame, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    m = toxicity.fit(frame(odd), none)
    got = toxicity.score(frame(odd), m).collect()
    assert len(got) == len(odd) and all(r["score"] < 1e-9 and r["predicted"] == 0 for r in got)
    assert toxicity.score(frame([]), m).count() == 0


def test_pu_risk_is_corrected():
    """Unlabelled rows hold positives too; the scorer still tells the two apart."""
    rng = np.random.default_rng(0)
    row = lambda toxic: np.unique(np.append(rng.integers(1, 50, 10), [0] if toxic else []).astype(np.int64))
    pos, unl = [row(True) for _ in range(200)], [row(i % 5 == 0) for i in range(1000)]
    w, b = toxicity.non_negative_pu(toxicity.in_rows(pos), toxicity.in_rows(unl), 0.2, 50)
    z = lambda r: w[r].sum() + b
    assert np.mean([z(r) > 0 for r in pos]) > 0.95 and np.mean([z(row(False)) < 0 for _ in range(200)]) > 0.95


def test_pu_risk_and_gradient():
    """The risk by its definition, row by row, and the gradient against differences, on both sides of the clamp."""
    rng, prior = np.random.default_rng(4), 0.3
    sides = set()
    for trial in range(12):
        pos, unl = ([np.unique(rng.integers(0, 9, 5)) for _ in range(n)] for n in (7, 11))
        w, b = rng.normal(size=9) * (1 if trial % 2 else 4), float(rng.normal()) - (6 if trial % 3 == 0 else 0)
        z = lambda r: w[r].sum() + b
        softplus = lambda x: np.log1p(np.exp(-abs(x))) + max(x, 0)
        negative = np.mean([softplus(z(r)) for r in unl]) - prior * np.mean([softplus(z(r)) for r in pos])
        sides.add(negative >= 0)
        p, u = toxicity.in_rows(pos), toxicity.in_rows(unl)
        risk, g, g_b = toxicity.pu_risk(p, u, w, b, prior)
        assert risk == pytest.approx(prior * np.mean([softplus(-z(r)) for r in pos]) + max(0, negative))
        for k in range(10):
            step = np.eye(10)[k] * 1e-6
            up, down = (toxicity.pu_risk(p, u, w + s * step[:9], b + s * step[9], prior)[0] for s in (1, -1))
            assert (up - down) / 2e-6 == pytest.approx(g[k] if k < 9 else g_b, abs=1e-5)
    assert sides == {True, False}


def test_scores_by_hand_and_repeated_ids(spark, frame):
    docs, labels = toxic_rows()
    lab = spark.createDataFrame(labels + [(labels[0][0], 1, 1 - labels[0][2]), (labels[1][0], 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    d = frame(docs + [(docs[0][0], "another text of the same id"), (docs[2][0], docs[2][1]), (None, docs[3][1]), (5, None)])
    m = toxicity.fit(d, lab)
    weight = dict(zip(m.slots.tolist(), m.weights.tolist()))
    for r in d.join(toxicity.score(d, m).filter("doc_id is not null").select("doc_id", "score").distinct(), "doc_id").groupBy("doc_id").agg({"text": "collect_list", "score": "collect_set"}).collect():
        want = set()
        for text in r["collect_list(text)"] or [""]:
            words = {w.encode() for w in "".join(c.lower() if c.isascii() and c.isalnum() else c if ord(c) > 127 else " " for c in text).split()}
            begun = {b"^" + w[:n] for w in words for n in (4, 5, 6, 7, 8) if len(w) > n}
            z = (m.offset + sum(weight.get(toxicity.slot(w, m.bits), 0) for w in words | begun)) * 1e-6
            want.add(round(1 / (1 + np.exp(-(m.slope * z + m.shift))), 9))
        assert want <= {round(x, 9) for x in r["collect_set(score)"]}
    assert toxicity.score(d, m).count() == d.count()
    assert str(toxicity.fit(d, lab)) == str(m)  # a second fit is the same


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, capped = {s: 0.0 for s in names}, set()
    left = float(sum(sizes.values()))
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            return target
        total = sum(weight[s] for s in free)
        target |= {s: left * weight[s] / total for s in free}
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = 3.0 * sizes[s]
            capped.add(s)
            left -= 3 * sizes[s]


def test_mixing_rows(spark, frame):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(0, 60)), f"s{i % 2 if i % 3 else 9}") for i in range(300)] + [(400, "a b c", None), (401, None, "zz"), (402, "x y", "tiny"), (402, "x y", "tiny"), (None, "p q", "s0")]
    got = mixing.mix(frame(rows)).collect()
    sizes, taken, cap = {}, {}, {}
    for (i, t, s) in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    by_target = {}
    for r in got:
        by_target.setdefault(round(r["target"], 6), []).append(r)
        assert r["taken"] <= 3 * r["size"]
    assert len(got) == len(rows)
    assert sorted({round(v, 6) for v in want.values()}) == sorted(by_target)
    for s, t in want.items():
        share = [r for r in by_target[round(t, 6)] if r["source_size"] == sizes[s]]
        same = sum(1 for x in want if round(want[x], 6) == round(t, 6) and sizes[x] == sizes[s])
        assert abs(sum(r["taken"] for r in share) - same * t) <= same
    assert [r["position"] for r in got if r["position"] is not None] == sorted(r["position"] for r in got if r["position"] is not None)
    assert sorted(map(str, mixing.mix(frame(rows)).collect())) == sorted(map(str, got))  # reruns agree
    assert mixing.mix(frame([])).count() == 0


def test_mixing_copies(spark, frame):
    rows = [(i, "w " * 20, "big") for i in range(200)] + [(1000 + i, "v " * 10, "rare") for i in range(5)] + [(1000, "v " * 10, "rare")]
    out = mixing.mixed(frame(rows))
    assert out.columns == frame(rows).columns
    n = {}
    for r in out.collect():
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + 1
    assert n[1001] == 3 and n[1000] == 6 and all(n.get(i, 0) <= 3 for i in range(200))


def test_schedule_inverse(spark):
    knots = ((0.0, 2.0), (0.25, 0.0), (0.5, 1.0), (1.0, 1.0))
    rows = spark.range(0, 101).selectExpr("id / 100 as s").select("s", mixing.time_of(mixing.F.col("s"), knots).alias("t")).collect()
    t = [r["t"] for r in rows]
    assert t == sorted(t) and t[0] == 0 and abs(t[-1] - 1) < 1e-9

    def integral(x):
        total = 0.0
        for (a, g), (b, h) in zip(knots, knots[1:]):
            if x > a:
                y = min(x, b)
                total += (g + g + (h - g) * (y - a) / (b - a)) / 2 * (y - a)
        return total

    for r in rows:
        assert abs(integral(r["t"]) / integral(1.0) - r["s"]) < 1e-9


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.skip, self.head, self.title = [], 0, False, False

    def handle_starttag(self, tag, attrs):
        if tag in warc.BLOCKS:
            self.out.append("\n")
        self.skip += tag in ("script", "style")
        self.head = True if tag == "head" else False if tag == "body" else self.head
        self.title = tag == "title" or self.title

    def handle_endtag(self, tag):
        if tag in warc.BLOCKS:
            self.out.append("\n")
        self.skip -= tag in ("script", "style")
        self.head = False if tag == "head" else self.head
        self.title = False if tag == "title" else self.title

    def handle_data(self, data):
        if not self.skip and (not self.head or self.title):
            self.out.append(data.replace("\n", " "))


PAGE = "<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style><meta name=k content='v'></head><body><!-- x <p> --><p>One\n two<br>three</p><script>var a='</p>';</script><a href='/q?x=1'>go</a> 1 < 2</body></html>"


def test_warc_page():
    text, title, links, metas = warc.read_page(PAGE, "http://h.example/d/")
    p = Plain()
    p.feed(PAGE)
    p.close()
    assert text == "\n".join(x for x in (" ".join(line.split()) for line in "".join(p.out).split("\n")) if x)
    assert (title, links, metas) == ("A & B", [("a@href", "http://h.example/q?x=1")], [("k", "v")])
    assert warc.read_page("<!-- open")[0] == warc.read_page("<script>x")[0] == warc.read_page("")[0] == ""


def test_warc_round_trip(spark):
    rows = [(1, "http://a.example/", PAGE), (2, None, None), (3, "http://b.example/", ""), (3, "http://b.example/", ""), (None, "x", "<p>é</p>")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, block string")
    source = warc.responses(pages)
    back = [next(warc.read_records(r["member"])) for r in warc.packed(source.unionByName(warc.derive(source))).collect()]
    by_id = {r["fields"]["WARC-Record-ID"]: r for r in back}
    derived = [r for r in back if r["fields"]["WARC-Type"] != "response"]
    assert len(back) == 15 and len(derived) == 10
    for r in derived:
        origin = by_id[r["fields"]["WARC-Refers-To"]]
        assert origin["fields"]["WARC-Payload-Digest"] == r["fields"]["WARC-Source-Payload-Digest"]
        assert origin["fields"]["WARC-Block-Digest"] == r["fields"]["WARC-Source-Block-Digest"] == warc.digest(origin["block"])
        assert warc.digest(r["block"]) == r["fields"]["WARC-Block-Digest"]
    assert warc.derivative_rows(pages.limit(0)).count() == 0
    assert warc.derivative_rows(pages).filter("warc_type = 'conversion' and page_id = 1").first()["block"].startswith("A & B\nOne two\nthree")


@pytest.mark.parametrize("a", [np.array([1, 2, 3]), np.array([1]), np.array([], int)])
def test_pruned_likeness(a):
    for b in (np.array([1, 2, 3, 4]), np.array([9]), np.array([], int)):
        j = spotsigs.likeness(a, b)
        for least in (0.3, 0.75, 0.9):
            assert spotsigs.reaches(a, b, least) == (j if j >= least else None)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 17])
def test_place_among(spark, n):
    from provspark.llm.common import place_among

    cuts = sorted({(7 * i) % 40 for i in range(n)})
    rows = spark.range(-2, 45).select("id", place_among(mixing.F.col("id"), cuts).alias("p")).collect()
    assert [r["p"] for r in rows] == np.searchsorted(cuts, [r["id"] for r in rows], side="right").tolist()


def test_fitting_brings_a_row_for_each_id_alone(spark, frame, monkeypatch):
    """An id that docs repeat thousands of times with other texts is one row for the driver, and the fit is the same however rows lie."""
    from provspark.llm import toxicity

    rows = [(1, f"bad words number {i}") for i in range(3000)] + [(i, f"good text {i} of some kind") for i in range(2, 60)] + [(i, f"bad words again {i}") for i in range(60, 90)]
    lab = spark.createDataFrame([(i, 1, int(i == 1 or i >= 60)) for i in range(1, 90)], "doc_id long, quality int, toxic int")
    brought = []
    in_rows = toxicity.in_rows
    monkeypatch.setattr(toxicity, "in_rows", lambda slots: brought.append(len(slots)) or in_rows(slots))
    one = toxicity.fit(frame(rows), lab)
    assert max(brought) < 90
    assert str(one) == str(toxicity.fit(frame(rows).repartition(7), lab))


def test_mixing_merges_rows_equal_in_every_column_only(spark, frame):
    """Copies of one row stay as many, rows that differ in a column beside the text stay apart, and a rerun gives the same order."""
    from pyspark.sql import functions as F

    from provspark.llm import mixing

    same = [(None, "alpha beta gamma", "s")] * 40
    docs = frame([*same, (1, "delta epsilon", "s"), (2, "zeta", "t"), (3, None, "t")])
    docs = docs.withColumn("lang", F.when(F.col("doc_id") == 1, F.lit("fr")).otherwise(F.col("lang"))).unionByName(docs.filter("doc_id = 1"))
    out = [tuple(r) for r in mixing.mixed(docs).collect()]
    assert out == [tuple(r) for r in mixing.mixed(docs.repartition(5)).collect()]
    n = {k: sum(r[1] == k for r in out) for k in ("alpha beta gamma", "delta epsilon", "zeta")}
    assert n["alpha beta gamma"] >= 1 and n["zeta"] >= 1
    assert {r[2] for r in out if r[1] == "delta epsilon"} <= {"fr", "en"} and len(out[0]) == len(docs.columns)
