"""Suffix arrays, repeated passages, embeddings, MinHash and the pipeline against brute force."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from provspark.llm import embedding_dedup, minhash_dedup, suffix_dedup
from provspark.llm.common import WordTable, components
from provspark.llm.suffix_array import grouped, suffix_array


@settings(max_examples=400, deadline=None)
@given(t=st.lists(st.integers(1, 3), max_size=60))
def test_suffix_array(t):
    t = [*t, 0]
    assert suffix_array(np.array(t)).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_groups_are_lyndon_prefixes():
    t = [2, 1, 2, 1, 3, 1, 2, 0]
    start, prev = grouped(np.array(t))
    smaller = [max((j for j in range(i) if t[j:] < t[i:]), default=-1) for i in range(len(t))]
    assert prev == smaller
    assert start[1] == start[5] or t[1:] != t[5:]


def brute_repeats(rows):
    n = suffix_dedup.LENGTH
    seen = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for k, (_, b) in enumerate(data):
        for i in range(len(b) - n + 1):
            seen.setdefault(b[i : i + n], []).append((k, i))
    gone = [np.zeros(len(b), bool) for _, b in data]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i : i + n] = True
    out = []
    for (d, b), g in zip(data, gone, strict=True):
        kept = bytes(np.frombuffer(b, np.uint8)[~g]) if b else b""
        out.append((d, len(b), int(g.sum()), int((np.diff(np.concatenate(([0], g.astype(int), [0]))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def passages(seed, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 7)))
    prose = lambda k: " ".join(word() for _ in range(k))
    common = [prose(60) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [prose(rng.randrange(5, 60))]
        for _ in range(rng.randrange(0, 3)):
            c = rng.choice(common)
            cut = rng.randrange(0, 30)
            parts += [c[cut:] if rng.random() < 0.5 else c, prose(rng.randrange(0, 30))]
        rows.append((i, "".join(parts)))
    near = list(rows[0][1])
    for p in range(40, len(near), 230):
        near[p] = "#"
    return [*rows, (900, "".join(near)), (901, rows[1][1]), (902, common[0] + common[0]), (903, "ab" * 400), (904, "a" * 199), (905, "a" * 200)]


@pytest.mark.parametrize("crowd", [1024, 2])
def test_repeats(spark, frame, odd, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rows = passages(crowd) + odd
    assert sorted(map(str, map(tuple, suffix_dedup.removed(frame(rows)).collect()))) == brute_repeats(rows)


def test_repeats_across_stretches(spark, frame, monkeypatch):
    rng = random.Random(9)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(900))
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(100, 900))) + shared + str(i)) for i in range(4)]
    monkeypatch.setattr(suffix_dedup, "STRETCH", 256)
    pieces = [p for _, t in rows for p in suffix_dedup.pieces(t.encode())]
    assert sum(len(p[0]) for p in pieces) > 0
    assert sorted(map(str, map(tuple, suffix_dedup.removed(frame(rows)).collect()))) == brute_repeats(rows)


def test_repeats_empty_and_stage(spark, frame):
    assert suffix_dedup.removed(frame([])).count() == 0
    text = "é" * 150
    out = suffix_dedup.without_repeats(frame([(1, "x" + text), (2, "yy" + text), (3, None)]))
    assert out.columns == frame([]).columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()} == {1: ("x", 1), 2: ("yy", 2), 3: (None, 0)}


def brute_components(n, links):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(400, i) for i in range(401, 450)]
    want = brute_components(450, links)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: want[x] for pair in links for x in pair if any(p[0] != p[1] for p in links if x in p)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("few", [True, False])
def test_components_of_few_edges_do_not_shuffle(spark, monkeypatch, few):
    """A loop over a few edges costs no shuffle a step, and both ways give the same."""
    from provspark.llm import common

    plans, write = [], common.cut
    monkeypatch.setattr(common, "cut", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or write(df, name))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 400 if few else 399)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(200)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: 0 if n <= 200 else 1000 for link in links for n in link}
    steps = [p for name, p in plans if name != "edges"]
    assert len(steps) >= 4 and any("Exchange hashpartitioning" in p for p in steps) != few



def brute_vectors(rows, least=0.9):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for a in range(len(ok)):
        for b in range(a):
            x, y = (np.array(rows[i][1], float) for i in (ok[a], ok[b]))
            if len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= least:
                links.append((ok[a], ok[b]))
    label = brute_components(len(rows), links)
    count = [sum(i in p for p in links) for i in range(len(rows))]
    ids = [r[0] for r in rows]
    least_id = lambda i: min((ids[j] for j in range(len(rows)) if label[j] == label[i] and ids[j] is not None), default=None)
    return sorted(str((ids[i], count[i], least_id(i))) for i in range(len(rows)))


@pytest.mark.parametrize(("d", "tile", "longest"), [(3, 4096, 1024), (40, 16, 1024), (20, 7, 19)])
def test_vectors(spark, monkeypatch, d, tile, longest):
    """Large and small tiles and chunks, and a dimension that no axes are worked out for."""
    for name, value in (("TILE_BYTES", tile * 8 * d), ("LEAST_ROWS", 5), ("CHUNK", 6 if tile < 100 else 512), ("LONGEST", longest)):
        monkeypatch.setattr(embedding_dedup, name, value)
    rng = np.random.default_rng(d)
    base = rng.normal(size=(60, d)).astype(np.float32)
    near = base[:25] + rng.normal(size=(25, d)).astype(np.float32) * 0.3
    rows = [(i, v.tolist()) for i, v in enumerate([*base, *near, *base[:5], *(base[:3] * 2)])]
    rows += [(500, None), (501, []), (502, [0.0] * d), (503, [float("nan")] * d), (504, [None] * d), (505, [float("inf")] + [1.0] * (d - 1)), (506, [1.0, 0.0]), (507, [1.0, 0.0]), (0, base[0].tolist())]
    df = spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows], "vec_id long, embedding array<float>, label int, id string, tile int")
    got = embedding_dedup.near_duplicates(df).collect()
    assert sorted(str((r["vec_id"], r["n_links"], r["component_id"])) for r in got) == brute_vectors(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_boxes_rule_out_what_is_far(spark, monkeypatch):
    """The bound of two boxes is over every cosine between them, and for vectors in clusters it spares most pairs of chunks."""
    rng = np.random.default_rng(2)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    for d in (2, 8, 30):
        for _ in range(30):
            a, b = (unit(rng.normal(size=(9, d)) * 0.2 + rng.normal(size=d)) for _ in range(2))
            assert embedding_dedup.box_bound(*embedding_dedup.box_of(a), *embedding_dedup.box_of(b)) >= (a @ b.T).max() - 1e-12
    monkeypatch.setattr(embedding_dedup, "CHUNK", 20)
    centres = unit(rng.normal(size=(12, 6)))
    x = np.concatenate([unit(c + rng.normal(size=(20, 6)) * 0.05) for c in centres])
    met = []
    bound = embedding_dedup.box_bound
    monkeypatch.setattr(embedding_dedup, "box_bound", lambda *a: met.append(bound(*a)) or met[-1])
    got = {(i, j) for p, q in embedding_dedup.compare(x, x, None, 0.9, True) for i, j in zip(p.tolist(), q.tolist())}
    assert got == {(i, j) for i in range(240) for j in range(i + 1, 240) if x[i] @ x[j] >= 0.9}
    assert np.mean(np.concatenate(met) < 0.9) > 0.5


def test_vectors_empty(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def brute_shingles(rows, k, percent=80):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    label = brute_components(len(rows), links)
    ids = [r[0] for r in rows]
    least = lambda i: min((ids[j] for j in range(len(rows)) if label[j] == label[i] and ids[j] is not None), default=None)
    return sorted(str((ids[i], len(sets[i]), least(i))) for i in range(len(rows)))


@pytest.mark.parametrize("k", [2, 5])
def test_minhash(spark, frame, odd, k):
    rng = random.Random(k)
    rows = [(i, " ".join(rng.choice(["the", "of", "a"] + [f"w{j}" for j in range(80)]) for _ in range(rng.randrange(3, 120)))) for i in range(60)]
    for i in range(60):
        words = rows[rng.randrange(20)][1].split()
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(999)}"
        rows.append((200 + i, " ".join(words)))
    rows += odd
    got = minhash_dedup.near_duplicates(frame(rows), k).collect()
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) == brute_shingles(rows, k)


def test_minhash_dense_group(spark, frame):
    """Many texts, each near some of the others: groups form over handfuls and the last comparison, as brute force has them."""
    rng = random.Random(11)
    base = [f"w{j}" for j in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for p in rng.sample(range(120), rng.randrange(2, 9)):
            words[p] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(words)))
    got = minhash_dedup.near_duplicates(frame(rows), 2).collect()
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) == brute_shingles(rows, 2)


def test_minhash_empty_and_stage(spark, frame, odd):
    assert minhash_dedup.near_duplicates(frame([]), 2).count() == 0
    out = minhash_dedup.one_of_each(frame(odd))
    assert out.columns == frame(odd).columns
    kept = [r["doc_id"] for r in out.collect()]
    assert sorted(kept, key=str) == sorted([1, 2, 3, 4, 5, None, 7, 8, 10], key=str)


def test_minhash_stage_tells_rows_apart(spark):
    """Rows that share a doc_id, or have none, against a plain reading: each group keeps its least row, every other text stays. Helper columns clash with those of docs."""
    rng = np.random.default_rng(17)
    words = [f"w{i}" for i in range(400)]
    text = lambda: " ".join(rng.choice(words, 40))
    x, q, z = text(), text(), text()
    near = " ".join([*x.split()[:-1], "changed"])
    rows = [(3, x), (5, x), (5, text()), (7, q), (7, z), (None, x), (None, q), (None, text()), (None, text()), (9, near), (9, text()), (4, ""), (None, None), (7, z), *[(None, z)] * 20]
    rows = [(i, t, k, -k, "s") for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key long, h long, source string")
    sets = [frozenset(zip(*[(t or "").split()[k:] for k in range(5)])) for _, t, *_ in rows]
    like = lambda a, b: bool(a) and 100 * len(a & b) >= 80 * len(a | b)
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if like(sets[a], sets[b]) and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    want = []
    for g in sorted(set(group)):
        members = [rows[k] for k in range(len(rows)) if group[k] == g]
        want += [min(((m[0] is None, m[0] or 0, m[1]) for m in members), key=lambda m: m[:2])] if sets[g] or len(members) > 1 else [(members[0][0] is None, members[0][0] or 0, members[0][1])]
    got = minhash_dedup.one_of_each(docs)
    assert got.columns == docs.columns
    found = [(r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in got.collect()]
    assert sorted(map(str, found)) == sorted(map(str, want))


def test_set_size_is_exact():
    assert len(minhash_dedup.shingle_set("A b a B c", 2, WordTable())) == 3
    assert len(minhash_dedup.shingle_set("one", 2, WordTable())) == 1 and not len(minhash_dedup.shingle_set(None, 2, WordTable()))


def test_pipeline(spark, oracle):
    """Each stage on what the one before kept, and the run of all of them."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from helpers import DATA

    from provspark.llm import bpe, registry, toxicity
    from provspark.llm.common import cut, documents

    docs = documents(spark, DATA)
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(cut(stage(spark, tables[-1], DATA), name))
    assert all(t.columns == docs.columns for t in tables[:-1])
    raw, clean, single, cut_, mixed, encoded = (t.toPandas() for t in tables)
    model = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet")).scorer()
    assert set(clean["doc_id"]) == {d for d, t in zip(raw["doc_id"], raw["text"], strict=True) if model.score(t) < toxicity.THRESHOLD}
    rows = list(zip(clean["doc_id"], clean["text"], strict=True))
    groups = {eval(s)[0]: eval(s)[2] for s in brute_shingles([(int(d), t) for d, t in rows], 5)}  # noqa: S307
    assert set(single["doc_id"]) == {d for d, g in groups.items() if d == g}
    want = brute_repeats([(int(d), t) for d, t in zip(single["doc_id"], single["text"], strict=True)])
    n_kept = {eval(s)[0]: eval(s)[1] - eval(s)[2] for s in want}  # noqa: S307
    assert all(n_kept[d] - 3 <= len(t.encode()) <= n_kept[d] for d, t in zip(cut_["doc_id"], cut_["text"], strict=True))
    counts = mixed["doc_id"].value_counts()
    assert set(counts.index) <= set(cut_["doc_id"]) and counts.max() <= 3
    t = bpe.transducer(registry.tokenizer_path())
    assert sorted(encoded["n_tokens"]) == sorted(len(t.encode(x)) // 4 for x in mixed["text"])
    assert sorted(map(str, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(str, tables[-1].collect()))
