"""Prose rules: plain functions and column expressions agree, and the cases that shaped them hold."""

import random

import plain_records
import pytest
from pyspark.sql import functions as F

from provspark.functions import text
from provspark.operators import records

SENTENCES = [
    "Use Parquet because it is columnar and keeps its schema", "refactor parser", "use ring:queue instead of linked-queue (#417)", "we merge rows instead of asking",
    "Prefer a pool rather than threads in order to save memory.", "because of that", "", "  spaced   out  so that   it works ", "Switched to X to fix Y, due to Z.",
]


def test_parts_agree(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(SENTENCES)], "i int, s string")
    p = text.decision_parts(F.col("s"))
    for r in rows.select("s", p["content"].alias("c"), p["reason"].alias("r"), p["alternatives"].alias("a"), text.looks_like_decision(F.col("s")).alias("d")).collect():
        assert (r["c"], r["r"], r["a"]) == text.parts_of_sentence(r["s"]), r["s"]
        assert r["d"] == text.says_decision(r["s"])


def test_texts_without_a_keyword_have_no_marker():
    assert all(any(k in m for k in text.KEYWORDS_LEAST) for m in (*text.KEYWORDS, *text.REASON_MARKERS, *text.ALTERNATIVE_MARKERS))


def test_sentences_end_where_the_plain_pattern_ends_them(spark):
    r = random.Random(3)
    said = ["".join(r.choice([*text.WHITE, "\n", *".!?-*+", "a", "é", "  "]) for _ in range(r.randint(0, 12))) for _ in range(4000)]
    t = spark.createDataFrame([(s,) for s in said], "s string")
    parts = F.transform(F.split("s", r"(?<=[.!?])\s+|\n+"), lambda p: F.trim(F.regexp_replace(p, r"^\s*[-*+]\s+", "")))
    plain = F.filter(parts, lambda p: p != "")
    assert t.filter(text.sentences(F.col("s")) != plain).count() == 0
    assert t.filter(F.transform(F.array("s"), text.collapsed_value)[0] != text.collapsed(F.col("s"))).count() == 0


def test_split_reason():
    assert text.parts_of_sentence(SENTENCES[0])[:2] == ("Use Parquet", "because it is columnar and keeps its schema")
    assert text.parts_of_sentence("use merges instead of asking")[2] == []  # no end of a sentence


@pytest.mark.parametrize(("subject", "tier", "category", "confidence"), [
    ("chore: sort imports", "event", "design", 0.5), ("refactor: use ring:queue instead of linked-queue (#417)", "decision", "design", 0.6),
    ("bump lz4 from 1.8.0 to 1.8.1", "event", "dependency", 0.5), ("build(deps): bump lz4 from 1 to 2 to fix CVE-2031-00417", "decision", "dependency", 0.65),
])
def test_commit_subjects(subject, tier, category, confidence):
    (r,) = plain_records.of_commit(subject, "commit abc")
    assert (r["tier"], r["category"], r["confidence"]) == (tier, category, confidence)


def test_subject_content_and_alternative():
    (r,) = plain_records.of_commit("refactor: use ring:queue instead of linked-queue (#417)", "commit abc")
    assert (r["content"], r["alternatives"]) == ("Use ring:queue", ["linked-queue (#417)"])


def test_commit_body():
    found = plain_records.of_commit("y\n\n- keep turns because readers starve\n- comma", "commit abc")
    assert [(r["confidence"], r["tier"]) for r in found] == [(0.5, "event"), (0.7, "decision")]


def test_unwrap():
    said = "Rows stay because they\nare few.\n\n- first\n  part\n- second"
    assert plain_records.unwrap(said) == "Rows stay because they are few.\n\n- first part\n\n- second"


@pytest.mark.parametrize(("raw", "clean"), [("save a pass (e.g.", "save a pass"), ("take a lease and the", "take a lease"), ("hold (any) row", "hold (any) row"), ("", ""), (None, "")])
def test_clean_clause(raw, clean):
    assert plain_records.clean_clause(raw) == clean


@pytest.mark.parametrize(("raw", "content"), [("Changed: take leases", "Take leases"), ("Version 7.1: take leases", "Version 7.1: take leases"), ("plan.sql goes", "plan.sql goes"), ("✨ Improvements: merge y", "Merge y"), ("--rows is new", "--rows is new")])
def test_polish(raw, content):
    assert plain_records.polish(raw) == content


@pytest.mark.parametrize(("said", "usable"), [("now sort the keys", False), ("Refresh", False), ("use parquet", True), ("same row", False), ("Fix GC", True), (None, False)])
def test_usable(said, usable):
    assert plain_records.is_usable(said) is usable


def test_fingerprint():
    assert text.fingerprint(" Keep  PARQUET ") == text.fingerprint("keep parquet")
    assert len(text.fingerprint(None)) == 8


def test_adr():
    (r,) = records.of_adr("# ADR 1\n\n## Status\nAccepted (supersedes 0)\n\n## Decision\nUse x. More.\n\n## Options\n- a\n- b\n", "ADR 1", "docs/adr/1.md")
    assert (r["status"], r["content"], r["alternatives"]) == ("superseded", "Use x.", ["a", "b"])
    assert records.of_adr("", "ADR", "p") == []


def test_changelog():
    said = "Version 3.0\n-----------\n\n-   Keep ``lease`` because it\n    is shorter.\n-   short\n\n## 2.0\n* drop y to avoid z\n"
    assert records.changelog_items(said) == [("Version 3.0", "Keep ``lease`` because it is shorter."), ("2.0", "drop y to avoid z")]
    assert records.changelog_items("* use a pool now\nloose\n  and rest\n\n  not this\n") == [("Changelog", "use a pool now and rest")]
    assert records.changelog_items("* above the heading\n\n# 1.0\n+ kept because of it\n") == [("1.0", "kept because of it")]
    assert [r["tier"] for r in plain_records.of_changelog(said, "CHANGES.rst")] == ["decision", "decision"]


def test_refs(spark):
    rows = spark.createDataFrame([("governs: src/a.py, src/b/\n<!-- governs: lib/c.py -->\nSee `x/y.go`, ``redirect`` and `app.route`.", "commit abcdef1 x")], "t string, r string")
    t = F.col("t")
    r = rows.select(text.governed_paths(t).alias("g"), text.backtick_paths(t).alias("p"), text.backtick_names(t).alias("n"), text.sha_of(F.col("r")).alias("s")).first()
    assert r["g"] == ["src/a.py", "src/b/", "lib/c.py"]
    assert r["p"] == ["x/y.go"]
    assert "redirect" in r["n"] and "app.route" in r["n"]
    assert r["s"] == "abcdef1"


def test_columns_say_what_the_functions_say(spark):
    """Clauses of random scraps, by column expressions and by plain functions, and brackets by a reading of their own."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(9)
    scraps = ["(", ")", "use", "Use", "pool", "e.g.", "and", "to", ",", ";", "Fixed:", "Bug Fixes:", "Now,", "also", "v1_2", "x.py", "é", "the", "(a", "b)", "  ", "Breaking  changes :", "an", "drop", "."]
    rows = [(i, " ".join(rng.choice(scraps) for _ in range(rng.randrange(9)))) for i in range(600)] + [(600, None), (601, ""), (602, "use (pools (and")]
    df = spark.createDataFrame(rows, "i long, said string").select("i", text.clean_clause_column(F.col("said")).alias("c"), text.polish_column(F.col("said")).alias("p"), text.usable_column(F.col("said")).alias("u"))
    got = {r["i"]: (r["c"], r["p"], r["u"]) for r in df.collect()}
    for i, said in rows:
        assert got[i] == (plain_records.clean_clause(said), plain_records.polish(said), plain_records.is_usable(said)), said
        left = " ".join((said or "").split())
        while left.count("(") > left.count(")"):
            left = left[: left.rfind("(")]
        words = left.rstrip(" .,;:").split()
        while words and words[-1].lower().strip(".,;:") in text.TAILS:
            words = words[:-1]
        assert got[i][0] == " ".join(words).rstrip(" .,;:"), said


def test_records_of_messages_as_one_by_one(spark):
    """Records by column expressions against plain Python, over random messages, odd ones among them."""
    rng = random.Random(12)
    heads = ["feat(core): ", "fix: ", "", "build(deps): bump x from 1 to 2 ", "Merge pull request #12 from a/b ", "  ", "Changed: ", "chore: "]
    scraps = ["use pools", "because it is cheap", "instead of threads.", "rather than (maps", "to avoid races", "Now", "also", "e.g.", "and", "due to", "x_y", "(see", "this)", "decided", "prefer `a.b`", "É", "so that", "...", "by the"]
    line = lambda: " ".join(rng.choice(scraps) for _ in range(rng.randrange(1, 8))) + rng.choice(["", ".", ". ", "!", ":"])
    body = lambda: rng.choice(["\n", "\n\n"]).join(rng.choice(["- ", "* ", "", "", "  "]) + line() for _ in range(rng.randrange(5)))
    said = [rng.choice(heads) + line() + rng.choice(["", "\n\n", "\n"]) + body() for _ in range(700)] + [None, "", "\n\n", " \n x", "word " * 300 + "because " + "of it " * 200, "a instead of " + "b " * 300 + "."]
    rows = [(i, f"{i:08x}", m, rng.choice(["", "src/a.py", None])) for i, m in enumerate(said)]
    df = spark.createDataFrame(rows, "seq long, sha string, message string, file_path string")
    got = {}
    for r in records.from_messages(df).orderBy("seq", "nth").collect():
        got.setdefault(r["seq"], []).append({k: v for k, v in r.asDict().items() if k not in ("seq", "nth")})
    for i, sha, m, path in rows:
        assert got.get(i, []) == plain_records.of_commit(m, f"commit {sha}", path or ""), m


def test_records_of_changelogs_as_one_by_one(spark):
    rng = random.Random(5)
    line = lambda: rng.choice(["* ", "- ", "  ", "", "+ "]) + rng.choice(["use pools because of load.", "drop y to avoid z. Keep x.", "plain words only here", "short", "Decided on maps rather than lists."])
    texts = ["\n".join(rng.choice([line(), line(), "", "# 1.0", "Version 2\n---------"]) for _ in range(12)) for _ in range(60)] + [None, ""]
    df = spark.createDataFrame([(i, "docs/CHANGES.md", t) for i, t in enumerate(texts)], "seq long, file_path string, text string")
    got = {}
    for r in records.from_documents(df, "changelog").orderBy("seq", "nth").collect():
        assert r["constraints"] == []
        got.setdefault(r["seq"], []).append({k: v for k, v in r.asDict().items() if k not in ("seq", "nth", "constraints")})
    assert len(got) > 30
    for i, t in enumerate(texts):
        assert got.get(i, []) == plain_records.of_changelog(t, "CHANGES.md"), t
