"""License scans by diagonal voting, with DataFrame functions only.

Every rolling k-gram of words (k is 2 for the short phrases, 3 for notices and whole license texts) is hashed and joined to the positions of the same k-gram in the templates (a fixed list, so
broadcast); the words themselves are then compared, so a vote is never a collision of hashes. A hit votes for the diagonal `document position - template position`.
Diagonals with two votes or more that lie at most GAP apart are merged, so that a few words put in or left out don't split a notice, and a merged
span is verified by the share of the template's k-grams whose words it has.

Base phrases count where they stand word for word: all 2-grams of the phrase on one diagonal. Notices and texts give further labels from COVER coverage on.

Words are maximal runs of ASCII letters and digits and of any non-ASCII character; A-Z are lower-cased and nothing else.

Defined results: null and empty texts have no words, no labels and score 0; a text of one word has no 2-gram; every row gives one row, repeated rows and doc_ids
included (rows are told apart by a number of their own); other columns are ignored. Nothing is gathered beyond the hits of one text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provspark.llm import notices

#: The phrases of the contract with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = 2
COVER = 0.6


def templates() -> list[tuple[list[str], int, str, bool]]:
    """(words, k, label, whether it is a base phrase)."""
    words = lambda said: re.findall(r"[a-z0-9]+", said.lower())
    found = [(words(said), 2, label, True) for said, label in PHRASES.items()]
    return found + [(words(said), 3, label, False) for texts in (notices.OPENINGS, notices.TEXTS) for label, said in texts.items()]


def template_grams(spark) -> DataFrame:
    """(gram, said, template, at, n_grams, label, base): a row for each k-gram of each template."""
    rows = [(" ".join(w[i : i + k]), t, i, len(w) - k + 1, label, base) for t, (w, k, label, base) in enumerate(templates()) for i in range(len(w) - k + 1)]
    schema = "said string, template int, at int, n_grams int, label string, base boolean"
    return spark.createDataFrame(rows, schema).select(F.xxhash64("said").alias("gram"), F.col("said").alias("meant"), "template", "at", "n_grams", "label", "base")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs (doc_id, text)."""
    words = F.array_remove(F.split(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), BREAKS), "")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words")).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), "words")
    later = lambda k: F.slice("words", F.lit(k + 1), F.size("words"))
    twos = F.zip_with("words", later(1), lambda a, b: F.concat(a, F.lit(" "), b))  # null behind the last words
    threes = F.zip_with(twos, later(2), lambda ab, c: F.concat(ab, F.lit(" "), c))
    placed = lambda grams: F.transform(grams, lambda said, i: F.struct(i.alias("pos"), said.alias("said")))
    rolled = d.select("row", "doc_id", "n_words", F.explode_outer(F.concat(placed(twos), placed(threes))).alias("g")).select("row", "doc_id", "n_words", "g.pos", "g.said", F.xxhash64("g.said").alias("gram"))
    met = rolled.join(F.broadcast(template_grams(docs.sparkSession)), "gram", "left").filter("template is not null or coalesce(pos, 0) = 0")
    same = F.col("said") == F.col("meant")
    hits = met.select("row", "doc_id", "n_words", *[F.when(same, F.col(c)).alias(c) for c in ("pos", "template", "at", "n_grams", "label", "base")])
    key = ["row", "doc_id", "n_words"]
    votes = (
        hits.groupBy(*key, "template", "n_grams", "label", "base", (F.col("pos") - F.col("at")).alias("diagonal"))
        .agg(F.collect_list("at").alias("ats"))  # at most the 2-grams of one template
        .withColumn("votes", F.size("ats"))
    )
    in_template = Window.partitionBy("row", "template").orderBy("diagonal")
    heavy = (F.col("votes") >= 2) & ~F.col("base")
    near = F.col("diagonal") - F.last(F.when(heavy, F.col("diagonal")), True).over(in_template.rowsBetween(Window.unboundedPreceding, -1)) <= GAP
    merged = votes.withColumn("span", F.sum(F.when(heavy & F.coalesce(near, F.lit(False)), 0).otherwise(1)).over(in_template.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy(*key, "template", "span").agg(
        F.first("label").alias("label"), F.first("base").alias("base"), F.first("n_grams").alias("n_grams"), F.min("diagonal").cast("long").alias("start"),
        F.max("votes").alias("votes"), F.size(F.array_distinct(F.flatten(F.collect_list(F.when(heavy | F.col("base"), F.col("ats")))))).alias("covered"),
    )
    share = F.col("covered") / F.col("n_grams")
    place = F.col("base") & (F.col("votes") == F.col("n_grams"))
    found = place | (~F.col("base") & (share >= COVER))
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return (
        spans.groupBy(*key)
        .agg(
            F.count(F.when(place, 1)).alias("n_base"), F.min(F.when(place, F.col("start"))).alias("first_word"), F.max(F.when(place, F.col("start"))).alias("last_word"),
            names(place).alias("base_labels"), names(found).alias("labels"),
            F.greatest(F.max(F.when(place, 1.0).otherwise(0.0)), F.coalesce(F.max(F.when(~F.col("base"), share)), F.lit(0.0))).alias("score"),
        )
        .drop("row")
    )


def oracle() -> str:
    """The same in DuckDB's SQL."""
    quoted = lambda w, i: f"'{w[i]}'" if i < len(w) else "null"
    rows = [f"({quoted(w, i)}, {quoted(w, i + 1)}, {quoted(w, i + 2) if k > 2 else 'null'}, {t}, {i}, {len(w) - k + 1}, '{label}', {'true' if base else 'false'})" for t, (w, k, label, base) in enumerate(templates()) for i in range(len(w) - k + 1)]
    return f"""
with t(w1, w2, w3, template, off, n_grams, label, base) as (values {", ".join(rows)}),
d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from documents),
w as (select r, doc_id, len(words) as n_words, unnest(words) as a, unnest(list_concat(words[2:], [null])) as b, unnest(list_concat(words[3:], [null, null])[1:len(words)]) as c, unnest(range(len(words))) as pos from d),
votes as (
  select r, template, n_grams, label, base, pos - off as diagonal, count(*) as votes, list(off) as ats
  from w join t on w.a = t.w1 and w.b = t.w2 and (t.w3 is null or w.c = t.w3) group by all),
m as (select *, votes >= 2 and not base as heavy from votes),
g as (select *, last_value(case when heavy then diagonal end ignore nulls) over (partition by r, template order by diagonal rows between unbounded preceding and 1 preceding) as prev from m),
s as (select *, sum(case when heavy and coalesce(diagonal - prev <= {GAP}, false) then 0 else 1 end) over (partition by r, template order by diagonal rows between unbounded preceding and current row) as span from g),
spans as (
  select r, template, span, any_value(label) as label, any_value(base) as base, any_value(n_grams) as n_grams, min(diagonal) as start, max(votes) as votes,
    len(list_distinct(flatten(list(ats) filter (where heavy or base)))) as covered
  from s group by r, template, span),
p as (select *, base and votes = n_grams as place, coalesce(covered, 0)::double / n_grams as share from spans),
f as (
  select r, count(*) filter (where place) as n_base, min(start) filter (where place) as first_word, max(start) filter (where place) as last_word,
    string_agg(distinct label, ',' order by label) filter (where place) as base_labels,
    string_agg(distinct label, ',' order by label) filter (where place or (not base and share >= {COVER})) as labels,
    greatest(max(case when place then 1.0::double else 0.0::double end), coalesce(max(case when not base then share end), 0.0::double)) as score
  from p group by r)
select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0::double) as score
from d left join f using (r)
"""
