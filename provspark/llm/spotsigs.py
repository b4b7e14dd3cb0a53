"""SpotSigs fingerprints (Theobald et al., 2008): chains of content words behind common-word anchors.

Every common word is an anchor; its signature is the anchor with the next CHAIN content words. A text's fingerprint is the set of its signatures. Texts without a full
chain fall back to all neighbouring words, then to the single word. `near_pairs` finds like texts: sets are partitioned by length (lengths too far apart can't reach
the threshold), met through their rarest signatures and compared by a Jaccard count that stops once the threshold is out of reach.

`with_edits` sets each text beside its edited form and the next text by doc_id. Rows are dealt by ranges of doc_id and sorted; the first row of each range is
sent to the range before as well, so no task needs more than its own range.

Defined results: null text: empty; an empty text has the empty set, fingerprint "0:"; two empty sets are alike by 1; order is by doc_id (null last), then text, and
repeated rows follow each other; a single row is its own next; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import U64, in_arrow, mix, place_among

#: Common words of four languages.
COMMON = frozenset(
    "the a an and of to in is was are be for on with as at by from that this it or not have has"
    " der die das und ist ein eine von zu mit den dem des im in für auf als auch nicht sich er es"
    " le la les un une et est dans en que qui de des du pour pas sur au avec par ce"
    " el los las uno una y es por con para no su al lo se del como".encode().split()
)
CHAIN = 2
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


class Spots(dict):
    """word -> hash whose lowest bit says whether the word is common; bounded, as every idle worker keeps its own."""

    def __init__(self, most: int = 50_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word) >> 1 << 1 | (word in COMMON)
        return h

    def signatures(self, text: str) -> np.ndarray:
        """Distinct signatures, ascending."""
        words = text.encode("utf-8", "surrogatepass").translate(_WORDS).split()
        h = np.fromiter(map(self.__getitem__, words), U64, len(words))
        common = (h & U64(1)).astype(bool)
        content = np.flatnonzero(~common)
        anchors = np.flatnonzero(common)
        first = np.searchsorted(content, anchors)
        whole = first + CHAIN <= len(content)
        sig = h[anchors[whole]]
        for k in range(CHAIN):
            sig = mix(sig * U64(0x9E3779B97F4A7C15) + h[content[first[whole] + k]])
        if not len(sig):
            sig = mix(h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:]) if len(h) > 1 else h
        return np.unique(sig)


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two ascending sets; 0 at once if their lengths rule out `least`."""
    if not len(a) and not len(b):
        return 1.0
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def reaches(a: np.ndarray, b: np.ndarray, least: float, step: int = 64) -> float | None:
    """Jaccard if at least `least`, else None, given up as soon as the signatures still to come can't make up for those missed."""
    over, under = Fraction(str(least)).as_integer_ratio()  # in floats the bound is too high for sets that meet it exactly
    need = -(-over * (len(a) + len(b)) // (over + under))
    if min(len(a), len(b)) < need or not max(len(a), len(b)):
        return 1.0 if len(a) == len(b) == 0 else None
    both = 0
    for i in range(0, len(a), step):
        part = a[i : i + step]
        at = np.minimum(np.searchsorted(b, part), len(b) - 1)
        both += int((b[at] == part).sum())
        if both + len(a) - i - len(part) < need:
            return None
    j = both / (len(a) + len(b) - both)
    return j if j >= least else None


def printed(sigs: np.ndarray) -> str:
    return f"{len(sigs)}:{xxhash.xxh3_128_hexdigest(sigs.astype('<u8').tobytes()) if len(sigs) else ''}"


def edited(text: str, nxt: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + nxt[:k] if k else text


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_edits(docs: DataFrame) -> DataFrame:
    """The row of SCHEMA for each row of docs (doc_id, text). One shuffle of the texts."""
    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = sorted(set(d.select("doc_id").stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)))  # as many as ranges
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(place_among(F.col("doc_id"), [int(c) for c in cuts]))
    firsts = sorted((r["bucket"], r["least"]) for r in d.groupBy(bucket.alias("bucket")).agg(F.min("doc_id").alias("least")).collect())  # one a range
    if not firsts:
        return spark.createDataFrame([], SCHEMA)
    ghosts = spark.createDataFrame([(least, firsts[k - 1][0]) for k, (_, least) in enumerate(firsts)], "first_id long, ghost_of int")
    dealt = (
        d.withColumn("own", bucket)
        .join(F.broadcast(ghosts), F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
        .select("doc_id", "text", F.explode(F.when(F.col("ghost_of").isNull(), F.array(F.struct(F.col("own").alias("bucket"), F.lit(0).alias("ghost")))).otherwise(
            F.array(F.struct(F.col("own").alias("bucket"), F.lit(0).alias("ghost")), F.struct(F.col("ghost_of").alias("bucket"), F.lit(1).alias("ghost"))))).alias("to"))
        .select("doc_id", "text", "to.bucket", "to.ghost")
        .repartition("bucket")
        .sortWithinPartitions("bucket", "ghost", F.col("doc_id").asc_nulls_last(), "text")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spots, held, out = Spots(), None, []

        def row(nxt: str, nxt_sigs: np.ndarray) -> tuple:
            doc_id, text, sigs, _ = held
            changed = edited(text, nxt)
            other = spots.signatures(changed)
            return doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), printed(sigs), printed(other), likeness(sigs, other), likeness(sigs, nxt_sigs)

        for b in batches:
            for doc_id, text, own, ghost in ((c[i].as_py() for c in b.columns) for i in range(b.num_rows)):  # a row at a time: texts are not held twice
                text = text or ""
                if ghost and (held is None or held[3] != own):
                    continue  # its range has its successor already
                sigs = spots.signatures(text)
                if held is not None and held[3] == own:
                    out.append(row(text, sigs))
                held = None if ghost else (doc_id, text, sigs, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True)], _NAMES)
                out = []

    return in_arrow(dealt, work, SCHEMA)


_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sigs, sigs): the signature set of each row of docs, as longs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spots = Spots()
        for b in batches:
            sigs = [spots.signatures(t or "").view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sigs], pa.int64()), pa.array(sigs, pa.list_(pa.int64()))], ["doc_id", "n_sigs", "sigs"])

    return in_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), work, "doc_id long, n_sigs long, sigs array<long>")


def near_pairs(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, jaccard) for pairs between distinct sets at or over the threshold; a, b: smallest doc_id of each set.

    Sets of n signatures meet through their n - ceil(threshold n) + 1 rarest, within a partition of lengths and the next one.
    """
    reps = prints.filter("n_sigs > 0").groupBy("sigs", "n_sigs").agg(F.min("doc_id").alias("id"))
    each = reps.select("id", "n_sigs", F.explode("sigs").alias("sig"))
    seen = each.groupBy("sig").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = each.join(seen, "sig").groupBy("id", "n_sigs").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("known"))  # within one set
    spare = F.col("n_sigs") - F.ceil(F.expr(f"n_sigs * {threshold}")) + 1 - (F.col("n_sigs") - F.size("known"))  # unique signatures use up the prefix first
    prefix = ranked.filter(spare > 0).select("id", "n_sigs", F.explode(F.slice("known", F.lit(1), spare.cast("int"))).alias("k")).select("id", "n_sigs", F.col("k.sig").alias("sig"), F.floor(F.log(F.col("n_sigs")) / -np.log(threshold)).alias("part"))
    other = prefix.select(F.col("id").alias("id_b"), F.col("n_sigs").alias("n_b"), "sig", F.explode(F.array("part", F.col("part") - 1)).alias("part"))
    met = prefix.join(other, ["sig", "part"]).filter(f"n_sigs <= n_b and n_sigs >= {threshold} * n_b and (n_sigs < n_b or id < id_b)").select("id", "id_b").distinct()
    pairs = met.join(reps.select("id", "sigs"), "id").join(reps.select(F.col("id").alias("id_b"), F.col("sigs").alias("sigs_b")), "id_b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, s, t = (x.to_pylist() for x in b.columns)
            js = [reaches(np.sort(np.array(x, np.int64)), np.sort(np.array(y, np.int64)), threshold) for x, y in zip(s, t, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(js, pa.float64())], ["a", "b", "jaccard"])

    found = in_arrow(pairs.select("id", "id_b", "sigs", "sigs_b"), work, "a long, b long, jaccard double").filter("jaccard is not null")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard")
