"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017), numpy only.

A linear scorer over which words and beginnings of words occur. Positives are rows labelled toxic; the unlabelled set is rows of `labels` of both kinds, whose labels are not looked at.
With class prior p (the share of toxic rows among the labelled ones) and the logistic loss the risk is p R_p+ + max(0, R_u- - p R_p-). An L1 term keeps the weights of
words that tell nothing at nothing: no word is picked or dropped by a count, and the same rule holds for any number of rows. Steps are accelerated proximal
gradient steps over all rows of the sample. Slope and shift of the score then minimise the same risk over a quarter of both kinds that a second fit
never saw; no label but those of the positives is used there either.

Labels are learnt only from rows whose crc32(doc_id as text) mod 3 is not 1. A score takes the text and nothing else.

Bounds, all parameters of `fit`: at most `most_positive` toxic and `most_unlabelled` labelled rows, taken in the order of a hash of doc_id, each with at most `most_slots` slots (those of
least number, a choice by hash), so that what reaches the driver is bounded whatever the texts; words count in a table of 2**`bits` slots. Scoring covers every word of every text.

Defined results: a null or empty text has no words and scores as the offset says; repeated rows score alike; a doc_id that labels repeat is toxic if any of them says so, and
one that docs repeat brings each of its texts; without any toxic label in the learning folds every score is the prior (0 without labels); other columns
are ignored. Null labels count as no label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import in_arrow, small_batches

THRESHOLD = 0.7
#: Margins and weights are whole multiples of this, so that sums don't depend on the order of words.
UNIT = 1e-6
#: Lower-cases A-Z and puts a space for every other ASCII character that is no letter or digit.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


#: Longer words also count by their beginnings of so many bytes, so that forms never met before are known by their stems.
STEMS = (4, 5, 6, 7, 8)


def words_of(text: str | None) -> set[bytes]:
    """Words of a text, and the beginnings of longer ones (marked by a leading `^`)."""
    words = set((text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split())
    stems = {b"^" + w[:n] for n in STEMS for w in words if len(w) > n}
    return words | stems


@dataclass
class Model:
    bits: int
    slots: np.ndarray  # of the words that count, ascending
    weights: np.ndarray  # in UNIT
    offset: int  # in UNIT
    slope: float
    shift: float

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer(dict):
    """word -> weight in UNIT, for words met lately; bounded."""

    def __init__(self, model: Model, most: int = 300_000):
        self.model, self.most = model, most
        self.by_slot = dict(zip(model.slots.tolist(), model.weights.tolist(), strict=True))

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = w = self.by_slot.get(slot(word, self.model.bits), 0)
        return w

    def score(self, text: str | None) -> float:
        m = self.model
        z = (m.offset + sum(map(self.__getitem__, words_of(text)))) * UNIT
        return float(1 / (1 + np.exp(-np.clip(m.slope * z + m.shift, -500, 500))))


def slot(word: bytes, bits: int) -> int:
    return xxhash.xxh3_64_intdigest(word) >> (64 - bits)


Rows = tuple[np.ndarray, np.ndarray, int]


def in_rows(slots: list[np.ndarray]) -> Rows:
    """Slots of all texts, the text of each, and how many texts there are."""
    at = np.concatenate([np.zeros(0, np.int64), *slots]).astype(np.int64)
    return at, np.repeat(np.arange(len(slots)), [len(s) for s in slots]), len(slots)


def margins(rows: Rows, w: np.ndarray, b: float) -> np.ndarray:
    return np.bincount(rows[1], w[rows[0]], rows[2]) + b


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def pu_risk(pos: Rows, unl: Rows, w: np.ndarray, b: float, prior: float) -> tuple[float, np.ndarray, float]:
    """The non-negative PU risk with the logistic loss, and its gradient by w and b (where the negative part is clamped, that of the positive part alone)."""
    z_p, z_u = margins(pos, w, b), margins(unl, w, b)
    positive = prior * np.logaddexp(0, -z_p).mean()
    negative = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
    if negative >= 0:
        d_p, d_u = np.full(pos[2], -prior / pos[2]), _sigmoid(z_u) / unl[2]
    else:
        d_p, d_u = -prior / pos[2] * _sigmoid(-z_p), np.zeros(unl[2])
    gradient = np.bincount(pos[0], d_p[pos[1]], len(w)) + np.bincount(unl[0], d_u[unl[1]], len(w))
    return positive + max(0.0, negative), gradient, float(d_p.sum() + d_u.sum())


def non_negative_pu(pos: Rows, unl: Rows, prior: float, n_slots: int, lasso: float = 5e-4, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and offset that minimise the non-negative PU risk plus lasso times the size of the weights (FISTA)."""
    w, b = np.zeros(n_slots), float(np.log(prior / (1 - prior)))
    v, c, t = w, b, 1.0
    x = np.ones(n_slots) / np.sqrt(max(1, n_slots))
    curve = 0.0
    for _ in range(12):  # the largest curvature, by power iteration
        x = np.bincount(unl[0], margins(unl, x, 0.0)[unl[1]], n_slots) / unl[2]
        curve = float(np.linalg.norm(x))
        x = x / max(curve, 1e-12)
    rate = 4 / (curve + 1)
    for _ in range(steps):
        _, g, g_b = pu_risk(pos, unl, v, c, prior)
        moved = v - rate * g
        new, new_b = np.sign(moved) * np.maximum(np.abs(moved) - rate * lasso, 0), c - rate * g_b
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    return w, b


def calibrate(z_p: np.ndarray, z_u: np.ndarray, prior: float, steps: int = 50, hold: float = 1.0) -> tuple[float, float]:
    """Slope and shift of the margins that minimise the PU risk, held to (1, 0) with the weight of `hold` rows, by Newton steps."""
    x_p, x_u = np.stack([z_p, np.ones_like(z_p)], 1), np.stack([z_u, np.ones_like(z_u)], 1)
    at, start, weight = np.array([1.0, 0.0]), np.array([1.0, 0.0]), hold / len(z_u)
    for _ in range(steps):
        q = _sigmoid(x_u @ at)
        g = x_u.T @ q / len(z_u) - prior * x_p.mean(axis=0) + weight * (at - start)
        h = (x_u * (q * (1 - q))[:, None]).T @ x_u / len(z_u) + weight * np.eye(2)
        at = at - np.clip(np.linalg.solve(h, g), -1, 1)
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def fold_is_held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most_positive: int = 3000, most_unlabelled: int = 5000, bits: int = 20, most_slots: int = 4096, lasso: float = 5e-4) -> Model:
    """Learns from docs (doc_id, text) and labels (doc_id, toxic). What comes to the driver is slots of words of the bounded samples, a row for each id in them."""
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter("doc_id is not null and toxic in (0, 1)").filter(~fold_is_held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in lab.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    nothing = np.zeros(0, np.int64)
    if not counts.get(1):
        return Model(bits, nothing, nothing, 0, 0.0, -500.0)
    prior = min(0.95, max(0.005, counts[1] / sum(counts.values())))
    order = F.xxhash64("doc_id")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = (
        lab.filter("toxic = 1").orderBy(order, "doc_id").limit(most_positive).select("doc_id", F.lit(1).alias("kind"))
        .unionByName(lab.orderBy(order, "doc_id").limit(most_unlabelled).select("doc_id", F.lit(0).alias("kind")))
    )
    chosen = chosen.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))  # bounded by the samples
    # A doc_id that docs repeat counts once, by the least of its rows: no more rows than the samples have ids come to the driver.
    found = _slots(d.join(F.broadcast(chosen), "doc_id").select("doc_id", "kinds", "text"), bits, most_slots)
    rows = found.groupBy("doc_id").agg(F.min(F.struct("slots", "kinds")).alias("r")).select("doc_id", "r.kinds", "r.slots").toArrow()
    slots = [np.frombuffer(b.as_buffer(), np.int32) for b in rows.column("slots")]  # views, no copies
    kinds, ids = rows.column("kinds").to_pylist(), rows.column("doc_id").to_pylist()
    order_ = sorted(range(len(slots)), key=lambda i: (ids[i], xxhash.xxh3_128_digest(slots[i])))  # rows come in any order
    slots, kinds, ids = [slots[i] for i in order_], [kinds[i] for i in order_], [ids[i] for i in order_]
    away = [xxhash.xxh3_64_intdigest(str(i)) % 4 == 0 for i in ids]
    if not any(1 in k for k in kinds) or not any(0 in k for k in kinds):
        return Model(bits, nothing, nothing, 0, 0.0, float(np.log(prior / (1 - prior))))
    use = np.unique(np.concatenate([s for s, k in zip(slots, kinds) if 1 in k]))  # a word of no positive text would only ever weigh against it
    place = np.full(1 << bits, -1, np.int32)
    place[use] = np.arange(len(use))
    slots = [(p := place[s])[p >= 0] for s in slots]
    of = lambda kind, *parts: in_rows([s for s, k, a in zip(slots, kinds, away) if kind in k and a in parts])
    slope, shift = 1.0, 0.0
    if of(1, False)[2] and of(0, False)[2] and of(1, True)[2] and of(0, True)[2]:
        w, b = non_negative_pu(of(1, False), of(0, False), prior, len(use), lasso)
        slope, shift = calibrate(margins(of(1, True), w, b), margins(of(0, True), w, b), prior)
    w, b = non_negative_pu(of(1, True, False), of(0, True, False), prior, len(use), lasso)
    units = np.rint(w / UNIT).astype(np.int64)
    return Model(bits, use[units != 0].astype(np.int64), units[units != 0], round(b / UNIT), slope, shift)


def _slots(df: DataFrame, bits: int, most: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.unique(np.array([slot(w, bits) for w in words_of(t)], np.int32))[:most].tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["doc_id", "kinds", "slots"])

    return in_arrow(df, work, "doc_id long, kinds array<int>, slots binary")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text). One pass, no shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = model.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([s.score(t) for t in b.column(2).to_pylist()], pa.float64())], ["doc_id", "held_out", "score"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = in_arrow(d.select("doc_id", fold_is_held_out().alias("held_out"), "text"), work, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, whose text scores below THRESHOLD."""

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = model.scorer()
        for t in texts:
            yield pd.Series([s.score(x) for x in t], dtype="float64")

    small_batches(docs.sparkSession)
    return docs.filter(scored(F.col("text")) < THRESHOLD)
