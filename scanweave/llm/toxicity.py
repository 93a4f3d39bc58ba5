"""Toxicity from confirmed examples and unlabelled text.

A linear classifier on the presence of words and word starts is trained with the non-negative positive-unlabelled
risk: the loss of unlabelled text as clean, less what the confirmed toxic share (the class prior)
contributes to it, never below zero. Negative labels are used for nothing but the prior.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave.llm.common import fold, settled

#: Training sample: rows with the smallest hashed ids. Scoring and everything else covers all rows.
POSITIVES = 3_000
UNLABELLED = 12_000
BUCKETS = 1 << 20
STARTS, LEVELS = (4, 6), (2, 4, 8)
FEATURES = 512
MEMBERS = 3
STEPS = 300
DECAY = 0.0002
FOLDS = 5

_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def word_set(text: str | None) -> np.ndarray:
    """Distinct hashed features of a whole text: words (letters only, without case), their starts of
    STARTS bytes, and starts that at least LEVELS different words share."""
    words = set((text or "").encode("utf-8", "replace").translate(_WORD).split())
    found = [zlib.crc32(w) for w in words]
    for size in STARTS:
        for start, n in Counter([w[:size] for w in words if len(w) >= size]).items():
            first = zlib.crc32(start, size)
            found.append(first)
            found += [first + level for level in LEVELS if n >= level]
    return np.unique(np.array(found, dtype=np.int64) % BUCKETS)


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.iloc[at:at + 256]
            yield pd.DataFrame({"doc_id": part["doc_id"], "positive": part["positive"], "words": [word_set(t) for t in part["text"]]})


class Model:
    """Weights of the chosen hashed words for each member, and their biases."""

    def __init__(self, slots: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> None:
        self.slots, self.weights, self.bias = slots, weights, bias
        self.place = np.full(BUCKETS, len(slots), dtype=np.int32)
        self.place[slots] = np.arange(len(slots))
        self.padded = np.vstack([weights, np.zeros((1, weights.shape[1]))])

    def score(self, text: str | None) -> float:
        raw = self.padded[self.place[word_set(text)]].sum(axis=0) + self.bias
        return float(np.mean(1 / (1 + np.exp(-np.clip(raw, -30, 30)))))


def choose_slots(sets: DataFrame, n_p: int, n_u: int) -> np.ndarray:
    """The FEATURES slots whose shares of confirmed and unlabelled texts differ most for their spread, counted by Spark."""
    seen = sets.select("positive", F.explode("words").alias("slot")).groupBy("slot").agg(
        F.sum(F.col("positive")).alias("in_p"), F.sum(1 - F.col("positive")).alias("in_u"))
    share = {k: (F.col(f"in_{k}") + 0.5) / (n + 1) for k, n in (("p", n_p), ("u", n_u))}
    gap = F.abs(share["p"] - share["u"]) / F.sqrt(share["p"] * (1 - share["p"]) / n_p + share["u"] * (1 - share["u"]) / n_u)
    best = seen.orderBy(F.desc(F.round(gap, 9)), "slot").limit(FEATURES).collect()
    return np.sort(np.array([r["slot"] for r in best], dtype=np.int64))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], slots: np.ndarray, prior: float) -> Model:
    """Fit MEMBERS classifiers by non-negative risk on bootstrap samples; same input, same model.

    Texts are given by the places of their features in `slots`.
    """
    n_p, n_u = max(1, len(positive)), max(1, len(unlabelled))

    def dense(sets):
        out = np.zeros((len(sets), len(slots)), dtype=np.float32)
        for i, s in enumerate(sets):
            out[i, s] = 1
        return out

    x_p, x_u = dense(positive), dense(unlabelled)
    weights, biases = np.zeros((len(slots), MEMBERS)), np.zeros(MEMBERS)
    for member in range(MEMBERS):
        rng = np.random.default_rng([11, member])
        p, u = x_p[rng.integers(0, n_p, n_p)], x_u[rng.integers(0, n_u, n_u)]
        w, b = np.zeros(len(slots), dtype=np.float32), np.float32(np.log(prior / (1 - prior)))
        mean_p = p.mean(axis=0)
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        for step in range(1, STEPS + 1):
            s_p, s_u = 1 / (1 + np.exp(-np.clip(p @ w + b, -30, 30))), 1 / (1 + np.exp(-np.clip(u @ w + b, -30, 30)))
            # Logistic loss: toxic -log s, clean -log(1 - s).
            clean_risk = -np.log(1 - s_u + 1e-6).mean() + prior * np.log(1 - s_p + 1e-6).mean()
            sum_p, sum_u = s_p @ p / n_p, s_u @ u / n_u
            g_clean, gb_clean = sum_u - prior * sum_p, s_u.mean() - prior * s_p.mean()
            if clean_risk >= 0:
                g, gb = prior * (sum_p - mean_p) + g_clean, prior * (s_p.mean() - 1) + gb_clean
            else:  # the corrected risk went below zero: step back from overfitting
                g, gb = -g_clean, -gb_clean
            g = g + DECAY * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            rate = np.float32(0.05 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step))
            w = (w - rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
            b = np.float32(b - rate * mb / (np.sqrt(vb) + 1e-8))
        weights[:, member], biases[member] = w, b
    return Model(slots, weights, biases)


def fit(docs: DataFrame, labels: DataFrame, usable: Column) -> Model | None:
    """Train on a bounded sample of the rows for which `usable` holds; None without confirmed examples.

    The class prior is the toxic share of all usable labelled rows.
    """
    known = labels.filter(usable & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = settled(known)
    total = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    if not total["n"] or not total["toxic"]:
        return None
    prior = min(0.9, max(0.001, total["toxic"] / total["n"]))

    def some(rows: DataFrame, most: int, positive: int) -> DataFrame:
        # Only ids are ordered; the texts of the chosen few are joined to them.
        ids = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        return ids.withColumn("positive", F.lit(positive))

    ids = settled(some(known.filter("toxic = 1"), POSITIVES, 1).unionByName(
        some(docs.filter(usable & F.col("doc_id").isNotNull()), UNLABELLED, 0)))
    # One row of every id, so that the sample is bounded in rows as well as in ids.
    mine = docs.select("doc_id", "text", F.xxhash64("text").alias("_h")).join(F.broadcast(ids), "doc_id")
    least = mine.groupBy("doc_id", "positive").agg(F.min(F.coalesce("_h", F.lit(0))).alias("_h"))
    sample = docs.select("doc_id", "text").withColumn("_h", F.coalesce(F.xxhash64("text"), F.lit(0))).join(F.broadcast(settled(least)), ["doc_id", "_h"])
    sets = settled(sample.dropDuplicates(["doc_id", "positive"]).select("doc_id", "positive", "text")
                   .mapInPandas(_sets, "doc_id long, positive int, words array<long>"))
    n = {r["positive"]: r["count"] for r in sets.groupBy("positive").count().collect()}
    if not n.get(1) or not n.get(0):
        return None
    slots = choose_slots(sets, n[1], n[0])
    # Only the chosen features leave the tasks: at most FEATURES places for each sampled text.
    place = F.array_sort(F.array_intersect("words", F.array(*[F.lit(int(x)) for x in slots])))
    kept = sets.select("positive", place.alias("words")).collect()
    at = {int(x): i for i, x in enumerate(slots)}
    found = {k: sorted([at[x] for x in r["words"]] for r in kept if r["positive"] == k) for k in (0, 1)}
    return train([np.array(f, dtype=np.int64) for f in found[1]], [np.array(f, dtype=np.int64) for f in found[0]], slots, prior)


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = FOLDS) -> DataFrame:
    """`docs` with held_out, score (0 to 1) and predicted (score of at least 0.5) for every row.

    Labels are learnt from rows whose crc32 of the id modulo `folds` is not 0. Null and empty texts
    have no words and get the bias alone; without confirmed examples every score is 0. Rows are
    neither dropped nor merged.
    """
    held = fold(folds) == 0
    model = fit(docs, labels, ~held)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns="text").assign(score=[0.0 if model is None else model.score(t) for t in batch["text"]]).astype({"doc_id": "Int64"})

    scored = docs.select("doc_id", "text").mapInPandas(score, "doc_id long, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of `docs`, all columns, that are not predicted toxic."""
    model = fit(docs, labels, fold(FOLDS) != 0)

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series([0.0 if model is None else model.score(t) for t in texts])

    return docs.filter(scores("text") < 0.5)
