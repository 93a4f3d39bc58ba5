"""Text quality by a generalised additive model with pairwise interactions.

Every text is measured by a fixed list of numbers, each cut into bins at quantiles of the training
sample. Boosting cycles over the features; every turn fits a shallow tree on one feature's bins and
adds it to that feature's table. The pairs whose residuals gain most then get tables of their own in
the same way. A score is the sum of looked-up bins through the logistic function.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave.llm.common import fold, settled

#: Training sample: labelled rows with the smallest hashed ids.
LABELLED = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 60
PAIR_ROUNDS = 20
RATE = 0.15
RIDGE = 5.0
FOLDS, HELD = 4, 2

NAMES = ["bytes", "words", "upper", "digits", "marks", "odd_marks", "blanks", "high", "word_bytes", "long_words",
         "distinct", "repeated_lines", "lines", "marked_words", "shouted_words", "common_mark", "short_words", "sentence"]

_CLASS = np.zeros(256, dtype=np.uint8)  # 0 letter, 1 upper, 2 digit, 3 sentence mark, 4 odd mark, 5 blank, 6 high
_CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 6
_CLASS[[b for b in range(128) if not chr(b).isalnum() and not chr(b).isspace()]] = 4
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 5
_MARK_BYTES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def measure(text: str | None) -> list[float]:
    """The numbers of NAMES for one whole text; an empty text has zeros."""
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw)
    if not n:
        return [0.0] * len(NAMES)
    kinds = np.bincount(_CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=7)
    words = raw.split()
    w = max(1, len(words))
    distinct = set(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    odd = [raw.count(c) for c in (b"!", b"#", b"$", b"%", b"&", b"*", b"|", b"=", b"@", b"~", b"<", b"{")]
    shouted = sum(map(bytes.isupper, words))
    marked = sum(1 for x in words if x[-1] in _MARK_BYTES)
    stops = raw.count(b".") + raw.count(b"?") + raw.count(b"!")
    return [np.log1p(n), np.log1p(len(words)), kinds[1] / n, kinds[2] / n, kinds[3] / n, kinds[4] / n, kinds[5] / n, kinds[6] / n,
            n / w, float((sizes > 20).mean()) if len(words) else 0.0, len(distinct) / w, 1 - len(set(lines)) / max(1, len(lines)),
            len(lines) / w, marked / w, shouted / w, max(odd) / w, float((sizes <= 2).mean()) if len(words) else 0.0, w / (1 + stops)]


def _tree(gain: np.ndarray, weight: np.ndarray, depth: int) -> np.ndarray:
    """Values of a tree of `depth` splits over ordered bins, from sums of gradients and hessians."""
    value = np.full(len(gain), gain.sum() / (weight.sum() + RIDGE))
    if not depth or len(gain) < 2:
        return value
    left_g, left_h = np.cumsum(gain)[:-1], np.cumsum(weight)[:-1]
    right_g, right_h = gain.sum() - left_g, weight.sum() - left_h
    better = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE)
    cut = int(np.argmax(better)) + 1
    return np.concatenate([_tree(gain[:cut], weight[:cut], depth - 1), _tree(gain[cut:], weight[cut:], depth - 1)])


def _pair_tree(gain: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """The best four-leaf tree over two features' bins: one cut on each, and its gain."""
    g, h = np.cumsum(np.cumsum(gain, 0), 1), np.cumsum(np.cumsum(weight, 0), 1)
    best, at = -1.0, (1, 1)
    for i in range(len(g) - 1):
        for j in range(len(g) - 1):
            parts = [(g[i, j], h[i, j]), (g[i, -1] - g[i, j], h[i, -1] - h[i, j]), (g[-1, j] - g[i, j], h[-1, j] - h[i, j]),
                     (g[-1, -1] - g[i, -1] - g[-1, j] + g[i, j], h[-1, -1] - h[i, -1] - h[-1, j] + h[i, j])]
            score = sum(a * a / (b + RIDGE) for a, b in parts)
            if score > best:
                best, at = score, (i + 1, j + 1)
    value = np.zeros_like(gain)
    for rows in (slice(0, at[0]), slice(at[0], None)):
        for columns in (slice(0, at[1]), slice(at[1], None)):
            value[rows, columns] = gain[rows, columns].sum() / (weight[rows, columns].sum() + RIDGE)
    return value, best


class AdditiveModel:
    """Bin edges, one table per feature, and tables of feature pairs."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        marks = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(column, marks)) for column in x.T]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        share = min(0.999, max(0.001, float(y.mean())))
        self.bias = float(np.log(share / (1 - share)))
        bins = self.bins(x)
        raw = np.full(len(y), self.bias)
        for _ in range(ROUNDS):
            for f, table in enumerate(self.tables):
                p = 1 / (1 + np.exp(-raw))
                step = RATE * _tree(np.bincount(bins[:, f], y - p, len(table)), np.bincount(bins[:, f], p * (1 - p), len(table)), 2)
                table += step
                raw += step[bins[:, f]]
        coarse = self.coarse(bins)

        def sums(i, j, p):
            cell = coarse[:, i] * PAIR_BINS + coarse[:, j]
            size = PAIR_BINS * PAIR_BINS
            shape = (PAIR_BINS, PAIR_BINS)
            return cell, np.bincount(cell, y - p, size).reshape(shape), np.bincount(cell, p * (1 - p), size).reshape(shape)

        p = 1 / (1 + np.exp(-raw))
        gains = sorted(((-_pair_tree(*sums(i, j, p)[1:])[1], i, j) for i, j in combinations(range(x.shape[1]), 2)))[:PAIRS]
        self.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for _, i, j in gains]
        for _ in range(PAIR_ROUNDS):
            for i, j, table in self.pairs:
                cell, g, h = sums(i, j, 1 / (1 + np.exp(-raw)))
                step = RATE * _pair_tree(g, h)[0]
                table += step
                raw += step.ravel()[cell]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, column, side="right") for e, column in zip(self.edges, x.T)], axis=1)

    def coarse(self, bins: np.ndarray) -> np.ndarray:
        return bins * PAIR_BINS // np.array([len(t) for t in self.tables])

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        raw = np.full(len(x), self.bias)
        for f, table in enumerate(self.tables):
            raw += table[bins[:, f]]
        coarse = self.coarse(bins)
        for i, j, table in self.pairs:
            raw += table[coarse[:, i], coarse[:, j]]
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


class Share:
    """What is known without labels of both classes: the share of label 1."""

    def __init__(self, share: float) -> None:
        self.share = share

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def fit(docs: DataFrame, labels: DataFrame, usable: Column) -> AdditiveModel | Share:
    """Train on at most LABELLED rows for which `usable` holds; the share of label 1 (1 without labels) unless both classes occur."""
    known = (labels.filter(usable & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
             .groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED))
    sample = docs.select("doc_id", "text").join(F.broadcast(settled(known)), "doc_id")

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "x": [measure(t) for t in batch["text"]]})

    # One row of every id, so that the sample is bounded in rows as well as in ids.
    sample = settled(sample.mapInPandas(measured, "doc_id long, quality int, x array<double>"))
    rows = sorted((r["x"], r["quality"]) for r in sample.groupBy("doc_id").agg(F.min("x").alias("x"), F.max("quality").alias("quality")).collect())
    y = np.array([r[1] for r in rows], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return Share(float(y[0]) if len(y) else 1.0)
    return AdditiveModel(np.array([r[0] for r in rows]), y)


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score of at least 0.7) for every row of `docs`.

    Labels are learnt from rows whose crc32 of the id modulo `folds` is not `held`. Null texts are
    empty ones, whose measures are all zero; with labels of one class every score is the share of
    label 1, and 1 without any label.
    """
    kept_out = fold(folds) == held
    model = fit(docs, labels, ~kept_out)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([measure(t) for t in batch["text"]]).reshape(len(batch), len(NAMES))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": model.score(x)})

    scored = docs.select("doc_id", "text").mapInPandas(score, "doc_id long, score double")
    return scored.select("doc_id", kept_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
