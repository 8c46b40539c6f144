"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct n-grams of 3 to 6 characters inside a text's
lower-case words with their boundaries, hashed into BUCKETS. Each present feature has the
value of its log-count ratio between toxic and other training documents; a
logistic regression on these values is fitted on at most ``sample`` labelled rows
(a bounded, documented sample with the smallest hashes of the id). The product of
weights and ratios, 4 MB, goes to the tasks, which score every whole text.

Defined results: null and empty texts have no features and get the intercept's
score; texts of any length are scored whole; a score at the threshold is toxic; without labels of
both kinds every score is 0; null doc_ids are scored and are not held out; repeated rows score alike; extra columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .logistic import Sparse, fit, labelled_sample

BUCKETS = 1 << 20
ORDERS = (3, 4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")
#: Odd constants of the rolling hash.
PRIME, MIX = 1_000_003, 0x9E3779B97F4A7C15
SMOOTH = 1.0
#: Standard errors that a log-count ratio must be away from zero to be a feature.
LEAST_ERRORS = 3.0


def features(text: str | None) -> np.ndarray:
    """Buckets of the n-grams of a whole text's distinct words, in no order, with repeats."""
    words = set(WORD.findall((text or "").lower()))
    if not words:
        return np.zeros(0, np.int64)
    c = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le"), "<u4")
    closing = np.flatnonzero(c == ord(">"))
    # How many characters are left to each place's word, its closing sign included.
    left = np.repeat(closing + 1, np.diff(closing, prepend=-1)) - np.arange(len(c))
    found = []
    h = np.zeros(len(c), np.uint64)
    for n in range(1, ORDERS[-1] + 1):
        h = h[: len(c) - n + 1] * np.uint64(PRIME) + c[n - 1 :]
        if n in ORDERS:
            found.append(h[left[: len(h)] >= n] + np.uint64(n))
    x = np.concatenate(found) * np.uint64(MIX)
    return (x >> np.uint64(64 - 20)).astype(np.int64)


class Model:
    def __init__(self, weights: np.ndarray, bias: float, constant: float | None = None):
        self.weights, self.bias, self.constant = weights.astype(np.float32), bias, constant

    def score(self, features: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        # Most buckets weigh nothing; of the others each counts once.
        z = float(self.weights[np.unique(features[self.weights[features] != 0])].sum(dtype=np.float64)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def train(texts: list[str | None], y: np.ndarray, l2: float = 5e-4) -> Model:
    if not (0 < y.sum() < len(y)):
        return Model(np.zeros(1), 0.0, constant=0.0)
    # Texts are cut up twice, so that no more than one text's features are held at once.
    toxic, other = np.full(BUCKETS, SMOOTH), np.full(BUCKETS, SMOOTH)
    for t, mark in zip(texts, y, strict=True):
        (toxic if mark else other)[np.unique(features(t))] += 1
    ratio = np.log(toxic / (y.sum() + 2 * SMOOTH)) - np.log(other / ((1 - y).sum() + 2 * SMOOTH))
    # Ratios that chance explains are noise, and there are many of them.
    sure = np.flatnonzero(np.abs(ratio) >= LEAST_ERRORS * np.sqrt(1 / toxic + 1 / other))
    place = np.full(BUCKETS, -1)
    place[sure] = np.arange(len(sure))
    used = []
    for t in texts:
        at = place[features(t)]
        used.append(np.unique(at[at >= 0]))
    w, b = fit(Sparse([(u, ratio[sure[u]]) for u in used], len(sure)), y, l2, positive_weight=3.0)
    weights = np.zeros(BUCKETS)
    weights[sure] = w * ratio[sure]
    return Model(weights, b)


def score(docs: DataFrame, labels: DataFrame, held_out: Column, text_col: str = "text", key_col: str = "doc_id", sample: int = 8000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; ``held_out`` rows teach nothing."""
    rows = docs.select(F.col(f"`{key_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), held_out.alias("held_out"))
    model = train(*labelled_sample(docs, labels, "toxic", ~held_out, sample, text_col, key_col))

    @F.arrow_udf("double")
    def toxic(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(features(t)) for t in texts.to_pylist()], pa.float64())

    scored = rows.select("doc_id", "held_out", toxic("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
