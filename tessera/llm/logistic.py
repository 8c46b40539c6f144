"""Logistic regression on sparse rows, for samples that fit the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Most bytes of text in a sample.
SAMPLE_BYTES = 64 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int, text_col: str = "text", key_col: str = "doc_id", most_bytes: int = SAMPLE_BYTES) -> tuple[list[str | None], np.ndarray]:
    """Texts and labels of at most ``most`` labelled rows of at most ``most_bytes`` of text in all.

    Of the labelled ids that ``train``, a condition on ``docs``, admits, those with the smallest hashes
    are chosen, one row of each: of several rows with one id that with the smallest hash of
    the text. Of these, in the same order, as many as fit the bytes are
    fetched. Several labels of one id count as the largest.
    """
    key, text = F.col(f"`{key_col}`"), F.col(f"`{text_col}`")
    marks = labels.filter(F.col(label).isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.max(label).alias("__label"))
    rows = docs.filter(train).select(key.alias("__doc"), text.alias("__text"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("__h"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("__size"))
    # The sample is chosen on ids, hashes and sizes; texts are fetched for it only.
    first = rows.groupBy("__doc").agg(F.min(F.struct("__h", "__size")).alias("__first"))
    chosen = first.join(marks, F.col("__doc") == F.col("__id")).orderBy(F.xxhash64("__doc"), "__doc").limit(most)
    table = chosen.select(F.col("__doc").alias("id"), "__first.__h", "__first.__size", "__label").toArrow()
    if not table.num_rows:
        return [], np.zeros(0)
    fits = np.cumsum(table.column(2).to_numpy()) <= most_bytes
    fits[:1] = True
    table = table.filter(pa.array(fits))
    picked = docs.sparkSession.createDataFrame(table.select([0, 1]).rename_columns(["__id", "__hash"]))
    got = rows.join(F.broadcast(picked), (F.col("__doc") == F.col("__id")) & (F.col("__h") == F.col("__hash")), "left_semi").select("__doc", "__text")
    # Rows equal in id and text come once.
    texts = dict(zip(*(c.to_pylist() for c in got.dropDuplicates(["__doc"]).toArrow().columns), strict=True))
    ids = table.column(0).to_pylist()
    return [texts[i] for i in ids], table.column(3).to_numpy().astype(np.float64)


class Sparse:
    """Rows of (column, value)."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int):
        self.n, self.width = len(rows), width
        sizes = [len(c) for c, _ in rows]
        self.row = np.repeat(np.arange(self.n), sizes)
        self.col = np.concatenate([c for c, _ in rows]) if rows else np.zeros(0, np.int64)
        self.val = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.val * w[self.col], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=self.val * g[self.row], minlength=self.width)


def fit(x: Sparse, y: np.ndarray, l2: float, steps: int = 80, rate: float = 0.1, positive_weight: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and intercept by Adam on the whole sample; the intercept isn't shrunk."""
    w, b = np.zeros(x.width), 0.0
    if not x.n:
        return w, b
    weight = np.where(y > 0.5, positive_weight, 1.0)
    weight /= weight.sum()
    share = float((weight * y).sum())
    b = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    m, v, mb, vb = np.zeros(x.width), np.zeros(x.width), 0.0, 0.0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w) + b, -50, 50)))
        g = weight * (p - y)
        gw, gb = x.back(g) + l2 * w, float(g.sum())
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = rate * min(1.0, 2 * (1 - t / (steps + 1)))
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-12)
        b -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-12)
    return w, b
