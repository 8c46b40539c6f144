"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic regression on the text's form (frequencies of character-class
trigrams, share of distinct words, share of repeated lines) gives each document's
evidence. It is fitted on at most ``sample`` labelled rows (a bounded, documented
sample with the smallest hashes of the id). Grouped sums of the documents' probabilities give
each host and each path of a host a posterior: a host's mean is shrunk towards
the global mean, a path's towards its host's, each with a strength from the
variance between groups beyond what their sizes explain. The document's log-odds
are then moved by the difference of its path's and the global log-odds.

Defined results: null and empty texts have no form and are rejected; null host or
path is a group of its own; without labels of both kinds all documents with a
word are kept; texts of any length are read whole; a posterior at the threshold is kept; repeated rows count
each and are judged alike; an empty table gives an empty table; extra columns, whatever their names, are
ignored by ``apply`` and stay as they are in ``keep``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_keys, stash, without
from .logistic import Sparse, fit, labelled_sample

#: Classes of characters: letters by case, other letters, digits, spaces, line ends; each other ASCII character is its own.
OWN = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
N_CLASSES = 7 + len(OWN)
WIDTH = N_CLASSES**3 + 2 * 10
_CLASS = np.full(256, 6, np.int64)
_CLASS[ord("A") : ord("Z") + 1] = 0
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[128:] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[ord(" ")] = 4
_CLASS[[9, 10, 11, 12, 13]] = 5
for _i, _c in enumerate(OWN):
    _CLASS[ord(_c)] = 7 + _i


def form(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features of a whole text: square roots of trigram frequencies, and two shares in tenths."""
    raw = (text or "").encode()
    c = _CLASS[np.frombuffer(raw, np.uint8)]
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0)
    counts = np.bincount((c[:-2] * N_CLASSES + c[1:-1]) * N_CLASSES + c[2:], minlength=1)
    col = np.flatnonzero(counts)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    shares = [len(set(words)) / max(len(words), 1), len(set(lines)) / max(len(lines), 1)]
    tenths = [N_CLASSES**3 + 10 * i + min(9, int(10 * s)) for i, s in enumerate(shares)]
    return np.concatenate([col, tenths]), np.concatenate([np.sqrt(counts[col] / counts.sum()) * 4, [1.0, 1.0]])


class Evidence:
    """Log-odds that a text is good."""

    def __init__(self, texts: list[str | None], y: np.ndarray):
        self.known = 0 < y.sum() < len(y)
        if self.known:
            self.w, self.b = fit(Sparse([form(t) for t in texts], WIDTH), y, l2=2e-4, steps=120)

    def __call__(self, text: str | None) -> float:
        if not (text or "").strip():
            return -12.0
        if not self.known:
            return 12.0
        col, val = form(text)
        return float(np.clip(val @ self.w[col] + self.b, -12, 12))


def evidence(docs: DataFrame, labels: DataFrame, text_col: str, key_col: str, sample: int) -> Column:
    """A column of the documents' log-odds."""
    model = Evidence(*labelled_sample(docs, labels, "quality", F.lit(True), sample, text_col, key_col))

    @F.arrow_udf("double")
    def logit(texts: pa.Array) -> pa.Array:
        return pa.array([model(t) for t in texts.to_pylist()], pa.float64())

    return logit(F.col(f"`{text_col}`"))


def _log_odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: Column, least: float = 20.0, most: float = 1e6) -> Column:
    """Prior strength by the method of moments, an aggregate over ``groups`` (n, s, q: sum of squares)."""
    between = F.sum(F.col("n") * (F.col("s") / F.col("n") - mean) ** 2)
    within = F.sum(F.col("q") - F.col("s") ** 2 / F.col("n")) / F.greatest(F.sum("n") - F.count(F.lit(1)), F.lit(1))
    spread = (between - within * F.count(F.lit(1))) / F.sum("n")
    return F.least(F.lit(most), F.greatest(F.lit(least), F.when(spread > 0, within / spread).otherwise(most)))


def posteriors(scored: DataFrame) -> DataFrame:
    """(host, path, shift) of each path from documents (host, path, logit): what to add to their log-odds."""
    p = 1 / (1 + F.exp(-F.col("logit")))
    paths = scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("q"))
    total = [F.sum(c).alias(c) for c in ("n", "s", "q")]
    hosts = paths.groupBy("host").agg(*total)
    everything = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).select((F.col("s") / F.col("n")).alias("mean"))
    one_row = lambda df: df.withColumn("one", F.lit(1))  # noqa: E731  a join on it has one row on the right
    with_mean = one_row(hosts).join(one_row(everything), "one")
    k_host = one_row(with_mean.agg(F.first("mean").alias("mean"), _strength(with_mean, F.col("mean")).alias("k")))
    host = one_row(hosts).join(k_host, "one").select(F.col("host").alias("__host"), "mean", ((F.col("k") * F.col("mean") + F.col("s")) / (F.col("k") + F.col("n"))).alias("host_mean"))
    of_host = paths.join(host, F.col("host").eqNullSafe(F.col("__host")))
    k_path = one_row(of_host.agg(_strength(of_host, F.col("host_mean")).alias("k")))
    mean = (F.col("k") * F.col("host_mean") + F.col("s")) / (F.col("k") + F.col("n"))
    inside = lambda c: F.least(F.lit(1 - 1e-4), F.greatest(F.lit(1e-4), c))
    return one_row(of_host).join(k_path, "one").select(
        F.col("host").alias("__h"), F.col("path").alias("__p"), inside(mean).alias("site_posterior"), (_log_odds(inside(mean)) - _log_odds(inside(F.col("mean")))).alias("shift")
    )


def judge(scored: DataFrame, sites: DataFrame, threshold: float) -> DataFrame:
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("__h")) & F.col("path").eqNullSafe(F.col("__p")), "left")
    z = F.col("logit") + F.coalesce("shift", F.lit(0.0))
    return joined.withColumn("posterior", 1 / (1 + F.exp(-z))).withColumn("kept", F.col("posterior") >= threshold)


def apply(docs: DataFrame, labels: DataFrame, host: Column, path: Column, text_col: str = "text", key_col: str = "doc_id", threshold: float = 0.4, sample: int = 8000) -> DataFrame:
    """(doc_id, host, path, logit, site_posterior, posterior, kept) of every document; texts are read once."""
    logit = evidence(docs, labels, text_col, key_col, sample)
    scored = stash(docs.select(F.col(f"`{key_col}`").alias("doc_id"), host.alias("host"), path.alias("path"), logit.alias("logit")), "evidence")
    return judge(scored, stash(posteriors(scored), "sites"), threshold).select("doc_id", "host", "path", "logit", "site_posterior", "posterior", "kept")


def keep(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, text_col: str = "text", key_col: str = "doc_id", threshold: float = 0.4, sample: int = 8000, learn_from: DataFrame | None = None
) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only.

    The labelled sample is drawn from ``learn_from`` (the same two columns), else from ``docs``:
    documents that an earlier filter has left hold too few bad ones to learn from. A verdict follows from the text, host and path alone. These are hashed and the
    hashes written with the evidence, which is scored once; the rows whose hashes are
    rejected are then taken out.
    """
    keys = row_keys(F.col(f"`{text_col}`"), host, path)
    logit = evidence(docs if learn_from is None else learn_from, labels, text_col, key_col, sample)
    scored = stash(docs.select(keys[0].alias("__k1"), keys[1].alias("__k2"), host.alias("host"), path.alias("path"), logit.alias("logit")), "evidence")
    return without(docs, keys, judge(scored, stash(posteriors(scored), "sites"), threshold).filter("not kept"))
