"""A corpus pipeline of five stages, each one of the training-data operators.

Every stage takes what its predecessor kept, written as Parquet and read again;
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontamination, ngram_jaccard, quality_classifier, quality_rules
from tessera.llm.common import stash


#: Bytes and rows that go to a Python worker at once. By default a batch is 10,000 rows, some 40 MB of
#: text that the executor and its workers each hold more than once, beside what earlier stages left in their memory.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage`` with BATCHES in all the jobs that it runs; its result has to need no Python workers any more."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        before = {k: spark.conf.get(k) for k in BATCHES}
        try:
            for k, v in BATCHES.items():
                spark.conf.set(k, v)
            return stage(spark, docs, sf_dir)
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)

    return run


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the adaptive limits of their language and source."""
    return quality_rules.keep(docs)


@in_small_batches
def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior says good.

    The evidence is learned from labelled rows of the whole table, as the rules have left
    next to no bad documents to learn from; the sites' posteriors are those of ``docs``.
    """
    whole, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    return quality_classifier.keep(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"), learn_from=whole)


@in_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its five-word shingles."""
    return ngram_jaccard.keep_one(docs, width=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in a benchmark item."""
    return decontamination.keep(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@in_small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    import public_tokenizers

    return stash(bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json")), "encoded")


STAGES = [
    ("quality_rules", quality),
    ("quality_classifier", classifier),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontaminate),
    ("bpe", encode),
]

#: Quantile sketches, a fitted classifier and BPE have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
