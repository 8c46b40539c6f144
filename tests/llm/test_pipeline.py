"""The pipeline against a version that applies brute force stage by stage."""

import collections
import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import brute_components, brute_hits, brute_metrics, library

import corpus_pipeline
from tessera.llm import quality_rules
from tessera.llm.common import stash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage was given and what it returned."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for name, f in corpus_pipeline.STAGES:
        given, d = d, stash(f(spark, d, SF), name)
        out[name] = (given, d)
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(steps):
    for name, (given, kept) in steps.items():
        assert name == "bpe" or (kept.columns == given.columns and kept.dtypes == given.dtypes)
        assert 0 < kept.count() <= given.count()


def test_quality_stage(steps):
    given, kept = steps["quality_rules"]
    judged = {r.doc_id: r.kept for r in quality_rules.apply(given).collect()}
    assert ids(kept) == sorted(i for i, k in judged.items() if k)
    assert not any(brute_metrics(r.text)[5] for r in kept.collect())


def test_classifier_keeps_good_documents(spark, steps):
    given, kept = steps["quality_classifier"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = {i for i in ids(given) if labels.get(i) == 1}
    assert len(good & set(ids(kept))) >= 0.98 * len(good)


def test_classifier_out_of_sample(spark, tmp_path):
    """Learns from labels of even ids; odd ids are judged, of which bad ones are many, then two, as after the rules."""
    whole, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    whole.write.parquet(f"{tmp_path}/documents.parquet")
    labels.filter("doc_id % 2 = 0").write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)["quality_classifier"]
    odd = {r.doc_id: r.quality for r in labels.filter("doc_id % 2 = 1").collect()}
    bad, good = ({i for i in ids(whole) if odd.get(i) == q} for q in (0, 1))
    for few in (sorted(bad), sorted(bad)[:2]):
        given = whole.filter(F.col("doc_id").isin([*few, *good]))
        kept = set(ids(stage(spark, given, str(tmp_path))))
        assert len(few) > 1 and len(kept & set(few)) <= 0.1 * len(few)
        assert len(kept & good) >= 0.98 * len(good)


def test_one_of_each_group(steps):
    given, kept = steps["ngram_jaccard"]
    rows = [(r.doc_id, r.text) for r in given.collect()]
    assert ids(kept) == sorted(i for i, _, c in brute_components(rows, 5, 80, 100) if i == c)


def test_decontamination_stage(spark, steps):
    given, kept = steps["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids(kept) == sorted(r.doc_id for r in given.collect() if not brute_hits(r.text, items)[4])


def test_encoding_stage(steps):
    given, out = steps["bpe"]
    rows = given.collect()
    tokens = library([r.text for r in rows])[1]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = collections.Counter((r.doc_id, len(t), sha(np.array(t, "<u4").tobytes()), sha(r.text.encode())) for r, t in zip(rows, tokens, strict=True))
    assert collections.Counter(map(tuple, out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == want


def test_run(spark, steps):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, steps["bpe"][1].collect()))


@pytest.mark.parametrize(
    ("stage", "module", "method"),
    [("quality_classifier", "quality_classifier", "keep"), ("ngram_jaccard", "ngram_jaccard", "keep_one"), ("bpe", "bpe", "round_trip")],
)
def test_batches_to_python_workers(spark, monkeypatch, stage, module, method):
    """What a stage sends to a Python worker at once has a bound of bytes; the session's setting stays."""
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1500).alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]}, pa.schema([("rows", pa.int64()), ("bytes", pa.int64())]))

    def measured(docs, *_, **__):
        out = docs.mapInArrow(sizes, "rows long, bytes long")
        return out if method == "round_trip" else stash(out, "sizes")

    monkeypatch.setattr(getattr(corpus_pipeline, module), method, measured)
    settings = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = [spark.conf.get(k) for k in settings]
    seen = dict(corpus_pipeline.STAGES)[stage](spark, docs, SF).collect()
    assert sum(r.rows for r in seen) == 4000
    assert max(r.bytes for r in seen) < 5_000_000
    assert [spark.conf.get(k) for k in settings] == before


def test_encoding_leaves_no_cache(spark):
    """Workers that encoded texts hold no cache when other tasks run in them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(8)
    dict(corpus_pipeline.STAGES)["bpe"](spark, docs, SF).collect()

    def held(batches):
        from tessera.llm import bpe

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [bpe._cache.cache_info().currsize]}, pa.schema([("n", pa.int64())]))

    assert {r.n for r in spark.range(0, 8, 1, 8).mapInArrow(held, "n long").collect()} == {0}
