"""Operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bpe, decontamination, lm_scoring, ngram_jaccard, pretokens, quality_classifier, quality_rules, seekable, token_counts, token_files, toxicity, warc
from tessera.llm.common import shared_dir, stash
from tessera.llm.logistic import labelled_sample
from tessera.llm.components import components

SF = "/root/testdata/sf0.001"
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_tokens", T.StringType()), T.StructField("score", T.StringType()), T.StructField("key", T.StringType())])
ODD = [None, "", " ", "\n\n", "a", "a b", "x" * 50_000, "w " * 20_000, "É ñ 漢字 😀 　z", "<|endoftext|> a<|endoftext|>", "it's  12 --- 'LL\t\r\n"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    """Rows (doc_id, text) with other columns, some of which share names with results."""
    return spark.createDataFrame([(i, t, "en", "s0", "x", "y", "z") for i, t in rows], DOC)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty and very long texts, null and repeated ids, repeated rows."""
    return docs(spark, [*enumerate(ODD), (None, "null id"), (None, None), (3, "\n\n"), (4, "other text of id four"), (7, "w " * 20_000)])


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(sample):
    return {r.doc_id: r.text for r in sample.collect()}


# --- 1 -------------------------------------------------------------------------------


def test_token_counts_brute_force(spark, sample, texts):
    u = token_counts.UnigramTrie(pretokens.read_vocabulary(RANKS))

    def brute(w):
        b = w.encode()
        best = [(0, 0)] + [None] * len(b)
        for e in range(1, len(b) + 1):
            best[e] = max((best[s][0] + u.pieces[b[s:e]], best[s][1] - 1) for s in range(e) if b[s:e] in u.pieces)
        return -best[-1][1]

    memo = {}
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in token_counts.token_counts(sample, RANKS).collect()}
    for i, t in list(texts.items())[:40]:
        ps = pretokens.PATTERN.findall(t or "")
        assert got[i] == (len(ps), sum(memo.setdefault(p, None) or memo.update({p: brute(p)}) or memo[p] for p in ps))
    words = ["a" * 300, "ñ€😀" * 30, " " * 100]
    assert u.counts(words) == [brute(w) for w in words]


def test_token_counts_edges(odd, empty):
    rows = token_counts.token_counts(odd, RANKS).collect()
    assert len(rows) == odd.count() and {r.n_tokens for r in rows if r.doc_id in (0, 1)} == {0}
    assert token_counts.token_counts(empty, RANKS).count() == 0


# --- 2 -------------------------------------------------------------------------------


def test_lm_scores_brute_force(sample, texts):
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    words = {d: [w.encode().lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None] for d, t in texts.items()}
    c, b = collections.Counter(), collections.Counter()
    for d, w in words.items():
        if not held(d):
            c.update(w)
            b.update(zip([None] + w[:-1], w, strict=True))
    n, v = sum(c.values()), len(c)
    counts = np.array(list(c.values()), float)
    mass = [float((counts * (counts + 1) ** -g).sum()) for g in lm_scoring.GRID]
    beta = float(np.interp(-sum(x == 1 for x in b.values()), -np.array(mass), lm_scoring.GRID))

    def p(h, w):
        one = (c[w] + 1) / (n + v + 1)
        u = (c[h] + 1) ** -beta if c[h] else 1.0
        return (1 - u) * (b[h, w] / c[h] if c[h] else 0) + u * one

    got = {r.doc_id: r for r in lm_scoring.score(sample, lm_scoring.held_out_by_id(F.col("doc_id"), 7, 2)).collect()}
    better = 0
    for d, w in words.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(d), len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert r.score == pytest.approx(sum(math.log10(p(h, x)) for h, x in zip([None] + w[:-1], w, strict=True)), rel=1e-9)
        better += held(d) and r.score > r.base_score
    assert better > 0
    h = next(w[0] for w in words.values() if c[w[0]] > 3)
    assert sum(p(h, w) for w in c) + (c[h] + 1) ** -beta / (n + v + 1) == pytest.approx(1)


def test_lm_edges(odd, empty):
    rows = lm_scoring.score(odd, lm_scoring.held_out_by_id(F.col("doc_id"), 7, 2)).collect()
    assert len(rows) == odd.count() and all(math.isfinite(r.score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (0, 1, 2)} == {1} and not any(r.held_out for r in rows if r.doc_id is None)
    assert lm_scoring.score(empty, F.lit(False)).count() == 0
    assert all(r.train_tokens == 0 for r in lm_scoring.score(odd, F.lit(True)).collect())


# --- 3 -------------------------------------------------------------------------------


def words13(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute_hits(text, items):
    w, covered, found = words13(text), set(), set()
    for item, t in items:
        x = words13(t)
        for i in range(max(1, len(x) - 12)) if x else ():
            p = x[i : i + 13]
            for j in range(len(w) - len(p) + 1):
                if w[j : j + len(p)] == p:
                    covered.update(range(j, j + len(p)))
                    found.add(str(item))
    return len(w), len(covered), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(covered) and 20 * len(covered) >= len(w)


@pytest.mark.parametrize("most", [decontamination.MOST_WINDOWS, 0])
def test_decontamination_brute_force(spark, monkeypatch, most):
    """The windows broadcast, and joined by shuffle."""
    monkeypatch.setattr(decontamination, "MOST_WINDOWS", most)
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(60)] + ["the"] * 40
    say = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(n))) for i, n in enumerate([20, 13, 5, 1, 40, 30])] + [(6, None), (7, ""), (8, "the the the"), (8, "the the the")]
    rows = []
    for i in range(60):
        t = say(rnd.choice([0, 3, 30, 200]))
        for item, s in rnd.sample(items, 2):
            x = (s or "").split()
            a = rnd.randrange(len(x) + 1)
            t[rnd.randrange(len(t) + 1) :][:0] = []
            at = rnd.randrange(len(t) + 1)
            t = t[:at] + [w.upper() + "," for w in x[a // 2 :]] + t[at:]
        rows.append((i, " ".join(t)))
    rows += [(100, None), (101, ""), (102, "the " * 3000), (5, "again the id " + items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.apply(docs(spark, rows), bench).collect())
    assert got == collections.Counter((i, *brute_hits(t, items)) for i, t in rows)
    kept = sorted(r.doc_id for r in decontamination.keep(docs(spark, rows), bench).collect())
    assert kept == sorted(i for i, t in rows if not brute_hits(t, items)[4])


def test_shuffled_postings_carry_no_words(spark):
    d = decontamination._rows(docs(spark, [(1, "a b c")]), "text", "doc_id")
    terms = spark.createDataFrame([("a",)], "term string")
    assert decontamination.postings(d, terms, 12, False).columns == ["term", "doc_id", "h", "pos"]
    plan = decontamination.postings(d, terms, 12, False)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode" in plan and "words" not in plan.split("Generate")[0]


def test_decontamination_edges(spark, odd, empty):
    bench = spark.createDataFrame([(1, "null id")], "item_id long, text string")
    rows = decontamination.apply(odd, bench).collect()
    assert len(rows) == odd.count() and [r.n_hit for r in rows if r.doc_id is None and r.n_words] == [2]
    assert decontamination.keep(odd, bench).columns == odd.columns
    assert decontamination.apply(empty, bench).count() == 0
    assert {r.n_hit for r in decontamination.apply(odd, bench.limit(0)).collect()} == {0}


@pytest.mark.parametrize("most", [decontamination.MOST_WINDOWS, 0])
def test_proximity(spark, monkeypatch, most):
    monkeypatch.setattr(decontamination, "MOST_WINDOWS", most)
    bench = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    rows = docs(spark, [(1, "blue x red y green"), (2, "blue " + "x " * 30 + "red green"), (3, "red green")])
    assert [(r.doc_id, r.item_id) for r in decontamination.near(rows, bench, within=5).collect()] == [(1, 1)]


# --- 4 and 10 ------------------------------------------------------------------------


def labelled(spark):
    rnd = random.Random(5)
    good = lambda n: " ".join("".join(rnd.choices("aeioulnrst", k=rnd.randint(2, 8))) for _ in range(n)) + "."
    rows, labels = [], []
    for i in range(600):
        t = good(60)
        bad, toxic = i % 5 == 0, i % 4 == 1
        t = " ".join(w.upper() + "!!" for w in t.split()) if bad else t
        t = t[:100] + " wugglefink " + t[100:] if toxic else t
        rows.append((i, t))
        labels.append((i, int(not bad), int(toxic)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifiers_hold_out(spark):
    d, labels = labelled(spark)
    truth = {r.doc_id: r for r in labels.collect()}
    got = toxicity.score(d, labels, lm_scoring.held_out_by_id(F.col("doc_id"), 3, 1)).filter("held_out").collect()
    assert len(got) > 100 and all(0 <= r.score <= 1 for r in got)
    assert sum(r.predicted == truth[r.doc_id].toxic for r in got) / len(got) > 0.97
    some = labels.filter("doc_id < 300")
    judged = quality_classifier.apply(d, some, F.col("source"), F.col("lang")).filter("doc_id >= 300").collect()
    assert sum(r.kept == bool(truth[r.doc_id].quality) for r in judged) / len(judged) > 0.97
    assert quality_classifier.keep(d, some, F.col("source"), F.col("lang")).columns == d.columns


def test_labelled_sample_is_bounded(spark):
    """One row an id, in rows and in bytes, whatever repeats."""
    rows = [(7, f"text {i % 3}") for i in range(5000)] + [(i, "x" * 1000) for i in range(100, 150)] + [(8, None)]
    labels = spark.createDataFrame([(i, int(i % 2)) for i in [7, 8, *range(100, 150)]], "doc_id long, quality int")
    d = docs(spark, rows)
    texts, y = labelled_sample(d, labels, "quality", F.lit(True), 1000)
    assert len(texts) == len(y) == 52 and texts.count(None) == 1
    assert len(labelled_sample(d, labels, "quality", F.lit(True), 2)[0]) == 2
    assert sum(len(t or "") for t in labelled_sample(d, labels, "quality", F.lit(True), 1000, most_bytes=5000)[0]) <= 5000
    assert labelled_sample(d, labels, "quality", F.col("doc_id") < 0, 10)[0] == []


def test_toxicity_model_brute_force():
    """Log-count ratios and the choice of features against plain counting, and scores against the sum over a text's features."""
    rnd = random.Random(6)
    texts = [" ".join("".join(rnd.choices("abcde", k=rnd.randint(1, 7))) for _ in range(30)) + (" wugglefink" if i % 3 == 0 else "") for i in range(300)]
    y = np.array([float(i % 3 == 0) for i in range(300)])

    def brute(t):
        out = set()
        for w in set(re.findall(r"[^\W\d_]+", t.lower())):
            w = f"<{w}>"
            for n in (3, 4, 5, 6):
                for i in range(len(w) - n + 1):
                    h = 0
                    for c in w[i : i + n]:
                        h = (h * 1_000_003 + ord(c)) % 2**64
                    out.add((h + n) * toxicity.MIX % 2**64 >> 44)
        return out

    sets = [brute(t) for t in texts]
    assert all(set(toxicity.features(t).tolist()) == s for t, s in zip(texts, sets, strict=True))
    toxic, other = collections.Counter(), collections.Counter()
    for s, mark in zip(sets, y, strict=True):
        (toxic if mark else other).update(s)
    ratio = {f: math.log((toxic[f] + 1) / (100 + 2)) - math.log((other[f] + 1) / (200 + 2)) for f in toxic | other}
    sure = {f for f, r in ratio.items() if abs(r) >= 3 * math.sqrt(1 / (toxic[f] + 1) + 1 / (other[f] + 1))}
    model = toxicity.train(texts, y)
    assert set(np.flatnonzero(model.weights).tolist()) <= sure and len(sure) > 5
    for t, s in list(zip(texts, sets, strict=True))[:50]:
        z = sum(float(model.weights[f]) for f in s) + model.bias
        assert model.score(toxicity.features(t)) == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-6)


def test_posteriors_equal_sql(spark):
    """Shrunk means and shifts of hosts and paths, recomputed by SQL."""
    import duckdb
    import pandas as pd

    rnd = random.Random(12)
    rows = [(f"h{rnd.randrange(12)}", f"p{rnd.randrange(4)}", rnd.gauss(0, 3)) for _ in range(3000)] + [("h99", "p0", -8.0), ("h98", None, 2.0), (None, "p1", 1.0)]
    d = pd.DataFrame(rows, columns=["host", "path", "logit"])  # noqa: F841
    strength = "least(1e6, greatest(20.0, case when spread > 0 then wi / spread else 1e6 end))"
    moments = "sum(q - s * s / n) / greatest(sum(n) - count(*), 1) wi, sum(n * (s / n - m) ** 2) be, count(*) k, sum(n) total"
    want = duckdb.sql(f"""
        with p as (select host, path, count(*) n, sum(1 / (1 + exp(-logit))) s, sum((1 / (1 + exp(-logit))) ** 2) q from d group by 1, 2),
        h as (select host, sum(n) n, sum(s) s, sum(q) q from p group by 1),
        g as (select sum(s) / sum(n) m from h),
        kh as (select m, {strength} k from (select m, wi, (be - wi * k) / total spread from (select any_value(m) m, {moments} from h, g))),
        hm as (select host, m, (k * m + s) / (k + n) hm from h, kh),
        ph as (select p.*, hm.m g, hm.hm m from p join hm on p.host is not distinct from hm.host),
        kp as (select {strength} k from (select wi, (be - wi * k) / total spread from (select {moments} from ph))),
        f as (select host, path, greatest(1e-4, least(1 - 1e-4, (k * m + s) / (k + n))) x, greatest(1e-4, least(1 - 1e-4, g)) g from ph, kp)
        select host, path, x, ln(x / (1 - x)) - ln(g / (1 - g)) from f""").fetchall()
    got = {tuple(r)[:2]: tuple(r)[2:] for r in quality_classifier.posteriors(spark.createDataFrame(rows, "host string, path string, logit double")).collect()}
    assert len(got) == len(want) > 40
    for h, p, x, shift in want:
        assert got[h, p] == (pytest.approx(x, rel=1e-9), pytest.approx(shift, rel=1e-7, abs=1e-9))


def test_sites_shrink_towards_the_prior(spark):
    rows = [("big", "p", -2.0)] * 500 + [("big", "q", 2.0)] * 500 + [("small", "r", -2.0)] + [("other", "s", 2.0)] * 1000
    s = {(r.__getitem__("__h"), r.__getitem__("__p")): r.site_posterior for r in quality_classifier.posteriors(spark.createDataFrame(rows, "host string, path string, logit double")).collect()}
    assert s["big", "p"] < s["small", "r"] < s["other", "s"] and s["big", "p"] < s["big", "q"]


def test_classifier_edges(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(4, 1, 0), (4, None, None), (6, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        assert toxicity.score(odd, labels, F.lit(False)).filter("score between 0 and 1").count() == odd.count()
        rows = quality_classifier.apply(odd, labels, F.col("source"), F.col("lang")).collect()
        assert len(rows) == odd.count() and not any(r.kept for r in rows if r.doc_id in (0, 1, 2))
        assert toxicity.score(empty, labels, F.lit(False)).count() == 0
        assert quality_classifier.keep(empty, labels, F.col("source"), F.col("lang")).count() == 0


# --- 5 and 6 -------------------------------------------------------------------------


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    return t, [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_bpe_equals_the_library(spark, sample, odd):
    d = sample.select("doc_id", "text").union(odd.select("doc_id", "text"))
    rows = d.collect()
    t, ids = library([r.text for r in rows])
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = collections.Counter((r.doc_id, len(i), sha(np.array(i, "<u4").tobytes()), sha(t.decode(i, skip_special_tokens=False).encode())) for r, i in zip(rows, ids, strict=True))
    assert collections.Counter(map(tuple, bpe.round_trip(d, JSON).collect())) == want
    codes = [*range(1, 0x3000), *range(0x3000, 0xD800, 13), *range(0xE000, 0x20000, 17)]
    rnd = random.Random(1)
    rare = ["".join(chr(c) for c in codes[i : i + 200]) for i in range(0, len(codes), 200)] + ["".join(rnd.choices("aA '\n\t\xa0é1²!_", k=200)) for _ in range(200)]
    rare += ["".join(rnd.choices(" \n\t\x1c\x85\xa0\u2028\u3000aé.'", weights=[9, 2, 1, 1, 1, 1, 1, 1, 6, 2, 1, 1], k=rnd.randrange(60))) for _ in range(3000)]
    rare += ["  ", " ", "   ", " a", "a  ", "a   b", "\n  b", "b \n c", "a\n \nb", " <|endoftext|>  <|endoftext|> ", None, ""]
    data = pretokens.read_vocabulary(JSON)
    want = library(rare)[1]
    ids, counts = bpe.encode_texts(data, rare)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    # The library gives whole texts what it gives their units.
    assert [np.frombuffer(x, "<u4").tolist() for x in token_files.library_ids(data, rare)] == want
    sliced = pa.array(["zz  ", *rare, "  "]).slice(1, len(rare))
    assert [np.frombuffer(x, "<u4").tolist() for x in token_files.library_ids(data, sliced)] == want
    small = pretokens.IdCache(pretokens.vocabulary(data), bpe.PairIndexEncoder(pretokens.vocabulary(data)).encode, entries=50)
    for at in range(0, len(rare), 300):
        part = rare[at : at + 300]
        ids, counts = small.encode(pa.array(part, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want[at : at + 300]


def test_bpe_general_interface(odd, empty):
    back = {(r.doc_id, r.text) for r in bpe.decode(bpe.encode(odd, JSON), JSON).collect()}
    assert back == {(r.doc_id, r.text or "") for r in odd.collect()}
    assert bpe.round_trip(empty, JSON).count() == 0


def test_token_files(spark, sample, odd, empty):
    for d in (sample, odd):
        rows = sorted(d.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
        got = sorted(token_files.round_trip(d, JSON).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in got] == [r.doc_id for r in rows]
        assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
        want = collections.Counter((r.doc_id, len(i) + 1, zlib.crc32(np.array([*i, 0], "<u4").tobytes())) for r, i in zip(rows, library([r.text for r in rows])[1], strict=True))
        assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert token_files.round_trip(empty, JSON).count() == 0


def test_token_files_keep_their_order_beside_names(spark, sample):
    """More files in a part than Spark's names have digits for: their place comes from the directory."""
    path = shared_dir(spark, "many")
    n = 1100
    token_files.write(spark.createDataFrame([(i, f"w{i}") for i in range(n)], "doc_id long, text string"), path, JSON, file_bytes=1)
    assert seekable.read_files(spark, path).count() == n
    got = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == list(range(n)) and [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(n)]
    rows = spark.createDataFrame([(p, f, p % 7 + f + 1) for p in range(99_998, 100_003) for f in (0, 1)] + [(0, 0, 5), (1024, 0, 3)], "part long, number long, n_tokens long").withColumn("at", F.lit(0))
    starts = [(r.part, r.number, r.start, r.n_tokens) for r in token_files.with_start(rows).orderBy("part", "number").collect()]
    assert [s for *_, s, _ in starts] == [sum(x[3] for x in starts[:i]) for i in range(len(starts))]


def test_ranged_reads(spark):
    path = shared_dir(spark, "ranged")
    texts = [(i, " ".join(f"w{i}x{j}" for j in range(3000))) for i in range(60)]
    token_files.write(spark.createDataFrame(texts, "doc_id long, text string"), path, JSON)
    (file,) = [r.path for r in seekable.read_files(spark, path).select("path").collect()]
    assert token_files.fetch(spark, file, 33) == [x + b"\0\0\0\0" for x in token_files.library_ids(pretokens.read_vocabulary(JSON), [texts[33][1]])]
    reader = seekable.open_remote(spark, file)
    asked = []
    fetch = reader.read
    reader.read = lambda at, size: asked.append(size) or fetch(at, size)
    reader.frame(1)
    assert len(reader) > 2 and asked == [reader.frames[1][1]]
    path = shared_dir(spark, "ranged")
    warc.write(spark.createDataFrame([(i, f"u{i}", f"page {i} " * 20_000) for i in range(20)], "page_id long, url string, html string").coalesce(1), path)
    found = [x for r in seekable.read_files(spark, path).select("path").collect() for x in warc.fetch(spark, r.path, 7)]
    assert [p for _, _, p in found] == [b"page 7 " * 20_000]


def test_token_file_random_access():
    ids = [np.arange(n, dtype="<u4").tobytes() for n in (1, 300_000, 0, 5, 400_000)]
    content = token_files.pack_file([5, 7, None, 9, 9], ids) + seekable.SEEKABLE
    f = token_files.TokenFile(content)
    assert [f.ids(i) for i in (4, 0, 2, 1, 3)] == [ids[i] for i in (4, 0, 2, 1, 3)] and f.find(9) == ids[3:] and f.find(6) == []
    assert len(f.reader) > 2
    broken = bytearray(content)
    at = f.reader.frames[2][0]
    broken[at + f.reader.frames[2][1] // 2] ^= 0xFF
    import zstandard

    with pytest.raises((ValueError, zstandard.ZstdError)):
        seekable.Reader(bytes(broken)).frame(2)


# --- 7 -------------------------------------------------------------------------------


def test_warc(spark):
    page = "<p>" + "x" * 200 + "</p>"
    rows = [(3, "u3", page), (1, "u1", page), (2, None, "short"), (4, "u4", "short"), (5, "u5", None), (6, "u\r\n6", "é" * 60), (7, "u7", "é" * 60), (None, "n", page), (1, "u1", page), (8, "u8", "y" * 2_000_000), (9, "u9", "é" * 49)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = collections.Counter(map(tuple, warc.round_trip(pages).collect()))
    first = {page: 1, "é" * 60: 6}

    def want(i, html):
        b = (html or "").encode()
        r = first.get(html)
        again = r is not None and r != i
        return i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", r if again else None

    assert got == collections.Counter(want(i, h) for i, _, h in rows)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_random_access():
    ids = [warc.record_id(i) for i in range(50)]
    bodies = [(f"page {i} " * 3000).encode() for i in range(50)]
    b = warc.Bundle(warc.pack_bundle(ids, [warc.record(i, f"http://x/{i}", x, "d", "response", None) for i, x in enumerate(bodies)]) + seekable.SEEKABLE)
    (headers, _, payload), *rest = b.find(warc.record_id(33))
    assert payload == bodies[33] and headers["WARC-Target-URI"] == "http://x/33" and not rest and len(b.reader) > 1
    assert [p for _, _, p in b] == bodies


# --- 8 -------------------------------------------------------------------------------


def shingles(t, width):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_components(rows, width, num, den):
    sets = [shingles(t, width) for _, t in rows]
    to = list(range(len(rows)))

    def find(i):
        while to[i] != i:
            i = to[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and den * n >= num * (len(sets[i]) + len(sets[j]) - n):
                to[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i), d)) for i, (d, _) in enumerate(rows)]


def edited_groups(seed, n_groups=25, each=8):
    """Groups of texts with few to many edits, so that similarities lie on both sides of the limit."""
    rnd = random.Random(seed)
    rows = []
    for g in range(n_groups):
        n = rnd.choice([2, 4, 9, 15, 25, 40, 80, 200, 600])
        base = [f"g{g}w{rnd.randrange(5 * n)}" for _ in range(n)]
        for _ in range(each):
            t = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, n // 40, n // 20, n // 10])):
                k = rnd.randrange(len(t))
                t[k : k + rnd.choice([0, 1])] = [f"e{rnd.randrange(10**6)}"] * rnd.choice([0, 1])
                if not t:
                    t = ["e"]
            rows.append((len(rows) * 7 % 1000 + len(rows) // 1000, " ".join(t)))
    return rows


@pytest.mark.parametrize("width,num,den", [(3, 90, 100), (5, 80, 100)])
def test_jaccard_brute_force(spark, width, num, den):
    rows = edited_groups(width) + [(5000, None), (5001, ""), (5002, "one"), (5003, "ONE"), (None, "one"), (5004, "one two")]
    got = collections.Counter(map(tuple, ngram_jaccard.join(docs(spark, rows), width, num, den).collect()))
    want = brute_components(rows, width, num, den)
    assert len({c for _, _, c in want}) < len(rows) - 20
    assert got == collections.Counter(want)
    kept = sorted(r.doc_id for r in ngram_jaccard.keep_one(docs(spark, rows), width, num, den).collect() if r.doc_id is not None)
    assert kept == sorted(d for d, _, c in want if d is not None and d == c)


def test_signatures_lose_no_link():
    """Any two texts over the limit share a signature, whatever the sizes."""
    rnd = random.Random(9)
    for num, den in ((90, 100), (80, 100)):
        for _ in range(150):
            n = rnd.choice([9, 10, 12, 20, 31, 50, 120, 400, 900])
            base = [f"w{rnd.randrange(10**9)}" for _ in range(n)]
            other = list(base)
            for _ in range(rnd.randrange(1, 2 + n * (den - num) // den // 2)):
                k = rnd.randrange(len(other))
                other[k : k + 1] = [f"x{rnd.randrange(10**9)}"] * rnd.choice([0, 1, 2])
            a, b = (shingles(" ".join(t), 1) for t in (base, other))
            if a == b or den * len(a & b) < num * len(a | b):
                continue
            sigs, keys = ngram_jaccard.signatures(ngram_jaccard.Sets([" ".join(base), " ".join(other)], 1), num, den)
            assert set(sigs[keys == keys[0]].tolist()) & set(sigs[keys != keys[0]].tolist()), (num, n)


def test_long_sets_share_no_empty_signature():
    """Unrelated long texts have no signature in common, so they make no candidates."""
    rnd = random.Random(10)
    for num, den in ((90, 100), (80, 100)):
        texts = [" ".join(f"w{rnd.randrange(10**9)}" for _ in range(rnd.randrange(3000, 8000))) for _ in range(40)]
        sigs, keys = ngram_jaccard.signatures(ngram_jaccard.Sets(texts, 1), num, den)
        s, k, (shared, _, _) = ngram_jaccard.star(sigs, keys)
        assert len(set(keys.tolist())) == len(texts)
        assert len(shared) < len(s) // 100, (num, len(shared), len(s))


def test_jaccard_edges(odd, empty):
    got = ngram_jaccard.join(odd, 3, 90, 100).collect()
    assert len(got) == odd.count() and {r.n_shingles for r in got if r.doc_id in (0, 1, 2)} == {0}
    assert ngram_jaccard.join(empty, 3, 90, 100).count() == 0
    assert ngram_jaccard.keep_one(odd, 3, 90, 100).columns == odd.columns


def test_keep_one_of_repeated_rows(spark):
    """Copies without an id and repeated rows: one of each stays; rows without words link to nothing and stay."""
    rows = [(None, "a b c d e f")] * 4 + [(1, "g h i j k l")] * 3 + [(2, "G h i j k l"), (1, "other text of id one")] + [(None, None)] * 2 + [(3, "")] * 2
    kept = ngram_jaccard.keep_one(docs(spark, rows), 3, 90, 100)
    want = [(None, "a b c d e f"), (1, "g h i j k l"), (1, "other text of id one"), (None, None), (None, None), (3, ""), (3, "")]
    assert kept.dtypes == docs(spark, rows).dtypes
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == collections.Counter(want)


def test_components(spark):
    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(200)] + [(1000, x) for x in range(1001, 1100)] + [(rnd.randrange(5000, 5200), rnd.randrange(5000, 5200)) for _ in range(120)]
    links = [(a, b) for a, b in links if a != b]
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    to = {}
    for a, b in links:
        find = lambda x: x if to.setdefault(x, x) == x else find(to[x])
        x, y = find(a), find(b)
        to[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in got} and len(got) == len(to)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n", [400, 1000])
def test_components_of_long_paths(spark, n):
    """Paths whose ids are in no order: the rounds don't grow with their length."""
    ids = list(range(n))
    random.Random(n).shuffle(ids)
    got = sorted(map(tuple, components(spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a long, b long")).collect()))
    assert got == [(i, 0) for i in range(n)]


def test_jaccard_of_many_revisions(spark):
    """Texts that each change one word of the one before are one component, as long as the row of them may be."""
    rows, words = [], [f"w{i}" for i in range(60)]
    for i in range(400):
        words[7 * i % 60] = f"v{i}"
        rows.append((i, " ".join(words)))
    got = ngram_jaccard.join(docs(spark, rows), 3, 90, 100).collect()
    assert sorted(map(tuple, got)) == [(i, 58, 0) for i in range(400)]


def test_jaccard_of_one_large_group(spark, monkeypatch):
    """Near copies of one text, of which the smallest classes lie at the edge: pairs to verify grow with the group, not with its square."""
    rnd = random.Random(12)
    base = [f"w{i}" for i in range(150)]

    def copy(edits):
        words = list(base)
        for k in rnd.sample(range(150), edits):
            words[k] = f"e{rnd.randrange(10**9)}"
        return " ".join(words)

    def keyed(n, edits):
        texts = [copy(edits) for _ in range(n)]
        return [t for _, t in sorted(zip(ngram_jaccard.Sets(texts, 5).keys.tolist(), texts, strict=True))]

    far = keyed(1200, 4)
    limit = int(ngram_jaccard.Sets(far, 5).keys[60])
    near = [t for t in keyed(200, 1) if int(ngram_jaccard.Sets([t], 5).keys[0]) > limit]
    texts = far[:60] + near
    rows = list(enumerate(texts))
    seen, met = [], []
    verify, across = ngram_jaccard.verify, ngram_jaccard._across

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return verify(pairs, *rest)

    def counted_across(*given):
        out = across(*given)
        met.append(out.count())
        return out

    monkeypatch.setattr(ngram_jaccard, "verify", counted)
    monkeypatch.setattr(ngram_jaccard, "_across", counted_across)
    got = collections.Counter(map(tuple, ngram_jaccard.join(docs(spark, rows).coalesce(1), 5, 80, 100).collect()))
    assert got == collections.Counter(brute_components(rows, 5, 80, 100))
    assert max(collections.Counter(c for _, _, c in got).values()) >= len(near) > 100
    assert sum(seen) < 5 * len(texts) and sum(met) < 5 * len(texts)


def test_pairs_across_components_meet_about_once(spark):
    """Pairs of classes that share many signatures come out of the join a few times, none is lost."""
    rnd = random.Random(13)
    rows = [(sig, a, a, 100, [0] * ngram_jaccard.SKETCH) for sig in range(60) for a in range(1, 21) if rnd.random() < 0.8]
    inside = spark.createDataFrame(rows, "sig long, a long, comp long, na long, sa array<long>")
    split = inside.join(ngram_jaccard._ranks(inside.select("sig", "a")).select("a", "lowest"), "a")
    pairs = [tuple(r) for r in ngram_jaccard._met(split, 80, 100).collect()]
    assert set(pairs) == {(a, b) for a in range(1, 21) for b in range(a + 1, 21)}
    assert len(pairs) < 3 * len(set(pairs))


# --- 9 -------------------------------------------------------------------------------


def brute_metrics(text):
    t = text or ""
    w = WORD.findall(t)
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines, dup = set(), 0
    for x in t.split("\n"):
        if WORD.search(x):
            dup += x in lines
            lines.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_quality_brute_force(spark, sample, odd):
    d = sample.select("doc_id", "text", "lang", "source").union(odd.select("doc_id", "text", "lang", "source"))
    r = quality_rules.apply(d)
    got = collections.Counter((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in r.collect())
    assert got == collections.Counter((x.doc_id, *brute_metrics(x.text)) for x in d.collect())
    assert r.filter("base_failed and kept").count() == 0


def test_quality_keeps_clean_and_rejects_junk(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(600):
        words = ["".join(rnd.choices("aeioulnrst", k=rnd.randint(2, 8))) for _ in range(80)]
        rows.append((i, " ".join(w + "***" for w in words) if i % 20 == 0 else " ".join(words)))
    kept = {r.doc_id for r in quality_rules.keep(docs(spark, rows)).collect()}
    assert kept == {i for i, _ in rows if i % 20}


def brute_kept(rows, least=200):
    """Verdicts of (key, lang, source, shares of quality_rules) by exact quantiles."""
    def q(values, p):
        v = sorted(values)
        return v[max(0, math.ceil(p * len(v) - 1e-9) - 1)]

    def pick(group, of):
        fine, mid, top = ([r for r in of if r["lang"] == group[0] and r["source"] == group[1]], [r for r in of if r["lang"] == group[0]], of)
        return fine, mid, top, fine if len(fine) >= least else mid if len(mid) >= least else top

    def widest(levels, distance):
        _, mid, top, own = levels
        w = max(distance(own), distance(mid) if len(mid) >= least else 0)
        return w if w > 0 else distance(top)

    passed = [r for r in rows if not r["base_failed"]]
    groups = {(r["lang"], r["source"]) for r in passed}
    core = []
    for g in groups:
        levels = pick(g, passed)
        inside = levels[0]
        for m in quality_rules.SPREAD:
            middle = q([r[m] for r in levels[3]], 0.5)
            w = 2 * widest(levels, lambda x: q([r[m] for r in x], 0.75) - q([r[m] for r in x], 0.25))
            inside = [r for r in inside if middle - w <= r[m] <= middle + w]
        core += inside
    limits = {}
    for g in {(r["lang"], r["source"]) for r in core}:
        levels = pick(g, core)
        for m, (_, sides) in quality_rules.METRICS.items():
            for side in sides:
                tail, sign = (0.99, 1) if side == "max" else (0.01, -1)
                w = widest(levels, lambda x: sign * (q([r[m] for r in x], tail) - q([r[m] for r in x], 0.5)))
                limits[(*g, m, side)] = q([r[m] for r in levels[3]], 0.5) + sign * 4 * w if w > 0 else None
    kept = set()
    for r in passed:
        ok = True
        for m, (judged, sides) in quality_rules.METRICS.items():
            for side in sides:
                at = limits.get((r["lang"], r["source"], m, side))
                ok &= at is None or (r[judged] <= at if side == "max" else r[judged] >= at)
        if ok:
            kept.add(r["doc_id"])
    return kept, limits


def test_quality_verdicts_brute_force(spark):
    """Groups with different texts get different limits, which exact quantiles confirm, and the verdicts follow."""
    rnd = random.Random(8)
    rows = []
    for i in range(1500):
        lang, source = ("en", "s0") if i < 600 else ("en", f"s{1 + i % 2}") if i < 1400 else ("fr", "s0")
        letters = (2, 8) if lang == "fr" or source == "s0" else (3, 12)
        words = ["".join(rnd.choices("aeioulnrst", k=rnd.randint(*letters))) for _ in range(rnd.randint(15, 150))]
        if i % 11 == 0:
            words = [w + "#*"[: rnd.randrange(3)] for w in words]
        if i % 13 == 0:
            words = words[:8] * (len(words) // 8 + 1)
        rows.append((i, " ".join(words).capitalize() + "." + "\nsame line" * rnd.choice([0, 0, 0, 1, 2]), lang, source))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = [r.asDict() for r in quality_rules.apply(d).collect()]
    kept, limits = brute_kept(got)
    assert {r["doc_id"] for r in got if r["kept"]} == kept and 0 < len(kept) < sum(not r["base_failed"] for r in got)
    assert sorted(r.doc_id for r in quality_rules.keep(d).collect()) == sorted(kept)
    found = {(r["lang"], r["source"]): r for r in got}
    for (lang, source, m, side), at in limits.items():
        have = found[lang, source][f"{m}_{side}"]
        assert (have is None) == (at is None) and (at is None or have == pytest.approx(at))
    for m in ("symbol_noise", "mean_word_chars", "upper_share"):
        assert len({limits["en", s, m, "max"] for s in ("s0", "s1", "s2")}) > 1


def test_quality_of_a_group_of_copies(spark):
    """A source of near copies has no spread of its own: its other documents are not lost."""
    rnd = random.Random(3)
    say = lambda: " ".join("".join(rnd.choices("aeioulnrst", k=rnd.randint(2, 9))) for _ in range(60)).capitalize()
    copy = say()
    rows = [(i, copy if i < 700 else say(), "en", "s0" if i < 800 else "s1") for i in range(1300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert quality_rules.keep(d).count() == len(rows)


def test_native_plans_hold_no_python(spark, sample, monkeypatch):
    """Every plan of op3 and op9, those of the files they write included."""
    plans = []

    def seen(df, name):
        plans.append(df._jdf.queryExecution().toString())
        return stash(df, name)

    monkeypatch.setattr(quality_rules, "stash", seen)
    monkeypatch.setattr(decontamination, "stash", seen)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    plans += [df._jdf.queryExecution().toString() for df in (quality_rules.apply(sample), quality_rules.keep(sample), decontamination.apply(sample, bench), decontamination.keep(sample, bench))]
    assert sum("documents.parquet" in p and "text" in p for p in plans) >= 4
    assert not any("Python" in p or "Arrow" in p for p in plans)


def test_quality_edges(spark, odd, empty):
    assert quality_rules.apply(odd).count() == odd.count() and quality_rules.apply(empty).count() == 0
    nulls = odd.withColumn("lang", F.lit(None).cast("string"))
    assert quality_rules.apply(nulls).count() == odd.count() and quality_rules.keep(nulls).columns == odd.columns


# --- files ---------------------------------------------------------------------------


def test_seekable_files_through_spark(spark):
    path = shared_dir(spark, "test")
    frames = [[b"a" * 1000, b"", bytes(range(256))], [b"\x00\xff\n" * 99]]
    seekable.write_files(spark.createDataFrame([(bytearray(seekable.pack(f)),) for f in frames], "file binary").coalesce(1), path)
    got = [[r.frame(i) for i in range(len(r))] for r in (seekable.Reader(bytes(x.content)) for x in seekable.read_files(spark, path).orderBy("path").collect())]
    assert got == frames
