"""Benchmark decontamination by a positional inverted index, in DataFrame functions only.

Test items are cut into windows of 13 consecutive words (shorter items are one
window). The index holds postings (term, document, position) of the training
tokens; how often each test term occurs is counted over all documents, and for each
window the postings of its two rarest terms are kept. The lists, adjusted by the
terms' offsets in the window, are intersected from the rarest on; what is left of
the window is compared at the starts that remain. Words of a document inside any
occurrence are hit. ``near`` finds documents in which a window's terms stand
within a given distance of its rarest one, in any order.

The windows are written to the shared folder first and counted: up to MOST_WINDOWS
they, their terms and anchors are broadcast; beyond, tokens are joined by shuffle as (term,
document, position) only, and a document's words are fetched where both lists of a window meet.

Defined results: null and empty texts have no words and no hit; null items and
items without words have no windows; a null item_id counts as no item in n_items
and items_sha256 but its words are hit; rows with the same doc_id are judged by their own
texts; texts of any length are read whole; of equally rare terms those first in order of their
letters are taken, which changes no result; repeated rows are judged alike; extra columns are ignored; empty tables
give an empty result or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stash

#: What stands between words, after A-Z are lower-cased and before.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Most windows (13 words each) that are broadcast.
MOST_WINDOWS = 200_000


def words(text: str) -> Column:
    """A split costs half of what extracting the words does; only its first and last part can be empty."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), BETWEEN), "")


def n_words(text: str) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), RAW_BETWEEN), ""))


def windows(items: DataFrame, width: int, text_col: str = "text", key_col: str = "item_id") -> DataFrame:
    """(item_id, phrase, length): the distinct windows of each item."""
    w = items.select(F.col(key_col).alias("item_id"), words(text_col).alias("words")).filter(F.size("words") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - width + 1))).alias("start")
    cut = w.select("item_id", "words", starts).select("item_id", F.slice("words", F.col("start"), F.lit(width)).alias("phrase"))
    return cut.distinct().withColumn("length", F.size("phrase"))


def _small(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def _tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, h, words, pos, term): one row for each token, pos from 0."""
    return docs.select("doc_id", "h", words("text").alias("words")).select("doc_id", "h", "words", F.posexplode("words").alias("pos", "term"))


def term_counts(docs: DataFrame, terms: DataFrame, small: bool) -> DataFrame:
    """(term, n) of the test terms over all documents."""
    tokens = _tokens(docs).select("term")
    if small:
        return tokens.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return tokens.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(terms, "term", "left_semi")


def anchors(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """(phrase, length, term1, offset1, term2, offset2): each window's rarest terms, if all of its terms occur.

    A window with one distinct term has its rarest one twice.
    """
    terms = phrases.select("phrase", "length", F.posexplode("phrase").alias("offset", "term"))
    first = terms.groupBy("phrase", "length", "term").agg(F.min("offset").alias("offset"))
    ranked = first.join(counts, "term", "left").groupBy("phrase", "length").agg(
        F.bool_and(F.col("n").isNotNull()).alias("all"), F.array_sort(F.collect_list(F.struct("n", "term", "offset"))).alias("by")
    )
    second = F.element_at("by", F.least(F.lit(2), F.size("by")))
    return ranked.filter("all").select(
        "phrase", "length", F.col("by")[0]["term"].alias("term1"), F.col("by")[0]["offset"].alias("offset1"), second["term"].alias("term2"), second["offset"].alias("offset2")
    )


def postings(docs: DataFrame, terms: DataFrame, reach: int, small: bool) -> DataFrame:
    """(term, doc_id, h, pos) of ``terms``; if ``small`` also the words up to ``reach`` before and after, ``around`` from ``from_pos`` on."""
    if not small:
        return _tokens(docs).select("term", "doc_id", "h", "pos").join(terms, "term", "left_semi")
    return _around(_tokens(docs).join(F.broadcast(terms), "term", "left_semi"), reach, "term", "doc_id", "h", "pos")


def _around(hit: DataFrame, reach: int, *keep: str) -> DataFrame:
    start = F.greatest(F.col("pos") - reach, F.lit(0))
    around = F.slice("words", start + 1, F.col("pos") - start + reach + 1)
    return hit.select(*keep, start.alias("from_pos"), around.alias("around"))


def _with_words(found: DataFrame, docs: DataFrame) -> DataFrame:
    """``found`` (doc_id, h, ...) with the documents' words."""
    texts = docs.select(F.col("doc_id").alias("__doc"), F.col("h").alias("__hash"), words("text").alias("words"))
    return found.join(texts, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("h") == F.col("__hash"))).drop("__doc", "__hash")


def _prepared(docs: DataFrame, items: DataFrame, width: int) -> tuple[DataFrame, DataFrame, bool]:
    """Windows and anchors, written, and whether they are few."""
    cut = stash(windows(items, width), "windows")
    terms = stash(cut.select(F.explode("phrase").alias("term")).distinct(), "terms")
    small = cut.count() <= MOST_WINDOWS
    counts = stash(term_counts(docs, terms, small), "termcounts")
    return cut, stash(anchors(cut.select("phrase", "length").distinct(), counts), "anchors"), small


def matches(docs: DataFrame, anchored: DataFrame, width: int, small: bool) -> DataFrame:
    """(doc_id, h, start, length, phrase): every occurrence of a window."""
    terms = anchored.select(F.col("term1").alias("term")).union(anchored.select("term2")).distinct()
    index = stash(postings(docs, terms, width - 1, small), "postings")
    lists = [
        index.join(_small(anchored.select("phrase", "length", F.col(f"term{i}").alias("term"), F.col(f"offset{i}").alias("offset")), small), "term").withColumn("start", F.col("pos") - F.col("offset"))
        for i in (1, 2)
    ]
    rare, other = lists[0], lists[1].select(F.col("doc_id").alias("d2"), F.col("h").alias("h2"), F.col("start").alias("s2"), F.col("phrase").alias("p2"))
    both = rare.join(other, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")) & (F.col("start") == F.col("s2")) & (F.col("phrase") == F.col("p2")), "left_semi")
    if not small:
        same = F.slice("words", F.greatest("start", F.lit(0)) + 1, F.col("length")) == F.col("phrase")
        return _with_words(both.filter("start >= 0").select("doc_id", "h", "start", "length", "phrase").distinct(), docs).filter(same).drop("words").distinct()
    at = F.col("start") - F.col("from_pos")
    found = both.filter((at >= 0) & (F.slice("around", F.greatest(at, F.lit(0)) + 1, F.col("length")) == F.col("phrase")))
    return found.select("doc_id", "h", "start", "length", "phrase").distinct()


def near(docs: DataFrame, items: DataFrame, width: int = 13, within: int = 20, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """(doc_id, item_id): documents with all terms of one of the item's windows within ``within`` words of its rarest term."""
    rows = _rows(docs, text_col, key_col)
    cut, anchored, small = _prepared(rows, items, width)
    index = postings(rows, anchored.select(F.col("term1").alias("term")).distinct(), within, small)
    index = index if small else _around(_with_words(index, rows), within, "term", "doc_id")
    pairs = index.join(_small(anchored.select("phrase", F.col("term1").alias("term")), small), "term")
    found = pairs.filter(F.size(F.array_except("phrase", "around")) == 0).select("doc_id", "phrase").distinct()
    return found.join(cut.select("item_id", "phrase"), "phrase").select("doc_id", "item_id").distinct()


def _rows(docs: DataFrame, text_col: str, key_col: str) -> DataFrame:
    return docs.select(F.col(f"`{key_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).withColumn("h", F.xxhash64("text"))


def hits(docs: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """(doc_id, h, n_hit, items) of the documents with an occurrence; items are sorted ids as strings."""
    cut, anchored, small = _prepared(docs, items, width)
    found = stash(matches(docs, anchored, width, small), "matches")
    end = F.col("start") + F.col("length")
    # A document's occurrences in order: each adds the words past the furthest end before it.
    ahead = Window.partitionBy("doc_id", "h").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("doc_id", "h", "start", "length").distinct().withColumn("before", F.coalesce(F.max(end).over(ahead), F.lit(0)))
    covered = spans.groupBy("doc_id", "h").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "before"))).cast("long").alias("n_hit"))
    by_phrase = cut.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), "phrase")
    named = found.join(_small(by_phrase, small), "phrase").groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("item")).alias("items"))
    named = named.select(F.col("doc_id").alias("d2"), F.col("h").alias("h2"), "items")
    return covered.join(named, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")), "left").select("doc_id", "h", "n_hit", "items")


def apply(docs: DataFrame, items: DataFrame, width: int = 13, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    rows = _rows(docs, text_col, key_col)
    hit = stash(hits(rows, items, width), "hits").withColumnsRenamed({"doc_id": "d2", "h": "h2"})
    counted = rows.select("doc_id", "h", n_words("text").cast("long").alias("n_words"))
    joined = counted.join(hit, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    names = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def keep(docs: DataFrame, items: DataFrame, width: int = 13, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with their own columns only."""
    rows = _rows(docs, text_col, key_col)
    hit = hits(rows, items, width).withColumnsRenamed({"doc_id": "__d", "h": "__h"}).select("__d", "__h", F.col("n_hit").alias("__n_hit"))
    found = stash(hit, "hits")
    same = F.col(f"`{key_col}`").eqNullSafe(F.col("__d")) & (F.xxhash64(f"`{text_col}`") == F.col("__h"))
    return docs.join(found, same & (20 * F.col("__n_hit") >= n_words(f"`{text_col}`")), "left_anti")
