"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each document gets metrics (symbol share, repeated lines, repeated 8-word
windows, mean word length, share of capitals). Limits come from mergeable KLL
sketches of each metric per language and source, which are merged into the
language's and those into the whole corpus's, in two rounds:

1. Of the documents that pass the base rule, the quartiles of the metrics with
   a spread (SPREAD) give each group a core: the documents within CORE times the quartiles'
   distance of the medians. Junk that the base rule leaves is outside of it.
2. Of the core's documents a metric's median and its tail quantiles (TAIL and
   1 - TAIL) give the limit ``median + STRETCH * (tail - median)``, on the low side
   likewise. The median is that of the finest of source, language and corpus with
   ``least_docs`` documents; the distance to the tail is the largest of that level's and those above
   it up to the language, so that a group of near copies, which has next to no tail, loses no other document.

Sketches of symbols count one more than each text has (``symbol_noise``), so that texts without any,
which are most, have a spread too: what one symbol weighs in texts of their lengths. The limit is held against the
plain share, so a text without symbols never exceeds it. A metric whose
tail is its median in all these levels has no scale and sets no limit. The limits are
joined to the metrics; a document beyond any limit is rejected.

KLL sketches of more than SKETCH_K values are random within a rank error of about
0.3 %: verdicts of documents at a limit may differ when run again. With fewer they are exact.

Defined results: a null or empty text has no words and fails the base rule; texts of any length are
counted whole; a value at a limit passes; null
language or source is a group of its own; repeated rows are judged alike; an
empty table gives an empty table; extra columns, whatever their names, are ignored by ``apply`` and stay as they are in ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_keys, stash, without

#: What separates words, and the characters that count as symbols.
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Metric that is sketched -> the column that its limits are held against, and the sides on which it can be bad.
METRICS = {
    "symbol_noise": ("symbol_share", ("max",)),
    "dup_line_share": ("dup_line_share", ("max",)),
    "repeat_share": ("repeat_share", ("max",)),
    "mean_word_chars": ("mean_word_chars", ("max", "min")),
    "upper_share": ("upper_share", ("max",)),
}
#: Metrics that differ between any two texts: they tell the core.
SPREAD = ("mean_word_chars", "upper_share", "symbol_noise")
CORE, TAIL, STRETCH = 2.0, 0.99, 4.0
SKETCH_K = 1600


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def _repeat_words(words: str, width: int) -> Column:
    """Words in windows of ``width`` words that occur twice or more in the array column ``words``."""
    windows = f"transform(sequence(1, size({words}) - {width - 1}), i -> xxhash64(slice({words}, i, {width})))"
    # Sorted by hash, windows that occur again stand side by side; only those positions go on.
    again = f"""
        with_hash -> transform(
            filter(
                transform(with_hash, (x, i) -> struct(
                    x.pos as pos,
                    (i > 0 and with_hash[greatest(i - 1, 0)].h = x.h)
                      or (i < size(with_hash) - 1 and with_hash[least(i + 1, size(with_hash) - 1)].h = x.h) as twice)),
                y -> y.twice),
            y -> y.pos)"""
    hashes = f"array_sort(transform({windows}, (h, i) -> struct(h as h, i as pos)))"
    positions = f"element_at(transform(array({hashes}), {again}), 1)"
    # Covered words: each repeated window adds what reaches past the one before it.
    covered = f"""
        aggregate(array_sort({positions}), struct(0L as n, -1 as upto),
            (a, p) -> struct(
                a.n + p + {width} - greatest(p, a.upto) as n,
                p + {width} as upto),
            a -> a.n)"""
    return F.expr(f"""
        case when size({words}) < {width + 1} then 0L
             when size(array_distinct({windows})) = size({words}) - {width - 1} then 0L
             else {covered} end""")


def metrics(docs: DataFrame, text_col: str = "text", carry: list[Column] | None = None) -> DataFrame:
    """``carry`` columns and each document's counts: one pass over the texts, no shuffle."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(*(carry or []), text.alias("__text"), _words(F.col(f"`{text_col}`")).alias("__words"))
    lines = F.filter(F.split(F.col("__text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    has_dup = F.instr("__text", "\n") > 0
    counted = base.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.char_length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.regexp_count("__text", F.lit(SYMBOLS)).cast("long"),
            "n_upper": F.regexp_count("__text", F.lit("[A-Z]")).cast("long"),
            "n_lines": F.when(has_dup, F.size(lines)).otherwise((F.size("__words") > 0).cast("int")).cast("long"),
            "n_dup_lines": F.when(has_dup, F.size(lines) - F.size(F.array_distinct(lines))).otherwise(0).cast("long"),
            "n_repeat_words": _repeat_words("__words", 8),
        }
    )
    return counted.drop("__text", "__words")


def _shares(m: DataFrame) -> DataFrame:
    chars = F.greatest("word_chars", F.lit(1))
    words = F.greatest("n_words", F.lit(1))
    return m.withColumns(
        {
            "symbol_share": F.col("n_symbols") / chars,
            "symbol_noise": (F.col("n_symbols") + 1) / (F.col("word_chars") + 1),
            "dup_line_share": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
            "repeat_share": F.col("n_repeat_words") / words,
            "mean_word_chars": F.col("word_chars") / words,
            "upper_share": F.col("n_upper") / chars,
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        }
    )


def sketches(shares: DataFrame, metrics: tuple[str, ...] = tuple(METRICS)) -> DataFrame:
    """A mergeable quantile sketch of each metric per (language, source)."""
    return shares.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *(F.expr(f"kll_sketch_agg_double({m}, {SKETCH_K})").alias(m) for m in metrics))


def levels(by_source: DataFrame, quantiles: tuple[float, ...], metrics: tuple[str, ...] = tuple(METRICS)) -> DataFrame:
    """One row per (language, source): for each metric and level (fine, mid, top) its quantiles, and the level's n.

    Sketches are merged upwards: sources into languages into the corpus.
    """
    merged = [F.sum("n").alias("n"), *(F.expr(f"kll_merge_agg_double({m})").alias(m) for m in metrics)]

    def read(level: DataFrame, tag: str, cols: list) -> DataFrame:
        found = [F.expr(f"""case when n > 0 then array({", ".join(f"kll_sketch_get_quantile_double({m}, {q}D)" for q in quantiles)}) end""").alias(f"{m}_{tag}") for m in metrics]
        return level.select(*cols, F.col("n").alias(f"n_{tag}"), *found)

    fine = read(by_source, "fine", [F.col("lang").alias("__lang"), F.col("source").alias("__source")])
    by_lang = by_source.groupBy("lang").agg(*merged)
    mid = read(by_lang, "mid", [F.col("lang").alias("__of")])
    top = read(by_lang.groupBy(F.lit(1).alias("__one")).agg(*merged), "top", ["__one"])
    joined = fine.join(mid, F.col("__lang").eqNullSafe(F.col("__of")), "left").drop("__of")
    return joined.withColumn("__one", F.lit(1)).join(top, "__one", "left").drop("__one")


def _finest(column: str, least_docs: int) -> Column:
    """A column's value at the finest level with enough documents."""
    return F.when(F.col("n_fine") >= least_docs, F.col(f"{column}_fine")).when(F.col("n_mid") >= least_docs, F.col(f"{column}_mid")).otherwise(F.col(f"{column}_top"))


def _widest(column: str, distance, least_docs: int) -> Column:
    """The largest distance of the finest level with enough documents and of the language's; the corpus's where that is 0."""
    own = F.greatest(distance(_finest(column, least_docs)), F.when(F.col("n_mid") >= least_docs, distance(F.col(f"{column}_mid"))))
    return F.when(own > 0, own).otherwise(distance(F.col(f"{column}_top")))


def cores(quartiles: DataFrame, least_docs: int = 200) -> DataFrame:
    """(__lang, __source, lower and upper bound of the core for each metric of SPREAD)."""
    out = []
    for m in SPREAD:
        middle, width = _finest(m, least_docs)[1], CORE * _widest(m, lambda q: q[2] - q[0], least_docs)
        out += [(middle - width).alias(f"{m}_from"), (middle + width).alias(f"{m}_to")]
    return quartiles.select("__lang", "__source", *out)


def thresholds(shares: DataFrame, least_docs: int = 200) -> DataFrame:
    """One row per (__lang, __source) of the documents that pass the base rule: ``<metric>_min`` and ``<metric>_max``, null for no limit."""
    passed = shares.filter(~F.col("base_failed"))
    bounds = stash(cores(levels(sketches(passed, SPREAD), (0.25, 0.5, 0.75), SPREAD), least_docs), "cores")
    inside = F.lit(True)
    for m in SPREAD:
        inside = inside & F.col(m).between(F.col(f"{m}_from"), F.col(f"{m}_to"))
    core = passed.join(bounds, _same_group()).filter(inside).select("lang", "source", *METRICS)
    found = levels(sketches(core), (1 - TAIL, 0.5, TAIL))
    limits = []
    for m, (_, sides) in METRICS.items():
        for side, sign, tail in (("min", -1, 0), ("max", 1, 2)):
            width = _widest(m, lambda q, t=tail, s=sign: s * (q[t] - q[1]), least_docs)
            limit = F.when(width > 0, _finest(m, least_docs)[1] + sign * STRETCH * width) if side in sides else F.lit(None).cast("double")
            limits.append(limit.alias(f"{m}_{side}"))
    return found.select("__lang", "__source", *limits)


def _same_group() -> Column:
    return F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))


def judge(shares: DataFrame, limits: DataFrame) -> DataFrame:
    """Join each document with its group's limits; ``kept`` is the verdict."""
    within = ~F.col("base_failed")
    for m, (judged, _) in METRICS.items():
        within = within & F.coalesce(F.col(judged) >= F.col(f"{m}_min"), F.lit(True)) & F.coalesce(F.col(judged) <= F.col(f"{m}_max"), F.lit(True))
    return shares.join(limits, _same_group(), "left").withColumn("kept", within)


def _names(keys: tuple[str, str]) -> list[Column]:
    return [F.col(f"`{keys[0]}`").alias("lang"), F.col(f"`{keys[1]}`").alias("source")]


def apply(docs: DataFrame, text_col: str = "text", key_col: str = "doc_id", keys: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """Metrics and verdict of every document.

    The metrics (a few numbers a document) are written once and read for the
    sketches and for the verdicts; texts are read once.
    """
    shares = stash(_shares(metrics(docs, text_col, [F.col(f"`{key_col}`").alias("doc_id"), *_names(keys)])), "quality")
    return judge(shares, stash(thresholds(shares), "limits"))


def keep(docs: DataFrame, text_col: str = "text", keys: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only, whatever those are named.

    A verdict follows from the text, language and source alone. These are hashed and
    the hashes written with the metrics, which are counted once; the rows whose hashes
    are rejected are then taken out.
    """
    keys_ = row_keys(*(F.col(f"`{c}`") for c in (text_col, *keys)))
    shares = stash(_shares(metrics(docs, text_col, [keys_[0].alias("__k1"), keys_[1].alias("__k2"), *_names(keys)])), "quality")
    return without(docs, keys_, judge(shares, stash(thresholds(shares), "limits")).filter("not kept"))
