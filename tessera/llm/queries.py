"""The queries that apply the operators to their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, lm_scoring, ngram_jaccard, quality_classifier, quality_rules, token_counts, token_files, toxicity, warc


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_table(spark, sf_dir, "documents"), lm_scoring.held_out_by_id(F.col("doc_id"), 7, 2))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.apply(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, path = F.col("source"), F.concat_ws("/", "source", "lang")
    return quality_classifier.apply(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), host, path)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.join(_table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = lm_scoring.held_out_by_id(F.col("doc_id"), 3, 1)
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), held_out)


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_token_counts, op2_lm_scoring, op3_decontamination, op4_quality_classifier, op5_bpe, op6_token_files, op7_warc, op8_ngram_jaccard, op9_quality_rules, op10_toxicity,
    )}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that SQL can express."""
    return {
        "op3_decontamination": f"""
            with d as (select doc_id, {_WORDS} w from documents),
            b as (select item_id, {_WORDS} w from benchmark),
            win as (select distinct item_id, w[i:i + 12] p from (select item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) i from b where len(w) > 0)),
            lens as (select distinct len(p) l from win),
            dw as (select doc_id, i, l, w[i:i + l - 1] p from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) i from d, lens)),
            m as (select doc_id, i, l, item_id from dw join win using (p)),
            h as (select doc_id, count(distinct pos) n_hit from (select doc_id, unnest(range(i, i + l)) pos from m) group by 1),
            n as (select doc_id, count(distinct item_id) n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) items from m group by 1)
            select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256,
                   coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
            from d left join h using (doc_id) left join n using (doc_id)""",
        "op7_warc": """
            with p as (select page_id, coalesce(html, '') h from pages),
            f as (select page_id, h, min(page_id) over (partition by h) first from p)
            select page_id, strlen(h)::bigint payload_bytes, sha256(h) payload_digest,
                   case when strlen(h) >= 100 and page_id <> first then 'revisit' else 'response' end record_type,
                   case when strlen(h) >= 100 and page_id <> first then first end refers_to
            from f""",
        "op8_ngram_jaccard": f"""
            with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') w from documents),
            s as (select distinct doc_id, w[i:i + 2] g from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) i from d where len(w) > 0)),
            c as (select doc_id, count(*) n from s group by 1),
            k as (select x.doc_id a, y.doc_id b, count(*) k from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
            l as (select a, b from k join c ca on ca.doc_id = a join c cb on cb.doc_id = b where 100 * k >= 90 * (ca.n + cb.n - k)),
            r(doc_id, comp) as (select doc_id, doc_id from d union select l.b, r.comp from r join l on l.a = r.doc_id)
            select doc_id, coalesce(n, 0) n_shingles, component_id from (select doc_id, min(comp) component_id from r group by 1) left join c using (doc_id)""",
    }
