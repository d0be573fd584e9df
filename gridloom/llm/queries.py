"""The operators applied to whole tables, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, classifier, embed_dedup, jaccard, linededup, packing, quality_rules, sharding, suffix_dedup, warc
from .store import Scratch, read, ship_by_value

ship_by_value()


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.lengths(read(spark, sf_dir, "documents")), Scratch(spark, "op1"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"), Scratch(spark, "op2"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), Scratch(spark, "op3"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(read(spark, sf_dir, "embeddings"), Scratch(spark, "op4"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.dedup_passages(docs, Scratch(spark, "op5"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return linededup.dedup_lines(docs, Scratch(spark, "op6")).select("doc_id", "n_lines", "lines_removed", "words_removed", "text")


def op7_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write(read(spark, sf_dir, "pages"), Scratch(spark, "op7")).index()


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), Scratch(spark, "op8"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), Scratch(spark, "op9"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # says where the vocabulary files are

    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), Scratch(spark, "op10"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_ngram_jaccard, op3_quality_classifier, op4_embedding_dedup, op5_suffix_dedup, op6_line_dedup, op7_warc_archive, op8_quality_rules, op9_sharding, op10_bpe)}

_SPACE = r"[\x20\x09-\x0D]+"
ORACLES: dict[str, str] = {
    "op6_line_dedup": rf"""
with t as (select doc_id, text, coalesce(source, '') as s, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, s, unnest(ls) as line, unnest(range(len(ls))) as i from t),
w as (select *, regexp_replace(line, '^{_SPACE}|{_SPACE}$', '', 'g') as bare, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n from l),
b as (select bare from w where n >= {linededup.MIN_WORDS} group by bare having count(distinct s) >= {linededup.MIN_SITES}),
m as (select w.*, n >= {linededup.MIN_WORDS} and bare in (select bare from b) as gone from w),
d as (select doc_id, count(*) as n_lines, count(*) filter (where gone) as k, coalesce(sum(n) filter (where gone), 0) as cut, sum(n) as total, string_agg(line, chr(10) order by i) filter (where not gone) as rest from m group by doc_id)
select t.doc_id, n_lines, case when cut = total then 0 else k end as lines_removed, cast(case when cut = total then 0 else cut end as bigint) as words_removed, case when cut = 0 or cut = total then text else rest end as text from t join d using (doc_id)""",
    "op7_warc_archive": f"""
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, strlen(h) as n, sha1(h) as x, max(page_id) over (partition by h) as last from p)
select page_id, cast(n as bigint) as payload_bytes,
  array_to_string(list_transform(range(32), lambda j: substr('{warc.BASE32}', cast(((cast('0x' || substr(x, 1 + 10 * (j // 8), 10) as bigint) >> cast(35 - 5 * (j % 8) as int)) & 31) + 1 as int), 1)), '') as payload_digest,
  case when page_id = last then 'response' else 'revisit' end as record_type, case when page_id <> last then last end as refers_to, true as verified from d""",
}
