"""A training corpus from documents: rules, lines, near-duplicates, passages, packing.

Every stage takes (spark, docs, sf_dir) and returns the documents that it keeps, changed as it
says; the last one returns where each document is packed.  A stage's result is written and read
again as the next one's input.  Columns may be null, ids and rows may come twice, and tables may be
empty: no documents give none, and without labels only the base rules reject.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.llm import jaccard, linededup, packing, quality_rules, suffix_dedup
from gridloom.llm.store import Scratch, read, ship_by_value, sweep

ship_by_value()


def _with_text(docs: DataFrame, names: list[str]) -> DataFrame:
    """The columns of documents, n_chars as the text is now."""
    return docs.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in names])


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned rules reject."""
    out, _ = quality_rules.judge(docs, read(spark, sf_dir, "labels"), Scratch(spark, "rules"), carry=True)
    return out.where("kept").select("row.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their boilerplate lines."""
    return _with_text(linededup.dedup_lines(docs, Scratch(spark, "lines")), docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that is linked by shingles, that of smallest id (null ids last).

    Rows count, not ids: of repeated rows one stays, and of an id with two texts each is judged by its own links.  Rows
    without words are linked with nothing and stay.
    """
    scratch = Scratch(spark, "near")
    rows = scratch.table(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered", wide=True)  # numbers hold once written
    group = jaccard.near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"), scratch)
    group = rows.select("__row", "doc_id").join(group.select(F.col("doc_id").alias("__row"), "component_id"), "__row")
    first = group.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("x")).select("x.__row")
    return rows.join(first, "__row", "left_semi").select(*docs.columns)


def passage_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that come earlier too; those of which nothing is left go."""
    out = suffix_dedup.dedup_passages(docs, Scratch(spark, "passages"))
    return _with_text(out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document is packed."""
    return packing.pack(packing.lengths(docs), Scratch(spark, "packing"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicate_stage),
    ("passage_dedup", passage_dedup_stage),
    ("packing", packing_stage),
]

#: Learned rules and packing are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), read(spark, sf_dir, "documents")
    before = list(Scratch.made)
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), name, wide=True)
        sweep(before)  # the stage's working tables; its result stands elsewhere
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
