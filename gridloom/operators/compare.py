"""Differences between two datasets, by key or by position.

Both sides carry an ordinal column ``ord``: of equal keys on the extracted side the first counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import compare_key, trim_all, unique_column, values_equal

MISSING, SAME, DIFFERENT = "No data in PDF", "Same Values", "Values Mismatch"


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _require(df: DataFrame, name: str, side: str) -> str:
    if name not in df.columns:
        raise ValueError(f"{side} has no column named {name!r}")
    return name


@dataclass
class Comparison:
    """``report``: every existing row with a verdict; ``extracted_only``; ``summary`` and ``fields``: counts."""

    report: DataFrame
    extracted_only: DataFrame
    summary: DataFrame
    fields: DataFrame


def first_by_key(df: DataFrame, key: Column) -> DataFrame:
    """The first row of each key by ord; blank keys have none. Partial aggregation, so a hot key is no hot task."""
    rows = df.withColumn("_key", key).where(F.col("_key") != "")
    return rows.groupBy("_key").agg(F.min_by(F.struct(*[_q(c) for c in df.columns]), "ord").alias("_row")).select("_key", "_row.*")


def compare_by_key(extracted: DataFrame, existing: DataFrame, key: tuple[str, str], fields: list[tuple[str, str]]) -> Comparison:
    """Look each existing row up by key, then compare the mapped fields (extracted, existing)."""
    if not fields:
        raise ValueError("Select at least one field to compare")
    pairs = list(dict.fromkeys((_require(extracted, a, "Extracted data"), _require(existing, b, "Existing data")) for a, b in fields))
    a_key, b_key = _require(extracted, key[0], "Extracted data"), _require(existing, key[1], "Existing data")
    extracted, existing = extracted.na.fill(""), existing.na.fill("")
    own = [c for c in existing.columns if c != "ord"]
    side = first_by_key(extracted, compare_key(_q(a_key))).select("_key", *[_q(a).alias(f"_v{k}") for k, (a, _) in enumerate(pairs)], F.lit(True).alias("_there"))
    both = existing.withColumn("_key", compare_key(_q(b_key))).join(side, "_key", "left")
    there = F.coalesce("_there", F.lit(False))
    same = [F.coalesce(values_equal(F.col(f"_v{k}"), _q(b)), F.lit(False)) for k, (_, b) in enumerate(pairs)]
    both = both.withColumns({"_found": there, **{f"_same{k}": there & s for k, s in enumerate(same)}})
    every = F.lit(True)
    for k in range(len(pairs)):
        every = every & F.col(f"_same{k}")
    status = F.when(~F.col("_found"), MISSING).when(every, SAME).otherwise(DIFFERENT)
    found_name, status_name = unique_column(own, "Data in PDF"), unique_column(own, "Status")
    values = {}
    for k, (_, b) in enumerate(pairs):  # two pairs of one existing column share a name: the last one stays
        values[unique_column(own, "Value in PDF" if len(pairs) == 1 else f"{b} in PDF")] = F.coalesce(f"_v{k}", F.lit(""))
    report = both.select("ord", *[_q(c) for c in own], F.col("_found").alias(found_name), status.alias(status_name), *[v.alias(n) for n, v in values.items()])

    known = existing.select(compare_key(_q(b_key)).alias("_key")).where(F.col("_key") != "").distinct()
    only = extracted.withColumn("_key", compare_key(_q(a_key))).join(known, "_key", "left_anti").select(*[_q(c) for c in extracted.columns])

    def keys(df: DataFrame, c: str, name: str) -> DataFrame:
        n = df.groupBy(compare_key(_q(c)).alias("k")).count()
        return n.agg(F.coalesce(F.sum(F.when(F.col("k") == "", F.col("count"))), F.lit(0)).alias(f"blank_keys_{name}"), F.coalesce(F.sum(F.when(F.col("k") != "", F.col("count") - 1)), F.lit(0)).alias(f"duplicate_keys_{name}"), F.coalesce(F.sum("count"), F.lit(0)).alias(f"total_rows_{name}"))

    paired, hit = F.count_if("_found"), F.count_if(F.col("_found") & every)
    counts = both.agg(paired.alias("rows_paired"), hit.alias("matching_rows"), (paired - hit).alias("mismatched_rows"), (F.count("*") - paired).alias("only_in_existing_rows"), F.coalesce(F.bround(hit / F.nullif(paired, F.lit(0)) * 100, 2), F.lit(0.0)).alias("accuracy_percent"))
    summary = counts.crossJoin(only.agg(F.count("*").alias("only_in_extracted_rows"))).crossJoin(keys(extracted, a_key, "extracted")).crossJoin(keys(existing, b_key, "ground"))  # one row each
    sums = both.agg(F.count_if("_found").alias("total"), *[F.count_if(f"_same{k}").alias(f"m{k}") for k in range(len(pairs))])
    long = sums.select("total", F.explode(F.array(*[F.struct(F.lit(k).alias("slot"), F.lit(f"{a} → {b}").alias("column"), F.col(f"m{k}").alias("matches")) for k, (a, b) in enumerate(pairs)])).alias("x"))
    rate = F.coalesce(F.bround(F.col("x.matches") / F.nullif(F.col("total"), F.lit(0)) * 100, 2), F.lit(0.0))
    table = long.select("x.slot", "x.column", "x.matches", "total", rate.alias("accuracy")).orderBy("accuracy", "slot")
    return Comparison(report, only, summary, table)


def ordinals(df: DataFrame, buckets: int = 256) -> DataFrame:
    """Number rows 1.. in the order of ``ord``: counts per range come first, so no task sees all rows."""
    # Both uses read the one partitioning that is kept: ranges of a second one could be cut elsewhere.
    part = df.repartitionByRange(buckets, "ord").withColumn("_part", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    sums = part.groupBy("_part").count()
    part = part.withColumn("_in", F.row_number().over(W.partitionBy("_part").orderBy("ord")))
    before = sums.select("_part", (F.sum("count").over(W.orderBy("_part")) - F.col("count")).alias("_before"))
    return part.join(F.broadcast(before), "_part").withColumn("row", F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def compare_by_position(extracted: DataFrame, ground: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, column, extracted, ground_truth) of the cells that differ; and matches per common column.

    Names match stripped and in lower case; both sides have ``row`` from 1. A null extracted value
    is the text 'nan', as a text it never equals an empty one.  Without a common column both results are empty.
    """
    low = lambda df: {c.strip().lower(): c for c in df.columns if c not in ("ord", "row")}
    a, b = low(extracted), low(ground)
    common = sorted(set(a) & set(b))
    left = extracted.select("row", *[trim_all(F.coalesce(_q(a[c]).cast("string"), F.lit("nan"))).alias(f"a{k}") for k, c in enumerate(common)])
    right = ground.select("row", *[trim_all(F.coalesce(_q(b[c]).cast("string"), F.lit(""))).alias(f"b{k}") for k, c in enumerate(common)])
    both = left.join(right, "row")
    if not common:
        return both.selectExpr("row", "'' as column", "'' as extracted", "'' as ground_truth").limit(0), both.selectExpr("'' as column", "row as matches", "row as total", "0d as accuracy").limit(0)
    cells = both.select("row", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a{k}").alias("extracted"), F.col(f"b{k}").alias("ground_truth")) for k, c in enumerate(common)])).alias("x")).select("row", "x.*")
    same = F.count_if(F.col("extracted") == F.col("ground_truth"))
    columns = cells.groupBy("column").agg(same.alias("matches"), F.count("*").alias("total"), F.bround(same / F.count("*") * 100, 2).alias("accuracy"))
    return cells.where(F.col("extracted") != F.col("ground_truth")), columns


def position_summary(extracted: DataFrame, ground: DataFrame) -> DataFrame:
    """One row of counts of a comparison by position (see ``compare_by_position``), with what is said about it."""
    differ, columns = compare_by_position(extracted, ground)
    wrong = differ.agg(F.count_distinct("row").alias("mismatched"))
    n = extracted.agg(F.count("*").alias("a")).crossJoin(ground.agg(F.count("*").alias("b"))).crossJoin(wrong).crossJoin(columns.agg(F.count("*").alias("common")))  # one row each
    some, compared = F.col("common") > 0, F.least("a", "b")
    matched = F.when(some, compared - F.col("mismatched")).otherwise(0)
    rate = F.coalesce(matched / F.nullif(F.when(some, compared), F.lit(0)) * 100, F.lit(0.0))
    said = F.format_string("Compared %d rows across %d common columns. Row-level accuracy: %.2f%%. Matching rows: %d, Mismatched rows: %d.", compared, F.col("common"), rate, matched, F.col("mismatched"))
    return n.select(
        F.col("a").alias("total_rows_extracted"), F.col("b").alias("total_rows_ground"), matched.alias("matching_rows"), F.col("mismatched").alias("mismatched_rows"),
        F.when(some, F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("extra_rows_extracted"), F.when(some, F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("extra_rows_ground"),
        F.when(some, compared).alias("rows_compared"), F.bround(rate, 2).alias("accuracy_percent"),
        F.when(some, said).otherwise("No common columns found between extracted and ground truth data.").alias("summary"),
    )
