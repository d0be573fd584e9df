"""From table grids to rows under canonical columns.

A table is one row: (doc, table_index, columns, positional, grid, merges, ...) with ``grid`` an
array of rows of cells (null: empty) and ``merges`` the vertical spans (first, last, col).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.headers import DATA_LIKE, canonical_header, is_nameless
from ..functions.profile import ACTIVE, Profile
from ..functions.text import is_blank, null_if_empty, strip_image_artifacts, trim_all


def promote_header(tables: DataFrame) -> DataFrame:
    """Take the first row for the header where columns have numbers only and the row can be one.

    It cannot if it holds data, or names fewer than half of the columns (two at least).
    """
    first = F.get("grid", F.lit(0))
    named = F.size(F.filter(first, lambda v: v.isNotNull()))
    data = F.exists(first, lambda v: F.coalesce(trim_all(v).rlike(DATA_LIKE), F.lit(False)))
    fit = F.coalesce(F.col("positional") & (F.size("grid") >= 2) & ~data & (named >= F.greatest(F.lit(2), F.floor(F.size(first) / 2).cast("int"))), F.lit(False))
    names = F.transform(first, lambda v, i: F.coalesce(trim_all(v), F.concat(F.lit("Unnamed: "), i.cast("string"))))
    moved = F.transform(F.filter("merges", lambda m: m["first"] > 0), lambda m: F.struct((m["first"] - 1).alias("first"), (m["last"] - 1).alias("last"), m["col"].alias("col")))
    return tables.withColumns(
        {
            "columns": F.when(fit, names).otherwise(F.col("columns")),
            "merges": F.when(fit, moved).otherwise(F.col("merges")),
            "grid": F.when(fit, F.slice("grid", F.lit(2), F.greatest(F.size("grid") - 1, F.lit(0)))).otherwise(F.col("grid")),
            "positional": F.col("positional") & ~fit,
        }
    )


def holds_codes(grid: Column, p: Profile = ACTIVE) -> Column:
    return F.exists(F.flatten(grid), lambda v: F.coalesce(trim_all(v).rlike(p.code_like), F.lit(False)))


def _has_required(columns: Column, p: Profile) -> Column:
    names = F.transform(F.filter(columns, lambda c: ~is_nameless(c)), canonical_header)
    size = F.array_contains(names, "Size") & ~F.array_contains(names, "Case Size")
    out = F.lit(True)
    for c in p.required:
        there = F.array_contains(names, c)
        out = out & (there | (size & F.array_contains(names, "Case")) if c == "Midas Code" else there)
    return out


def inherit_schema(tables: DataFrame, p: Profile = ACTIVE) -> DataFrame:
    """A table without a header takes the names of the last product table of its document, if as wide and holding codes."""
    own = F.when(~F.col("positional") & _has_required(F.col("columns"), p), F.transform("columns", lambda c: F.when(~is_nameless(c), canonical_header(c))))
    last = F.last(own, ignorenulls=True).over(W.partitionBy("doc").orderBy("table_index").rowsBetween(W.unboundedPreceding, -1))
    tables = tables.withColumn("_carried", last)
    fit = F.coalesce(F.col("positional") & (F.size("_carried") == F.size("columns")) & holds_codes(F.col("grid"), p), F.lit(False))
    names = F.transform("_carried", lambda c, i: F.coalesce(c, F.concat(F.lit("Unnamed: "), i.cast("string"))))
    return tables.withColumns({"columns": F.when(fit, names).otherwise(F.col("columns")), "inherited": fit}).drop("_carried")


def product_tables(tables: DataFrame, p: Profile = ACTIVE) -> DataFrame:
    """Tables with the required columns: ``keep`` (positions) and ``names`` of their columns; others go."""
    names = F.transform("columns", lambda c: F.when(~is_nameless(c), canonical_header(c)))
    keep = F.filter(F.sequence(F.lit(0), F.size("columns") - 1), lambda i: F.get("_all", i).isNotNull() & (F.array_position("_all", F.get("_all", i)) == i + 1))
    df = tables.where(F.size("columns") > 0).withColumn("_all", names)
    df = df.withColumn("keep", keep).withColumn("names", F.transform("keep", lambda i: F.get("_all", i)))
    split = F.array_contains("names", "Size") & ~F.array_contains("names", "Case Size")
    rename = split & ~F.array_contains("names", "Midas Code")
    df = df.withColumn("split_case", split & F.array_contains("names", "Case") & F.array_contains("names", "Midas Code"))
    df = df.withColumn("names", F.transform("names", lambda n: F.when(split & (n == "Size"), "Case Size").when(rename & (n == "Case"), "Midas Code").otherwise(n)))
    out = F.lit(True)
    for c in p.required:
        out = out & F.array_contains("names", c)
    return df.where(out).drop("_all")


def table_rows(tables: DataFrame, p: Profile = ACTIVE) -> DataFrame:
    """A row per grid row of ``product_tables``: row_idx, columns and cleaned values in step, merges by name."""
    df = tables.select("*", F.posexplode("grid").alias("row_idx", "cells"))
    values = F.transform("keep", lambda i: null_if_empty(strip_image_artifacts(F.get("cells", i))))
    named = F.transform("merges", lambda m: F.struct(m["first"].alias("first"), m["last"].alias("last"), F.get("names", F.array_position("keep", m["col"]).cast("int") - 1).alias("column")))
    df = df.withColumn("values", values).withColumn("merges", F.filter(named, lambda m: m["column"].isNotNull()))
    case, code = F.array_position("names", "Case").cast("int"), F.array_position("names", "Midas Code").cast("int")
    old, other = F.get("values", code - 1), F.get("values", case - 1)
    moved = F.when(is_blank(old) & F.coalesce(other.rlike(p.code_like), F.lit(False)), other).otherwise(old)
    fixed = F.filter(F.transform("values", lambda v, i: F.when(i == code - 1, moved).otherwise(v)), lambda v, i: i != case - 1)
    df = df.withColumn("values", F.when(F.col("split_case"), fixed).otherwise(F.col("values")))
    df = df.withColumn("columns", F.when(F.col("split_case"), F.filter("names", lambda n: n != "Case")).otherwise(F.col("names")))
    return df.drop("cells", "grid", "keep", "names", "split_case", "positional")
