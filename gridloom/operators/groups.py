"""Values of vertically merged cells, spread over the rows that a table grouped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.profile import ACTIVE, Profile
from ..functions.text import is_blank
from .rows import cell_valid


def _spread(rows: Column, span: Column) -> Column:
    """The rows of a table with one span applied."""
    at = F.array_position(F.get(rows, F.lit(0))["columns"], span["column"]).cast("int") - 1
    inside = lambda r: r["row_idx"].between(span["first"], span["last"])
    group = F.filter(rows, inside)
    full = F.filter(group, lambda r: ~F.get(r["_blank"], at))
    source = F.coalesce(F.get(F.filter(full, lambda r: F.get(r["_ok"], at)), F.lit(0)), F.get(full, F.lit(0)))
    put = lambda cells, x: F.transform(cells, lambda c, i: F.when(i == at, x).otherwise(c))

    def fill(r: Column) -> Column:
        new = r.withField("values", put(r["values"], F.get(source["values"], at))).withField("_blank", put(r["_blank"], F.lit(False)))
        new = new.withField("_ok", put(r["_ok"], F.get(source["_ok"], at))).withField("filled", r["filled"] + 1)
        return F.when(inside(r) & F.get(r["_blank"], at), new).otherwise(r)

    return F.when((at >= 0) & (F.size(group) > 1) & source.isNotNull(), F.transform(rows, fill)).otherwise(rows)


def fill_groups(rows: DataFrame, keys: list[str], p: Profile = ACTIVE) -> DataFrame:
    """``rows`` (keys, row_idx, columns, values, merges) with blanks of merged groups filled, and ``filled`` cells.

    Per span: the first valid value of the group, or else its first value, goes to its blank rows;
    groups of one surviving row are left.  Spans apply in their order, and later ones see earlier
    fills, so the rows of a table that has spans meet in one array, which the spans are folded over;
    other tables go by.
    """
    marked, names = rows.withColumn("filled", F.lit(0)), rows.columns
    some = F.size("merges") > 0
    merged = F.transform("merges", lambda s: s["column"])
    ok = F.zip_with("columns", "values", lambda c, v: F.when(F.array_contains(merged, c), F.coalesce(cell_valid(c, v, p), F.lit(False))).otherwise(False))
    held = marked.where(some).withColumn("_ok", ok).withColumn("_blank", F.transform("values", is_blank))
    row = F.struct("row_idx", *[c for c in (*names, "filled", "_ok", "_blank") if c not in (*keys, "row_idx")])
    table = held.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    done = table.withColumn("_rows", F.aggregate(F.get("_rows", F.lit(0))["merges"], F.col("_rows"), _spread))
    back = done.select(*keys, F.explode("_rows").alias("_r")).select(*[F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in (*names, "filled")])
    return marked.where(~some).unionByName(back)
