"""What kind of row a row is, and realigning rows whose cells slid sideways.

Rows are (columns, values) in step; all of it is array expressions, as position is what matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.profile import ACTIVE, OUTPUT_COLUMNS, Profile
from ..functions.text import is_blank, let, trim_all
from ..functions.validate import cell_issue

EVIDENCE = r"£\s?\d|\d\s?%|\d{8,}"


def cell_valid(column: Column, value: Column, p: Profile = ACTIVE) -> Column:
    """Is a cell that is not blank valid in the column that it stands in?"""
    out = F.when(F.lit(False), F.lit(True))
    for c in OUTPUT_COLUMNS:
        if c in p.column_patterns or c in ("Midas Code", "EAN Barcode", "Consumer Deal"):
            out = out.when(column == c, cell_issue(c, value, p).isNull())
    return out.otherwise(True)


def cell(columns: Column, values: Column, name: str) -> Column:
    """A value by its column's name, null without the column."""
    at = F.array_position(columns, name).cast("int")
    return F.when(at > 0, F.get(values, at - 1))


def is_banner(values: Column) -> Column:
    """One text all the way across, in two cells at least."""
    there = F.transform(F.filter(values, lambda v: v.isNotNull()), trim_all)
    return (F.size(there) > 1) & (F.size(F.array_distinct(there)) == 1)


def has_evidence(values: Column, p: Profile = ACTIVE) -> Column:
    return F.exists(values, lambda v: ~is_blank(v) & (v.rlike(EVIDENCE) | trim_all(v).rlike(p.code_like)))


def score(columns: Column, values: Column, p: Profile = ACTIVE) -> Column:
    points = F.zip_with(columns, values, lambda c, v: F.when(is_blank(v), 0).when(cell_valid(c, v, p), 1).otherwise(-1))
    return F.aggregate(points, F.lit(0), lambda a, x: a + x)


def row_valid(columns: Column, values: Column, p: Profile = ACTIVE) -> Column:
    full = F.forall(F.zip_with(columns, values, lambda c, v: is_blank(v) | cell_valid(c, v, p)), lambda x: x)
    for m in p.mandatory:
        full = full & ~is_blank(cell(columns, values, m))
    return full


def _blanks(n: Column) -> Column:
    return F.array_repeat(F.lit(None).cast("string"), n)


def realign(columns: Column, values: Column, p: Profile = ACTIVE) -> Column:
    """struct(values, reason): the best realignment that puts the one code into its column and gains validity.

    Cells are dropped left of the code, or blanks put in; of the best scores the one that discards
    fewest cells, then fewest characters, then the first.  values is null where none will do.
    """
    n, home = F.size(values), F.array_position(columns, "Midas Code").cast("int") - 1
    hits = F.filter(F.transform(values, lambda v, i: F.when(F.coalesce(trim_all(v).rlike(p.code), F.lit(False)), i)), lambda i: i.isNotNull())

    def no(text: str | Column) -> Column:
        return F.struct(F.lit(None).cast("array<string>").alias("values"), (F.lit(text) if isinstance(text, str) else text).alias("reason"))

    def tries(anchor: Column, shift: Column) -> Column:
        drop = F.transform(F.sequence(F.lit(0), F.greatest(anchor - shift, F.lit(0))), lambda q: F.struct(F.concat(F.slice(values, F.lit(1), q), F.slice(values, q + shift + 1, F.greatest(n - q - shift, F.lit(0))), _blanks(shift)).alias("cand"), F.slice(values, q + 1, shift).alias("gone")))
        pad = F.transform(
            F.sequence(anchor, F.lit(0), F.lit(-1)),
            lambda q: F.struct(F.slice(F.concat(F.slice(values, F.lit(1), q), _blanks(-shift), F.slice(values, q + 1, F.greatest(n - q, F.lit(0)))), F.lit(1), n).alias("cand"), F.array().cast("array<string>").alias("gone")),
        )
        return F.when(shift > 0, drop).otherwise(pad)

    def choose(anchor: Column) -> Column:
        shift, code, base = anchor - home, trim_all(F.get(values, anchor)), score(columns, values, p)

        def rank(c: Column, i: Column) -> Column:
            gone = F.filter(F.transform(c["gone"], lambda v: trim_all(F.coalesce(v, F.lit("")))), lambda v: v != "")
            chars = F.aggregate(gone, F.lit(0), lambda a, v: a + F.length(v))
            return F.struct((-score(columns, c["cand"], p)).alias("s"), F.size(gone).alias("cells"), chars.alias("chars"), i.alias("i"), c["cand"].alias("cand"))

        landed = F.filter(tries(anchor, shift), lambda c: F.coalesce(trim_all(F.get(c["cand"], home)) == code, F.lit(False)))
        better = lambda b: F.filter(F.transform(landed, rank), lambda r: -r["s"] > b)
        said = lambda b, r: F.concat(F.lit("realigned by "), F.when(shift > 0, F.lit("+")).otherwise(F.lit("")), shift.cast("string"), F.lit(" (score "), b.cast("string"), F.lit(" -> "), (-r["s"]).cast("string"), F.lit(")"))
        pick = lambda b: let(F.array_min(better(b)), lambda r: F.when(r.isNull(), no(F.concat(F.lit("no realignment improved the row (score "), b.cast("string"), F.lit(")")))).otherwise(F.struct(r["cand"].alias("values"), said(b, r).alias("reason"))))
        return F.when(shift == 0, no("Midas Code column holds a non-Midas value")).otherwise(let(base, pick))

    return (
        F.when(is_banner(values), no("category banner row"))
        .when(F.size(hits) == 0, no("no Midas code anywhere in the row"))
        .when(F.size(hits) > 1, no("several Midas-looking values, alignment ambiguous"))
        .otherwise(let(F.get(hits, F.lit(0)), choose))
    )


def realign_tail(columns: Column, values: Column, p: Profile = ACTIVE) -> Column:
    """The first fully valid row that comes of moving cells right of the code across blanks; null if none.

    Blank cells alone are no evidence of a slide: a cell must hold a wrong value.
    """
    n, home = F.size(values), F.array_position(columns, "Midas Code").cast("int") - 1
    wrong = F.exists(F.zip_with(columns, values, lambda c, v: ~is_blank(v) & ~cell_valid(c, v, p)), lambda x: x)
    empty = lambda part: F.forall(part, is_blank)

    def shifts(q: Column) -> Column:
        out = []
        for k in (1, 2):
            left = F.concat(F.slice(values, F.lit(1), q), F.slice(values, q + k + 1, F.greatest(n - q - k, F.lit(0))), _blanks(F.lit(k)))
            right = F.concat(F.slice(values, F.lit(1), q), _blanks(F.lit(k)), F.slice(values, q + 1, F.greatest(n - k - q, F.lit(0))))
            tail = F.slice(values, F.greatest(n - k + 1, F.lit(1)), F.lit(k))
            out += [F.when((q + k <= n) & empty(F.slice(values, q + 1, F.lit(k))), left), F.when(empty(tail) & (F.size(right) == n), right)]
        return F.array(*out)

    def slides(i: Column) -> Column:
        swap = F.transform(values, lambda v, j: F.when(j == i, F.get(values, i + 1)).when(j == i + 1, F.get(values, i)).otherwise(v))
        a, b = F.get(values, i), F.get(values, i + 1)
        return F.when(is_blank(a) != is_blank(b), swap)

    moved = F.flatten(F.transform(F.sequence(home + 1, n - 1), shifts))
    slid = F.when(home + 1 <= n - 2, F.transform(F.sequence(home + 1, F.greatest(n - 2, home + 1)), slides)).otherwise(F.array().cast("array<array<string>>"))
    good = F.filter(F.concat(moved, slid), lambda c: c.isNotNull() & row_valid(columns, c, p))
    return F.when(wrong & (home + 1 <= n - 1), F.get(good, F.lit(0)))


def classify(rows: DataFrame, p: Profile = ACTIVE) -> DataFrame:
    """``rows`` with kind: product, realigned, blank_code, heading, banner or rejected; and reason.

    heading and banner are structure, not data; blank_code and rejected go to review as they are.
    """
    code = cell(F.col("columns"), F.col("values"), "Midas Code")
    plain = F.coalesce(trim_all(code).rlike(p.code) | trim_all(code).rlike(p.code_like), F.lit(False))
    product = is_blank(code) & has_evidence(F.col("values"), p) & ~is_banner(F.col("values"))
    fix = F.when(product | (~is_blank(code) & ~plain), realign(F.col("columns"), F.col("values"), p))
    df = rows.withColumn("_fix", fix).withColumn("_blank", is_blank(code)).withColumn("_product", product).withColumn("_plain", plain)
    kind = (
        F.when(F.col("_blank") & ~F.col("_product"), "heading")
        .when(F.col("_plain"), "product")
        .when(F.col("_fix.values").isNotNull(), "realigned")
        .when(F.col("_blank"), "blank_code")
        .when(F.col("_fix.reason") == "category banner row", "banner")
        .otherwise("rejected")
    )
    reason = F.when(F.col("kind") == "blank_code", "blank_midas_product_row").when(F.col("kind").isin("rejected", "realigned"), F.col("_fix.reason"))
    df = df.withColumn("kind", kind).withColumn("reason", reason)
    return df.withColumn("values", F.coalesce("_fix.values", "values")).drop("_fix", "_blank", "_product", "_plain")
