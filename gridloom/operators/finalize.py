"""The last step of every row: clean, correct, validate, and split into kept and review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.profile import ACTIVE, Profile
from ..functions.validate import corrected, issue_text, row_issues, sanitised

META = ["source_table", "page", "verified_by", "repaired"]


def finalize(rows: DataFrame, p: Profile = ACTIVE, corrections: bool = True) -> DataFrame:
    """``rows`` (profile columns, META, flags) with cells cleaned and corrected, and issues, blocking, notes.

    Columns that a table lacks are null and count as blank.  One projection makes all of it; split
    with ``kept`` and ``review``.
    """
    extra = [c for c in rows.columns if c not in {*p.output_columns, *META, "flags"}]
    clean = rows.select(*extra, *META, "flags", *[sanitised(c, F.col(f"`{c}`"), p).alias(c) for c in p.output_columns])
    notes: list[Column] = []
    if corrections:
        exact = F.coalesce(F.col("verified_by") == "text-layer", F.lit(False))
        fixes = {c: corrected(c, F.col(f"`{c}`"), p, tidy=True) for c in p.currency_columns}
        clean = clean.withColumns({f"_fix_{k}": F.when(~exact, x) for k, x in enumerate(fixes.values())})
        for k, c in enumerate(fixes):
            notes.append(F.when(F.col(f"_fix_{k}")["note"].isNotNull(), F.struct(F.lit(c).alias("column"), F.col(f"_fix_{k}")["note"].alias("change"))))
        clean = clean.withColumn("corrections", F.filter(F.array(*notes), lambda x: x.isNotNull()))
        clean = clean.withColumns({c: F.coalesce(F.col(f"_fix_{k}")["value"], F.col(f"`{c}`")) for k, c in enumerate(fixes)})
        suffix = F.when((F.size("corrections") > 0) & ~F.coalesce(F.endswith("verified_by", F.lit("+profile-correction")), F.lit(False)), "+profile-correction").otherwise("")
        clean = clean.withColumn("verified_by", F.concat(F.coalesce("verified_by", F.lit("vlm-only")), suffix)).drop(*[f"_fix_{k}" for k in range(len(fixes))])
    else:
        clean = clean.withColumn("corrections", F.array().cast("array<struct<column:string,change:string>>"))
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    blocking = F.filter(flags, lambda f: f.isin(*p.blocking_flags))
    return clean.withColumn("issues", row_issues({c: F.col(f"`{c}`") for c in p.output_columns}, p, tidy=True)).withColumn("blocking", blocking)


def is_kept() -> Column:
    return (F.size("issues") == 0) & (F.size("blocking") == 0)


def kept(done: DataFrame) -> DataFrame:
    return done.where(is_kept())


def review(done: DataFrame) -> DataFrame:
    """Rows with something wrong, with the reasons in words and in sorted codes."""
    reason = F.concat_ws("; ", F.transform("issues", issue_text), F.col("blocking"))
    codes = F.array_join(F.array_sort(F.array_union(F.transform("issues", lambda x: x["code"]), F.col("blocking"))), ",")
    return done.where(~is_kept()).withColumn("reason", reason).withColumn("issue_codes", codes)


def stats(done: DataFrame) -> DataFrame:
    """One row of counts; what is not kept is both in review and rejected."""
    bad = F.count_if(~is_kept())
    return done.agg(
        F.count("*").alias("validated"), F.count_if(is_kept()).alias("kept"), bad.alias("needs_review"), bad.alias("rejected"), F.sum(F.size("corrections")).alias("autofixed")
    )
