"""From recognised pages to a validated product table, its review list, audit and integrity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.profile import ACTIVE, Profile
from ..operators import finalize as fin, reconcile as rec
from ..operators.groups import fill_groups
from ..operators.rows import classify, realign_tail
from ..operators.tables import holds_codes, inherit_schema, product_tables, promote_header, table_rows
from ..sources import pages as src

STRUCTURE = ("heading", "banner")


def cells_of(columns: Column, values: Column, p: Profile = ACTIVE) -> dict[str, Column]:
    """The profile's columns of a row by name; null where the table lacks them."""
    named = F.map_from_arrays(columns, values)
    return {c: F.try_element_at(named, F.lit(c)) for c in p.output_columns}


def clean_rows(rows: DataFrame, p: Profile = ACTIVE) -> tuple[DataFrame, DataFrame]:
    """(aligned rows as profile columns with META and flags, all rows with their kind) of product-table rows.

    Classify, realign, fill merged groups, then realign tails, in this order: a blank that a span
    covers is no sign of a slide.
    """
    kinds = classify(rows, p).persist()
    aligned = fill_groups(kinds.where(F.col("kind").isin("product", "realigned")), ["doc", "table_index"], p)
    tail = F.when(F.col("kind") == "product", realign_tail(F.col("columns"), F.col("values"), p))
    aligned = aligned.withColumn("_tail", tail).withColumn("repaired", (F.col("kind") == "realigned") | F.col("_tail").isNotNull())
    aligned = aligned.withColumn("values", F.coalesce("_tail", "values")).drop("_tail")
    out = cells_of(F.col("columns"), F.col("values"), p)
    out["Leaflet"] = F.lit(None).cast("string")  # an icon: what was read there is no text
    return _as_rows(aligned, out, F.array().cast("array<string>")), kinds.where(~F.col("kind").isin("product", "realigned"))


def _as_rows(df: DataFrame, cells: dict[str, Column], flags: Column) -> DataFrame:
    repaired = F.col("repaired") if "repaired" in df.columns else F.lit(False)
    extra = [F.col("filled")] if "filled" in df.columns else [F.lit(0).alias("filled")]
    return df.select("doc", "table_index", "row_idx", F.concat(F.lit("table-"), F.col("table_index").cast("string")).alias("source_table"), "page", F.lit("vlm-only").alias("verified_by"), repaired.alias("repaired"), flags.alias("flags"), *extra, *[c.alias(n) for n, c in cells.items()])


def early_review(left: DataFrame, p: Profile = ACTIVE) -> DataFrame:
    """Rows that never got aligned, with their cells as they are and the reason."""
    rows = _as_rows(left.where(~F.col("kind").isin(*STRUCTURE)), cells_of(F.col("columns"), F.col("values"), p), F.array("reason"))
    clean = rows.select("doc", "table_index", "row_idx", *fin.META, *[fin.sanitised(c, F.col(f"`{c}`"), p).alias(c) for c in p.output_columns], "flags")
    return clean.withColumn("reason", F.array_join("flags", "; ")).withColumn("issue_codes", F.array_join("flags", ",")).drop("flags")


@dataclass
class Extraction:
    kept: DataFrame
    review: DataFrame
    audit: DataFrame
    integrity: DataFrame
    stats: DataFrame


def in_order(df: DataFrame) -> DataFrame:
    """By numeric page, others last, and by source within a page."""
    return df.orderBy(F.coalesce(F.col("page").cast("string").try_cast("int"), F.lit(1_000_000)), "source_rank", "table_index", "row_idx")


def extract(spark: SparkSession, folder: str, p: Profile = ACTIVE, corrections: bool = True) -> Extraction:
    """A document's folder of page JSON and sidecars, all the way."""
    pages, sides = src.read_pages(spark, folder), src.read_sidecars(spark, folder)
    tables = rec.covered(inherit_schema(promote_header(src.read_tables(pages)), p), sides).persist()
    products = product_tables(tables, p)
    rows = table_rows(products, p).persist()
    aligned, left = clean_rows(rows.where(~F.col("covered")), p)
    ocr = fin.finalize(aligned, p, corrections).withColumn("source_rank", F.lit(0)).persist()
    geometry = fin.finalize(rec.geometry_rows(sides, p), p, corrections).withColumn("source_rank", F.lit(1)).persist()
    out = [*p.output_columns, *fin.META, "source_rank", "table_index", "row_idx"]
    quoted = [f"`{c}`" for c in out]
    done = ocr.select(*quoted, "issues", "blocking", "corrections").unionByName(geometry.select(*quoted, "issues", "blocking", "corrections"))
    kept = fin.kept(done).select(*quoted).persist()
    early = early_review(left, p).withColumn("source_rank", F.lit(0))
    review = fin.review(done).select(*quoted, "reason", "issue_codes").unionByName(early.select(*quoted, "reason", "issue_codes")).persist()

    said = lambda page, column, note, code=F.lit(""), value=F.lit(""): [page.cast("string").alias("page"), code.alias("midas"), F.lit(column).alias("column") if isinstance(column, str) else column.alias("column"), value.alias("pdf_geometry_value"), note.alias("ocr_value_or_note")]
    name = F.concat(F.lit("table-"), F.col("table_index").cast("string"))
    skipped = tables.join(products.select("doc", "table_index"), ["doc", "table_index"], "left_anti").where(holds_codes(F.col("grid"), p))
    audit = skipped.select(*said(F.col("page"), "(table)", F.concat(name, F.lit(" skipped (no usable header) but contains Midas-like values: rows may be missing"))))
    audit = audit.unionByName(sides.select("page", F.explode("warnings").alias("w")).select(*said(F.col("page"), "(page)", F.col("w"))))
    audit = audit.unionByName(sides.select("page", F.explode(F.flatten(F.transform("tables", lambda t: t["warnings"]))).alias("w")).select(*said(F.col("page"), "(table)", F.col("w"))))
    changed = done.select("page", "source_rank", F.col("`Midas Code`").alias("code"), F.explode("corrections").alias("c"))
    page = F.when(F.col("source_rank") == 1, F.col("page"))  # page readings are corrected before they know their page
    audit = audit.unionByName(changed.select(*said(F.coalesce(page.cast("string"), F.lit("")), F.col("c.column"), F.concat(F.lit("corrected by document profile: "), F.col("c.change")), F.col("code"))))
    read = rows.where("covered").select("page", *[c.alias(n) for n, c in cells_of(F.col("columns"), F.col("values"), p).items()])
    g = geometry.withColumn("ord", F.struct("page", "table_index", "row_idx"))
    checks = rec.cross_check(g, read.withColumn("ord", F.lit(0)), p)
    audit = audit.unionByName(checks.select(*said(F.col("page"), F.col("column"), F.col("vlm"), F.col("midas"), F.col("geometry"))))
    by_page = rec.integrity_by_page(rec.source_codes(pages), sides, kept.unionByName(review.select(*quoted))).persist()
    proof = rec.integrity(by_page, kept, review).persist()
    lost = by_page.where(F.size("lost") > 0)
    audit = audit.unionByName(lost.select(*said(F.col("page"), "(MISSING ROWS)", F.concat(F.size("lost").cast("string"), F.lit(" product(s) present in the source are absent from the output")), F.array_join("lost", ","))))
    audit = audit.unionByName(proof.select(F.explode("warnings").alias("w")).select(*said(F.lit(""), "(integrity)", F.col("w"))))
    kinds = left.agg(F.count_if(F.col("kind") == "heading").alias("blank_midas"), F.count_if(F.col("kind") == "banner").alias("banners"), F.count_if(F.col("kind") == "rejected").alias("early_rejected"), F.count_if(F.col("kind") == "blank_code").alias("early_review"))
    fixed = ocr.agg(F.count_if("repaired").alias("repaired"), F.coalesce(F.sum("filled"), F.lit(0)).alias("filled"), F.count_if(~fin.is_kept()).alias("bad"))
    stats = kinds.crossJoin(fixed).select("blank_midas", "banners", "repaired", "filled", (F.col("early_rejected") + F.col("bad")).alias("rejected"), (F.col("early_review") + F.col("bad")).alias("needs_review"))  # one row each
    return Extraction(in_order(kept), in_order(review), audit, proof, stats)


def merge(tables: DataFrame, p: Profile = ACTIVE, corrections: bool = True) -> tuple[DataFrame, DataFrame]:
    """(kept, review) of all product tables, each by its own header: no geometry, no inherited schema, no pages."""
    rows = table_rows(product_tables(promote_header(tables), p), p).persist()
    aligned, left = clean_rows(rows.withColumn("page", F.lit(None).cast("int")), p)
    done, order = fin.finalize(aligned, p, corrections).persist(), ["doc", "table_index", "row_idx"]
    out = [f"`{c}`" for c in (*order, *p.output_columns, *fin.META)]
    review = fin.review(done).select(*out, "reason", "issue_codes").unionByName(early_review(left, p).select(*out, "reason", "issue_codes"))
    return fin.kept(done).select(*out).orderBy(*order), review.orderBy(*order)


def replay(spark: SparkSession, folder: str, p: Profile = ACTIVE) -> tuple[DataFrame, DataFrame]:
    """``merge`` over the stored pages of a document, without recognising anything again."""
    return merge(src.read_tables(src.read_pages(spark, folder)), p)


class IncompleteExtraction(Exception):
    """Rows of the source are missing from the output."""


def require_complete(done: Extraction, allow_incomplete: bool = False) -> dict:
    proof = done.integrity.first().asDict(True)
    if proof["status"] == "INCOMPLETE" and not allow_incomplete:
        raise IncompleteExtraction(f"{proof['missing_rows']} rows are missing; {'; '.join(proof['warnings'])}")
    return proof
