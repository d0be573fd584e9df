"""Several readings of one document: consensus, cross-check, and proof that nothing is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.profile import ACTIVE, Profile
from ..functions.text import clean_text, code_tokens, cut_off, trim_all
from ..functions.validate import cell_issue

ROW_KINDS = ("product", "blank_midas")


def consensus(column: str, primary: Column, alt: Column, p: Profile = ACTIVE) -> Column:
    """struct(value, flag) of two readings: the only valid one, else the first; flagged if both are valid and differ."""
    a, b = clean_text(primary), clean_text(alt)
    good_a, good_b = (a != "") & cell_issue(column, a, p).isNull(), cell_issue(column, b, p).isNull()
    only_b, clash = (b != "") & (a != b) & good_b & ~good_a, (b != "") & (a != b) & good_a & good_b
    return F.struct(F.when(only_b, b).otherwise(a).alias("value"), F.when(clash, "second_pass_disagrees").alias("flag"))


def geometry_rows(sidecars: DataFrame, p: Profile = ACTIVE) -> DataFrame:
    """Rows (doc, page, profile columns, META, flags) of rebuilt tables; banners are left out, other kinds pass."""
    t = sidecars.select("doc", "page", F.coalesce("mode", F.lit("text-layer")).alias("mode"), F.posexplode("tables").alias("t_pos", "t")).where("t.layout is not null")
    r = t.select("doc", "page", "mode", "t_pos", F.posexplode("t.rows").alias("r_pos", "r")).where(F.col("r.kind") != "banner")
    ocr, flags, out = F.col("mode") == "ocr", [F.coalesce("r.flags", F.array().cast("array<string>"))], {}
    for c in p.output_columns:
        own = F.try_element_at("r.cells", F.lit(c))
        if c in p.consensus_columns:
            both = consensus(c, own, F.try_element_at("r.alt", F.lit(c)), p)
            use = ocr & own.isNotNull()
            out[c] = F.when(use, both["value"]).otherwise(own)
            flags.append(F.when(use & both["flag"].isNotNull(), F.array(both["flag"])).otherwise(F.array().cast("array<string>")))
        else:
            out[c] = own
    deal = F.coalesce(out["Consumer Deal"], F.lit(""))
    some = lambda cond, flag: F.when(F.coalesce(cond, F.lit(False)), F.array(F.lit(flag))).otherwise(F.array().cast("array<string>"))
    flags.append(some(F.col("r.kind") == "blank_midas", "blank_midas_product_row"))
    flags.append(some((F.col("r.deal_method") == "own-cell") & (deal == ""), "deal_group_unresolved"))
    return r.select(
        "doc", F.col("t_pos").alias("table_index"), F.col("r_pos").alias("row_idx"),
        F.concat(F.lit("page-"), F.col("page").cast("string"), F.lit("-geometry-"), (F.col("t_pos") + 1).cast("string")).alias("source_table"),
        "page", F.when(F.col("mode") == "text-layer", "text-layer").otherwise("ocr-two-pass").alias("verified_by"),
        F.lit(False).alias("repaired"), F.concat(*flags).alias("flags"), *[v.alias(c) for c, v in out.items()],
    )


def covered(tables: DataFrame, sidecars: DataFrame) -> DataFrame:
    """``tables`` (doc, page, table_index, bbox) with covered: the box's centre is in a rebuilt table with rows."""
    boxes = sidecars.select("doc", "page", F.explode("tables").alias("t")).where(F.col("t.layout").isNotNull() & F.exists("t.rows", lambda r: r["kind"].isin(*ROW_KINDS))).select("doc", "page", F.col("t.bbox").alias("b"))
    x, y = (F.get("bbox", F.lit(0)) + F.get("bbox", F.lit(2))) / 2, (F.get("bbox", F.lit(1)) + F.get("bbox", F.lit(3))) / 2
    c = tables.select("doc", "page", "table_index", x.alias("x"), y.alias("y"))
    hit = c.join(boxes, ["doc", "page"]).where(F.col("x").between(F.get("b", F.lit(0)), F.get("b", F.lit(2))) & F.col("y").between(F.get("b", F.lit(1)), F.get("b", F.lit(3))))
    return tables.join(hit.select("doc", "table_index").distinct().withColumn("_hit", F.lit(True)), ["doc", "table_index"], "left").withColumn("covered", F.coalesce("_hit", F.lit(False))).drop("_hit")


NOT_TEXT = ("Image", "Leaflet", "EAN Barcode")


def cross_check(geometry: DataFrame, ocr: DataFrame, p: Profile = ACTIVE, every: bool = False) -> DataFrame:
    """(page, midas, column, geometry, vlm): where a page reading differs from the rebuilt row of its code.

    Both sides have ord; of equal codes the last geometry row counts, or with ``every`` each of them.
    """
    g = geometry.where(F.col("`Midas Code`").rlike(p.code)).select(F.col("`Midas Code`").alias("_code"), F.struct(*[F.col(f"`{c}`") for c in geometry.columns]).alias("g"))
    g = g if every else g.groupBy("_code").agg(F.max_by("g", "g.ord").alias("g"))
    v = ocr.withColumn("_code", clean_text(F.col("`Midas Code`"))).join(g, "_code", "left")
    missing = v.where("g is null").select("page", F.col("_code").alias("midas"), F.lit("(row)").alias("column"), F.lit("").alias("geometry"), F.lit("row only in VLM output").alias("vlm"))
    cols = [c for c in p.output_columns if c not in NOT_TEXT and c in ocr.columns]
    pair = F.array(*[F.struct(F.lit(c).alias("column"), clean_text(F.col("g")[c]).alias("geometry"), clean_text(F.col(f"`{c}`")).alias("vlm")) for c in cols])
    cells = v.where("g is not null").select(F.col("g.page").alias("page"), F.col("_code").alias("midas"), F.explode(pair).alias("x")).select("page", "midas", "x.*")
    return missing.unionByName(cells.where((F.col("vlm") != "") & (F.col("geometry") != F.col("vlm"))))


def source_codes(raw: DataFrame) -> DataFrame:
    """(page, codes, truncated) of raw pages (file, raw); files without a page number are skipped."""
    page = F.nullif(F.regexp_extract("file", r"page_(\d+)", 1), F.lit("")).try_cast("int")
    df = raw.select(page.alias("page"), code_tokens(F.col("raw")).alias("t"), cut_off(F.col("raw")).alias("cut")).where("page is not null")
    return df.groupBy("page").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("t")))).alias("codes"), F.max("cut").alias("truncated"))


def integrity_by_page(source: DataFrame, sidecars: DataFrame, output: DataFrame) -> DataFrame:
    """(page, expected, lost, truncated, covered): codes that a page has against those that were produced.

    The text layer says alone which codes exist where it rebuilt rows; else it and the raw tokens do.
    """
    empty = F.array().cast("array<string>")
    s = sidecars.select("page", F.coalesce("midas_codes", empty).alias("known"), (F.coalesce("rows_rebuilt", F.lit(0)) > 0).alias("covered"), ((F.col("mode") == "text-layer") & (F.coalesce("rows_rebuilt", F.lit(0)) > 0)).alias("exact"))
    o = output.select(F.col("page").cast("string").try_cast("double").cast("int").alias("page"), F.coalesce(F.col("`Midas Code`"), F.lit("")).alias("c")).where("page is not null").groupBy("page").agg(F.collect_set("c").alias("produced"))
    df = source.join(s, "page", "full").join(o, "page", "left")
    have = F.when(F.coalesce("exact", F.lit(False)), F.array_distinct("known")).otherwise(F.array_union(F.coalesce("codes", empty), F.coalesce("known", empty)))
    df = df.withColumn("have", have).withColumn("produced", F.coalesce("produced", empty))
    return df.select("page", F.size(F.array_union("have", "produced")).alias("expected"), F.array_sort(F.array_except("have", "produced")).alias("lost"), F.coalesce("truncated", F.lit(False)).alias("truncated"), F.coalesce("covered", F.lit(False)).alias("covered"))


def integrity(by_page: DataFrame, kept: DataFrame, review: DataFrame) -> DataFrame:
    """One row: the status, counts and warnings of a run.

    A blank code counts as a code of its page and as a blank row, so such pages expect one more.
    """
    pages = by_page.agg(
        F.coalesce(F.sum("expected"), F.lit(0)).alias("on_pages"),
        F.coalesce(F.sum(F.size("lost")), F.lit(0)).alias("missing_rows"),
        F.array_sort(F.collect_list(F.when(F.size("lost") > 0, F.struct("page", "lost")))).alias("missing"),
        F.array_sort(F.collect_list(F.when(F.col("truncated"), F.col("page")))).alias("truncated_pages"),
        F.array_sort(F.collect_list(F.when(F.col("truncated") & ~F.col("covered"), F.col("page")))).alias("cut"),
    )
    blank = lambda c: trim_all(F.coalesce(F.col(f"`{c}`"), F.lit(""))) == ""
    k = kept.agg(F.count("*").alias("kept_rows"), F.count_if(blank("EAN Barcode")).alias("no_ean"), F.count_if(blank("Leaflet")).alias("no_leaflet"))
    both = kept.select("`Midas Code`").unionAll(review.select("`Midas Code`")).agg(F.count("*").alias("extracted_rows"), F.count_if(blank("Midas Code")).alias("blanks"))
    twice = kept.groupBy("`Midas Code`").count().where("count > 1").agg(F.array_sort(F.collect_list("`Midas Code`")).alias("twice"))
    df = pages.crossJoin(k).crossJoin(review.agg(F.count("*").alias("review_rows"))).crossJoin(both).crossJoin(twice)  # one row each
    cut = F.transform("cut", lambda p: F.concat(F.lit("page "), p.cast("string"), F.lit(": OCR table output is cut off (unclosed <table>) and the PDF geometry pass did not cover it - rows after the cut-off are unrecoverable")))
    doubles = F.when(F.size("twice") > 0, F.array(F.concat(F.lit("duplicate Midas codes in the CSV: ['"), F.array_join("twice", "', '"), F.lit("']")))).otherwise(F.array().cast("array<string>"))
    bare = [F.when(F.col(n) > 0.5 * F.col("kept_rows"), F.array(F.concat(F.lit(f"{c} is blank in "), F.col(n).cast("string"), F.lit("/"), F.col("kept_rows").cast("string"), F.lit(" rows - it cannot be read by OCR; it needs the PDF geometry pass")))).otherwise(F.array().cast("array<string>")) for c, n in (("EAN Barcode", "no_ean"), ("Leaflet", "no_leaflet"))]
    status = F.when((F.col("missing_rows") > 0) | (F.size("cut") > 0), "INCOMPLETE").when(F.col("review_rows") > 0, "NEEDS_REVIEW").otherwise("COMPLETE")
    return df.select(status.alias("status"), (F.col("on_pages") + F.col("blanks")).alias("expected_rows"), "extracted_rows", "kept_rows", "review_rows", "missing_rows", "missing", "truncated_pages", F.concat(cut, doubles, *bare).alias("warnings"))
