"""Recognised pages: JSON files of blocks, one per page, in a folder per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.text import trim_all
from .htmltable import with_tables

PAGE = "page_index int, input_path string, width int, height int, parsing_res_list array<struct<block_label:string,block_content:string,block_order:int,block_bbox:array<double>>>"
SIDECAR = (
    "page int, mode string, anchors_on_page int, rows_rebuilt int, midas_codes array<string>, warnings array<string>, tables array<struct<bbox:array<double>,"
    "layout:struct<names:array<string>,edges:array<double>,source:string>,header_found:boolean,band_method:string,warnings:array<string>,"
    "rows:array<struct<kind:string,y0:double,y1:double,cells:map<string,string>,flags:array<string>,deal_method:string,alt:map<string,string>>>>>"
)


def _path() -> Column:
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(doc, file, raw, page fields) of each JSON file right in ``folder``; none is an error."""
    raw = spark.read.text(f"{folder}/*.json", wholetext=True)
    df = raw.select(_path().alias("path"), F.col("value").alias("raw"), F.from_json("value", PAGE).alias("p")).select("path", "raw", "p.*")
    df = df.withColumn("doc", F.regexp_extract("path", "([^/]+)/[^/]+$", 1)).withColumn("file", F.regexp_extract("path", "([^/]+)$", 1))
    if df.isEmpty():
        raise FileNotFoundError(f"No JSON files found in {folder}")
    return df


def page_number(index: Column, file: Column) -> Column:
    """page_index + 1, or the number in the file's name; null prints as '-'."""
    return F.coalesce(index + 1, F.nullif(F.regexp_extract(file, r"page_(\d+)", 1), F.lit("")).try_cast("int"))


def blocks(pages: DataFrame, label: str | None = None) -> DataFrame:
    """The blocks of pages in order, of one label if it is named."""
    out = pages.select("*", F.posexplode("parsing_res_list").alias("block_pos", "b")).select("*", "b.*").drop("b")
    return out if label is None else out.where(F.col("block_label") == label)


def html_tables(pages: DataFrame) -> DataFrame:
    """The blocks of any label whose content has a table in HTML."""
    return blocks(pages).where(F.contains(F.lower(F.coalesce("block_content", F.lit(""))), F.lit("<table")))


def table_by_index(tables: DataFrame, doc: str, index: int) -> DataFrame:
    """The one table of a document with this number; an error if the document or the number is gone."""
    out = tables.where((F.col("doc") == doc) & (F.col("table_index") == index))
    if out.isEmpty():
        raise LookupError(f"no table {index} in {doc!r}")
    return out


def page_header(block_list: Column) -> Column:
    """All header blocks with text, joined; null without any."""
    texts = F.transform(F.filter(block_list, lambda b: b["block_label"] == "header"), lambda b: trim_all(F.coalesce(b["block_content"], F.lit(""))))
    texts = F.filter(texts, lambda t: t != "")
    return F.when(F.size(texts) > 0, F.array_join(texts, " | "))


def document_title(block_list: Column) -> Column:
    """The first title block, even if empty; null without one."""
    titles = F.filter(block_list, lambda b: b["block_label"] == "doc_title")
    return F.get(F.transform(titles, lambda b: trim_all(F.coalesce(b["block_content"], F.lit("")))), F.lit(0))


def table_heading(block_list: Column, order: Column) -> Column:
    """The last text with words before the first block whose order is not below the table's."""
    numbered = F.filter(block_list, lambda b: b["block_order"].isNotNull())
    stops = F.filter(F.transform(numbered, lambda b, i: F.when(b["block_order"] >= order, i)), lambda i: i.isNotNull())
    before = F.slice(numbered, F.lit(1), F.coalesce(F.get(stops, F.lit(0)), F.size(numbered)))
    texts = F.filter(F.transform(F.filter(before, lambda b: b["block_label"] == "text"), lambda b: trim_all(F.coalesce(b["block_content"], F.lit("")))), lambda t: t != "")
    return F.when(order.isNotNull() & (F.size(texts) > 0), F.element_at(texts, -1)).otherwise("Untitled Table")


def read_tables(pages: DataFrame) -> DataFrame:
    """A row per table, numbered from 1 in a document by file, block and place in the block."""
    df = pages.select("doc", "file", "page_index", "parsing_res_list", F.posexplode(F.filter("parsing_res_list", lambda b: b["block_label"] == "table")).alias("block_index", "b"))
    df = df.where(F.length("b.block_content") > 0)
    meta = df.select(
        "doc", "file", "block_index",
        page_number(F.col("page_index"), F.col("file")).alias("page"),
        document_title(F.col("parsing_res_list")).alias("document_title"),
        page_header(F.col("parsing_res_list")).alias("header"),
        table_heading(F.col("parsing_res_list"), F.col("b.block_order")).alias("table_heading"),
        F.when(F.size("b.block_bbox") == 4, F.col("b.block_bbox")).alias("bbox"),
        F.col("b.block_content").alias("html"),
    )
    tables = with_tables(meta, "html").drop("html")
    return tables.withColumn("table_index", F.row_number().over(W.partitionBy("doc").orderBy("file", "block_index", "frag_index")))


def read_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """The geometry of pages; of two files of one page the later one counts. No folder, no rows."""
    schema = spark.createDataFrame([], f"doc string, {SIDECAR}").schema
    try:
        raw = spark.read.text(f"{folder}/_geometry/page_*.json", wholetext=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    df = raw.select(F.regexp_extract(_path(), "([^/]+)/_geometry/[^/]+$", 1).alias("doc"), _path().alias("path"), F.from_json("value", SIDECAR).alias("s"))
    return df.groupBy("doc", F.col("s.page").alias("_p")).agg(F.max_by("s", "path").alias("s")).select("doc", "s.*")


def prune_pages(pages: DataFrame, page: str, mode: str = "all", max_pages: int | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """all, first_n or page_range (from 1, both ends in); a range beyond the document is empty."""
    if mode == "all":
        return pages
    if mode == "first_n":
        if not max_pages or max_pages <= 0:
            raise ValueError("max_pages must be greater than 0")
        return pages.where(F.col(page) <= max_pages)
    if mode == "page_range":
        if not start or not end or start < 1 or end < start:
            raise ValueError("a page range needs 1 <= start <= end")
        return pages.where(F.col(page).between(start, end))
    raise ValueError(f"unknown mode {mode!r}")
