"""User tables: CSV and XLSX in, CSV with a byte-order mark and XLSX out; all cells are text."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import sheet_safe

#: What a CSV or sheet reader takes for missing; fixed values.
NA = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, missing values empty."""
    if path.lower().endswith(".csv"):
        df = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8", multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        df = df.toDF(*[c.removeprefix("\ufeff") for c in df.columns])
    elif path.lower().endswith(".xlsx"):
        df = read_xlsx(spark, path)
    else:
        raise ValueError(f"unsupported file type: {path.rsplit('.', 1)[-1]}")
    return df.select(*[F.when(F.col(f"`{c}`").isin(*NA) | F.col(f"`{c}`").isNull(), "").otherwise(F.col(f"`{c}`")).alias(c) for c in df.columns])


def load_merged(spark: SparkSession, path: str) -> DataFrame:
    """A written table again, empty cells null."""
    df = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8", multiLine=True, escape='"')
    return df.toDF(*[c.removeprefix("\ufeff") for c in df.columns])


#: Rows that are shown of an upload, an extraction, and a report; fixed values.
PREVIEW = {"upload": 5, "extract": 50, "report": 100}


def preview(df: DataFrame, rows: int = PREVIEW["upload"]) -> tuple[list[str], DataFrame]:
    return df.columns, df.limit(rows)


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def sheet_rows(data: bytes) -> Iterator[list[str | None]]:
    """The rows of the first sheet of a workbook."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        for row in ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml")).iter(f"{_MAIN}row"):
            out: dict[int, str | None] = {}
            for k, c in enumerate(row):
                value = c.find(f"{_MAIN}v")
                text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t")) if c.get("t") == "inlineStr" else value.text if value is not None else None
                out[_column(c.get("r")) if c.get("r") else k] = shared[int(text)] if c.get("t") == "s" and text is not None else text
            yield [out.get(k) for k in range(1 + max(out, default=-1))]


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet; one workbook is one task, as its format asks."""
    head = spark.read.format("binaryFile").load(path).select("content").first()
    names = [c or f"Unnamed: {k}" for k, c in enumerate(next(sheet_rows(head["content"]), []))]
    width = len(names)

    def run(batches):
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                rows = list(sheet_rows(content))[1:]
                yield pd.DataFrame([[*r[:width], *[None] * (width - len(r))] for r in rows], columns=names, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, StructType([StructField(c, StringType()) for c in names]))


def workbook(names: list[str], rows: Iterator[list]) -> bytes:
    """A workbook of one sheet with inline texts."""

    def line(k: int, cells: list) -> str:
        return f'<row r="{k}">' + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape("" if c is None else str(c))}</t></is></c>' for c in cells) + "</row>"

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = [("/xl/workbook.xml", "sheet.main"), ("/xl/worksheets/sheet1.xml", "worksheet")]
        types = "".join(f'<Override PartName="{p}" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{t}+xml"/>' for p, t in kinds)
        z.writestr("[Content_Types].xml", f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        body = "".join(line(k, r) for k, r in enumerate([names, *rows], 1))
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def _put(spark: SparkSession, path: str, chunks: Iterator[bytes]) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    for chunk in chunks:
        stream.write(bytearray(chunk))
    stream.close()


def write_xlsx(df: DataFrame, path: str, order: list[str]) -> None:
    """One workbook, rows streamed to the driver: a report for people, not a table format."""
    df = df.orderBy(*order).select(*[sheet_safe(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns if c not in order or c != "ord"])
    _put(df.sparkSession, path, iter([workbook(df.columns, (list(r) for r in df.toLocalIterator()))]))


def write_csv(df: DataFrame, path: str, order: list[str], skip_empty: bool = False) -> bool:
    """One CSV file with a byte-order mark; says whether it was written."""
    if skip_empty and df.isEmpty():
        return False
    cell = lambda v: "" if v is None else '"' + str(v).replace('"', '""') + '"' if re.search('[",\r\n]', str(v)) else str(v)
    line = lambda cells: (",".join(map(cell, cells)) + "\n").encode()
    rows = df.orderBy(*order) if order else df
    _put(df.sparkSession, path, (x for part in (iter([b"\xef\xbb\xbf" + line(df.columns)]), (line(r) for r in rows.toLocalIterator())) for x in part))
    return True
