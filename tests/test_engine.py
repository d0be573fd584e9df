"""The rules of the table engine, case by case."""

import json

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gridloom.functions import headers, text as tx, validate as va
from gridloom.functions.profile import OUTPUT_COLUMNS
from gridloom.operators import barcode, compare, finalize as fin, geometry as geo, groups, history, rows as rw, tables as tb
from gridloom.operators.history import History
from gridloom.plans import extract as plan, outputs
from gridloom.sources import htmltable, pages, sheets
from gridloom.streaming.intake import page_stream, run_batches

GOOD = ["1", "AERO MILK", "15 x 90G", "M123456", "5000168001234", "£10.00", "£1.65", "2 FOR £5", "15.14%", "Yes", "", "2"]
EAN = "500016800123" + str(next(d for d in range(10) if barcode.check_ok(f"500016800123{d}")))
GOOD[4] = EAN


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def lit(v):
    return F.lit(v).cast("string")


@pytest.mark.parametrize(
    "raw, want",
    [("a\\nb", "a b"), (" a  b​c ", "a bc"), ("NaN", ""), (None, ""), ("<na>", ""), ("x\x1cy", "x y"), ("", "")],
)
def test_clean_text(spark, raw, want):
    assert one(spark, tx.clean_text(lit(raw)))[0] == want


def test_image_artifacts(spark):
    assert one(spark, tx.strip_image_artifacts(lit("[f47] AERO [ 3 ] x")))[0] == "AERO x"


@pytest.mark.parametrize("a, b, same", [("1", "1.0", True), ("1,000", "1000", True), ("£1.50", "1.50", True), (" Ab  c", "aB C ", True), ("", "nan", True), ("1.50", "1.51", False), ("BOGOF", "BOGOF x2", False), ("£2", "$2", True), ("1d", "1", False), ("ANY 2 FOR £2", "ANY 2 FOR $2", False), ("Straße", "STRASSE", True)])
def test_values_equal(spark, a, b, same):
    assert one(spark, tx.values_equal(lit(a), lit(b)))[0] == same


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=12, max_size=12), st.integers(0, 12), st.integers(1, 9))
def test_gs1_sees_every_wrong_digit(spark, digits, at, by):
    check = -sum(d * (1 if k % 2 == 0 else 3) for k, d in enumerate(digits)) % 10
    full = [*digits, check]
    wrong = [(d + by) % 10 if k == at else d for k, d in enumerate(full)]
    join = lambda x: "".join(map(str, x))
    assert one(spark, tx.gs1_ok(lit(join(full))), tx.gs1_ok(lit(join(wrong))))[:] == (True, False)


@pytest.mark.parametrize(
    "deal, code",
    [("£6.00", None), ("half price : £3.27", None), ("BUY 2 FOR £3", None), ("3 FOR 2", None), ("SAVE £1.00", None), ("£1.50 EACH", None), ("50p", None), ("2 POR £5", "deal_keyword"), ("$5", "wrong_currency"), ("GREAT", "bad_deal"), ("", None)],
)
def test_deals(spark, deal, code):
    got = one(spark, va.cell_issue("Consumer Deal", lit(deal)))[0]
    assert (got and got["code"]) == code


def product(spark, **change):
    cells = dict(zip(OUTPUT_COLUMNS, GOOD)) | change
    return spark.createDataFrame([(*cells.values(), "t", "1", "vlm-only", False, [])], "struct<" + ",".join(f"`{c}`:string" for c in OUTPUT_COLUMNS) + ",source_table:string,page:string,verified_by:string,repaired:boolean,flags:array<string>>")


@pytest.mark.parametrize(
    "change, codes, fixed",
    [
        ({}, "", None),
        ({"Consumer Deal": "2 POR £5"}, "", ("Consumer Deal", "2 FOR £5")),
        ({"Std RSP": "$1.65"}, "", ("Std RSP", "£1.65")),
        ({"Std RSP": "€1.65"}, "wrong_currency", None),
        ({"Midas Code": "M12345"}, "bad_midas", None),
        ({"Midas Code": ""}, "blank_midas_code", None),
        ({"EAN Barcode": "5000168001230"}, "bad_ean", None),
        ({"Consumer Deal": None}, "blank_consumer_deal", None),
        ({"Leaflet": "15.14%", "Promo POR": ""}, "bad_format", None),
        ({"Image": "[f47]"}, "", ("Image", "")),
    ],
)
def test_one_field_broken(spark, change, codes, fixed):
    done = fin.finalize(product(spark, **change))
    row = done.first()
    assert ",".join(i["code"] for i in row["issues"]) == codes
    assert (fin.kept(done).count(), fin.review(done).count()) == ((1, 0) if not codes else (0, 1))
    if fixed:
        assert row[fixed[0]] == fixed[1]
    if fixed and fixed[0] != "Image":
        assert row["verified_by"] == "vlm-only+profile-correction" and "->" in row["corrections"][0]["change"]


def test_corrections_off_and_exact_text(spark):
    bad = product(spark, **{"Consumer Deal": "2 POR £5"})
    assert fin.review(fin.finalize(bad, corrections=False)).first()["issue_codes"] == "deal_keyword"
    assert fin.kept(fin.finalize(bad.withColumn("verified_by", F.lit("text-layer")))).count() == 0
    flagged = product(spark).withColumn("flags", F.array(F.lit("ean_conflict"), F.lit("other")))
    assert fin.review(fin.finalize(flagged)).first()["reason"] == "ean_conflict"


@pytest.mark.parametrize("raw, want", [("MidasCode", "Midas Code"), (" pack  size", "Case Size"), ("por%", "Promo POR"), ("new thing", "New Thing")])
def test_headers(spark, raw, want):
    assert one(spark, headers.canonical_header(lit(raw)))[0] == want


@pytest.mark.parametrize(
    "html, want",
    [
        ("<table><tr><td>a<td colspan=2>b</td></tr><tr><td rowspan='2'>c</td><td>d</td></tr><tr><td>e</td></tr></table>", [[["a", "b", "b"], ["c", "d", None], [None, "e", None]]]),
        ("<table><tr><td>cut", []),
        ("<table><tr><td>x</td><tr><td>y</td></tr></table>", [[["y"]]]),
        ("<table></table>", []),
        ("<table><tr><td alt=\"I\"\">1 &amp; 2\\nz</td></tr></table><table><tr><th>q</th></tr></table>", [[["1 & 2 z"]], [["q"]]]),
        (None, []),
    ],
)
def test_html(html, want):
    assert [t["grid"] for t in htmltable.parse(html)] == want


def test_rowspans():
    html = "<table><tr><td rowspan=x>a</td><td rowspan=3>b</td></tr><tr><td>c</td></tr></table>"
    assert htmltable.parse(html) == [{"grid": [["a", "b"], ["c", None], [None, None]], "merges": [{"first": 0, "last": 2, "col": 1}]}]
    assert htmltable.parse(html, replicate=True)[0]["grid"] == [["a", "b"], ["c", "b"], [None, "b"]]


COLS = ["Product Description", "Case Size", "Midas Code", "Std RSP", "Consumer Deal", "Promo POR", "Leaflet"]
ROW = ["AERO", "15 x 90G", "M123456", "£1.65", "2 FOR £5", "15.14%", None]


def arrays(cells):
    return F.array(*map(lit, COLS)), F.array(*map(lit, cells))


@pytest.mark.parametrize("cells", [["AERO", None, *ROW[1:6]], [*ROW[1:], None]])
def test_realign(spark, cells):
    got = one(spark, rw.realign(*arrays(cells)))[0]
    assert got["values"] and got["values"][2] == "M123456" and got["reason"].startswith("realigned by ")


@pytest.mark.parametrize("cells, reason", [(["FRESH"] * 7, "category banner row"), (["x"] * 6 + [None], "category banner row"), (["x", "y"] + [None] * 5, "no Midas code anywhere in the row"), (["M123456", "M123457"] + ["z"] * 5, "several Midas-looking values, alignment ambiguous")])
def test_refused(spark, cells, reason):
    assert one(spark, rw.realign(*arrays(cells)))[0]["reason"] == reason


def test_realign_tail(spark):
    slid = [*ROW[:5], None, "15.14%"]
    assert one(spark, rw.realign_tail(*arrays(slid)))[0] == ROW
    assert one(spark, rw.realign_tail(*arrays([*ROW[:4], None, *ROW[5:]])))[0] is None  # a blank is no evidence
    assert one(spark, rw.realign_tail(*arrays(ROW)))[0] is None


@settings(max_examples=10, deadline=None)
@given(st.lists(st.sampled_from([*ROW, "x", "£9.99", None]), min_size=7, max_size=7))
def test_realigning_never_lowers_the_score(spark, cells):
    c, v = arrays(cells)
    got = one(spark, rw.realign(c, v)["values"], rw.score(c, v), rw.score(c, rw.realign(c, v)["values"]))
    assert got[0] is None or got[2] > got[1]


def test_fill_groups(spark):
    names, merges = ["Midas Code", "Consumer Deal"], [(0, 2, "Consumer Deal"), (2, 3, "Consumer Deal")]
    data = [("d", 1, k, names, ["M1", v], merges) for k, v in ((0, None), (1, "2 POR"), (2, "£6.00"), (3, None))] + [("d", 2, 0, names, ["M2", None], [])]
    df = spark.createDataFrame(data, "doc string, table_index int, row_idx int, columns array<string>, values array<string>, merges array<struct<first:int,last:int,column:string>>")
    got = {(r["table_index"], r["row_idx"]): r["values"][1] for r in groups.fill_groups(df, ["doc", "table_index"]).collect()}
    assert got == {(1, 0): "£6.00", (1, 1): "2 POR", (1, 2): "£6.00", (1, 3): "£6.00", (2, 0): None}


def test_comparison(spark):
    ext = spark.createDataFrame([(1, "A1", "2 for £5", "1.50"), (2, "A2", "BOGOF", "2.00"), (3, "A3", "3 for £10", "3.00"), (4, "a1 ", "dup", "9"), (5, "", "x", "1")], "ord int, code string, deal string, price string")
    old = spark.createDataFrame([(1, " a1", "2 for £5", "1.5"), (2, "A3", "3 for £12", "3.00"), (3, "A9", "Half price", "9.99"), (4, None, "", "")], "ord int, Code string, Deal string, Status string")
    c = compare.compare_by_key(ext, old, ("code", "Code"), [("deal", "Deal"), ("price", "Status"), ("deal", "Deal")])
    s = c.summary.first()
    assert (s["rows_paired"], s["matching_rows"], s["mismatched_rows"], s["only_in_existing_rows"], s["only_in_extracted_rows"]) == (2, 1, 1, 2, 2)
    assert (s["duplicate_keys_extracted"], s["blank_keys_extracted"], s["blank_keys_ground"]) == (1, 1, 1)
    assert [r["Status (comparison)"] for r in c.report.orderBy("ord").collect()] == ["Same Values", "Values Mismatch", "No data in PDF", "No data in PDF"]
    assert [(r["matches"], r["accuracy"]) for r in c.fields.collect()] == [(1, 50.0), (2, 100.0)]
    with pytest.raises(ValueError):
        compare.compare_by_key(ext, old, ("nope", "Code"), [("deal", "Deal")])
    with pytest.raises(ValueError):
        compare.compare_by_key(ext, old, ("code", "Code"), [])


@pytest.mark.parametrize("module", [1, 2, 3, 4, 6, 8])
def test_barcodes(module):
    image = barcode.encode(EAN, module)
    assert barcode.decode(image) == EAN and barcode.decode(image[:, ::-1]) == EAN and barcode.decode(np.rot90(image).copy()) == EAN
    assert barcode.decode(barcode.encode(EAN[:-1] + str((int(EAN[-1]) + 1) % 10), module)) is None
    assert barcode.decode(np.full((20, 200), 255, np.uint8)) is None


def _words(lines):
    return geo.Words.of((t, x, y, x + w, y + 10) for t, x, y, w in lines)


HEAD = [("Product", 10, 0, 40), ("Description", 55, 0, 60), ("Midas", 300, 0, 30), ("Code", 300, 12, 25), ("Consumer", 450, 0, 50), ("Deal", 505, 0, 25)]


def test_geometry_sees_a_row_without_its_code():
    w = _words(HEAD + [("AERO", 10, 30, 40), ("M123456", 300, 30, 50), ("2 FOR £5", 450, 45, 60), ("TWIX", 10, 60, 40), ("£1.00", 450, 60, 40), ("MARS", 10, 90, 40), ("M123457", 300, 90, 50), ("50P", 450, 90, 40)])
    rules = [(55.0, 0.0, 600.0), (85.0, 0.0, 600.0)]
    t = geo.rebuild(w, rules, [], (0, -5, 600, 110))
    assert [r["kind"] for r in t.rows] == ["product", "blank_midas", "product"] and t.band_method == "rules"
    assert t.layout.names == ["Product Description", "Midas Code", "Consumer Deal"]
    below = _words([("BOUNTY", 10, 200, 50), ("M123458", 300, 200, 50), ("50P", 450, 200, 30)])
    assert geo.rebuild(below, [], [], (0, 190, 600, 220), carried=t.layout).layout.source == "carried"
    assert geo.rebuild(below, [], [], (200, 190, 600, 220), carried=t.layout).layout is None


def test_a_row_below_the_header_that_has_a_header_word_is_a_row():
    w = _words(HEAD + [("AERO", 10, 34, 40), ("2 POR £5", 450, 34, 60), ("MARS", 10, 64, 40), ("M123457", 300, 64, 50), ("50P", 450, 64, 40)])
    t = geo.rebuild(w, [(55.0, 0.0, 600.0)], [], (0, -5, 600, 85))
    assert t.layout.names == ["Product Description", "Midas Code", "Consumer Deal"]
    assert [(r["kind"], r["cells"]["Product Description"], r["cells"]["Consumer Deal"]) for r in t.rows] == [("blank_midas", "AERO", "2 POR £5"), ("product", "MARS", "50P")]


def test_shared_deals():
    w = _words(HEAD + [("A", 10, 30, 40), ("M123456", 300, 30, 50), ("B", 10, 60, 40), ("M123457", 300, 60, 50), ("2 FOR £5", 450, 45, 60), ("C", 10, 90, 40), ("M123458", 300, 90, 50), ("GREAT", 450, 90, 40)])
    rules = [(55.0, 0.0, 400.0), (85.0, 0.0, 600.0)]
    rows = geo.rebuild(w, rules, [], (0, -5, 600, 110)).rows
    assert [r["cells"]["Consumer Deal"] for r in rows] == ["2 FOR £5", "2 FOR £5", "GREAT"]
    assert [r["deal_method"] for r in rows] == ["rules-group", "rules-group", "rules-single"]


def test_boxes_and_rules():
    assert geo.merge_boxes([(0, 0, 50, 100), (52, 0, 100, 100), (0, 200, 100, 300)]) == [(0, 0, 100, 100), (0, 200, 100, 300)]
    assert geo.merge_rules([(10, 0, 50), (10.5, 52, 90), (10, 100, 120)]) == [(10.25, 0, 90), (10, 100, 120)]
    assert geo.read_barcode({"EAN Barcode": EAN}, "0" + EAN)[0] == "0" + EAN
    assert geo.read_barcode({"EAN Barcode": EAN}, "4006381333931")[1] == "ean_conflict"


def _page(k, blocks, index=None):
    return json.dumps({"page_index": index, "input_path": "x", "parsing_res_list": [{"block_label": a, "block_content": b, "block_order": o, "block_bbox": box} for a, b, o, box in blocks]}, ensure_ascii=False)


def _table(rows, head=True):
    names = ["", "Product Description", "Case Size", "MidasCode", "EAN Barcode", "Prom WSP", "Std RSP", "Consumer Deal", "Promo POR", "Leaflet", "Feature Space", "Shelf"]
    line = lambda r: "<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>"
    return "<table>" + "".join(map(line, ([names] if head else []) + rows)) + "</table>"


@pytest.fixture()
def document(tmp_path):
    folder = tmp_path / "my doc"
    folder.mkdir()
    rows = [[*GOOD[:3], f"M12345{k}", *GOOD[4:9], "", *GOOD[10:]] for k in range(4)]
    rows[1][7] = "2 POR £5"
    rows[2][3] = "M1234"
    banner = ["FRESH"] * 12
    (folder / "page_001_res.json").write_text(_page(1, [("doc_title", " Pack ", 0, None), ("header", "H1", 1, None), ("text", "Week 7", 2, None), ("table", _table([banner, *rows[:2]]), 3, [0, 0, 10, 10])]), encoding="utf-8")
    (folder / "page_002_res.json").write_text(_page(2, [("table", _table(rows[2:], head=False), None, None), ("table", _table([["a", "b"]], False), 1, None)]), encoding="utf-8")
    return folder


def test_extraction(spark, document):
    got = plan.extract(spark, str(document))
    assert [(r["Midas Code"], r["Consumer Deal"], r["source_table"], r["page"]) for r in got.kept.collect()] == [("M123450", "2 FOR £5", "table-1", 1), ("M123451", "2 FOR £5", "table-1", 1), ("M123453", "2 FOR £5", "table-2", 2)]
    assert [(r["Midas Code"], r["issue_codes"]) for r in got.review.collect()] == [("M1234", "bad_midas")]
    proof = plan.require_complete(got)
    assert proof["status"] == "NEEDS_REVIEW" and proof["expected_rows"] == 4 and proof["missing_rows"] == 0
    assert got.stats.first().asDict() == {"blank_midas": 0, "banners": 1, "repaired": 0, "filled": 0, "rejected": 1, "needs_review": 1}
    notes = {(r["column"], r["midas"]): r["ocr_value_or_note"] for r in got.audit.collect()}
    assert notes["Consumer Deal", "M123451"] == "corrected by document profile: '2 POR £5' -> '2 FOR £5'"
    tables = pages.read_tables(pages.read_pages(spark, str(document))).orderBy("table_index").collect()
    assert [(t["doc"], t["table_index"], t["page"], t["document_title"], t["header"], t["table_heading"]) for t in tables] == [("my doc", 1, 1, "Pack", "H1", "Week 7"), ("my doc", 2, 2, None, None, "Untitled Table"), ("my doc", 3, 2, None, None, "Untitled Table")]


def test_cut_off_pages_are_incomplete(spark, document):
    (document / "page_003_res.json").write_text(_page(3, [("table", "<table><tr><td>M999999</td></tr>", 1, None)]), encoding="utf-8")
    got = plan.extract(spark, str(document))
    with pytest.raises(plan.IncompleteExtraction):
        plan.require_complete(got)
    assert plan.require_complete(got, allow_incomplete=True)["missing_rows"] == 1


def test_geometry_covers_a_page(spark, document):
    words = HEAD + [("AERO", 10, 30, 40), ("M123450", 300, 30, 50), ("50P", 450, 30, 30), ("TWIX", 10, 60, 40), ("M123451", 300, 60, 50), ("£2.00", 450, 60, 30)]
    data = [("my doc", 1, [(t, float(x), float(y), float(x + w), float(y + 10)) for t, x, y, w in words], [[50.0, 0.0, 600.0]], [], [[0.0, -5.0, 600.0, 80.0]], None)]
    df = spark.createDataFrame(data, "doc string, page int, words array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>, h_rules array<array<double>>, v_rules array<array<double>>, boxes array<array<double>>, names array<string>")
    (document / "_geometry").mkdir()
    for r in geo.geometry_pass(df).collect():
        (document / "_geometry" / f"page_{r['page']:03d}.json").write_text(r["sidecar"], encoding="utf-8")
    got = plan.extract(spark, str(document))
    kept = {r["Midas Code"]: (r["Consumer Deal"], r["verified_by"]) for r in got.kept.collect()}
    assert kept["M123450"] == ("50P", "text-layer") and kept["M123453"] == ("2 FOR £5", "vlm-only")
    checks = {(r["midas"], r["column"]): (r["pdf_geometry_value"], r["ocr_value_or_note"]) for r in got.audit.collect()}
    assert checks["M123450", "Consumer Deal"] == ("50P", "2 FOR £5")


def test_no_pages(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|No JSON"):
        pages.read_pages(spark, str(tmp_path))
    assert pages.read_sidecars(spark, str(tmp_path)).count() == 0
    for bad in (dict(mode="first_n", max_pages=0), dict(mode="page_range", start=3, end=2), dict(mode="odd")):
        with pytest.raises(ValueError):
            pages.prune_pages(spark.range(3), "id", **bad)


def test_sheets(spark, tmp_path):
    df = spark.createDataFrame([(2, "b, \"q\"", None), (1, "é\x01", "2")], "ord int, name string, n string")
    assert sheets.write_csv(df, f"{tmp_path}/a.csv", ["ord"])
    raw = (tmp_path / "a.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf" + b"ord,name,n\n1,") and not sheets.write_csv(df.limit(0), f"{tmp_path}/no.csv", [], skip_empty=True)
    assert [tuple(r) for r in sheets.load_table(spark, f"{tmp_path}/a.csv").collect()][1] == ("2", 'b, "q"', "")
    sheets.write_xlsx(df, f"{tmp_path}/a.xlsx", ["ord"])
    assert [tuple(r) for r in sheets.load_table(spark, f"{tmp_path}/a.xlsx").collect()] == [("é", "2"), ('b, "q"', "")]
    assert sheets.load_merged(spark, f"{tmp_path}/a.csv").collect()[1]["n"] is None
    with pytest.raises(ValueError):
        sheets.load_table(spark, "a.doc")


def test_history(spark, tmp_path):
    h = History(spark, f"file://{tmp_path}/h")
    a, b = (h.add("extraction_records", filename=n, mode="all", status="COMPLETE", rows=3) for n in ("a.pdf", "b.pdf"))
    h.add("extracted_tables", record_id=a, table_index=2)
    h.add("extracted_tables", record_id=a, table_index=1)
    c = h.add("comparison_records", record_id=a, summary="{}")
    h.set_reports(c, "r.xlsx", "o.xlsx")
    assert (a, b) == (1, 2) and [r["table_index"] for r in h.tables_of(a).collect()] == [1, 2]
    row = h.comparisons().first()
    assert (row["filename"], row["report_path"]) == ("a.pdf", "r.xlsx")
    assert h.delete_record(a) and not h.delete_record(a)
    assert h.comparisons().count() == 0 and h.tables_of(a).count() == 0 and h.records().count() == 1


def test_stream(spark, document, tmp_path):
    seen = []
    stream = page_stream(spark, str(document.parent))
    run_batches(stream, lambda df, k: seen.extend(r["file"] for r in df.select("file").collect()), f"{tmp_path}/cp").awaitTermination(60)
    assert sorted(seen) == ["page_001_res.json", "page_002_res.json"]


def test_entry_without_the_llm_folder(tmp_path):
    """The other queries still work when the training-data operators are taken away."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "gridloom", tmp_path / "gridloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'kept_rows' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})


def test_outputs(spark, document, tmp_path):
    got = plan.extract(spark, str(document))
    made = outputs.write_extraction(got, str(tmp_path), "my doc")
    assert sorted(made) == ["audit", "kept", "rejected"] and (tmp_path / "my doc.csv").read_bytes().startswith(b"\xef\xbb\xbfImage,Product Description")
    assert sheets.load_merged(spark, made["kept"]).count() == 3
    tables = tb.promote_header(pages.read_tables(pages.read_pages(spark, str(document))))
    outputs.write_raw_tables(tables, f"{tmp_path}/individual")
    files = sorted((tmp_path / "individual").glob("doc=*/table_index=*/part-*"))
    assert len(files) == 3 and files[2].read_text() == "0,1\na,b\n"
    assert pages.table_by_index(tables, "my doc", 2).count() == 1
    with pytest.raises(LookupError):
        pages.table_by_index(tables, "my doc", 9)
    assert pages.html_tables(pages.read_pages(spark, str(document))).count() == 3


def test_sidecars_are_replaced_by_document(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "doc string, page int, sidecar string")
    outputs.write_sidecars(rows(("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x")), f"{tmp_path}/s")
    outputs.write_sidecars(rows(("a", 1, "y")), f"{tmp_path}/s")
    assert sorted((r["doc"], r["page"], r["sidecar"]) for r in spark.read.parquet(f"{tmp_path}/s").collect()) == [("a", 1, "y"), ("b", 1, "x")]


def test_replay(spark, document):
    kept, review = plan.replay(spark, str(document))
    assert [r["Midas Code"] for r in kept.collect()] == ["M123450", "M123451"] and review.count() == 0


def test_compare_a_file(spark, tmp_path):
    (tmp_path / "mine.csv").write_text("code,deal\nM1,50P\nM2,NA\nM9,x\n")
    extracted = spark.createDataFrame([(1, "M1", "50P"), (2, "M2", ""), (3, "M3", "9P")], "ord int, Code string, Deal string")
    kept = history.History(spark, f"{tmp_path}/h")
    record = kept.add("extraction_records", filename="../My pack (1).pdf")
    made, number = outputs.compare_file(spark, extracted, f"{tmp_path}/mine.csv", '{"extracted": "Code", "existing": "code"}', '[{"extracted": "Deal", "existing": "deal"}]', kept, record, str(tmp_path))
    assert made.summary.first()["matching_rows"] == 2 and kept.comparisons().first()["filename"] == "../My pack (1).pdf"
    assert (tmp_path / f"comparison_{number}_My_pack_1_existing-data.xlsx").exists() and (tmp_path / f"comparison_{number}_My_pack_1_only-in-extracted.xlsx").exists()
    for bad in ("no", "[]", '{"extracted": "a"}', '{"extracted": "", "existing": "b"}'):
        with pytest.raises(ValueError):
            outputs.parse_pair(bad, "key")
    for bad in ("{}", "[]", "[1]"):
        with pytest.raises(ValueError):
            outputs.parse_pairs(bad, "fields")
    assert outputs.file_stem("a/§") == "document" and outputs.safe_name("../x.pdf") == "x.pdf"


def test_users(spark, tmp_path):
    kept = history.History(spark, f"{tmp_path}/h")
    assert history.seed_user(kept, "admin", "secret") and not history.seed_user(kept, "admin", "other")
    assert history.knows_user(kept, "admin", "secret") and not history.knows_user(kept, "admin", "other")


def test_position_summary(spark):
    a = spark.createDataFrame([(1, "x", "1"), (2, "y", "2"), (3, "z", "3")], "row int, A string, b string")
    b = spark.createDataFrame([(1, "x", "1"), (2, "y", "9")], "row int, a string, B string")
    got = compare.position_summary(a, b).first()
    assert (got["rows_compared"], got["matching_rows"], got["extra_rows_extracted"], got["extra_rows_ground"], got["accuracy_percent"]) == (2, 1, 1, 0, 50.0)
    assert got["summary"] == "Compared 2 rows across 2 common columns. Row-level accuracy: 50.00%. Matching rows: 1, Mismatched rows: 1."
    none = compare.position_summary(a, b.select("row", F.col("a").alias("other"))).first()
    assert none["summary"].startswith("No common columns") and none["rows_compared"] is None and none["accuracy_percent"] == 0


def test_fallback_decoding():
    image = barcode.encode(EAN, 3).astype(float)
    gray = (60 + image * 0.5).astype(np.uint8)
    assert barcode.decode_any(gray) == EAN and barcode.decode_any(np.zeros((0, 5), np.uint8)) is None
    assert barcode.best_valid(["1", EAN]) == EAN and barcode.best_valid(["1", "2"]) == "1" and barcode.best_valid([]) is None


def test_barcodes_and_ticks_in_the_page_pass():
    head = HEAD + [("EAN", 350, 0, 30), ("Barcode", 350, 12, 40), ("Leaflet", 560, 0, 30)]
    w = _words(head + [("A", 10, 30, 40), ("M123456", 300, 30, 40), ("4006381333931", 350, 30, 60), ("50P", 450, 30, 40)])
    made, _ = geo.sidecar(1, w, [], [], [(0, -5, 620, 60)], None, None, bars=[(EAN, 380.0, 35.0)], inks=[(575.0, 35.0, 0.3)])
    row = made["tables"][0]["rows"][0]
    assert row["cells"]["EAN Barcode"] == "4006381333931" and row["flags"] == ["ean_conflict"] and row["alt"] == {"EAN Barcode": EAN}
    assert row["cells"]["Leaflet"] == "Yes"
