"""Grammar checks of cells and rows, compiled from a profile to Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from .profile import ACTIVE, Profile
from .text import bare_digits, clean_text, gs1_ok, is_blank, let, quoted, strip_image_artifacts

ISSUE = "struct<column:string,code:string,message:string,value:string>"


def issue(column: str, code: str | Column, message: str | Column, value: Column) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(column).alias("column"), text(code).alias("code"), text(message).alias("message"), value.alias("value"))


def _code_issue(text: Column, p: Profile) -> Column:
    found = F.length(F.regexp_replace(text, r"\D", "")).cast("string")
    digits = F.concat(F.lit("Midas Code must be M + 6 digits, found "), found, F.lit(" digits"))
    return (
        F.when(text == "", issue("Midas Code", "blank_midas", "Midas Code is blank", F.lit("")))
        .when(text.rlike(p.code), None)
        .otherwise(issue("Midas Code", "bad_midas", F.when(text.rlike(p.code_like), digits).otherwise("not a Midas code"), text))
    )


def _barcode_issue(text: Column, p: Profile) -> Column:
    bad = lambda m: issue("EAN Barcode", "bad_ean", m, text)

    def check(digits: Column) -> Column:
        return (
            F.when(digits == "", bad("barcode contains non-digit characters"))
            .when(~F.length(digits).isin(*p.barcode_lengths), bad(F.concat(F.length(digits).cast("string"), F.lit(" digits is not a valid barcode length"))))
            .when(~gs1_ok(digits), bad("GS1 check digit does not match"))
        )

    return F.when(text == "", issue("EAN Barcode", "blank_ean", "EAN Barcode is blank", F.lit(""))).otherwise(let(bare_digits(text), check))


def is_deal(text: Column, p: Profile = ACTIVE) -> Column:
    return text.rlike(p.deal)


def _fixed_deal(text: Column, p: Profile) -> Column:
    words = F.create_map(*[F.lit(x) for kv in p.confused_words.items() for x in kv])
    fixed = F.array_join(F.transform(F.split(text, " "), lambda w: F.coalesce(F.try_element_at(words, F.upper(w)), w)), " ")
    return let(fixed, lambda x: F.when((text != "") & (x != text) & is_deal(x, p), x))


def deal_fix(c: Column, p: Profile = ACTIVE) -> Column:
    """The deal with confused words replaced; null unless that makes it a deal."""
    return let(clean_text(c), lambda text: _fixed_deal(text, p))


def _foreign(text: Column, p: Profile) -> Column:
    return text.rlike("[" + "".join("\\" + s if s == "$" else s for s in p.foreign_symbols) + "]")


def _deal_issue(text: Column, p: Profile) -> Column:
    extra = lambda hint: F.when(hint.isNotNull(), F.concat(F.lit("; did you mean "), quoted(hint), F.lit("?"))).otherwise("")
    bad = lambda code, m: issue("Consumer Deal", code, m, text)
    return (
        F.when(text == "", issue("Consumer Deal", "blank_deal", "Consumer Deal is blank", F.lit("")))
        .when(_foreign(text, p), bad("wrong_currency", "deal contains a non-GBP currency symbol"))
        .when(is_deal(text, p), None)
        .when(text.rlike(r"(?i)\bPOR\b"), bad("deal_keyword", F.concat(F.lit("'POR' is not valid deal wording (OCR confusion of 'FOR')"), let(_fixed_deal(text, p), extra))))
        .otherwise(bad("bad_deal", "deal text does not match any known deal wording"))
    )


def _tidy_blank(c: Column) -> Column:
    """``is_blank`` of a cell that is sanitised."""
    return F.lower(c).isin("", "nan", "none", "<na>")


def _tidy_text(c: Column) -> Column:
    """``clean_text`` of a cell that is sanitised."""
    return F.when(_tidy_blank(c), F.lit("")).otherwise(c)


def cell_issue(column: str, c: Column, p: Profile = ACTIVE, tidy: bool = False) -> Column:
    """What is wrong with one cell, null if nothing. A blank is wrong in the key column only. ``tidy`` cells are sanitised before."""
    blank, clean = (_tidy_blank, _tidy_text) if tidy else (is_blank, clean_text)
    if column == "Midas Code":
        return let(clean(c), lambda text: _code_issue(text, p))
    if column == "EAN Barcode":
        return F.when(~blank(c), let(clean(c), lambda text: _barcode_issue(text, p)))
    if column == "Consumer Deal":
        return F.when(~blank(c), let(clean(c), lambda text: _deal_issue(text, p)))
    if column not in p.column_patterns:
        return F.lit(None).cast(ISSUE)

    def match(text: Column) -> Column:
        wrong = F.when(~text.rlike(f"^{p.column_patterns[column]}$"), issue(column, "bad_format", "value does not match the expected format", text))
        if column in ("Prom WSP", "Std RSP"):
            return F.when(_foreign(text, p), issue(column, "wrong_currency", f"only '{p.currency}' is valid in this document", text)).otherwise(wrong)
        return wrong

    return F.when(~blank(c), match(c) if tidy else let(clean(c), match))


def row_issues(cells: Mapping[str, Column], p: Profile = ACTIVE, tidy: bool = False) -> Column:
    """All issues: blanks of mandatory columns first, then every cell that is not blank, in order."""
    is_empty = _tidy_blank if tidy else is_blank
    blank = [F.when(is_empty(cells[m]) if m in cells else F.lit(True), issue(m, f"blank_{m.lower().replace(' ', '_')}", f"{m} is blank", F.lit(""))) for m in p.mandatory]
    own = [cell_issue(m, c, p, tidy) if m != "Midas Code" else F.when(~is_empty(c), cell_issue(m, c, p, tidy)) for m, c in cells.items() if m in p.column_patterns or m in ("Midas Code", "EAN Barcode", "Consumer Deal")]
    return F.filter(F.array(*blank, *own), lambda x: x.isNotNull())


def issue_text(x: Column) -> Column:
    return F.concat(x["column"], F.lit(": "), x["message"], F.lit(" (got "), quoted(x["value"]), F.lit(")"))


def corrected(column: str, c: Column, p: Profile = ACTIVE, tidy: bool = False) -> Column:
    """struct(value, note): a foreign dollar or a confused deal word is set right if the result is valid."""

    def fix(text: Column) -> Column:
        out = F.regexp_replace(text, r"\$(?=\d)", p.currency) if column in p.currency_columns else text
        if column != "Consumer Deal":
            return out
        return let(out, lambda x: F.when(x.rlike(r"(?i)\bPOR\b"), F.coalesce(_fixed_deal(x, p), x)).otherwise(x))

    def result(text: Column, fixed: Column) -> Column:
        good = (text != "") & (fixed != text) & cell_issue(column, fixed, p, tidy).isNull()
        note = F.concat(quoted(text), F.lit(" -> "), quoted(fixed))
        return let(good, lambda g: F.struct(F.when(g, fixed).otherwise(text).alias("value"), F.when(g, note).alias("note")))

    return let(_tidy_text(c) if tidy else clean_text(c), lambda text: let(fix(text), lambda fixed: result(text, fixed)))


def sanitised(column: str, c: Column, p: Profile = ACTIVE) -> Column:
    """Cleaned; the picture column keeps small integers only."""
    text = strip_image_artifacts(c)
    return F.when(text.rlike(f"^{p.column_patterns['Image']}$"), text).otherwise("") if column == "Image" else text
