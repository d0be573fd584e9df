"""Text hygiene and comparison keys, as Column expressions.

``\\s`` means Unicode white space here, as the (?U) flag and the four separators U+001C..1F say.
Digits are ASCII.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is written, and computed, once."""
    return F.transform(F.array(value), body)[0]


SPACE = r"(?U)[\s\x1c-\x1f]"


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    return trim_all(F.regexp_replace(c, f"{SPACE}+", " "))


def is_blank(c: Column) -> Column:
    """Null, empty, white space, or a spelled-out missing value."""
    return c.isNull() | F.lower(trim_all(c)).isin("", "nan", "none", "<na>")


def normalize_whitespace(c: Column) -> Column:
    """Literal backslash escapes first, then NBSP and zero-width space, then runs of white space."""
    c = F.regexp_replace(c, r"\\[nrt]", " ")
    return collapse(F.replace(F.replace(c, F.lit("\u00a0"), F.lit(" ")), F.lit("\u200b"), F.lit("")))


def clean_text(c: Column) -> Column:
    return F.when(is_blank(c), F.lit("")).otherwise(normalize_whitespace(c))


def strip_image_artifacts(c: Column) -> Column:
    """Short bracketed tokens go."""
    return collapse(F.regexp_replace(clean_text(c), r"\[[^\]\[]{0,8}\]", " "))


def null_if_empty(c: Column) -> Column:
    return F.when(c == "", None).otherwise(c)


def quoted(c: Column) -> Column:
    """The text in quotes: double ones if it holds a single one and no double one."""
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    double = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), c, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("\\'")), F.lit("'")))


def gs1_ok(digits: Column) -> Column:
    """The GS1 check digit: weights 3, 1, 3, ... from the digit left of it."""
    n = F.length(digits)
    body = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    total = F.aggregate(body, F.lit(0), lambda a, i: a + F.coalesce(F.substr(digits, n - i, F.lit(1)).try_cast("int"), F.lit(0)) * F.when(i % 2 == 1, 3).otherwise(1))
    return F.coalesce(F.when(digits.rlike(r"^\d{2,}$"), (10 - total % 10) % 10 == F.substr(digits, n, F.lit(1)).try_cast("int")), F.lit(False))


def bare_digits(text: Column) -> Column:
    return F.when(text.rlike(r"[^\d\s\-]"), F.lit("")).otherwise(F.regexp_replace(text, r"[\s\-]", ""))


def normalize_ean(c: Column) -> Column:
    """Digits of a printed barcode; empty if anything but digits, spaces and hyphens is there."""
    return let(clean_text(c), bare_digits)


#: What a comparison takes as missing; fixed values.
MISSING = ("", "nan", "none", "<na>", "null", "n/a")


def compare_key(c: Column) -> Column:
    """Collapsed and case-folded; a missing value is the empty key."""
    key = F.replace(F.lower(collapse(F.coalesce(c, F.lit("")))), F.lit("ß"), F.lit("ss"))
    return F.when(key.isin(*MISSING), F.lit("")).otherwise(key)


def as_number(c: Column) -> Column:
    """The number that a text is without separators, currency and percent signs; null if it is none."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?U)[,\s£$€%]", ""), r"(?<=\d)_(?=\d)", "")
    literal = bare.rlike(r"(?i)^[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?$")
    return F.when(literal, bare.try_cast("double")).otherwise(F.when(bare.rlike(r"(?i)^[+-]?(?:inf|infinity)$"), bare.try_cast("double")))


def values_equal(a: Column, b: Column) -> Column:
    """Equal keys, or equal numbers; a bare amount equals itself in another currency or in percent."""
    same = lambda x, y: (x == y) | F.coalesce(as_number(x) == as_number(y), F.lit(False))
    return let(compare_key(a), lambda x: let(compare_key(b), lambda y: same(x, y)))


def sheet_safe(c: Column) -> Column:
    """Without the control characters that a worksheet cannot hold."""
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def unique_column(taken: list[str], name: str) -> str:
    """``name``, or the first of 'name (comparison)', 'name (comparison 2)', ... that is not taken."""
    k, out = 0, name
    while out in taken:
        k += 1
        out = f"{name} (comparison)" if k == 1 else f"{name} (comparison {k})"
    return out


def code_tokens(c: Column) -> Column:
    """Code-like tokens that no letter or digit precedes and no digit follows."""
    return F.regexp_extract_all(c, F.lit(r"(?<![A-Za-z0-9])M\d{3,9}(?!\d)"), F.lit(0))


def cut_off(c: Column) -> Column:
    """More tables are opened than closed."""
    return F.regexp_count(c, F.lit("<table")) > F.regexp_count(c, F.lit("</table>"))
