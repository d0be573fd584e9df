"""Header names: what columns are called, and which of them are data."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .profile import HEADER_NAMES
from .text import collapse

#: Names that carry nothing: unnamed, a bare number, blank.
NAMELESS = r"^(?:Unnamed.*|\d+|\s*)$"
#: What only a row of data holds: a price, a percentage, a long number, a code.
DATA_LIKE = r"^(?:£\s?\d.*|.*\d\s?%|\d{6,}|M\d{3,9})$"


def known_header(c: Column) -> Column:
    """The canonical name of a header, null if it is not a known one."""
    names = F.create_map(*[F.lit(x) for kv in HEADER_NAMES.items() for x in kv])
    return F.try_element_at(names, F.lower(F.regexp_replace(collapse(c), r"([a-z])([A-Z])", "$1 $2")))


def canonical_header(c: Column) -> Column:
    """The canonical name, or else the words of the header with capitals."""
    return F.coalesce(known_header(c), F.initcap(F.regexp_replace(collapse(c), r"([a-z])([A-Z])", "$1 $2")))


def is_nameless(c: Column) -> Column:
    return c.rlike(NAMELESS)
