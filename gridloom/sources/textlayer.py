"""Words and rules of a page as a document's own text layer gives them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fewer words than this are no text layer, nor is one with this share of unreadable words; lengths and
# thickness of drawn rules in points.
LEAST_WORDS, MOST_GARBAGE = 25, 0.02
LEAST_RULE, SLOPE, THICKNESS = 12.0, 0.6, 1.6


def is_garbage(text: Column) -> Column:
    return F.contains(text, F.lit("�")) | F.contains(text, F.lit("(cid:"))


def usable_layers(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_words, usable) of ``words`` (keys, text): enough of them, and hardly one unreadable."""
    bad = F.count_if(is_garbage(F.coalesce("text", F.lit(""))))
    good = (F.col("n_words") >= LEAST_WORDS) & (F.col("bad") / F.col("n_words") < MOST_GARBAGE)
    return words.groupBy(*keys).agg(F.count("*").alias("n_words"), bad.alias("bad")).select(*keys, "n_words", good.alias("usable"))


def drawn_rules(items: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, way, at, from, to) of drawn ``items`` (keys, kind 'l' or 're', x0, y0, x1, y1): straight lines and thin, long rectangles."""
    dx, dy = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    line = F.col("kind") == "l"
    flat = F.when(line, dy < SLOPE).when(F.col("kind") == "re", dy <= THICKNESS) & (dx >= LEAST_RULE)
    tall = F.when(line, dx < SLOPE).when(F.col("kind") == "re", dx <= THICKNESS) & (dy >= LEAST_RULE)
    mid = lambda a, b: F.when(line, F.col(a)).otherwise((F.col(a) + F.col(b)) / 2)
    h = F.struct(F.lit("h").alias("way"), mid("y0", "y1").alias("at"), F.least("x0", "x1").alias("from"), F.greatest("x0", "x1").alias("to"))
    v = F.struct(F.lit("v").alias("way"), mid("x0", "x1").alias("at"), F.least("y0", "y1").alias("from"), F.greatest("y0", "y1").alias("to"))
    return items.select(*keys, F.when(flat, h).when(tall, v).alias("r")).where("r is not null").select(*keys, "r.*")
