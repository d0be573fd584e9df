"""Balanced label propagation over equal texts, in DataFrame operations only.

Documents of equal text are linked to one another, and labels are shards.  Linked documents of one
text and one label are alike, so the state of the graph is a row per (text, label) with how many
they are: a third of all rows with one text is 24 rows of it.

Each document starts with the label its id hashes to.  In every round each text counts its
documents' current labels; all move towards the label that most of them have, of those whose shard
still has room for the whole text.  A shard takes movers, largest gain first, up to its quota, and
keeps them.  Where that fails, documents whose label has no room left take on the commonest label
of their neighbours that has, or else an open shard by hash, and the next round counts again.
Rounds end when all texts are settled or fit nowhere whole; each settles at least one text for
every shard that is asked.  Texts of more than a quarter of a shard go first.

Only texts of more rows than a shard's quota are cut before (into as few parts as they need), and
only texts that no shard has room for are cut after.  These are fewer than twice the shards.
``cut_links`` counts, for each document, the others of its text in other shards.

Law ``rows``: shard counts are at most one apart.  Null texts count as empty; null ids and
repeated rows are placed like others.  No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .store import Scratch

#: Rows that a window of running sums should hold, and bounds of how many there are by shard.
WINDOW_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 100_000, 64, 4096


def _running(df: DataFrame, keys: list[str], order: list[Column], weight: Column, bucket: str, out: str) -> DataFrame:
    """Sum of ``weight`` over the rows up to each row, per ``keys`` in bucket order.

    Only sums per (keys, bucket) meet in one place; they are bounded by shards and buckets, and broadcast.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(weight).alias("_w"))
    by = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    before = sums.select(*keys, bucket, (F.sum("_w").over(by.orderBy(bucket)) - F.col("_w")).alias("_before"))
    inner = F.sum(weight).over(W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("_in", inner).join(F.broadcast(before), [*keys, bucket]).withColumn(out, F.col("_in") + F.col("_before")).drop("_in", "_before")


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(x).cast("long") for x in values])


def _votes(cells: DataFrame, free: list[int], turn: int) -> DataFrame:
    """(unit, n, near, to, gain): the label that most of a text's documents have, of shards with room for all; else an open shard."""
    room = _longs(free)
    near = F.sort_array(F.collect_list(F.struct("n", F.negative("label").alias("back"))), False)
    units = cells.groupBy("unit").agg(F.sum("n").alias("total"), near.alias("near"))
    fit = F.filter("near", lambda x: F.get(room, -x["back"]) >= F.col("total"))
    open_ = F.filter(F.sequence(F.lit(0), F.lit(len(free) - 1)), lambda s: F.get(room, s) >= F.col("total"))
    spare = F.get(open_, F.pmod(F.xxhash64("unit", F.lit(turn)), F.greatest(F.size(open_), F.lit(1))).cast("int"))
    best = F.get(fit, F.lit(0))
    return units.withColumn("to", F.coalesce(-best["back"], spare)).withColumn("gain", F.coalesce(best["n"], F.lit(0)))


def _settle(cells: DataFrame, load: list[int], quota: list[int], buckets: int, scratch: Scratch, name: str) -> list[DataFrame]:
    """Tables (unit, shard) of the texts that found a shard whole; ``load`` grows by them."""
    out, k, spent = [], 0, []
    while True:
        free = [max(0, q - x) for q, x in zip(quota, load)]
        votes = _votes(cells, free, k).where("to is not null").drop("near")
        rung = (F.lit(63) - F.log2(F.col("gain") + 1).cast("int")) * buckets + F.pmod("unit", F.lit(buckets)).cast("int")
        run = _running(votes.withColumn("rung", rung), ["to"], [F.desc("gain"), F.desc("total"), F.col("unit")], F.col("total"), "rung", "upto")
        taken = run.where(F.col("upto") <= F.get(_longs(free), F.col("to"))).select("unit", F.col("to").alias("shard"), "total")
        taken = scratch.table(taken, f"{name}-taken{k}")
        sums = taken.groupBy("shard").agg(F.sum("total").alias("n")).collect()  # a row per shard
        if not sums:
            break
        out.append(taken.select("unit", "shard"))
        for r in sums:
            load[r["shard"]] += r["n"]
        # What was refused: labels without room give way to the neighbours' commonest label that has, counted anew.
        room = [max(0, q - x) for q, x in zip(quota, load)]
        left = cells.join(taken.select("unit"), "unit", "left_anti")
        want = _votes(left, room, k + 1).where("to is not null").select("unit", "total", "to")
        moved = left.join(want, "unit").withColumn("label", F.when(F.get(_longs(room), F.col("label")) >= F.col("total"), F.col("label")).otherwise(F.col("to")))
        cells = scratch.table(moved.groupBy("unit", "label").agg(F.sum("n").alias("n")), f"{name}-cells{k}")
        spent.append(f"{name}-cells{k}")
        k += 1
        if cells.isEmpty():
            break
    scratch.drop(*spent)
    return out


def shard(docs: DataFrame, scratch: Scratch, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, cut_links) for each row of ``docs`` (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"))
    base = scratch.table(base.withColumn("group", F.xxhash64("h", "text_crc32", "size")).drop("h"), "base", wide=True)
    total = base.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    least, spot = max(1, total // shards), F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 20)).cast("int")
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, total // shards // WINDOW_ROWS))

    # Texts of more rows than a shard holds, fewer than the shards, are cut into runs of a quota by rank.
    rows = base.withColumn("unit", F.col("group"))
    over = scratch.table(base.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > least).select("group"), "over")
    if not over.isEmpty():
        big = _running(base.join(F.broadcast(over), "group").withColumn("bucket", F.pmod(spot, F.lit(buckets))), ["group"], [F.col("doc_id")], F.lit(1).cast("long"), "bucket", "rank")
        big = big.withColumn("unit", F.xxhash64("group", F.floor((F.col("rank") - 1) / least))).select(rows.columns)
        rows = rows.join(F.broadcast(over), "group", "left_anti").select(rows.columns).unionByName(big)
    rows = scratch.table(rows.withColumn("label", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).cast("int")), "rows")

    cells = rows.groupBy("unit", "label").agg(F.count("*").alias("n"))
    many = scratch.table(cells.groupBy("unit").agg(F.sum("n").alias("total")).where("total > 1"), "many")
    cells = scratch.table(cells.join(many, "unit"), "cells")
    load: list[int] = [0] * shards
    found = []
    for name, part in (("large", F.col("total") > least / 4), ("small", F.col("total") <= least / 4)):
        own = cells.where(part).drop("total")
        if not own.isEmpty():
            found += _settle(own, load, quota, buckets, scratch, name)
    settled = None
    for table in found:
        settled = table if settled is None else settled.unionByName(table)
    if settled is None:
        settled = cells.select("unit", F.col("label").alias("shard")).limit(0)
    settled = scratch.table(settled, "settled")
    # Texts of more rows than 1/64 of a shard, at most 64 a shard, are joined by broadcast, so that no task gets all rows of one.
    busy = F.col("total") > least / 64
    heavy = F.broadcast(many.where(busy).join(settled, "unit", "left").select("unit", "shard", F.lit(True).alias("heavy")))
    placed = rows.drop("label").join(heavy, "unit", "left")
    light = placed.where("heavy is null").drop("heavy", "shard").join(settled.join(many.where(~busy), "unit", "left_semi"), "unit", "left")
    placed = scratch.table(placed.where("heavy").drop("heavy").unionByName(light), "placed")

    # The rest is laid over the room left: first texts that fit nowhere, fewer than the shards as they exceed
    # the room of each, largest first; then documents without a link, which are one row each.
    stuck = [r["unit"] for r in cells.join(settled, "unit", "left_anti").groupBy("unit").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit").collect()]
    room = sorted(((max(0, q - x), s) for s, (q, x) in enumerate(zip(quota, load))), key=lambda x: (-x[0], x[1]))
    ends = [sum(n for n, _ in room[: k + 1]) for k in range(shards)]
    rank = F.array_position(F.array(*[F.lit(u).cast("long") for u in stuck]).cast("array<long>"), F.col("unit")).cast("int")
    rest = placed.where("shard is null")
    first = F.when(rank > 0, (rank - 1) * buckets + F.pmod(spot, F.lit(buckets))).otherwise(F.lit(len(stuck) * buckets) + F.pmod("unit", F.lit(8 * buckets)).cast("int"))
    rest = _running(rest.withColumn("bucket", first), [], [F.col("unit"), F.col("doc_id")], F.lit(1).cast("long"), "bucket", "rank")
    at = F.size(F.filter(_longs(ends), lambda e: e < F.col("rank")))
    rest = rest.withColumn("shard", F.get(F.array(*[F.lit(s) for _, s in room]), at)).select(placed.columns)
    whole = placed.where("shard is not null").unionByName(rest)
    whole = scratch.table(whole.withColumn("bucket", F.pmod(spot, F.lit(buckets))), "whole")

    # Cut texts are those cut before and those that fitted nowhere: fewer than twice the shards.
    ids = F.array(*[F.lit(u).cast("long") for u in stuck]).cast("array<long>")
    cut = whole.join(F.broadcast(over), "group", "left_semi").unionByName(whole.where(F.array_contains(ids, F.col("unit"))))
    cut = cut.select("group").distinct()
    spread = whole.join(F.broadcast(cut), "group").groupBy("group", "shard").agg(F.count("*").alias("here"))
    spread = spread.withColumn("cut_links", F.sum("here").over(W.partitionBy("group")) - F.col("here")).drop("here")
    spread = scratch.table(spread, "spread")
    ranked = _running(whole, ["shard"], [F.col("doc_id")], F.lit(1).cast("long"), "bucket", "rank").join(F.broadcast(spread), ["group", "shard"], "left")
    scratch.drop("base", "rows", "cells", "many", "settled", "placed")
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return ranked.select("doc_id", "size", "text_crc32", law, "shard", (F.col("rank") - 1).alias("slot"), grown, F.coalesce("cut_links", F.lit(0)).alias("cut_links"))
