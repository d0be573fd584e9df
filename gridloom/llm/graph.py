"""Connected components by contraction: every round is a few joins over the edges that are left."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) for each node of ``edges`` (u, v); component is the smallest node reachable.

    A round points each node at its smallest neighbour, twice, and keeps the edges between what
    remains.  Labels only fall and the smallest node of a component keeps its own, so the last
    label is the minimum.  Self links and repeated links are harmless; no edges give no rows.
    """
    live = scratch.table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-e0")
    labels, k, old = None, 0, []
    while not live.isEmpty():
        both = live.unionAll(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")), f"{name}-p{k}")
        jump = scratch.table(
            up.alias("a").join(up.select(F.col("u").alias("p"), F.col("p").alias("q")), "p").select("u", F.col("q").alias("p")), f"{name}-j{k}"
        )
        side = jump.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        half = live.join(jump, "u").select("v", F.col("p").alias("pu"))
        new = half.join(side, "v").where("pu <> pv").select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v")).distinct()
        new = scratch.table(new, f"{name}-e{k + 1}")
        if labels is None:
            labels = scratch.table(jump.select(F.col("u").alias("node"), F.col("p").alias("component")), f"{name}-l0")
        else:
            moved = labels.join(jump.select(F.col("u").alias("component"), "p"), "component", "left")
            labels = scratch.table(moved.select("node", F.coalesce("p", "component").alias("component")), f"{name}-l{k}")
        scratch.drop(f"{name}-e{k}", f"{name}-p{k}", f"{name}-j{k}", *([f"{name}-l{k - 1}"] if k else []))
        live, k = new, k + 1
    if labels is None:
        labels = live.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels
