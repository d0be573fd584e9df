"""Near-duplicate vectors through a forest of random-projection trees with spill.

Equal vectors are one class first.  Each tree splits at the median of a random projection; vectors
close to the split (by rank) go to both sides.  The trees are fitted on a bounded sample and route
every class; they are as deep as the number of classes asks.  Below the level where a node has hardly
a sample vector left, a level splits all its nodes where its projection splits the whole sample.
Within a leaf all cosines are computed in double precision, in blocks.  A pair that
meets in several leaves counts in the first of them only, so links are counted without listing
pairs: a leaf gives one row per vector, its links there and the smallest vector it reaches there.

Groups larger than a leaf would be cut through their middle, so they do not go through the trees:
sample vectors with many links become pivots, and a vector near a pivot is its host.  Each host is
compared, in blocks, with all vectors that it can link with by the angles to its pivot (guests), so
all links of a host are found.  Only vectors near no pivot are routed.

Vectors that are null, zero, or hold null or non-finite components link with nothing, and no
vector links with one of another length.  Repeated rows are vectors of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .graph import components
from .store import Scratch, Shared

COSINE, TREES, LEAF, SPILL = 0.95, 10, 256, 0.06
#: Vectors that the trees are fitted on, at most (those that hash lowest). Every vector is routed.
SAMPLE = 40_000
#: Sample vectors of a node that is split by them, at least.
FIT = 8
BLOCK = 1024
#: Hosts are nearer to their pivot than this many times the angle of a link.
REACH = 1.5
#: Hosts, and guests, of a pivot that meet in one task, about.
CELL = 8192


class Forest:
    """Per tree and level a direction; per node a threshold and the span around it that spills."""

    def __init__(self, sample: np.ndarray, total: int, trees: int, leaf: int, spill: float, seed: int = 11):
        rng = np.random.Generator(np.random.PCG64(seed))
        depth = next(d for d in range(64) if (total >> d) <= leaf)
        fitted = next(d for d in range(depth + 1) if d == depth or (len(sample) >> d) <= FIT)
        self.trees, self.depth, self.fitted, self.dim = trees, depth, fitted, sample.shape[1]
        self.directions = rng.standard_normal((trees, depth, self.dim))
        #: Of deeper levels, by tree: low, mid and high of the whole sample.
        self.whole = np.quantile(np.einsum("nd,tld->tln", sample, self.directions[:, fitted:]), [0.5 - spill, 0.5, 0.5 + spill], axis=2) if len(sample) else np.zeros((3, trees, depth - fitted))
        self.low = np.zeros((trees, 1 << fitted))
        self.mid, self.high = self.low.copy(), self.low.copy()
        for t in range(trees):
            parts = {1: np.arange(len(sample))}
            for level in range(fitted):
                down: dict[int, np.ndarray] = {}
                for node, rows in parts.items():
                    p = sample[rows] @ self.directions[t, level]
                    if len(p):
                        self.low[t, node], self.mid[t, node], self.high[t, node] = np.quantile(p, [0.5 - spill, 0.5, 0.5 + spill])
                    down[2 * node], down[2 * node + 1] = rows[p < self.mid[t, node]], rows[p >= self.mid[t, node]]
                parts = down

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf code) pairs; codes of a tree are apart from those of others."""
        who, codes = [], []
        for t in range(self.trees):
            rows, node = np.arange(len(x)), np.ones(len(x), np.int64)
            for level in range(self.depth):
                p = (x @ self.directions[t, level])[rows]
                low, mid, high = (x[t, node] for x in (self.low, self.mid, self.high)) if level < self.fitted else self.whole[:, t, level - self.fitted]
                left, right = p <= high, p >= low
                left |= ~right
                # A span without extent holds its ties on both sides only where the sample had ties.
                same = low == high
                left, right = np.where(same, p < mid, left), np.where(same, p >= mid, right)
                rows, node = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
            who.append(rows)
            codes.append((np.int64(t) << 48) + node)
        return np.concatenate(who), np.concatenate(codes)


def _leaf_links(ids: np.ndarray, weight: np.ndarray, x: np.ndarray, code: int, met: list[np.ndarray], cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Per vector of a leaf: the weight of its links that no earlier leaf has, and the smallest id it reaches here."""
    n = len(ids)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    before = np.concatenate([m[m < code] for m in met]) if n else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), [int((m < code).sum()) for m in met])
    kinds, col = np.unique(before, return_inverse=True)
    # Only leaves that two vectors of this one share matter.
    shared = np.bincount(col, minlength=len(kinds)) > 1
    place = np.cumsum(shared) - 1
    keep = shared[col]
    seen = np.zeros((n, int(shared.sum())), np.float32)
    seen[owner[keep], place[col[keep]]] = 1
    links, label = np.zeros(n, np.int64), np.arange(n)
    near = []
    for at in range(0, n, BLOCK):
        close = x[at : at + BLOCK] @ x.T >= cosine
        close[np.arange(len(close)), np.arange(at, at + len(close))] = False
        fresh = close & (seen[at : at + BLOCK] @ seen.T == 0) if seen.shape[1] else close
        links[at : at + BLOCK] = fresh.astype(np.float64) @ weight
        near.append(np.packbits(close, axis=1))
    while True:
        new = label.copy()
        for k, bits in enumerate(near):
            close = np.unpackbits(bits, axis=1, count=n).astype(bool)
            new[k * BLOCK : k * BLOCK + len(close)] = np.minimum(new[k * BLOCK : k * BLOCK + len(close)], np.where(close, label[None, :], n).min(axis=1))
        new = new[new]
        if np.array_equal(new, label):
            return links, ids[label]
        label = new


def _angle(cosine: float) -> float:
    return float(np.arccos(np.clip(cosine, -1, 1)))


def _pivots(x: np.ndarray, total: int, leaf: int, cosine: float) -> np.ndarray:
    """Vectors of the sample with about as many links as a quarter of a leaf holds, none near another."""
    many = max(4, leaf * len(x) // total // 4)
    near, rough = np.cos(min(np.pi, REACH * _angle(cosine))), x.astype(np.float32)
    found, free = [], np.ones(len(x), bool)
    for at in range(0, len(x), 256):
        rows = at + np.flatnonzero(free[at : at + 256])
        links = (rough[rows] @ rough.T >= cosine).sum(axis=1) - 1
        for k in np.argsort(-links, kind="stable"):
            if links[k] >= many and free[rows[k]]:
                found.append(rows[k])
                free &= x @ x[rows[k]] < near
    return x[found]


def _join(bits: np.ndarray, back: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each of ``a`` and of ``b`` reaches over links between them (bits: a row per a; back: per b)."""
    root_a, root_b, done = a.copy(), b.copy(), np.zeros(len(a), bool)
    for start in np.flatnonzero(bits.any(axis=1)):
        if done[start]:
            continue
        in_a, in_b, front = np.zeros(len(a), bool), np.zeros(len(b), bool), np.array([start])
        while len(front):
            in_a[front] = True
            new = np.unpackbits(np.bitwise_or.reduce(bits[front], axis=0), count=len(b)).astype(bool) & ~in_b
            in_b |= new
            front = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(back[new], axis=0), count=len(a)).astype(bool) & ~in_a)
        root_a[in_a] = root_b[in_b] = min(a[in_a].min(), b[in_b].min())
        done |= in_a
    return root_a, root_b


def _cell_links(left: pa.Table, right: pa.Table, cosine: float) -> pa.Table:
    """Rows (rep, root, links) of a block of hosts and one of guests; guests that are hosts themselves count their links there."""
    if not left.num_rows or not right.num_rows:
        return pa.table({c: pa.array([], pa.int64()) for c in ("rep", "root", "links")})
    (a, na, ka, xa), (b, nb, kb, xb) = [(t["rep"].to_numpy(), t["n"].to_numpy(), t["k1"].to_numpy(), np.stack(t["v"].to_numpy())) for t in (left, right)]
    xa, xb = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (xa, xb))
    ours, theirs, bits, back = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), [], []
    for at in range(0, len(a), BLOCK):
        own = slice(at, at + BLOCK)
        close = (xa[own] @ xb.T >= cosine) & (ka[own, None] != kb[None, :])
        bits.append(np.packbits(close, axis=1))
        back.append(np.packbits(close.T, axis=1))
        close = close.astype(np.float64)
        ours[own] = close @ nb
        theirs += (na[own] @ close).astype(np.int64)
    theirs[right["hot"].to_numpy()] = 0
    root_a, root_b = _join(np.concatenate(bits), np.concatenate(back, axis=1), a, b)
    ids, root, links = np.concatenate([a, b]), np.concatenate([root_a, root_b]), np.concatenate([ours, theirs])
    some = (links > 0) | (root != ids)
    return pa.table({"rep": ids[some], "root": root[some], "links": links[some]})


def _dense_rows(own: DataFrame, pivots: np.ndarray, cosine: float, scratch: Scratch) -> tuple[DataFrame, int]:
    """Rows of all links that a host has, and the number of hosts."""
    held, size = Shared(own.sparkSession, pivots), pivots.shape[1]
    host, guest = (np.cos(min(np.pi, k * _angle(cosine) + e)) for k, e in ((REACH, 0), (REACH + 1, 1e-6)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2000):
                batch = whole.slice(at, 2000)
                x = batch["v"].flatten().to_numpy().reshape(-1, size)
                p = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ held.get().T
                best = p.argmax(axis=1)
                hot = p[np.arange(len(p)), best] >= host
                hosts = np.flatnonzero(hot)
                who, at_pivot = np.nonzero(p >= guest)
                rows, side = np.concatenate([hosts, who]), np.arange(len(hosts) + len(who)) < len(hosts)
                cols = [batch[c].take(pa.array(rows)) for c in ("rep", "n", "v", "k1")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate([best[hosts], at_pivot])), pa.array(hot[rows]), pa.array(side)], ["rep", "n", "v", "k1", "pivot", "hot", "host"])

    placed = own.mapInArrow(place, "rep long, n long, v array<double>, k1 long, pivot long, hot boolean, host boolean")
    placed = scratch.table(placed, f"dense{size}", wide=True)
    sizes = placed.groupBy("pivot").agg(F.count_if("host").alias("hosts"), F.count_if(~F.col("host")).alias("guests"))
    sizes = scratch.table(sizes, f"dense-sizes{size}")
    count = sizes.agg(F.sum("hosts")).first()[0] or 0
    cells = sizes.select("pivot", F.ceil(F.col("hosts") / CELL).alias("p"), F.ceil(F.col("guests") / CELL).alias("q")).where("p > 0")
    both = placed.join(F.broadcast(cells), "pivot")
    i, j = (F.pmod(F.xxhash64("k1", F.lit(1)), F.col(c)) for c in "pq")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    hosts = both.where("host").select("pivot", i.alias("i"), every("q").alias("j"), "rep", "n", "k1", "v")
    guests = both.where(~F.col("host")).select("pivot", every("p").alias("i"), j.alias("j"), "rep", "n", "k1", "hot", "v")
    names = guests.columns
    guests = guests.toDF(*[f"g_{c}" for c in names])

    def link(left: pa.Table, right: pa.Table) -> pa.Table:
        return _cell_links(left, right.rename_columns(names), cosine)

    rows = hosts.groupBy("pivot", "i", "j").cogroup(guests.groupBy("g_pivot", "g_i", "g_j")).applyInArrow(link, "rep long, root long, links long")
    return rows, count


def near_duplicates(vectors: DataFrame, scratch: Scratch, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding)."""
    v = F.col("embedding")
    # Squares of doubles from finite floats stay finite and above zero.
    norm = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    sound = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (norm > 0)
    base = vectors.select("vec_id", F.when(sound, v.cast("array<double>")).alias("v"))
    base = scratch.table(base.withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), "v")}), "base", wide=True)
    classes = base.where("v is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.any_value("v").alias("v"))
    classes = scratch.table(classes, "classes", wide=True)
    found = scratch.table(_link_rows(classes, scratch, trees, leaf, spill, sample, cosine), "found")
    labels = components(found.where("rep <> root").select(F.col("rep").alias("u"), F.col("root").alias("v")), scratch)
    total = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.select("k1", "k2", "rep", "n").join(total, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    known = scratch.table(known.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c")), "known")
    good = base.where("v is not null").select("vec_id", "k1", "k2").join(known, ["k1", "k2"])
    out = good.select("vec_id", "n_links", F.col("c").alias("component_id"))
    out = out.unionByName(base.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _link_rows(classes: DataFrame, scratch: Scratch, trees: int, leaf: int, spill: float, sample: int, cosine: float) -> DataFrame:
    spark, out = classes.sparkSession, None
    lengths = scratch.table(classes.groupBy(F.size("v").alias("d")).count(), "lengths")
    if lengths.where(F.col("count") <= leaf).limit(1).count():
        # Lengths of one leaf: no tree splits them, so all of them are one plan, however many there are.
        def alone(table: pa.Table) -> pa.Table:
            order = np.argsort(table["rep"].to_numpy())
            ids, weight = table["rep"].to_numpy()[order], table["n"].to_numpy()[order]
            x = np.stack(table["v"].to_numpy())[order]
            links, root = _leaf_links(ids, weight, x, 0, [np.zeros(1, np.int64)] * len(ids), cosine)
            some = (links > 0) | (root != ids)
            return pa.table({"rep": ids[some], "root": root[some], "links": links[some]})

        few = classes.withColumn("d", F.size("v")).join(lengths.where(F.col("count") <= leaf), "d")
        out = few.select("d", "rep", "n", "v").groupBy("d").applyInArrow(alone, "rep long, root long, links long")
    for size, total in lengths.where(F.col("count") > leaf).collect():  # a row per vector length
        own = classes.where(F.size("v") == size).select("rep", "n", "k1", "v")
        first = own.orderBy(F.xxhash64("v"), "rep").limit(sample).select("v").toPandas()
        x = np.stack(first["v"].to_numpy())
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        pivots, near = _pivots(x, total, leaf, cosine), np.cos(min(np.pi, REACH * _angle(cosine)))
        if len(pivots):
            rows, hosts = _dense_rows(own, pivots, cosine, scratch)
            out = rows if out is None else out.unionAll(rows)
            total -= hosts
            x = x[(x @ pivots.T).max(axis=1) < near]
        if not total:
            continue
        x = x if len(x) else pivots[:1]
        forest = Shared(spark, (Forest(x, total, trees, leaf, spill), pivots))

        def route(batches: Iterator[pa.RecordBatch], forest=forest, size=size, near=near) -> Iterator[pa.RecordBatch]:
            fitted, pivots = forest.get()
            for batch in batches:
                x = batch["v"].flatten().to_numpy().reshape(-1, size)
                if len(pivots):
                    p = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ pivots.T
                    batch = batch.filter(pa.array(p.max(axis=1) < near))
                    x = batch["v"].flatten().to_numpy().reshape(-1, size)
                who, code = fitted.leaves(x / np.linalg.norm(x, axis=1, keepdims=True))
                order = np.lexsort((code, who))
                who, code = who[order], code[order]
                at = np.searchsorted(who, np.arange(len(x) + 1))
                met = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(code)).take(pa.array(who))
                rows = batch.take(pa.array(who))
                for k in range(0, len(who), 10_000):
                    yield pa.RecordBatch.from_arrays([rows["rep"][k : k + 10_000], rows["n"][k : k + 10_000], rows["v"][k : k + 10_000], met[k : k + 10_000], pa.array(code[k : k + 10_000])], ["rep", "n", "v", "met", "code"])

        def link(table: pa.Table) -> pa.Table:
            ids, weight = table["rep"].to_numpy(), table["n"].to_numpy()
            x = np.stack(table["v"].to_numpy())
            met = [np.asarray(m) for m in table["met"].to_numpy()]
            order = np.argsort(ids)
            links, root = _leaf_links(ids[order], weight[order], x[order], int(table["code"][0].as_py()), [met[i] for i in order], cosine)
            some = (links > 0) | (root != ids[order])
            return pa.table({"rep": ids[order][some], "root": root[some], "links": links[some]})

        routed = own.mapInArrow(route, "rep long, n long, v array<double>, met array<long>, code long")
        rows = routed.groupBy("code").applyInArrow(link, "rep long, root long, links long")
        out = rows if out is None else out.unionAll(rows)
    return out if out is not None else spark.createDataFrame([], "rep long, root long, links long")
