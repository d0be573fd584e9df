"""Repeated passages by a sparse suffix array.

Of all suffixes only those are retained that start at a minimiser: the 20-word run (seed) of least
hash in some 50-word window.  Equal windows have their minimiser at the same place, so two passages
of 50 words or more share a retained suffix.  A suffix whose seed comes once is dropped by a bitmap.

1. Retained suffixes are sorted over the cluster by seed, by what surrounds it as far as the windows
   that chose it reach, and by place in the corpus.  Ranges are cut anywhere, also within equal
   suffixes, so a passage that a third of all documents hold is many tasks' work.
2. Neighbours are compared.  Equal ones match left and right over all their windows, and all but the
   first of a run are marked.  What a run that crosses the edge of a range started with is carried
   over from the ranges before.
3. Neighbours of one seed with other surroundings match on a part: the first of each such run is
   extended left and right, word by word, to all windows that hold the seed; these are sorted and
   compared with their neighbours in the same way.

Windows and surroundings are told apart by 128 bits over 64-bit word hashes, so that no text goes
on a chance agreement (some 1e-12 expected among 10^13 windows).  Words are compared with A-Z folded
(``fold``), as near-duplicates are: passages that differ in such case only are the same.

Of equal windows the one with the smallest (doc_id, place) stays.  The words of the others go,
except those that the one that stays holds itself, where a text repeats itself.  White space beside
what goes is kept.  Null texts stay null.  Rows without an id are left as they are.  Rows of one id
and one text are one document; of one id and other texts they are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import textkit as tk
from .counting import count
from .store import Scratch, Shared

PASSAGE, SEED = 50, 20
#: Bases of the two hashes of a window.
BASES = (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)
WHO = ["doc_id", "tid", "place"]


def minimisers(h: np.ndarray, bounds: np.ndarray, passage: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, first window, windows) of each retained suffix; windows are by their first word in ``h``."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    g, span = tk.rolling(h, seed), passage - seed + 1
    if len(g) < span:
        return none
    at = tk.leftmost_min(g, span)
    # Windows that lie in one text.
    n = np.diff(bounds)
    own = np.zeros(len(at) + 1, np.int64)
    some = n >= passage
    np.add.at(own, bounds[:-1][some], 1)
    np.add.at(own, bounds[1:][some] - passage + 1, -1)
    first = np.flatnonzero(np.cumsum(own)[:-1] > 0)
    if not len(first):
        return none
    new = np.ones(len(first), bool)
    new[1:] = (at[first[1:]] != at[first[:-1]]) | (first[1:] != first[:-1] + 1)
    runs = np.flatnonzero(new)
    return g[at[first[runs]]], first[runs], np.diff(np.append(runs, len(first)))


def _suffixes(batch: pa.RecordBatch, passage: int, seed: int, fold: bool) -> Iterator[tuple]:
    for first, last, data, offsets in tk.pieces(batch):
        _, _, h, bounds = tk.words(data, offsets, fold)
        yield first, h, bounds, *minimisers(h, bounds, passage, seed)


def _owners(batch: pa.RecordBatch, first: int, bounds: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    row = np.searchsorted(bounds, at, "right") - 1
    who = pa.array(row + first)
    return [batch["doc_id"].take(who), batch["tid"].take(who), pa.array(at - bounds[row])]


def _windows(h: np.ndarray, at: np.ndarray, n: np.ndarray, passage: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where the windows of the given suffixes start, and their two hashes."""
    where = np.repeat(at - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    return where, [tk.rolling(h, passage, b)[where] if len(where) else np.zeros(0, np.uint64) for b in BASES]


def _pair(g: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return tk.mix(g ^ tk.mix(ids.view(np.uint64)))


def sorted_runs(rows: DataFrame, keys: list[str], scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame, list[int]]:
    """(what comes again; first rows of runs; seeds) of ``rows`` (keys, WHO, n) sorted by keys and place.

    What comes again has o_doc, o_tid and o_place of the first of its run.  First rows have ``more``:
    their neighbour before has the same first key, with other ones after it.  The seeds are first
    keys that so differ across an edge of two ranges, one a range at most.
    """
    longs, order = [*keys, *WHO, "n"], [*keys, *WHO]
    made = [*longs, "o_doc", "o_tid", "o_place", "part", "lead", "more", "kind"]
    again, first, edge_first, edge_last = 0, 1, 2, 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = origin = part = None  # of the last row
        count_, begin = 0, None
        for batch in batches:
            if not len(batch):
                continue
            k = [batch[c].to_numpy() for c in keys]
            who = [batch[c].to_numpy() for c in WHO]
            size, part = len(batch), int(batch["part"][0].as_py())
            new, more = np.ones(size, bool), np.zeros(size, bool)
            new[1:] = np.any([x[1:] != x[:-1] for x in k], axis=0)
            more[1:] = k[0][1:] == k[0][:-1]
            if key is None:
                begin = [int(x[0]) for x in k], [int(x[0]) for x in who]
            else:
                new[0], more[0] = key != [int(x[0]) for x in k], key[0] == int(k[0][0])
            start = np.maximum.accumulate(np.where(new, np.arange(size), -1))
            old = [np.where(start >= 0, x[start], 0 if origin is None else o) for x, o in zip(who, origin or [0] * 3)]
            lead = count_ + np.cumsum(new) == 1
            count_ += int(new.sum())
            key, origin = [int(x[-1]) for x in k], [int(x[-1]) for x in old]
            kind = np.where(new, first, again)
            held = [pa.array(x, mask=~new) for x in k]
            yield pa.RecordBatch.from_arrays([*held, *[batch[c] for c in (*WHO, "n")], *[pa.array(x) for x in old], batch["part"].cast(pa.int64()), pa.array(lead), pa.array(new & more), pa.array(kind)], made)
        if key is not None:
            lines = [(*begin[0], *begin[1], 0, *begin[1], part, True, False, edge_first), (*key, 0, 0, 0, 0, *origin, part, count_ == 1, False, edge_last)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if m in ("lead", "more") else pa.int64()) for c, m in zip(zip(*lines), made)], made)

    ranged = rows.select(longs).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = ", ".join(f"{c} {'boolean' if c in ('lead', 'more') else 'long'}" for c in made)
    table = scratch.table(ranged.mapInArrow(run, schema), name, wide=True)

    # Edges: two rows for each range. A run that goes on has the first row of the range where it began.
    edges: dict[int, dict[int, tuple]] = {}
    for r in table.where(F.col("kind") >= edge_first).select(*keys, "o_doc", "o_tid", "o_place", "part", "lead", "kind").collect():
        edges.setdefault(r["part"], {})[r["kind"]] = ([r[c] for c in keys], [r["o_doc"], r["o_tid"], r["o_place"]], r["lead"])
    seeds, goes_on, key, origin = [], [], None, None
    for part in sorted(edges):
        left, right = edges[part][edge_first], edges[part][edge_last]
        if key == left[0]:
            goes_on.append((part, *origin))
        elif key is not None and key[0] == left[0][0]:
            seeds.append(key[0])
        key = right[0]
        origin = origin if right[2] and goes_on and goes_on[-1][0] == part else right[1]
    over = F.broadcast(_carried(rows, goes_on))
    table = table.where(F.col("kind") < edge_first).withColumn("part", F.when(F.col("lead"), F.col("part"))).join(over, "part", "left")
    on = F.col("c_doc").isNotNull()
    out = table.where((F.col("kind") == again) | on).select(*WHO, "n", *[F.when(on, F.col(f"c_{c}")).otherwise(F.col(f"o_{c}")).alias(f"o_{c}") for c in ("doc", "tid", "place")])
    return out, table.where((F.col("kind") == first) & ~on).select(*keys, *WHO, "more"), seeds


def _carried(rows: DataFrame, lines: list[tuple]) -> DataFrame:
    return rows.sparkSession.createDataFrame(lines, "part long, c_doc long, c_tid long, c_place long")


def _marks(again: DataFrame, passage: int) -> DataFrame:
    """Word ranges of what comes again, but for words that the first occurrence holds itself."""
    same = (F.col("doc_id") == F.col("o_doc")) & (F.col("tid") == F.col("o_tid"))
    start = F.when(same, F.greatest("place", F.col("o_place") + passage)).otherwise(F.col("place"))
    return again.where(~(same & (F.col("place") == F.col("o_place")))).select("doc_id", "tid", start.alias("start"), (F.col("place") + F.col("n") - 1 + passage).alias("stop")).where("start < stop")


def repeats(docs: DataFrame, scratch: Scratch, passage: int = PASSAGE, seed: int = SEED, fold: bool = True) -> DataFrame:
    """(doc_id, tid, start, stop): the word ranges that go, by id and text; they may overlap."""
    docs = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("tid"), "text")
    spark = docs.sparkSession
    found = Shared(spark, count(docs.select("text"), lambda batch: (x[3] for x in _suffixes(batch, passage, seed, fold)), of=docs))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, h, bounds, g, at, n in _suffixes(batch, passage, seed, fold):
                keep = found.get().again(g)
                g, at, n = g[keep], at[keep], n[keep]
                # The hashes of a whole span from those of its windows, and how many they are.
                windows, hashes = _windows(h, at, n, passage)
                place = (windows - np.repeat(at, n)).astype(np.uint64)
                marks = [tk.mix(np.add.reduceat(tk.mix(w + place), np.cumsum(n) - n) + n.astype(np.uint64)) if len(n) else w for w in hashes]
                yield pa.RecordBatch.from_arrays([*[pa.array(x.view(np.int64)) for x in (g, *marks)], *_owners(batch, first, bounds, at), pa.array(n)], ["g", "s1", "s2", *WHO, "n"])

    rows = scratch.table(docs.mapInArrow(spans, "g long, s1 long, s2 long, doc_id long, tid long, place long, n long"), "spans", wide=True)
    again, firsts, seeds = sorted_runs(rows, ["g", "s1", "s2"], scratch, "runs")
    whole = _marks(again, passage)

    # Seeds with other surroundings, and the documents that the first of each surroundings is in, as bitmaps. Bits of
    # others let more pass, which changes nothing: all windows of a suffix that passes are compared.
    twice = lambda h: iter([np.repeat(h, 2)])
    g_of = lambda batch: batch["g"].to_numpy().view(np.uint64)
    more = firsts.where("more").select("g").unionByName(spark.createDataFrame([(g,) for g in seeds], "g long"))
    varied = Shared(spark, count(more, lambda batch: twice(g_of(batch))))

    def chosen(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        g = g_of(batch)
        keep = varied.get().again(g)
        return twice(_pair(g[keep], batch["doc_id"].to_numpy()[keep]))

    heads = Shared(spark, count(firsts.select("g", "doc_id"), chosen))

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, h, bounds, g, at, n in _suffixes(batch, passage, seed, fold):
                keep = found.get().again(g)
                keep[keep] = varied.get().again(g[keep])
                ids = batch["doc_id"].to_numpy()[first + np.searchsorted(bounds, at[keep], "right") - 1]
                keep[keep] = heads.get().again(_pair(g[keep], ids))
                where, hashes = _windows(h, at[keep], n[keep], passage)
                yield pa.RecordBatch.from_arrays([*[pa.array(w.view(np.int64)) for w in hashes], *_owners(batch, first, bounds, where), pa.array(np.ones(len(where), np.int64))], ["w1", "w2", *WHO, "n"])

    each = scratch.table(docs.mapInArrow(extended, "w1 long, w2 long, doc_id long, tid long, place long, n long"), "windows", wide=True)
    part, _, _ = sorted_runs(each, ["w1", "w2"], scratch, "window-runs")
    out = scratch.table(whole.unionByName(_marks(part, passage)), "marks", wide=True)
    scratch.drop("spans", "runs", "windows", "window-runs")
    return out


def _merge(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > stops[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
    return starts[new], stops[last]


def dedup_passages(docs: DataFrame, scratch: Scratch, passage: int = PASSAGE, seed: int = SEED, fold: bool = True) -> DataFrame:
    """``docs`` with the repeated passages taken out of text, and n_words, n_removed and spans [start, stop) in words."""
    marks = repeats(docs, scratch, passage, seed, fold).groupBy("doc_id", "tid").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("__marks"))
    marks = marks.select(F.col("doc_id").alias("__doc"), F.col("tid").alias("__tid"), "__marks")
    names = docs.columns
    joined = docs.join(marks, (F.col("doc_id") == F.col("__doc")) & (F.xxhash64("text") == F.col("__tid")), "left").select(*names, "__marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in tk.pieces(batch):
                texts, figures, spans = [], [], []
                ws, we, _, bounds = tk.words(data, offsets)
                for k in range(last - first):
                    a, b = int(bounds[k]), int(bounds[k + 1])
                    marks = batch["__marks"][first + k].as_py()
                    if not marks:
                        texts.append(batch["text"][first + k].as_py())
                        figures.append((b - a, 0))
                        spans.append([])
                        continue
                    lo, hi = _merge(np.array([m["start"] for m in marks]), np.array([m["stop"] for m in marks]))
                    cut = np.concatenate([[offsets[k]], np.stack([ws[a + lo], we[a + hi - 1]], axis=1).ravel(), [offsets[k + 1]]]).tolist()
                    texts.append(b"".join(data[s:e].tobytes() for s, e in zip(cut[::2], cut[1::2])).decode())
                    figures.append((b - a, int((hi - lo).sum())))
                    spans.append(np.stack([lo, hi], axis=1).tolist())
                cols = [pa.array(texts, pa.string()) if c == "text" else batch[c].slice(first, last - first) for c in names]
                cols += [pa.array([f[j] for f in figures], pa.int64()) for j in range(2)] + [pa.array(spans, pa.list_(pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays(cols, [*names, "n_words", "n_removed", "spans"])

    fields = [docs.schema[c] for c in names] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))]
    return joined.mapInArrow(run, T.StructType(fields))
