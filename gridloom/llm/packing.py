"""Conflict-constrained best-fit packing.

Open bins stand in order of the room left.  A document takes its successor in that order: the
tightest bin that holds it and has neither its duplicate cluster nor too many documents of its
source; the search goes on to wider bins until one is compatible, else a bin is opened.  Bins
carry bitmaps of sources (one plane per document a source may have) and of duplicate clusters.

Documents are dealt by a hash of their id into independent groups of about ``group_rows``, so a
group's size does not depend on the source or the cluster; longest first in each.  Rows alike in
id and text that are more than a group holds are dealt further, by their place in the table, so a
table of repeated rows or of rows without ids and words is many groups too.  A document of more
than ``capacity`` words fills whole bins of its own (``n_full``) and its rest is packed.

Empty and null texts have no words and are packed as of length 0.  A null source or cluster
is never in conflict.  Repeated rows are packed as often as they come.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .store import Scratch

CAPACITY, PER_SOURCE, GROUP_ROWS = 2048, 2, 4096
#: Keys of rows alike that may be broadcast: some 20 MB.
BROADCAST_KEYS = 500_000


def pack_group(length: np.ndarray, source: np.ndarray, cluster: np.ndarray, capacity: int, per_source: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and start of each item; source and cluster are small ints, negative for none. Items come longest first."""
    room: list[tuple[int, int]] = []  # (room left, bin), in order
    planes: list[list[int]] = []  # of a bin: source bitmaps, one plane per document
    seen: list[int] = []  # of a bin: cluster bitmap
    bins, starts = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
    for i, (n, s, c) in enumerate(zip(length.tolist(), source.tolist(), cluster.tolist())):
        sbit, cbit = (1 << s if s >= 0 else 0), (1 << c if c >= 0 else 0)
        at = bisect.bisect_left(room, (n, -1))
        while at < len(room) and (seen[room[at][1]] & cbit or planes[room[at][1]][-1] & sbit):
            at += 1
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(seen)
            planes.append([0] * per_source)
            seen.append(0)
        bins[i], starts[i] = b, capacity - left
        seen[b] |= cbit
        for k, plane in enumerate(planes[b]):
            if not plane & sbit:
                planes[b][k] = plane | sbit
                break
        bisect.insort(room, (left - n, b))
    return bins, starts


def lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_words, cluster); cluster is a fingerprint of the words, null without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in tk.pieces(batch):
                _, _, h, bounds = tk.words(data, offsets)
                n = np.diff(bounds)
                mark = np.zeros(len(n), np.int64)
                full = n > 0
                if full.any():
                    place = np.arange(len(h), dtype=np.uint64) - np.repeat(bounds[:-1], n).astype(np.uint64)
                    mark[full] = tk.mix(np.add.reduceat(tk.mix(h ^ tk.mix(place + tk.U64(1))), bounds[:-1][full])).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"][first:last], batch["source"][first:last], pa.array(n.astype(np.int64)), pa.array(mark, mask=~full)],
                    ["doc_id", "source", "n_words", "cluster"],
                )

    return docs.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, n_words long, cluster long")


def pack(items: DataFrame, scratch: Scratch, capacity: int = CAPACITY, per_source: int = PER_SOURCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, n_words, n_full, pack_group, bin, start) for each row of ``items`` (doc_id, source, n_words, cluster)."""
    items = scratch.table(items.select("doc_id", "source", "n_words", "cluster"), "items", wide=True)
    groups = max(1, -(-items.count() // group_rows))
    alike = items.groupBy("doc_id", "cluster").count().where(F.col("count") > group_rows).select("doc_id", "cluster", F.lit(True).alias("many"))
    alike = scratch.table(alike, "alike")
    if alike.limit(1).count():
        # Fewer than rows / group_rows; beyond what may be broadcast, adaptive execution splits the skewed side.
        few = alike.count() <= BROADCAST_KEYS
        names = items.columns
        items = items.withColumn("place", F.monotonically_increasing_id()).alias("i")
        same = F.col("i.doc_id").eqNullSafe(F.col("a.doc_id")) & F.col("i.cluster").eqNullSafe(F.col("a.cluster"))
        items = items.join((F.broadcast(alike) if few else alike).alias("a"), same, "left").select(*[F.col(f"i.{c}") for c in names], F.when(F.col("many"), F.col("place")).alias("place"))
    else:
        items = items.withColumn("place", F.lit(None).cast("long"))
    dealt = items.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "cluster", "place"), F.lit(groups))).drop("place")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(rest=pdf.n_words % capacity).sort_values(["rest", "cluster", "source", "doc_id"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        source = pd.factorize(pdf.source)[0]
        cluster = pd.factorize(pdf.cluster)[0]
        again = np.bincount(cluster[cluster >= 0], minlength=1) if len(cluster) else np.zeros(1, int)
        cluster = np.where((cluster >= 0) & (again[np.maximum(cluster, 0)] > 1), cluster, -1)
        number = np.cumsum(again > 1) - 1
        cluster = np.where(cluster >= 0, number[np.maximum(cluster, 0)], -1)
        bins, starts = pack_group(pdf.rest.to_numpy(np.int64), source, cluster, capacity, per_source)
        return pdf.assign(n_full=pdf.n_words // capacity, bin=bins, start=starts)[["doc_id", "n_words", "n_full", "pack_group", "bin", "start"]]

    return dealt.groupBy("pack_group").applyInPandas(run, "doc_id long, n_words long, n_full long, pack_group long, bin long, start long")
