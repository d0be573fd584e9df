"""Cross-site boilerplate lines: a line is boilerplate if it stands on enough distinct sites.

A line is what stands between newlines, without white space at its ends; lines of fewer than
``min_words`` words never count.  Distinct sites per line hash are HyperLogLog sketches, merged
by aggregation; lines whose estimate is near the threshold get an exact distinct count.  A
document loses its boilerplate lines, newline included, whatever share of it they are.  Only a
document without a word outside them stays whole: nothing of it would be left, so it is a copy of
other documents, for the near-duplicate operators to judge, and no carrier of boilerplate.

Lines are told apart by two hashes, 128 bits, so that no line goes because another one that happens
to hash alike stands on many sites.

A null source counts as the empty one, a null text stays null, and an empty one empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import textkit as tk
from .store import Scratch

MIN_SITES, MIN_WORDS, SKETCH_K, BAND = 8, 4, 8, 0.25
#: Lines that may be broadcast: 16 MB. Longer lists are joined.
BROADCAST_LINES = 1_000_000
LINE = ["line", "line2"]


def line_hashes(data: np.ndarray, offsets: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, word counts, hashes (rows of two longs) and which lines are long enough, and each text's range among them."""
    starts, ends, bounds = tk.lines(data, offsets)
    ws, we, _, _ = tk.words(data, offsets, lower=False)
    a, b = np.searchsorted(ws, starts), np.searchsorted(ws, ends)
    hashes, counted = np.zeros((len(starts), 2), np.int64), b - a >= min_words
    for k, code in enumerate((tk.CODE, tk.OTHER)):
        hashes[counted, k] = tk.span_hashes(data, ws[a[counted]], we[b[counted] - 1], code).view(np.int64)
    return starts, ends, b - a, hashes, counted, bounds


def _sites(docs: DataFrame, min_words: int) -> DataFrame:
    """(line, line2, site), once for each piece of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            site = batch["site"].to_numpy()
            for first, last, data, offsets in tk.pieces(batch):
                _, _, _, h, counted, bounds = line_hashes(data, offsets, min_words)
                who = np.repeat(site[first:last], np.diff(bounds))
                rows = np.column_stack([h, who])[counted]
                order = np.lexsort(rows.T)
                new = np.ones(len(rows), bool)
                new[1:] = (rows[order][1:] != rows[order][:-1]).any(axis=1)
                rows = rows[order][new]
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in range(3)], ["line", "line2", "site"])

    return docs.select("text", F.xxhash64(F.coalesce("source", F.lit(""))).alias("site")).mapInArrow(run, "line long, line2 long, site long")


def boilerplate(docs: DataFrame, scratch: Scratch, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """(line, line2): the hashes of the lines on at least ``min_sites`` sites."""
    rows = scratch.table(_sites(docs, min_words), "rows", wide=True)
    # A line needs as many rows as sites, so most lines never get a sketch.
    often = scratch.table(rows.groupBy(LINE).count().where(F.col("count") >= min_sites).select(LINE), "often")
    rows = scratch.table(rows.join(often, LINE, "left_semi"), "some")
    guess = rows.groupBy(LINE).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", SKETCH_K)).alias("sites"))
    guess = scratch.table(guess.where(F.col("sites") >= min_sites * (1 - BAND)), "guess")
    sure = F.col("sites") > min_sites * (1 + BAND)
    exact = rows.join(guess.where(~sure), LINE, "left_semi").groupBy(LINE).agg(F.count_distinct("site").alias("sites"))
    out = scratch.table(guess.where(sure).select(LINE).unionAll(exact.where(F.col("sites") >= min_sites).select(LINE)), "boilerplate")
    scratch.drop("rows", "often", "some", "guess")
    return out


def _strip(data: np.ndarray, offsets: np.ndarray, gone, min_words: int) -> Iterator[tuple[bytes | None, int, int, int]]:
    """For each text: what is left (None: as it was), its lines, the lines and words that went. gone(hashes, text) -> mask."""
    starts, ends, n, h, counted, bounds = line_hashes(data, offsets, min_words)
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        out = gone(h[a:b], k) & counted[a:b]
        cut = int(n[a:b][out].sum())
        if not cut or cut == int(n[a:b].sum()):
            yield None, b - a, 0, 0
        else:
            yield b"\n".join(data[s:e].tobytes() for s, e in zip(starts[a:b][~out].tolist(), ends[a:b][~out].tolist())), b - a, int(out.sum()), cut


def _known(lines: list[tuple[int, int]]) -> np.ndarray:
    """Rows of two longs in order."""
    rows = np.array(lines, np.int64).reshape(-1, 2)
    return np.asfortranarray(rows[np.lexsort((rows[:, 1], rows[:, 0]))])


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which rows of ``h`` are among the ``known`` ones."""
    out, at, end = np.zeros(len(h), bool), np.searchsorted(known[:, 0], h[:, 0]), len(known) - 1
    while end >= 0:
        near = np.minimum(at, end)
        same = (at <= end) & (known[near, 0] == h[:, 0])
        if not same.any():
            break
        out |= same & (known[near, 1] == h[:, 1])
        at = at + 1  # another known line may agree in the first hash
    return out


def dedup_lines(docs: DataFrame, scratch: Scratch, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """``docs`` with the text cleaned, and n_lines, lines_removed and words_removed."""
    lines = boilerplate(docs, scratch, min_sites, min_words)
    few = lines.count() <= broadcast_lines
    spark, listed = docs.sparkSession, None
    if few:
        listed = spark.sparkContext.broadcast(_known([tuple(r) for r in lines.collect()]))
    else:
        def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, last, data, offsets in tk.pieces(batch):
                    _, _, _, h, counted, bounds = line_hashes(data, offsets, min_words)
                    who = np.repeat(np.arange(first, last), np.diff(bounds))[counted]
                    yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(who)), pa.array(h[counted, 0]), pa.array(h[counted, 1])], ["doc_id", *LINE])

        hits = docs.select("doc_id", "text").mapInArrow(held, "doc_id long, line long, line2 long").join(lines, LINE)
        hits = hits.groupBy("doc_id").agg(F.collect_set(F.struct(*LINE)).alias("__gone"))
        docs = docs.join(hits, docs["doc_id"].eqNullSafe(hits["doc_id"]), "left").drop(hits["doc_id"])

    names = [c for c in docs.columns if c != "__gone"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch["text"]
            for first, last, data, offsets in tk.pieces(batch):
                texts, figures = [], []
                if listed is not None:
                    gone = lambda h, k: _among(h, listed.value)
                else:
                    gone = lambda h, k, first=first: _among(h, _known([tuple(x.values()) for x in batch["__gone"][first + k].as_py() or []]))
                for k, (text, *rest) in enumerate(_strip(data, offsets, gone, min_words)):
                    texts.append(given[first + k].as_py() if text is None else text.decode())
                    figures.append(rest)
                cols = [pa.array(texts, pa.string()) if c == "text" else batch[c].slice(first, last - first) for c in names]
                cols += [pa.array([f[j] for f in figures], pa.int64()) for j in range(3)]
                yield pa.RecordBatch.from_arrays(cols, [*names, "n_lines", "lines_removed", "words_removed"])

    fields = [docs.schema[c] for c in names] + [T.StructField(c, T.LongType()) for c in ("n_lines", "lines_removed", "words_removed")]
    return docs.mapInArrow(run, T.StructType(fields))
