"""Counts of hashes over all documents, in packed blocks, as a bitmap of bounded size.

A hash goes to a bucket and is known there by 32 more bits.  Each bucket counts its own hashes and
answers with its part of the bitmap of what came twice or more, and with its commonest hashes.
A clear bit of the two is sure; set bits may be other hashes', so it only lets more pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit as tk

#: Bits of the bitmap: one for eight bytes of input, between 8 and 64 MB. Beyond, it fills up and lets more pass, which
#: costs time and changes no result. Commonest hashes that are kept: 2 MB.
LEAST_BITS, MOST_BITS, MAX_COMMON = 1 << 26, 1 << 29, 1 << 18
#: Sizes from here on mean that Spark has no estimate.
UNKNOWN = 1 << 60
BUCKETS = 128


class Counted:
    """What came twice or more, and what came more than ``over`` times."""

    def __init__(self, rows: DataFrame, buckets: int, bits: int):
        self.buckets, self.bits = buckets, bits
        self.twice, common = np.zeros((buckets, bits // 8), np.uint8), [np.zeros(0, np.uint64)]
        for r in rows.collect():  # a row per bucket, of fixed size
            self.twice[r["bucket"]] = np.frombuffer(r["bits"], np.uint8)
            common.append(np.frombuffer(r["common"], np.uint32).astype(np.uint64) * tk.U64(buckets) + tk.U64(r["bucket"]))
        self.common = np.sort(np.concatenate(common))

    def again(self, h: np.ndarray) -> np.ndarray:
        bucket, code = _code(h, self.buckets)
        out = np.ones(len(h), bool)
        for at in _spots(code, self.bits):
            out &= ((self.twice[bucket, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)
        return out

    def often(self, h: np.ndarray) -> np.ndarray:
        if not len(self.common):
            return np.zeros(len(h), bool)
        bucket, code = _code(h, self.buckets)
        whole = code.astype(np.uint64) * tk.U64(self.buckets) + bucket.astype(np.uint64)
        return np.append(self.common, 0)[np.searchsorted(self.common, whole)] == whole


def _code(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each hash, and what identifies it there."""
    n = tk.U64(buckets)
    return (h % n).astype(np.int64), ((h // n) & tk.U64(0xFFFFFFFF)).astype(np.uint32)


def _spots(code: np.ndarray, bits: int) -> list[np.ndarray]:
    """The two bits of each code."""
    return [((code.astype(np.uint64) * tk.U64(m) >> tk.U64(20)) % tk.U64(bits)).astype(np.int64) for m in (0x9E3779B1, 0x85EBCA6B)]


def bits_for(size: int) -> int:
    """Bits of a bitmap for an input of ``size`` bytes, a power of two."""
    return LEAST_BITS if size >= UNKNOWN else min(MOST_BITS, max(LEAST_BITS, 1 << (size // 8).bit_length()))


def count(docs: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], over: int = 1 << 31, buckets: int = BUCKETS, of: DataFrame | None = None) -> Counted:
    """Count the arrays of hashes that ``hashes`` makes of each batch of ``docs``; ``of`` is the table by whose size the bitmap is made.

    Without it the bitmap has its least size: what joins make has no good estimate.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            bucket, code = _code(np.concatenate(held), buckets)
            order = np.lexsort((code, bucket))
            bucket, code = bucket[order], code[order]
            at = np.searchsorted(bucket, np.arange(buckets + 1))
            some = np.flatnonzero(at[1:] > at[:-1])
            return pa.RecordBatch.from_arrays([pa.array(some), pa.array([code[at[b] : at[b + 1]].tobytes() for b in some], pa.binary())], ["bucket", "codes"])

        for batch in batches:
            for h in hashes(batch):
                held.append(h)
                size += len(h)
                if size > 2_000_000:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    size = int(of._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) if of is not None else 0
    bits = max(8, bits_for(size) // buckets)
    most = max(1, MAX_COMMON // buckets)

    def tally(table: pa.Table) -> pa.Table:
        codes, n = np.unique(np.concatenate([np.frombuffer(b, np.uint32) for b in table["codes"].to_pylist()]), return_counts=True)
        mask = np.zeros(bits, bool)
        for at in _spots(codes[n > 1], bits):
            mask[at] = True
        common = codes[n > over][np.argsort(-n[n > over], kind="stable")[:most]]
        return pa.table({"bucket": table["bucket"][:1], "bits": pa.array([np.packbits(mask).tobytes()], pa.binary()), "common": pa.array([common.tobytes()], pa.binary())})

    rows = docs.mapInArrow(pack, "bucket long, codes binary").groupBy("bucket").applyInArrow(tally, "bucket long, bits binary, common binary")
    return Counted(rows, buckets, bits)
