"""Word, shingle and line fingerprints, computed with numpy over whole Arrow batches.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``.  All hashes are 64-bit and depend on
the content alone, so they agree between tasks, executors and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1_000_000
_BASE = 0x9E3779B97F4A7C15


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    code = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
    return space, lower, code


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


SPACE, LOWER, CODE = _tables()
#: Codes of a second hash, for what must not rest on a chance agreement.
OTHER = mix(CODE + U64(0x2545F4914F6CDD1D))


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges (first, last), their bytes and byte offsets; nulls count as empty.

    A piece holds about ``limit`` bytes, or a single longer text.
    """
    texts = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.string())
    texts = texts.fill_null("") if texts.null_count else texts
    n = len(texts)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bufs = texts.buffers()
    offsets = np.frombuffer(bufs[1], kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: np.ndarray = CODE) -> np.ndarray:
    """A hash of each byte span; spans are in order, non-empty and disjoint. Other codes make another hash."""
    if not len(starts):
        return np.zeros(0, U64)
    length = ends - starts
    at = np.cumsum(length) - length
    inside = np.arange(int(length.sum())) - np.repeat(at, length)
    kept = data[inside + np.repeat(starts, length)]
    return mix(np.add.reduceat(code[kept] * powers(int(length.max()))[inside], at) ^ (length.astype(U64) * U64(0xA0761D6478BD642F)))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words, and each text's range among them (one more than texts)."""
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = solid[1:] != solid[:-1]
    edge[offsets] = True
    marks = np.flatnonzero(edge)
    if len(marks) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    left, right = marks[:-1], marks[1:]
    own = solid[left]
    starts, ends = left[own], right[own]
    return starts, ends, span_hashes(LOWER[data] if lower else data, starts, ends), np.searchsorted(starts, offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all newline-split lines (empty ones too), and each text's range among them."""
    cut = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets, cut, "right") - 1
    starts = np.concatenate([offsets[:-1], cut + 1])
    ends = np.concatenate([cut, offsets[1:]])
    who = np.concatenate([np.arange(len(offsets) - 1), owner])
    order = np.lexsort((starts, who))
    # The k-th start of a text belongs to its k-th end.
    starts = starts[order]
    back = np.lexsort((ends, np.concatenate([owner, np.arange(len(offsets) - 1)])))
    ends = ends[back]
    bounds = np.searchsorted(who[order], np.arange(len(offsets)))
    return starts, ends, bounds


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words; entry i covers words i to i+k-1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, k, U64)
    for j in range(k):
        out = out * U64(0x9FB21C651E98DF25) + hashes[j : j + n]
    return mix(out)


def rolling(hashes: np.ndarray, k: int, base: int = 0x9FB21C651E98DF25) -> np.ndarray:
    """As ``grams`` (with other values), in a few passes whatever k is: differences of one running sum."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = np.full(len(hashes), base, U64), np.full(n, pow(base, -1, 1 << 64), U64)
    up[0] = down[0] = 1
    total = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * np.cumprod(up, dtype=U64), dtype=U64, out=total[1:])
    return mix((total[k:] - total[:n]) * np.cumprod(down, dtype=U64) + U64(k))


def leftmost_min(values: np.ndarray, span: int) -> np.ndarray:
    """Where each run of ``span`` values has its least one, the leftmost of equals."""
    pick = lambda a, b: np.where(values[a] <= values[b], a, b)
    at, size = np.arange(len(values)), 1
    while 2 * size <= span:
        at, size = pick(at[:-size], at[size:]), 2 * size
    n = len(values) - span + 1
    return pick(at[:n], at[span - size : span - size + n])


def shingle_sets(hashes: np.ndarray, bounds: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each text its sorted distinct k-word shingles; with fewer words, the whole sequence as one."""
    flat, out = grams(hashes, k), []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            s = np.sort(flat[a : b - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(grams(hashes[a:b], b - a))
        else:
            out.append(np.zeros(0, U64))
    return out
