"""EAN-13 from pixels: scan lines as run lengths, matched against all digits at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

# Left odd digits, and which left digits are even for each leading digit.
LEFT = ("0001101", "0011001", "0010011", "0111101", "0100011", "0110001", "0101111", "0111011", "0110111", "0001011")
PARITY = ("LLLLLL", "LLGLGG", "LLGGLG", "LLGGGL", "LGLLGG", "LGGLLG", "LGGGLL", "LGLGLG", "LGLGGL", "LGGLGL")
RUNS, MODULES, TOLERANCE = 59, 7, 1.6
LINES = (0.5, 0.4, 0.6, 0.3, 0.7, 0.2, 0.8)


def _widths(bits: str) -> list[int]:
    cuts = [0, *(i for i in range(1, len(bits)) if bits[i] != bits[i - 1]), len(bits)]
    return [b - a for a, b in zip(cuts, cuts[1:])]


#: Run widths of odd digits; a right digit has the same ones, an even one has them reversed.
ODD = np.array([_widths(b) for b in LEFT], float)
EVEN = ODD[:, ::-1]


def check_ok(digits: str) -> bool:
    return len(digits) > 1 and digits.isascii() and digits.isdigit() and sum(int(d) * (3 if k % 2 else 1) for k, d in enumerate(reversed(digits))) % 10 == 0


def otsu(gray: np.ndarray) -> int:
    """The threshold that parts dark from light with the most variance between them."""
    hist = np.bincount(gray.ravel(), minlength=256).astype(float)
    n, s = np.cumsum(hist), np.cumsum(hist * np.arange(256))
    with np.errstate(all="ignore"):
        between = (s[-1] * n / n[-1] - s) ** 2 / (n * (n[-1] - n))
    return int(np.argmax(np.nan_to_num(between, posinf=0)))


def decode_line(bars: np.ndarray) -> str | None:
    """The first symbol of a line of booleans (true: bar)."""
    cuts = np.flatnonzero(np.diff(bars.astype(np.int8))) + 1
    runs = np.diff(np.concatenate([[0], cuts, [len(bars)]])).astype(float)
    if len(runs) < RUNS:
        return None
    first = np.arange(0 if bars[0] else 1, len(runs) - RUNS + 1, 2)
    window = np.lib.stride_tricks.sliding_window_view(runs, RUNS)[first]
    unit = window[:, :3].mean(axis=1, keepdims=True)
    guards = np.concatenate([window[:, :3], window[:, 27:32]], axis=1)
    window = window[((guards <= 1.8 * unit) & (guards >= 0.5 * unit)).all(axis=1)]
    quads = np.concatenate([window[:, 3:27], window[:, 32:56]], axis=1).reshape(len(window), 12, 4)
    scaled = quads * MODULES / quads.sum(axis=2, keepdims=True)
    odd, even = (np.abs(scaled[:, :, None, :] - p).sum(axis=3) for p in (ODD, EVEN))
    even[:, 6:] = np.inf
    for a, b in zip(odd, even):
        use = b.min(axis=1) < a.min(axis=1)
        best = np.where(use[:, None], b, a)
        parity = "".join("G" if u else "L" for u in use[:6])
        if (best.min(axis=1) <= TOLERANCE).all() and parity in PARITY:
            return str(PARITY.index(parity)) + "".join(map(str, best.argmin(axis=1)))
    return None


def decode(gray: np.ndarray) -> str | None:
    """A symbol with a right check digit: several lines, both directions, and the image on its side."""
    if gray.ndim != 2 or not gray.size or gray.min() == gray.max():
        return None
    dark = gray <= otsu(gray)
    for image in (dark, np.rot90(dark)):
        for part in LINES:
            line = image[min(len(image) - 1, int(len(image) * part))]
            for way in (line, line[::-1]):
                if (found := decode_line(way)) and check_ok(found):
                    return found
    return None


def _variants(gray: np.ndarray) -> Iterator[np.ndarray]:
    """The picture as it is, two and three times as large, smoothed along and across, and cut at other levels."""
    yield gray
    for k in (2, 3):
        yield np.repeat(np.repeat(gray, k, axis=0), k, axis=1)
    wide = gray.astype(float)
    for axis in (1, 0):
        smooth = sum(np.roll(wide, s, axis=axis) for s in (-1, 0, 1)) / 3
        yield smooth.astype(np.uint8)
    for level in (96, 128, 160):
        yield np.where(gray <= level, 0, 255).astype(np.uint8)


def decode_any(gray: np.ndarray) -> str | None:
    """``decode`` of the picture, or else of its variants, until one has a valid symbol."""
    return next((found for image in _variants(gray) if (found := decode(image))), None) if gray.ndim == 2 and gray.size else None


def best_valid(found: list[str]) -> str | None:
    """Of several readings, the first with a right check digit, else the first."""
    return next((x for x in found if check_ok(x)), found[0] if found else None)


def encode(digits: str, module: int = 2, height: int = 20, quiet: int = 10) -> np.ndarray:
    """The symbol of 13 digits as gray pixels."""
    flip = lambda b: "".join("10"[int(c)] for c in b)
    left = "".join(LEFT[int(d)] if p == "L" else flip(LEFT[int(d)])[::-1] for d, p in zip(digits[1:7], PARITY[int(digits[0])]))
    bits = "101" + left + "01010" + "".join(flip(LEFT[int(d)]) for d in digits[7:]) + "101"
    row = np.repeat(np.array([0] * quiet + [int(c) for c in bits] + [0] * quiet), module)
    return np.tile(np.where(row == 1, 0, 255).astype(np.uint8), (height, 1))


def decode_pixels(pixels: Column, width: Column) -> Column:
    """The digits of gray pixels in rows of ``width``; null if there is no valid symbol."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for data, widths in batches:
            yield pd.Series([None if d is None or not w else decode_any(np.frombuffer(d, np.uint8).reshape(-1, w)) for d, w in zip(data, widths)], dtype=object)

    return run(pixels, width)
