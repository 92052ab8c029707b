"""Context-triggered piecewise digests: a character for every piece of a text, pieces ending where the text itself says so."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of the rolling window and its multiplier, the smallest piece size, and the number of pieces aimed at.
ROLL, BASE, SMALLEST, PIECES = 7, 31, 3, 64
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def rolling(codes: np.ndarray) -> np.ndarray:
    """Sum over the last ROLL code points, each times a power of BASE (the latest times 1), modulo 2**32; what is before the text is 0."""
    out = np.zeros(len(codes), np.uint64)
    for k in range(min(ROLL, len(codes))):
        out[k:] += codes[: len(codes) - k].astype(np.uint64) * np.uint64(BASE**k)
    return out % np.uint64(1 << 32)


def piece_size(n: int) -> int:
    """SMALLEST doubled until PIECES pieces of it hold n characters."""
    size = SMALLEST
    while size * PIECES < n:
        size *= 2
    return size


def _pieces(text: str, roll: np.ndarray, size: int) -> str:
    ends = (np.flatnonzero(roll % np.uint64(size) == size - 1) + 1).tolist()
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    starts = [0, *ends[:-1]]
    return "".join(ALPHABET[hashlib.md5(text[a:b].encode("utf-8", "replace")).digest()[0] & 63] for a, b in zip(starts, ends))


def digests(text: str | None) -> list[tuple[int, str]]:
    """(piece size, digest) for the text's piece size and its double, so texts of up to twice the length share one."""
    if not text:
        return []
    roll = rolling(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"))
    size = piece_size(len(text))
    return [(s, _pieces(text, roll, s)) for s in (size, 2 * size)]


def fuzzy_digests(text: Column) -> Column:
    """array<struct<size, digest>>: no digest for a null or empty text; digests are never cut off."""

    @F.pandas_udf("array<struct<size:long,digest:string>>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"size": s, "digest": d} for s, d in digests(t)] for t in texts], index=texts.index, dtype=object)

    return of(text)
