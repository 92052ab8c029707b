"""Word and shingle primitives shared by the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash

_xxh = xxhash.xxh64_intdigest
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def release_memory() -> None:
    """Gives what this Python worker has freed back to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow or mapInPandas, with a worker's memory released when the task ends."""

    @wraps(run)
    def told(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return told


def lower_bytes(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased and nothing else changed; null counts as empty."""
    return b"" if text is None else text.encode("utf-8", "replace").lower()


def blank_words(text: str | None) -> list[bytes]:
    """Words between U+0020 and U+0009-U+000D (bytes.split() knows exactly these)."""
    return lower_bytes(text).split()


def shingle_hashes(words: list[bytes], n: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every n-word shingle, repeats included; a shorter text is one shingle, no words give none."""
    if not words:
        return np.empty(0, np.uint64)
    buf = b" ".join(words)
    if len(words) < n:
        return np.array([_xxh(buf, seed)], np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    a, b = starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist()
    return np.fromiter((_xxh(buf[i:j], seed) for i, j in zip(a, b)), np.uint64, len(a))


def shingle_mixes(words: list[bytes], n: int, seed: int = 42) -> np.ndarray:
    """64-bit hashes of every n-word shingle from the XXH64 of its words, repeats included; a shorter text is one shingle.

    Several times as fast as `shingle_hashes`, for uses that may choose their hash.
    """
    if not words:
        return np.empty(0, np.uint64)
    n = min(n, len(words))
    h = np.fromiter((_xxh(w, seed) for w in words), np.uint64, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out *= _MULTIPLIER
        out += h[i : i + len(out)]
    out ^= out >> np.uint64(32)
    out *= _MULTIPLIER
    out ^= out >> np.uint64(29)
    return out


def simhash(hashes: np.ndarray) -> int:
    """The 64 majority bits: a bit is 1 if it is set in over half of the hashes; no hashes give zero."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[i : i + (1 << 16)], dtype="<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])
