"""Similar files by token sets: banded MinHash signatures, whole sets compared, crowded bands taken apart by rare tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.session import cut

SHINGLE, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.95, 128
#: Sets in a band from which on its pairs are found by rare shingles.
CROWD = 32
_EPS = 1e-9
SEED = 42
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: How many shingles are hashed together.
_AT_ONCE = 1 << 15


def shingle_set(text: Column, words: int = SHINGLE) -> Column:
    """array<bigint>: sorted distinct 64-bit hashes of the runs of so many words; a shorter text is one run, none gives no hash.

    The words are bound to a name, so that they are split once and not for every run.
    """
    split = F.array(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    run = lambda w, i: F.xxhash64(F.array_join(F.slice(w, i, F.lit(words)), " "))
    runs = lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (words - 1), F.lit(1))), lambda i: run(w, i)))
    return F.array_sort(F.array_distinct(F.coalesce(F.element_at(F.transform(split, runs), 1), F.array().cast("array<bigint>"))))


def bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the longest rows, so the fewest false candidates, by which a pair at the threshold shares a band with that chance."""
    for rows in range(most, 0, -1):
        if (n := most // rows) and 1 - (1 - threshold**rows) ** n >= recall:
            while n > 1 and 1 - (1 - threshold**rows) ** (n - 1) >= recall:
                n -= 1
            return n, rows
    raise ValueError(f"{most} hashes do not reach a recall of {recall} at {threshold}")


def distinct_sets(files: DataFrame) -> DataFrame:
    """node (128-bit digest of the set), file (smallest), n_files, shingles: equal sets are compared once. files: file, shingles."""
    told = files.where(F.size("shingles") > 0).withColumn("node", F.md5(F.array_join("shingles", ",").cast("binary")))
    return told.groupBy("node").agg(F.min("file").alias("file"), F.count("*").alias("n_files"), F.any_value("shingles").alias("shingles"))


def _set_bands(n_bands: int, rows: int):
    """The band keys of each set; a batch's sets are hashed together, one hash function at a time."""
    seeds, odd = np.random.default_rng(SEED).integers(0, 1 << 64, (2, n_bands * rows), np.uint64)
    odd |= np.uint64(1)

    def keys(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.empty((len(starts), n_bands), np.uint64)
        for b in range(n_bands):
            key = np.full(len(starts), b + 1, np.uint64)
            for i in range(b * rows, (b + 1) * rows):
                key ^= np.minimum.reduceat((h ^ seeds[i]) * odd[i], starts)
                key *= _MIX
                key ^= key >> np.uint64(29)
            out[:, b] = key
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lo, ends = 0, whole.column("shingles").offsets.to_numpy().astype(np.int64)
            while lo < whole.num_rows:
                hi = max(int(np.searchsorted(ends, ends[lo] + _AT_ONCE, "right")) - 1, lo + 1)
                batch = whole.slice(lo, hi - lo)
                h = batch.column("shingles").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                found = keys(h, ends[lo:hi] - ends[lo]).view(np.int64)
                at = pa.array(np.arange(0, found.size + 1, n_bands), pa.int32())
                n = pa.array(np.diff(ends[lo : hi + 1]), pa.int32())
                yield pa.RecordBatch.from_pydict({"node": batch.column("node"), "n": n, "bands": pa.ListArray.from_arrays(at, pa.array(found.ravel()))})
                lo = hi

    return run


def set_bands(sets: DataFrame, n_bands: int, rows: int) -> DataFrame:
    """node, n (the size of the set), bands (a hash of each band's number and minima): no row for a shingle is made."""
    kind = sets.schema["node"].dataType.simpleString()
    return sets.where("size(shingles) > 0").select("node", "shingles").mapInArrow(_set_bands(n_bands, rows), f"node {kind}, n int, bands array<long>")


def band_keys(sets: DataFrame, n_bands: int, rows: int) -> DataFrame:
    """node, n, band: set_bands, a row for each band."""
    return set_bands(sets, n_bands, rows).select("node", "n", F.explode("bands").alias("band"))


def _close(a: Column, b: Column, threshold: float) -> Column:
    return F.least(a, b) >= threshold * F.greatest(a, b) - _EPS


def _pairs(rows: DataFrame, key: str, threshold: float) -> DataFrame:
    """a < b of nodes that share the key and whose sizes allow the similarity."""
    left = rows.select(key, F.col("node").alias("a"), F.col("n").alias("na"))
    right = rows.select(key, F.col("node").alias("b"), F.col("n").alias("nb"))
    return left.join(right, key).where((F.col("a") < F.col("b")) & _close(F.col("na"), F.col("nb"), threshold)).select("a", "b")


def rare_prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """node, n, h: of each set the shingles of which similar sets share at least one, rarest first over all these sets."""
    one = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("h"))
    held = one.groupBy("h").agg(F.count("*").alias("df"))
    told = one.join(held, "h").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("in_order"))
    first = told.withColumn("in_order", F.slice("in_order", F.lit(1), (F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - _EPS) + 1).cast("int")))
    return first.select("node", "n", F.explode("in_order").alias("e")).select("node", "n", F.col("e.h").alias("h"))


def similar_sets(sets: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, crowd: int = CROWD, most: int = MOST_HASHES) -> DataFrame:
    """a < b, shared, similarity: pairs of nodes whose sets have at least that Jaccard similarity. sets: node, shingles, a table.

    A pair at the threshold is found with the chance ``recall``, more similar ones more surely. A band that more than
    ``crowd`` sets share makes no pairs of its own: its sets are paired where they share one of their rarest shingles,
    which finds all its similar pairs and does not pair sets for what all of them hold.
    """
    n_bands, rows = bands(threshold, recall, most)
    # a table of a row for each set, read twice
    keys = cut(set_bands(sets, n_bands, rows), "set-bands").select("node", "n", F.explode("bands").alias("band"))
    counts = keys.groupBy("band").agg(F.count("*").alias("crowd")).where("crowd > 1")
    told = keys.join(counts, "band")
    plain = _pairs(told.where(F.col("crowd") <= crowd), "band", threshold)
    hot = told.where(F.col("crowd") > crowd).select("node").distinct()
    rare = _pairs(rare_prefixes(sets.join(hot, "node", "left_semi"), threshold), "h", threshold)
    met = plain.unionByName(rare).distinct()
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    told = met.join(a, "a").join(b, "b").withColumn("shared", F.size(F.array_intersect("x", "y")).cast("long"))
    told = told.select("a", "b", "shared", (F.col("shared") / (F.size("x") + F.size("y") - F.col("shared"))).alias("similarity"))
    return told.where(F.col("similarity") >= threshold - _EPS)
