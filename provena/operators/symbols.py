"""Static libraries by symbol sets: relational division by bitmaps of releases, never by rows of library and release.

Inputs: libs (lib, symbol), refs (component, release, ord, symbol), components (component, prefix).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.session import cut

#: Releases that are shown where none explains all.
CLOSEST = 5


def universe(refs: DataFrame) -> DataFrame:
    return refs.select("component", "symbol").distinct()


def _prefixed(df: DataFrame, components: DataFrame) -> DataFrame:
    return df.join(components, "component").where(F.expr("symbol rlike concat('^(?:', prefix, ')')")).drop("prefix")


def known(libs: DataFrame, refs: DataFrame, components: DataFrame) -> DataFrame:
    """lib, component, symbol: observed symbols with the component's prefix that some release has."""
    return _prefixed(libs.select("lib", "symbol").distinct().join(universe(refs), "symbol"), components).select("lib", "component", "symbol")


def observed_counts(libs: DataFrame, kept: DataFrame, components: DataFrame) -> DataFrame:
    """lib, component, n_observed, n_known: symbols with the prefix, for pairs that know at least one."""
    n = kept.groupBy("lib", "component").agg(F.count("*").alias("n_known"))
    seen = _prefixed(libs.select("lib", "symbol").distinct().join(n.select("lib", "component"), "lib"), components)
    return seen.groupBy("lib", "component").agg(F.count("*").alias("n_observed")).join(n, ["lib", "component"])


def release_table(refs: DataFrame) -> DataFrame:
    """component, release, ord, place (from 0, in the table's order), size (symbols)."""
    sizes = refs.select("component", "release", "ord", "symbol").distinct().groupBy("component", "release", "ord").agg(F.count("*").alias("size"))
    order = Window.partitionBy("component").orderBy("ord", "release")  # the releases of one component
    return sizes.withColumn("place", F.row_number().over(order) - 1)


def symbol_bitmaps(refs: DataFrame, releases: DataFrame, components: DataFrame) -> DataFrame:
    """component, symbol, prefixed, words: the releases that have a symbol as bits, in words of 64 that are not zero."""
    at = refs.select("component", "release", "symbol").distinct().join(releases.select("component", "release", "place"), ["component", "release"])
    words = at.groupBy("component", "symbol", F.floor(F.col("place") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(place % 64 AS INT))")).alias("bits"))
    told = words.groupBy("component", "symbol").agg(F.collect_list(F.struct("word", "bits")).alias("words")).join(components, "component")
    return told.select("component", "symbol", F.expr("symbol rlike concat('^(?:', prefix, ')')").alias("prefixed"), "words")


def _rows_and_words(words: pa.Array, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, its 64 bits as a number) of every word of lists of words, of which each belongs to a row."""
    offsets = words.offsets.to_numpy()
    lo, hi = int(offsets[0]), int(offsets[-1])
    word = words.values.field("word").to_numpy(zero_copy_only=False)[lo:hi]
    return np.repeat(row, np.diff(offsets)), word, words.values.field("bits").to_numpy(zero_copy_only=False)[lo:hi]


def _rows_and_bits(words: pa.Array, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _rows_and_words, with the bits one by one."""
    row, word, bits = _rows_and_words(words, row)
    return row, word, np.unpackbits(np.ascontiguousarray(bits, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _sums(n: int, n_words: int, row: np.ndarray, word: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """How many of a row's bitmaps have each bit."""
    out = np.zeros((n * n_words, 64), np.int32)
    key = row * n_words + word
    order = np.argsort(key, kind="stable")
    if len(order):
        starts = np.flatnonzero(np.r_[True, np.diff(key[order]) > 0])
        out[key[order][starts]] = np.add.reduceat(bits[order], starts, axis=0, dtype=np.int32)
    return out.reshape(n, n_words * 64)


def _chosen(unexplained: np.ndarray, matched: np.ndarray, soft: np.ndarray, there: np.ndarray, mode: str) -> tuple[np.ndarray, np.ndarray]:
    """(mask of the releases that a mode returns, fewest unexplained symbols) of each row."""
    far = np.iinfo(np.int32).max
    open_ = np.where(there & (matched > 0) if mode == "fold" else there, unexplained, far)
    least = open_.min(1)
    if mode == "strict":
        return open_ == 0, least
    mask = open_ == least[:, None]
    fewest = np.where(mask, soft, far).min(1)
    narrow = mask & (soft == fewest[:, None])
    if mode == "fold":
        return narrow, least
    closest = np.zeros_like(mask)
    np.put_along_axis(closest, np.argsort(open_, axis=1, kind="stable")[:, :CLOSEST], True, axis=1)
    return np.where(least[:, None] == 0, narrow, closest & there), least


def _common(n: int, n_words: int, row: np.ndarray, word: np.ndarray, bits: np.ndarray, known_: np.ndarray) -> np.ndarray:
    """(row, word) of 64 bits: the releases that all known symbols of a row have. A word that a symbol lacks has no release for it."""
    out = np.zeros(n * n_words, np.int64)
    key = row * n_words + word
    order = np.argsort(key, kind="stable")
    if len(order):
        starts = np.flatnonzero(np.r_[True, np.diff(key[order]) > 0])
        at = key[order][starts]
        whole = np.diff(np.r_[starts, len(order)]) == known_[at // n_words]
        out[at] = np.where(whole, np.bitwise_and.reduceat(bits[order], starts), 0)
    return out.reshape(n, n_words)


def _divide_ranges(*more: str):
    """Of the releases that explain all known symbols how many, the first and the last, by bitmaps alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            most = max(pc.max(pc.list_value_length(whole.column("sizes"))).as_py() or 1, 1) if whole.num_rows else 1
            n_words = -(-most // 64)
            step = max(1, (1 << 20) // (64 * n_words))
            for first in range(0, whole.num_rows, step):
                batch = whole.slice(first, step)
                n, held = batch.num_rows, batch.column("held")
                offsets = held.offsets.to_numpy()
                entries = held.values.slice(offsets[0], offsets[-1] - offsets[0])
                row = np.repeat(np.arange(n), np.diff(offsets))
                prefixed = entries.field("prefixed").to_numpy(zero_copy_only=False)
                words = entries.field("words")
                own = np.repeat(prefixed, pc.list_value_length(words).to_numpy(zero_copy_only=False))
                of, word, raw = _rows_and_words(words, row)
                known_ = np.bincount(row[prefixed], minlength=n)
                both = np.unpackbits(_common(n, n_words, of[own], word[own], raw[own], known_).astype("<i8").view(np.uint8), axis=1, bitorder="little").view(bool)
                columns = {c: batch.column(c) for c in ("lib", "component", *more)}
                a, b = both.argmax(1), both.shape[1] - 1 - both[:, ::-1].argmax(1)
                yield pa.RecordBatch.from_pydict(columns | {"n": pa.array(both.sum(1), pa.int64()), "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32())})

    return run


def _divide(mode: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            most = max(pc.max(pc.list_value_length(whole.column("sizes"))).as_py() or 1, 1) if whole.num_rows else 1
            n_words = -(-most // 64)
            step = max(1, (1 << 20) // (64 * n_words))
            for first in range(0, whole.num_rows, step):
                batch = whole.slice(first, step)
                n, held, sizes = batch.num_rows, batch.column("held"), batch.column("sizes")
                offsets = held.offsets.to_numpy()
                entries = held.values.slice(offsets[0], offsets[-1] - offsets[0])
                row = np.repeat(np.arange(n), np.diff(offsets))
                prefixed = entries.field("prefixed").to_numpy(zero_copy_only=False)
                of, word, bits = _rows_and_bits(entries.field("words"), row)
                own = np.repeat(prefixed, pc.list_value_length(entries.field("words")).to_numpy(zero_copy_only=False))
                all_held = _sums(n, n_words, of, word, bits)
                matched = all_held if prefixed.all() else _sums(n, n_words, of[own], word[own], bits[own])
                length = pc.list_value_length(sizes).to_numpy(zero_copy_only=False)
                there = np.arange(64 * n_words) < length[:, None]
                size = np.zeros(there.shape, np.int64)
                size[there] = sizes.flatten().to_numpy(zero_copy_only=False)
                known_ = np.bincount(row, weights=prefixed, minlength=n).astype(np.int64)
                unexplained = known_[:, None] - matched
                soft = size - all_held
                mask, least = _chosen(unexplained, matched, soft, there, mode)
                at, place = np.nonzero(mask)
                ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=n))]).astype(np.int32)
                found = pa.StructArray.from_arrays([pa.array(place, pa.int32()), pa.array(unexplained[mask], pa.int64()), pa.array(soft[mask], pa.int64())], ["place", "unexplained", "soft"])
                columns = {"lib": batch.column("lib"), "component": batch.column("component"), "least": pa.array(least, pa.int64()), "found": pa.ListArray.from_arrays(ends, found)}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _held(libs: DataFrame, refs: DataFrame, components: DataFrame, **more: Column) -> tuple[DataFrame, DataFrame]:
    """(lib, component, held: words and prefixed of each symbol, sizes, and aggregates over lib, component, symbol, prefixed; releases).

    A library meets the bitmap of each of its symbols, once for each component that has it: no row for a library and a
    release is made. Bits are added up within the row, which holds one library's symbols.
    """
    releases = release_table(refs)
    bitmaps = symbol_bitmaps(refs, releases, components)
    met = libs.select("lib", "symbol").distinct().join(bitmaps, "symbol")
    some = {name: c.alias(name) for name, c in more.items()}
    rows = met.groupBy("lib", "component").agg(F.collect_list(F.struct("words", "prefixed")).alias("held"), F.max("prefixed").alias("some"), *some.values()).where("some").drop("some")
    sizes = releases.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "size"))), lambda x: x["size"]).alias("sizes"))
    return rows.join(sizes, "component").select("lib", "component", "held", "sizes", *more), releases


def _kinds(rows: DataFrame, *names: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return ", ".join(f"{c} {kinds[c]}" for c in names)


def _divided(libs: DataFrame, refs: DataFrame, components: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """(lib, component, least, found: array of place, unexplained, soft; releases): a row for a library and a component."""
    rows, releases = _held(libs, refs, components)
    schema = f"{_kinds(rows, 'lib', 'component')}, least long, found array<struct<place:int,unexplained:bigint,soft:bigint>>"
    return rows.mapInArrow(_divide(mode), schema), releases


def window(libs: DataFrame, refs: DataFrame, components: DataFrame, mode: str = "fold") -> DataFrame:
    """The releases a library may hold of each component it shares symbols with: lib, component, release, ord, unexplained, soft, kind.

    fold: all releases with the fewest unexplained symbols, narrowed to the fewest soft absences.
    strict: releases that explain all known symbols.
    rank: the strict ones with the fewest soft absences, else the five closest (order of the table on ties).
    """
    found, releases = _divided(libs, refs, components, mode)
    told = found.select("lib", "component", "least", F.inline("found")).join(releases.select("component", "place", "release", "ord"), ["component", "place"])
    closest = F.concat(F.lit("closest (+"), F.col("least"), F.lit(" unexplained)"))
    return told.select("lib", "component", "release", "ord", "unexplained", "soft", F.when(F.col("least") == 0, "consistent").otherwise(closest).alias("kind"))


def spans(libs: DataFrame, refs: DataFrame, components: DataFrame) -> DataFrame:
    """lib, component, n_releases, first_release, last_release of the strict window, a row for each that has one.

    The first and the last place of the bits name the range, so its releases are never listed.
    """
    rows, releases = _held(libs, refs, components)
    found = rows.mapInArrow(_divide_ranges(), f"{_kinds(rows, 'lib', 'component')}, n long, a int, b int")
    return _range_names(found, releases, "inner").select("lib", "component", F.col("n").alias("n_releases"), "first_release", "last_release")


def _range_names(found: DataFrame, releases: DataFrame, how: str) -> DataFrame:
    """found with first_release and last_release at its places a and b where n is not 0."""
    for x, name in (("a", "first_release"), ("b", "last_release")):
        at = releases.select("component", F.col("place").alias(x), F.col("release").alias(name))
        found = found.withColumn(x, F.when(F.col("n") > 0, F.col(x))).join(at, ["component", x], how)
    return found


def span(rows: DataFrame) -> DataFrame:
    """lib, component, n_releases, first_release, last_release in the table's order."""
    return rows.groupBy("lib", "component").agg(F.count("*").alias("n_releases"), F.min_by("release", "ord").alias("first_release"), F.max_by("release", "ord").alias("last_release"))


def show_span(first, last, n, most: int = 4):
    """A range when there are more than ``most`` releases."""
    return F.when(n > most, F.concat(first, F.lit(" … "), last)).otherwise(first)


def discriminating(refs: DataFrame) -> DataFrame:
    """component, symbol, n, first_release, last_release of symbols that some releases have and others lack."""
    refs = refs.distinct()
    total = refs.groupBy("component").agg(F.count_distinct("release").alias("n_releases"))
    held = refs.groupBy("component", "symbol").agg(F.count("*").alias("n"), F.min_by("release", "ord").alias("first_release"), F.max_by("release", "ord").alias("last_release"))
    return held.join(total, "component").where("n < n_releases").drop("n_releases")


def batch_scan(libs: DataFrame, refs: DataFrame, components: DataFrame, shown: int = 10) -> DataFrame:
    """lib, component, n_observed, n_known, n_unknown, known_sample, n_consistent, first_release, last_release."""
    refs = cut(refs, "symbol-refs")  # a table, as two jobs read it
    n_known = F.count_if("prefixed")
    sample = F.slice(F.array_sort(F.collect_list(F.when(F.col("prefixed"), F.col("symbol")))), 1, shown)
    rows, releases = _held(libs, refs, components, n_known=n_known, known_sample=sample)
    told = rows.mapInArrow(_divide_ranges("n_known", "known_sample"), f"{_kinds(rows, 'lib', 'component', 'n_known', 'known_sample')}, n long, a int, b int")
    told = cut(told.join(components, "component"), "scanned-libraries")  # read twice
    # a library's symbols are matched once with each prefix, not with each component
    seen = libs.select("lib", "symbol").distinct().join(told.select("lib", "prefix").distinct(), "lib").where(F.expr("symbol rlike concat('^(?:', prefix, ')')"))
    counts = seen.groupBy("lib", "prefix").agg(F.count("*").alias("n_observed"))
    out = _range_names(told.join(counts, ["lib", "prefix"]), releases, "left")
    return out.select("lib", "component", "n_observed", "n_known", (F.col("n_observed") - F.col("n_known")).alias("n_unknown"), "known_sample", F.col("n").alias("n_consistent"), "first_release", "last_release")


def scan_summary(libs: DataFrame, matches: DataFrame, errors: DataFrame) -> DataFrame:
    """libs_scanned, hits, no_match, unreadable. errors: lib of unreadable libraries."""
    state = libs.select("lib").distinct().join(matches.select("lib").distinct().withColumn("hit", F.lit(1)), "lib", "left")
    told = state.agg(F.count("*").alias("readable"), F.count("hit").alias("hits"))
    bad = errors.agg(F.count_distinct("lib").alias("unreadable"))
    return told.crossJoin(bad).select((F.col("readable") + F.col("unreadable")).alias("libs_scanned"), "hits", (F.col("readable") - F.col("hits")).alias("no_match"), "unreadable")


def toolchain_variance(libs: DataFrame, keys: list[str], flavour: str) -> DataFrame:
    """keys, n_flavours, n_symbols, n_differing, verdict: symbol sets across flavours; fewer than two flavours are skipped."""
    rows = libs.select(*keys, flavour, "symbol").distinct()
    flavours = rows.groupBy(*keys).agg(F.count_distinct(flavour).alias("n_flavours")).where("n_flavours > 1")
    held = rows.groupBy(*keys, "symbol").agg(F.count("*").alias("n")).join(flavours, keys)
    told = held.groupBy(*keys).agg(F.max("n_flavours").alias("n_flavours"), F.count("*").alias("n_symbols"), F.count_if(F.col("n") < F.col("n_flavours")).alias("n_differing"))
    return told.withColumn("verdict", F.when(F.col("n_differing") == 0, "IDENTICAL").otherwise("DIFFERS"))


def differing_symbols(libs: DataFrame, keys: list[str], flavour: str) -> DataFrame:
    """keys, symbol, holders: symbols that some flavours have and others lack."""
    rows = libs.select(*keys, flavour, "symbol").distinct()
    flavours = rows.groupBy(*keys).agg(F.count_distinct(flavour).alias("n_flavours"))
    held = rows.groupBy(*keys, "symbol").agg(F.array_sort(F.collect_set(flavour)).alias("holders")).join(flavours, keys)
    return held.where(F.size("holders") < F.col("n_flavours")).drop("n_flavours")
