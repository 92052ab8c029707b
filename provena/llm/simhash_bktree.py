"""SimHash classes: fingerprints linked with BK-trees.

Fingerprints are dealt into shards: a shard holds fingerprints that agree on a set of key bits. Every shard is a
BK-tree (children keyed by their integer Hamming distance to the parent) and a search follows only the edges within
the radius. A shard of at most about ``shard_rows`` fingerprints is built and searched in one task. A larger one is split
into sub-shards; each builds its tree once, and the trees are broadcast to the blocks of the later sub-shards. The
broadcast is bounded: if the trees of all split shards take more than ``broadcast_bytes``, they travel to the blocks by
hash exchange instead, because fingerprints of all documents may not pass the driver.

`pigeonhole_masks` decides which shards can hold a neighbour: 64 bits in B blocks, of which a pair within radius r leaves
at least B - r untouched; one shard for each choice of those, so no link is lost. B grows with the number of fingerprints.

A shard does not emit all its links but a spanning forest of them (each member to the smallest of its local class),
which has the same connected components and is linear in the shard.

Defined results: null and empty texts have fingerprint zero and are linked like any other; repeated rows and equal texts
share a fingerprint and a class; a null id takes its fingerprint's class and never names one unless no id is
there; empty tables give empty results; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm.text import blank_words, release_memory, shingle_hashes, simhash, trimmed
from provena.session import cut, remove, scratch

SHARD_ROWS = 2048
BROADCAST_BYTES = 64 << 20
LINK_ROWS = 250_000
_FRONTIER = 1 << 21


def fingerprints(text: Column, shingle: int = 4, seeds: tuple[int, ...] = (42,)) -> Column:
    """array<bigint>: a 64-bit SimHash of the whole text for each seed."""

    @F.pandas_udf("array<bigint>")
    def of(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            words = blank_words(t)
            prints = [simhash(shingle_hashes(words, shingle, s)) for s in seeds]
            out.append([x - (1 << 64) if x >> 63 else x for x in prints])
        release_memory()
        return pd.Series(out, index=texts.index, dtype=object)

    return of(text)


class BKForest:
    """BK-trees of many shards at once, built and searched level by level with array operations.

    fps: (n, w) unsigned words; shard: n non-decreasing shard numbers; only rows with in_tree become nodes.
    """

    def __init__(self, fps: np.ndarray, shard: np.ndarray, in_tree: np.ndarray):
        self.fps, self.width = fps, 64 * fps.shape[1] + 1
        nodes = np.flatnonzero(in_tree)
        self.root = np.full(len(fps), -1)
        keys, children = [], []
        if len(nodes):
            shards, first = np.unique(shard[nodes], return_index=True)
            roots = nodes[first]
            at = np.searchsorted(shards, shard)
            at[at == len(shards)] = 0
            self.root = np.where(shards[at] == shard, roots[at], -1)
            is_root = np.zeros(len(fps), bool)
            is_root[roots] = True
            active = nodes[~is_root[nodes]]
            parent = self.root[active]
            while len(active):
                edge = parent * self.width + self.distance(active, parent)
                edges, chosen, inverse = np.unique(edge, return_index=True, return_inverse=True)
                keys.append(edges)
                children.append(active[chosen])
                parent = active[chosen][inverse]
                rest = active != parent
                active, parent = active[rest], parent[rest]
        self.keys = np.concatenate(keys) if keys else np.empty(0, np.int64)
        self.children = np.concatenate(children) if children else np.empty(0, np.int64)
        order = np.argsort(self.keys)
        self.keys, self.children = self.keys[order], self.children[order]

    @classmethod
    def of(cls, fps: np.ndarray, edges: np.ndarray) -> "BKForest":
        """A tree that was built elsewhere: its fingerprints, and its keys and children (two rows)."""
        self = cls.__new__(cls)
        self.fps, self.width, self.root = fps, 64 * fps.shape[1] + 1, np.zeros(len(fps), np.int64)
        self.keys, self.children = edges
        return self

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.fps[a] ^ self.fps[b]).sum(1, dtype=np.int64)

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node, distance) of all pairs within the radius, a query's own node excepted."""
        queries = queries[self.root[queries] >= 0]
        at, node, d = self.search(self.fps[queries], self.root[queries], radius)
        own = queries[at] != node
        return queries[at[own]], node[own], d[own]

    def search(self, fps: np.ndarray, node: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, node, distance) of all nodes within the radius of fps; node: where each search starts."""
        found = []
        query = np.arange(len(fps))
        while len(query):
            d = np.bitwise_count(fps[query] ^ self.fps[node]).sum(1, dtype=np.int64)
            hit = d <= radius
            found.append((query[hit], node[hit], d[hit]))
            lo = np.searchsorted(self.keys, node * self.width + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.keys, node * self.width + np.minimum(d + radius, self.width - 1), "right")
            n = hi - lo
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            query, node = np.repeat(query, n), self.children[np.repeat(lo, n) + step]
        if not found:
            empty = np.empty(0, np.int64)
            return empty, empty, empty
        return tuple(np.concatenate(x) for x in zip(*found))


def _classes(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row of each row's class under the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _complete(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Frames of whole shards from batches sorted by shard; one shard is bounded, so is what is held."""
    held: list[pd.DataFrame] = []
    n = 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= rows:
            all_ = pd.concat(held, ignore_index=True)
            g = all_["g"].to_numpy()
            end = int(np.searchsorted(g, g[-1]))
            if end:
                yield all_.iloc[:end]
            held, n = [all_.iloc[end:]], len(all_) - end
    if n:
        yield pd.concat(held, ignore_index=True)


def _chosen(n: int, q: np.ndarray, node: np.ndarray, d: np.ndarray, nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of the links between n rows a spanning forest, or each query's nearest."""
    if nearest:
        order = np.lexsort((node, d, q))
        q, node = q[order], node[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else q
        return q[first], node[first]
    label = _classes(n, q, node)
    a = np.flatnonzero(label != np.arange(n))
    return a, label[a]


def _parts(cost: np.ndarray) -> list[np.ndarray]:
    """Places of queries, so many at a time that their searches stay small."""
    return np.split(np.arange(len(cost)), np.flatnonzero(np.diff(np.cumsum(cost) // _FRONTIER)) + 1) if len(cost) else []


BUILT = "u array<bigint>, v array<bigint>, k long, s int, m int, fps binary, edges binary"


def _build(radius: int, nearest: bool):
    """Links inside each (sub-)shard, and the tree of each sub-shard that others have to meet."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in BUILT.split(", ")]
        for pdf in _complete(batches, 40_000):
            fps = np.array(pdf["fp"].tolist(), np.int64).reshape(len(pdf), -1).view(np.uint64)
            _, first, shard, size = np.unique(pdf["g"].to_numpy(), return_index=True, return_inverse=True, return_counts=True)
            forest = BKForest(fps, shard, np.ones(len(fps), bool))
            for part in _parts(size[shard]):
                a, b = _chosen(len(fps), *forest.within(part, radius), nearest)
                if len(a):
                    signed = fps.view(np.int64)
                    yield pd.DataFrame({"u": list(signed[a]), "v": list(signed[b])}).reindex(columns=names)
            for at, n in zip(first, size):
                if pdf["m"].iat[at] > 1:
                    own = fps[at : at + n]
                    tree = BKForest(own, np.zeros(n, np.int64), np.ones(n, bool))
                    # the root is the first row
                    row = {"k": pdf["k"].iat[at], "s": pdf["s"].iat[at], "m": pdf["m"].iat[at], "fps": own.tobytes(), "edges": np.stack([tree.keys, tree.children]).tobytes()}
                    yield pd.DataFrame([row]).reindex(columns=names)

    return trimmed(build)


def _cross(radius: int, words: int, nearest: bool):
    """Links between the tree of a sub-shard and the fingerprints of a later one."""

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fps, edges, block in zip(*(batch.column(c).to_pylist() for c in ("fps", "edges", "block"))):
                tree = BKForest.of(np.frombuffer(fps, np.uint64).reshape(-1, words), np.frombuffer(edges, np.int64).reshape(2, -1))
                queries = np.frombuffer(block, np.uint64).reshape(-1, words)
                signed = np.concatenate([tree.fps, queries]).view(np.int64)
                for part in _parts(np.full(len(queries), len(tree.fps))):
                    q, node, d = tree.search(queries[part], np.zeros(len(part), np.int64), radius)
                    a, b = _chosen(len(signed), len(tree.fps) + part[q], node, d, nearest)
                    if len(a):
                        ends = pa.array(np.arange(0, words * len(a) + 1, words), pa.int32())
                        yield pa.RecordBatch.from_pydict({n: pa.ListArray.from_arrays(ends, pa.array(signed[x].ravel())) for n, x in (("u", a), ("v", b))})

    return trimmed(cross)


def pigeonhole_masks(n: int, radius: int, bits: int = 64, shard_rows: int = 64) -> list[int]:
    """Key masks such that two fingerprints within the radius agree on all bits of at least one.

    The number of blocks is the smallest whose keys cut n fingerprints to about shard_rows a shard.
    """
    blocks = radius + 1
    while blocks < radius + 4 and n / 2 ** (bits * (blocks - radius) / blocks) > shard_rows:
        blocks += 1
    edge = [round(i * bits / blocks) for i in range(blocks + 1)]
    block = [((1 << edge[i + 1]) - (1 << edge[i])) for i in range(blocks)]
    return [sum(block[i] for i in keep) for keep in combinations(range(blocks), blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shard_links(nodes: DataFrame, radius: int, masks: list[list[int]], shard_rows: int = SHARD_ROWS, nearest: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Links (u array<bigint>, v array<bigint>) between distinct fingerprints `fp array<bigint>` within the radius.

    A spanning forest of all links, or with ``nearest`` each fingerprint's nearest in each (sub-)shard.
    """
    key = F.array(*[F.xxhash64(F.lit(t), *[F.col("fp")[w].bitwiseAND(F.lit(_signed(m))) for w, m in enumerate(mask)]) for t, mask in enumerate(masks)])
    dealt = nodes.select("fp", F.explode(key).alias("k"))
    large = dealt.groupBy("k").count().where(F.col("count") > shard_rows).select("k", F.ceil(F.col("count") / shard_rows).cast("int").alias("m"))
    dealt = dealt.join(large, "k", "left").select("fp", "k", F.coalesce("m", F.lit(1)).alias("m"))
    dealt = dealt.withColumn("s", F.pmod(F.xxhash64(F.lit(11), "fp"), F.col("m")).cast("int"))
    dealt = dealt.select(F.xxhash64("k", "s").alias("g"), "fp", "k", "s", "m")
    built = cut(dealt.repartition("g").sortWithinPartitions("g").mapInPandas(_build(radius, nearest), BUILT), "bk-trees")
    links = built.where("edges is null").select("u", "v")
    trees = built.where("edges is not null").select("k", "s", "m", "fps", "edges")
    size = trees.agg(F.sum(F.octet_length("fps") + F.octet_length("edges"))).first()[0]
    if not size:
        return links
    spread = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = trees.select("k", F.col("s").alias("j"), F.col("fps").alias("block"))
    if size <= broadcast_bytes:
        met = blocks.repartition(spread, "k", "j").join(F.broadcast(trees), "k").where("s < j")
    else:
        met = trees.where("s < m - 1").withColumn("j", F.explode(F.expr("sequence(s + 1, m - 1)"))).join(blocks, ["k", "j"])
    crossed = met.select("fps", "edges", "block").mapInArrow(_cross(radius, len(masks[0]), nearest), "u array<bigint>, v array<bigint>")
    return links.unionByName(crossed)


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link u-v; root is the smallest node of the component.

    Alternating large-star and small-star rounds; every round ends in a table in the shared folder. The minima are tables
    too: both sides of their joins are then plain exchanges, so the node of a large class can be split.
    """
    edges = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "cc")
    # no round has more than twice as many rows: a file for each LINK_ROWS of them, not for each partition of an exchange
    files = edges.count() // LINK_ROWS + 1
    write = lambda df, name: cut(df.coalesce(files), name)
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-low")
        large = write(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
        least = write(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, write(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        remove(before, low, large, least)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = now


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, shard_rows: int = SHARD_ROWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """id_col, fp bigint, component (smallest id reachable over links of at most radius bits), a row for each input row."""
    with scratch() as keep:
        fps = keep(cut(docs.select(F.col(id_col).alias("id"), fingerprints(F.col(text_col), shingle)[0].alias("fp")), "fingerprints"))
        nodes = cut(fps.groupBy("fp").agg(F.min("id").alias("rep")), "fingerprint-nodes")
        masks = pigeonhole_masks(nodes.count(), radius)
        links = shard_links(nodes.select(F.array("fp").alias("fp")), radius, [[m] for m in masks], shard_rows, broadcast_bytes=broadcast_bytes)
        roots = connected_components(links.select(F.col("u")[0].alias("u"), F.col("v")[0].alias("v")))
        linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp")
        least = linked.groupBy("root").agg(F.min("rep").alias("component"))
        linked = linked.join(least, "root").select("fp", "component")
        # a table of its own: both sides of the last join come from plain exchanges, so a hot fingerprint can be split
        classes = keep(cut(nodes.join(linked, "fp", "left").select("fp", F.coalesce("component", "rep").alias("component")), "fingerprint-classes"))
    return fps.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component")
