"""Approximate nearest neighbours on randomly rotated one-bit codes.

Index: a vector is scaled to length one and turned by a random rotation (fixed by seed and dimension); its code is the
sign of each coordinate, packed into 64-bit words, and its correction scalar is the inner product of the vector with the
unit vector of its code. Every row is indexed; nothing is fitted.

Search: a query is turned likewise and its coordinates are rounded to ``query_bits`` bits, so that its inner product with
a code is a few bit counts, one for each bit plane. Divided by the code's scalar this estimates the cosine; the error is
bounded by epsilon * sqrt((1 - s^2) / s^2 / (d - 1)), which the true value leaves with the chance that a normal variable
exceeds epsilon, plus the rounding. A vector is reranked with its exact cosine when its upper bound reaches the k-th best
exact value its task has seen for the query; the others are passed over.

The index is cut into lists of about ``list_rows`` vectors around centroids (k-means on a sample of at most ``sample``
vectors, the most that is ever gathered; at most ``max_lists`` centroids); a query meets the lists of its nearest centroids,
at least ``probes``, and as many as hold the share ``target`` of the sample's true neighbours. With no more lists than probes,
so up to list_rows * probes rows, nothing is passed over but by the bounds. A list larger than a task should hold is cut into parts by a hash, so a vector that a third
of all rows share is no hot task. Queries are sent to the parts they meet by exchange, a part's queries stream past its
vectors, and k rows a query and part go on to the merge. Nothing but the sample passes the driver.

Vectors are kept scaled by the power of two that brings their largest component to between a half and one: cosines stay the
same to the last bit, and no length under- or overflows.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, as query or
candidate; only vectors of the query's dimension are candidates; fewer than k candidates are all returned; ties go to
the smaller id; rows that repeat an id are separate candidates unless the id is the query's own, and of those that repeat
a query's id the least vector asks; null ids take no part;
empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provena.llm.text import trimmed
from provena.session import cut

_CHUNK = 4096


@cache
def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def pack_bits(bits: np.ndarray) -> np.ndarray:
    """(n, d) booleans -> (n, words) unsigned 64-bit words."""
    pad = -bits.shape[1] % 64
    packed = np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8")


def encode(vectors: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, scalars) of (n, d) vectors."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    turned = unit @ rotation(vectors.shape[1], seed).T
    return pack_bits(turned > 0), np.abs(turned).sum(1) / np.sqrt(vectors.shape[1])


def norms(vectors: np.ndarray) -> np.ndarray:
    """Row lengths, summed in the order of the coordinates, so that equal vectors have equal values."""
    out = np.zeros(len(vectors))
    for column in np.ascontiguousarray(vectors.T):
        out += column * column
    return np.sqrt(out)


def cosines(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, pairs: int = 8192) -> np.ndarray:
    """Cosines of the pairs (a[i], b[j]) in double precision and that order; some pairs at a time, coordinates outermost."""
    at, bt = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    length = norms(a)[i] * norms(b)[j]
    out = np.zeros(len(i))
    for lo in range(0, len(i), pairs):
        part = slice(lo, lo + pairs)
        x, y = at.take(i[part], axis=1), bt.take(j[part], axis=1)
        x *= y
        for row in x:
            out[part] += row
    return out / length


class Queries:
    """Rotated and rounded queries of one dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int, bits: int):
        self.ids, self.vectors, d = ids, vectors, vectors.shape[1]
        turned = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ rotation(d, seed).T
        self.low = turned.min(1)
        self.step = np.maximum(turned.max(1) - self.low, 1e-12) / ((1 << bits) - 1)
        levels = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        self.planes = [pack_bits((levels >> b & 1) > 0) for b in range(bits)]
        self.total = self.low * d + self.step * levels.sum(1)
        self.slack = self.step / 2 * np.sqrt(d)

    def estimate(self, codes: np.ndarray, scalars: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
        """(estimated cosines, error bounds), queries by codes."""
        d = self.vectors.shape[1]
        ones = np.bitwise_count(codes).sum(1, dtype=np.int64)
        weighed = np.zeros((len(self.ids), len(codes)), np.int32)
        for b, plane in enumerate(self.planes):
            for w in range(codes.shape[1]):
                weighed += np.bitwise_count(plane[:, w, None] & codes[None, :, w]).astype(np.int32) << b
        # sum over set bits of the rounded query, twice, less its total: the inner product with the signs
        signs = 2 * (self.low[:, None] * ones[None, :] + self.step[:, None] * weighed) - self.total[:, None]
        scalars = np.maximum(scalars, 1e-9)
        bound = epsilon * np.sqrt(np.maximum(1 - scalars**2, 0) / scalars**2 / max(d - 1, 1))
        return signs / np.sqrt(d) / scalars, bound + self.slack[:, None] / scalars


def _valid(vector: str):
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & sound & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    return np.split(flat, ends[:-1]) if len(ends) else []


def _centroids(sample: np.ndarray, lists: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit vectors by k-means."""
    rng = np.random.default_rng(seed)
    found = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(rounds):
        near = (sample @ found.T).argmax(1)
        total = np.zeros_like(found)
        np.add.at(total, near, sample)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        found = np.where(length > 0, total / np.where(length > 0, length, 1), found)
    return found


def _probes(sample: np.ndarray, centroids: np.ndarray, target: float, k: int = 5) -> int:
    """How many lists, nearest centroids first, hold the share target of the k nearest of some sample vectors in the sample."""
    queries = sample[:256]
    cosine = queries @ sample.T
    cosine[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    k = min(k, len(sample) - 1)
    near = np.argpartition(-cosine, k, axis=1)[:, :k]
    own = (sample @ centroids.T).argmax(1)
    place = np.argsort(np.argsort(-(queries @ centroids.T), axis=1, kind="stable"), axis=1)
    return int(np.quantile(np.take_along_axis(place, own[near], 1), target, method="higher")) + 1


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 5, list_rows: int = 16_384, probes: int = 16, sample: int = 50_000, max_lists: int = 4096, target: float = 0.97) -> DataFrame:
    """id, vector array<double>, code binary, scalar, probes array<int> (the lists to search, the row's own first): written to the shared folder."""
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & _valid("vector"))
    sizes = sorted(((r["count"], r.d) for r in rows.groupBy(F.size("vector").alias("d")).count().collect()), reverse=True)
    centroids: dict[int, tuple[np.ndarray, int]] = {}
    for n, d in sizes[:8]:  # of other dimensions, which are odd rows, each is one list
        lists = min(max_lists, -(-n // list_rows))
        if lists > probes:
            drawn = rows.where((F.size("vector") == d) & (F.pmod(F.xxhash64("vector", F.lit(seed)), F.lit(1 << 30)) < min(1.0, sample / n) * (1 << 30)))
            drawn = np.array(drawn.select("vector").distinct().limit(2 * sample).toArrow()["vector"].to_pylist())
            drawn = _unit(np.ldexp(drawn, -np.frexp(np.abs(drawn).max(1, keepdims=True))[1]))
            found = _centroids(drawn, lists, seed)
            centroids[d] = found, max(probes, _probes(drawn, found, target))
    shared = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, scalar, near = [b""] * b.num_rows, np.zeros(b.num_rows), [[0]] * b.num_rows
            vs = [np.ldexp(v, -np.frexp(np.abs(v).max())[1]) for v in _matrix(b.column("vector"))]
            for d in {len(v) for v in vs}:
                at = [i for i, v in enumerate(vs) if len(v) == d]
                own = np.stack([vs[i] for i in at])
                codes, scalar[at] = encode(own, seed)
                if d in shared.value:
                    centres, many = shared.value[d]
                    told = np.argsort(-(_unit(own) @ centres.T), axis=1, kind="stable")[:, :many].tolist()
                    for i, x in zip(at, told):
                        near[i] = x
                for i, c in zip(at, codes):
                    code[i] = c.tobytes()
            columns = {"id": b.column("id"), "vector": pa.array(vs, pa.list_(pa.float64())), "code": pa.array(code, pa.binary()), "scalar": pa.array(scalar)}
            yield pa.RecordBatch.from_pydict(columns | {"probes": pa.array(near, pa.list_(pa.int32()))})

    return cut(rows.mapInArrow(run, f"id {kind}, vector array<double>, code binary, scalar double, probes array<int>"), "rabitq")


def _scan(k: int, seed: int, bits: int, epsilon: float):
    """k best of a part's vectors for each of its queries; the vectors of a part come before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, part = None, [], None
        for b in batches:
            cells = list(zip(*(b.column(c).to_pylist() for c in ("dim", "list", "part", "asks"))))
            edges = [0, *(i for i in range(1, len(cells)) if cells[i] != cells[i - 1]), len(cells)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                rows, d = b.slice(lo, hi - lo), cells[lo][0]
                if cells[lo][:3] != cell:
                    cell, held, part = cells[lo][:3], [], None
                ids = rows.column("id").to_numpy(zero_copy_only=False)
                vectors = np.stack(_matrix(rows.column("vector")))
                if not cells[lo][3]:
                    held.append((ids, vectors, np.stack([np.frombuffer(c, "<u8") for c in rows.column("code").to_pylist()]), rows.column("scalar").to_numpy()))
                    continue
                if not held and part is None:
                    continue
                if part is None:
                    part, held = [np.concatenate(x) for x in zip(*held)], []
                for at in range(0, len(ids), 256):
                    q = Queries(ids[at : at + 256], vectors[at : at + 256], seed, bits)
                    state = (q, np.full((len(q.ids), k), -np.inf), np.zeros((len(q.ids), k), ids.dtype))
                    for i in range(0, len(part[0]), _CHUNK):
                        _rerank(state, *(x[i : i + _CHUNK] for x in part), k, epsilon)
                    row, col = np.nonzero(state[1] > -np.inf)
                    if len(row):
                        yield pa.RecordBatch.from_pydict({"query_id": q.ids[row], "id": state[2][row, col], "score": state[1][row, col]})

    return trimmed(run)


def _rerank(state: tuple, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, scalars: np.ndarray, k: int, epsilon: float) -> None:
    """Exact cosines of the vectors whose upper bound reaches a query's k-th best; updates score and near in place."""
    q, score, near = state
    for lo in range(0, len(q.ids), 256):
        part = slice(lo, min(lo + 256, len(q.ids)))
        sub = Queries.__new__(Queries)
        sub.__dict__ = {n: ([p[part] for p in v] if n == "planes" else v[part]) for n, v in q.__dict__.items()}
        guess, bound = sub.estimate(codes, scalars, epsilon)
        guess[sub.ids[:, None] == ids[None, :]] = -np.inf
        m = min(k, guess.shape[1])
        # a first few by estimate, so that the bar is high before the bounds are compared
        first = np.argpartition(-guess, m - 1, axis=1)[:, :m]
        take = np.zeros(guess.shape, bool)
        np.put_along_axis(take, first, True, axis=1)
        take &= guess > -np.inf
        exact = np.full(guess.shape, -np.inf)
        for rest in (False, True):
            if rest:
                bar = np.sort(np.concatenate([score[part], np.take_along_axis(exact, first, 1)], 1), axis=1)[:, -k]
                take = (guess + bound >= bar[:, None]) & (guess > -np.inf) & (exact == -np.inf)
            row, col = np.nonzero(take)
            if len(row):
                exact[row, col] = cosines(sub.vectors, vectors, row, col)
        row, col = np.nonzero(exact > -np.inf)
        n = len(sub.ids)
        kept_row, kept_col = np.nonzero(score[part] > -np.inf)
        rows = np.concatenate([row, kept_row])
        names = np.concatenate([ids[col], near[part][kept_row, kept_col]])
        values = np.concatenate([exact[row, col], score[part][kept_row, kept_col]])
        order = np.lexsort((names, -values, rows))
        rows, names, values = rows[order], names[order], values[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, np.arange(n))[rows]
        best = place < k
        score[lo + rows[best], place[best]] = values[best]
        near[lo + rows[best], place[best]] = names[best]


def search(indexed: DataFrame, wanted: DataFrame, k: int = 5, seed: int = 5, query_bits: int = 6, epsilon: float = 3.5, part_bytes: int = 16 << 20) -> DataFrame:
    """query_id, rank, id, score: the k nearest of the indexed rows for each row of wanted (rows of an index)."""
    kind = indexed.schema["id"].dataType.simpleString()
    rows = indexed.select(F.size("vector").alias("dim"), F.col("probes")[0].alias("list"), "id", "vector", "code", "scalar")
    each = F.greatest(F.lit(1), F.lit(part_bytes) / (8 * F.col("dim")))
    cells = cut(rows.groupBy("dim", "list").agg(F.count("*").alias("n")).select("dim", "list", F.ceil(F.col("n") / each).cast("int").alias("m")), "rabitq-cells")
    large = F.broadcast(cells.where("m > 1"))  # at most a row for each centroid
    dealt = rows.join(large, ["dim", "list"], "left").withColumn("part", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.coalesce("m", F.lit(1))).cast("int")).drop("m")
    asked = wanted.groupBy("id").agg(F.min(F.struct("vector", "probes")).alias("q")).select("id", "q.*")
    asked = asked.select("id", "vector", F.size("vector").alias("dim"), F.explode("probes").alias("list")).join(F.broadcast(cells), ["dim", "list"])
    asked = asked.select("dim", "list", "id", "vector", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("part"), F.lit(True).alias("asks"))
    both = dealt.withColumn("asks", F.lit(False)).unionByName(asked, allowMissingColumns=True)
    spread = int(indexed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(spread, "dim", "list", "part").sortWithinPartitions("dim", "list", "part", "asks")
    found = both.mapInArrow(_scan(k, seed, query_bits, epsilon), f"query_id {kind}, id {kind}, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
