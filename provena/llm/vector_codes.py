"""Vector code compression: product quantization in integers, codes found by partial-distance search.

A vector's components become integers floor(scale * x) and it is cut into equal consecutive parts. Every part position
has a codebook of a few entries, which starts as that part of the rows with the smallest ids and is moved to the means
of its parts in a fixed number of rounds; a part's code is the index of its nearest entry. All arithmetic is on integers,
so results do not depend on how rows are dealt out.

Partial-distance search: one entry, the nearest in the dimension in which the codebook varies most, gets its complete
distance first; then dimensions are processed in descending codebook variance, and a mask drops every (part, entry) whose
accumulated distance strictly exceeds that best complete one. Entries at the same distance survive, so ties can go to
the lower index.

A round is one pass of Arrow batches; a task returns the sums of its parts by entry, and Spark adds them up. Only the
codebooks, whose size depends on the vectors' length alone, come to the driver and go out with the tasks.

Defined results: rows whose vector is null, empty or holds a null or non-finite component are dropped. Vectors of several
lengths: only those of the most frequent length count (the longer one on ties). A length that the number of parts does
not divide is filled up with zeros behind. Integers are held within +-2**62, and distances and sums of them within
2**63 - 1. Null ids come last; repeated rows count as often as they occur, also among the first entries, where equal ids
are ordered by their vectors; of equal entries the first is used and the others stay. Fewer rows than entries give
smaller codebooks; an empty table gives no rows and empty codebooks. Other columns are ignored unless asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from provena.llm.text import trimmed
from provena.session import cut, fresh

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Bounds of integers and of longs.
LIMIT, LONGEST = 1 << 62, (1 << 63) - 1
_LOW = (1 << 31) - 1
#: Rows that are searched at once.
_BLOCK = 4096


@dataclass(frozen=True)
class Codebooks:
    """entries[part] is a matrix of entries by components; length is the vectors' own."""

    length: int
    entries: tuple[np.ndarray, ...]
    scale: int = SCALE

    def sha256(self) -> str:
        """Digest of all components in decimal by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for book in self.entries for x in book.ravel().tolist()).encode()).hexdigest()


def integers(vectors: pa.Array, scale: int, length: int | None = None, parts: int = PARTS) -> tuple[np.ndarray, np.ndarray]:
    """(rows kept, their integers): all rows kept must have one length, or the one given, and are filled up to whole parts."""
    offsets = vectors.offsets.to_numpy()
    sizes = np.diff(offsets)
    flat = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    sound = vectors.is_valid().to_numpy(zero_copy_only=False) & (sizes > 0) & (wrong[offsets[1:]] == wrong[offsets[:-1]])
    rows = np.flatnonzero(sound if length is None else sound & (sizes == length))
    if length is None or not len(rows):
        return rows, np.empty((0, -(-(length or 0) // parts) * parts), np.int64)
    x = np.floor(np.clip(scale * flat[offsets[rows][:, None] + np.arange(length)], -float(LIMIT), float(LIMIT)))
    out = np.zeros((len(rows), -(-length // parts) * parts), np.int64)
    out[:, :length] = x.astype(np.int64)
    return rows, out


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry, the lower index on ties, by partial-distance search."""
    n, dims = part.shape
    if not n or not dims:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    most = max(abs(int(x)) for x in (part.min(), part.max(), book.min(), book.max()))
    if 4 * most * most * dims > LONGEST:  # no machine integer holds such distances
        part, book = part.astype(object), book.astype(object)
    spread = ((book - book.mean(0)).astype(float) ** 2).sum(0)
    order = np.argsort(-spread, kind="stable")
    first = (part[:, order[0], None] - book[None, :, order[0]]) ** 2
    best = ((part - book[first.argmin(1)]) ** 2).sum(1)  # complete
    row, entry = np.nonzero(first <= best[:, None])
    so_far = first[row, entry]
    for d in order[1:]:
        so_far = so_far + (part[row, d] - book[entry, d]) ** 2
        stays = so_far <= best[row]
        if not stays.all():
            row, entry, so_far = row[stays], entry[stays], so_far[stays]
    # every row still has the entry whose distance is complete, and its entries are in ascending order
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    least = np.minimum.reduceat(so_far, starts)
    hit = np.flatnonzero(so_far == least[row])
    _, at = np.unique(row[hit], return_index=True)
    return entry[hit[at]], least


def _pieces(batch: pa.RecordBatch, column: str, books: Codebooks) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    rows, matrix = integers(batch.column(column), books.scale, books.length, len(books.entries))
    for i in range(0, len(rows), _BLOCK):
        yield rows[i : i + _BLOCK], matrix[i : i + _BLOCK]


def _sums(books: Codebooks, column: str):
    """A row for every part, entry and dimension that a task has met: count and sum in two limbs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = (len(books.entries), *books.entries[0].shape)
        count, high, low = np.zeros(shape[:2], np.int64), np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        for batch in batches:
            for _, matrix in _pieces(batch, column, books):
                for p, (part, book) in enumerate(zip(np.split(matrix, shape[0], axis=1), books.entries)):
                    code, _ = nearest(part, book)
                    count[p] += np.bincount(code, minlength=shape[1])
                    for e in np.unique(code):
                        mine = part[code == e]
                        high[p, e] += (mine >> 31).sum(0)
                        low[p, e] += (mine & _LOW).sum(0)
        p, e, d = (x.ravel() for x in np.indices(shape))
        met = np.repeat(count.ravel(), shape[2])
        keep = met > 0
        columns = {"part": p, "entry": e, "dim": d, "n": met, "high": high.ravel(), "low": low.ravel()}
        yield pa.RecordBatch.from_pydict({k: pa.array(v[keep], pa.int64()) for k, v in columns.items()})

    return trimmed(run)


def _kept(column: str, scale: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, matrix = integers(batch.column(column), scale, length, 1)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id").take(pa.array(rows)), "q": pa.array(list(matrix), pa.list_(pa.int64()))})

    return trimmed(run)


def _lengths(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(column)
            rows, _ = integers(vectors, 1)
            size, n = np.unique(np.diff(vectors.offsets.to_numpy())[rows], return_counts=True)
            yield pa.RecordBatch.from_pydict({"size": pa.array(size, pa.int64()), "n": pa.array(n, pa.int64())})

    return trimmed(run)


def fit(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks of all vectors of df: a pass for the lengths, one for the first entries, one for every round."""
    own = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector}`").alias("v"))
    sizes = own.select("v").mapInArrow(_lengths("v"), "size long, n long").groupBy("size").agg(F.sum("n").alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not most:
        return Codebooks(0, (), scale)
    length = most[0]["size"]
    schema = StructType([StructField("id", own.schema["id"].dataType)])
    schema.add("q", ArrayType(LongType()))
    first = own.mapInArrow(_kept("v", scale, length), schema).orderBy(F.asc_nulls_last("id"), "q").limit(entries).collect()  # takes the first of every task
    width = -(-length // parts)
    start = np.zeros((len(first), width * parts), np.int64)
    start[:, :length] = [r["q"] for r in first]
    books = Codebooks(length, tuple(np.split(start, parts, axis=1)), scale)
    for _ in range(rounds):
        told = own.select("v").mapInArrow(_sums(books, "v"), "part long, entry long, dim long, n long, high long, low long")
        wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]
        moved = [b.copy() for b in books.entries]
        for r in told.groupBy("part", "entry", "dim").agg(*wide).collect():  # as many rows as the codebooks have components
            moved[r["part"]][r["entry"], r["dim"]] = ((int(r["high"]) << 31) + int(r["low"])) // int(r["n"])
        books = Codebooks(length, tuple(moved), scale)
    return books


def _encode(books: Codebooks, column: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in _pieces(batch, column, books):
                found = [nearest(part, book) for part, book in zip(np.split(matrix, len(books.entries), axis=1), books.entries)]
                code = np.stack([c for c, _ in found], axis=1).tolist()
                error = [min(sum(x), LONGEST) for x in zip(*(d.tolist() for _, d in found))]
                take = pa.array(rows)
                columns = [batch.column(c).take(take) for c in names if c not in ("code", "error")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(code, pa.list_(pa.int32())), pa.array(error, pa.int64())], names=names)

    return trimmed(run)


def encode(df: DataFrame, books: Codebooks, vector: str = "embedding") -> DataFrame:
    """The rows kept, without their vector, with ``code`` (array<int>, an index a part) and ``error`` (long)."""
    rest = [f for f in df.schema.fields if f.name not in (vector, "code", "error")]
    schema = StructType([StructField(f.name, f.dataType) for f in rest]).add("code", ArrayType(IntegerType())).add("error", LongType())
    own = fresh(df.select(*[F.col(f"`{f.name}`") for f in rest]), "v")
    told = df.select(*[F.col(f"`{f.name}`") for f in rest], F.col(f"`{vector}`").alias(own))
    if not books.entries:
        return told.drop(own).where("false").withColumns({"code": F.array().cast("array<int>"), "error": F.lit(0).cast("long")})
    return told.mapInArrow(_encode(books, own, schema.names), schema)


def decode(code: list[int], books: Codebooks) -> list[float]:
    """The vector that a code stands for: the middle of what its integers were rounded from."""
    return [(int(x) + 0.5) / books.scale for p, c in enumerate(code) for x in books.entries[p][c]][: books.length]


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """coded, a table, with ``label_error``: errors added up over equal labels, nulls together."""
    held = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    total = coded.groupBy(F.col(f"`{label}`").alias("_of")).agg(held.alias("label_error"))
    return coded.join(total, coded[f"`{label}`"].eqNullSafe(F.col("_of"))).drop("_of")


def compress(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, Codebooks]:
    """(id, label, code, error, label_error of every kept row, codebooks)."""
    own = df.select(*[F.col(f"`{c}`") for c in (id_column, label, vector)])
    books = fit(own, id_column, vector)
    return with_label_error(cut(encode(own, books, vector), "codes"), label), books
