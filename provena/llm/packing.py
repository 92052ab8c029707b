"""Mixture-controlled packing of token sequences by deficit round-robin.

Documents are tokenized once and dealt by a hash of id, text and the row's number, so that not even equal rows share a
shard, into shards of about ``shard_tokens`` tokens, which keeps every source, however hot, spread over all shards. In a
shard each source is a queue. Each window of ``window`` sequences credits every queue its target share of the window and serves the
queues in turn as far as their credit goes; what a queue is owed or has had too much of is carried to the next window,
and from shard to shard: because a shard packs all it holds, the deficits at a shard's start follow from the token
counts of the shards before it, so shards are packed in parallel. When the queues with credit are empty the others
overdraw, least overdrawn first, until the shard is packed: no token is dropped.

The targets are token shares by source: given, or the shares of the whole table. Given targets can be met only as long as
every source lasts: of each source as many tokens as the scarcest one allows are dealt to the first shards, whose windows
all have the targets; the rest, and sources without a target, follow in shards of their own, mixed by what they hold.

Sequences are consecutive cuts of a shard's stream, all full; what remains at a shard's end is cut at powers of two,
largest first, so nothing is padded.

Defined results: null text is empty and yields the end id alone; null sources are one source, apart from the empty one;
targets of zero or less, or for sources that hold nothing, are as if not given; null ids are kept;
repeated rows are packed one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heapreplace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provena.llm.text import trimmed
from provena.session import cut

END_ID = 1
assert sys.byteorder == "little" and array("I").itemsize == 4
#: Entries that chunks may fill, and words behind them.
_CHUNKS, _CACHE = 300_000, 500_000
_tokenizers: dict[str, object] = {}


#: Blanks of str.split() that the tokenizer reads as text.
_SEPARATORS = "\x1c\x1d\x1e\x1f"


def blank_chunks(text: str) -> list[str]:
    """Chunks between the Unicode white space that the tokenizer drops."""
    if any(map(text.count, _SEPARATORS)):
        return [c for c in re.split(r"[^\S\x1c-\x1f]+", text) if c]
    return text.split()


#: Byte-level alphabets show a byte as its Latin-1 character where that prints, else as the next one from U+0100 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_BYTE_LEVEL = {b: 256 + k for k, b in enumerate(_HIDDEN)}

#: Latin letters whose lower case is one letter, then punctuation.
_PUNCTUATED = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?)]*)")


class WordCache:
    """Token ids of a text from those of its blank-separated chunks.

    The tokenizer drops white space and never merges across it, so a text's ids are its chunks' ids in turn. Chunks
    repeat, so most come from a cache; it is bounded by its number of entries, and full it stays as it is: frequent
    chunks come early. A chunk that is not there is often a known word with other case or with punctuation behind it,
    whose ids follow from the word's: the tokenizer lower-cases, and a run of punctuation is a unit of its own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path)
        self.model = self.encode.model
        self.cache: dict[str, bytes] = {}

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        chunks = blank_chunks(text or "")
        parts = list(map(self.cache.get, chunks))
        if None in parts:
            at = [i for i, p in enumerate(parts) if p is None]
            for i, ids in zip(at, self._new([chunks[i] for i in at])):
                parts[i] = ids
        return b"".join(parts)

    def _new(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that the cache does not hold as they are."""
        split = list(map(_PUNCTUATED.fullmatch, chunks))
        words = [m[1].lower() if m else c for c, m in zip(chunks, split)]
        tails = [m[2] if m else "" for m in split]
        own: dict[str, bytes] = {}
        wanted = {w for w in words if w not in self.cache} | {t for t in tails if t and t not in self.cache}
        # such a word is one unit for the merges, whatever normalisation and splitting do elsewhere
        for w in {w for w, m in zip(words, split) if m} & wanted:
            own[w] = array("I", [t.id for t in self.model.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_LEVEL))]).tobytes()
        wanted -= own.keys()
        if wanted:
            todo = list(wanted)
            for w, e in zip(todo, self.encode.encode_batch_fast(todo, add_special_tokens=False)):
                own[w] = array("I", e.ids).tobytes()
            if len(self.cache) < _CACHE:
                self.cache.update(own)
        get = lambda w: own[w] if w in own else self.cache[w]
        out = [get(w) + get(t) if t else get(w) for w, t in zip(words, tails)]
        if len(self.cache) < _CHUNKS:
            self.cache.update(zip(chunks, out))
        return out


def _tokenize(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in _tokenizers:
            _tokenizers[path] = WordCache(path)
        ids, end = _tokenizers[path].ids, np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            tokens = [ids(t) + end for t in batch.column("text").to_pylist()]
            # 16 bits are enough for the ids of small vocabularies; the byte width is kept in the column
            narrow = [np.frombuffer(t, "<u4") for t in tokens]
            small = all(int(x.max()) < 1 << 16 for x in narrow) if narrow else True
            data = [x.astype("<u2").tobytes() for x in narrow] if small else tokens
            columns = {c: batch.column(c) for c in ("id", "source", "deal")}
            columns |= {"ids": pa.array(data, pa.binary()), "width": pa.array([2 if small else 4] * len(data), pa.int32()), "n": pa.array([len(x) for x in narrow], pa.int64())}
            yield pa.RecordBatch.from_pydict(columns)

    return trimmed(run)


def fill(sizes: dict[str, list[int]], credit: dict[str, float], share: dict[str, float], length: int, window: int) -> list[tuple[str, int, int, int]]:
    """The shard's stream as (source, document number in its queue, start, length), by deficit round-robin.

    credit: tokens each source is owed at the start; it is changed to what is owed at the end.
    """
    stream = []
    head = dict.fromkeys(sizes, 0)
    done = dict.fromkeys(sizes, 0)
    left = {s: sum(x) for s, x in sizes.items()}
    order = sorted(s for s in sizes if left[s])
    rank = {s: i for i, s in enumerate(order)}
    total = sum(left.values())

    def serve(s: str, most: int) -> int:
        given = 0
        while given < most and left[s] > 0:
            i, start = head[s], done[s]
            n = min(most - given, sizes[s][i] - start)
            last = stream[-1] if stream else None
            if last and last[:2] == (s, i) and last[2] + last[3] == start:
                stream[-1] = (s, i, last[2], last[3] + n)
            else:
                stream.append((s, i, start, n))
            given += n
            left[s] -= n
            done[s] += n
            if done[s] == sizes[s][i]:
                head[s], done[s] = i + 1, 0
        credit[s] = credit.get(s, 0.0) - given
        return given

    while total:
        space = min(window * length, total)
        total -= space
        for s, x in share.items():
            credit[s] = credit.get(s, 0.0) + x * space
        order = [s for s in order if left[s]]
        for s in order:
            space -= serve(s, min(space, int(credit.get(s, 0.0)))) if credit.get(s, 0.0) >= 1 else 0
        if space:  # queues with credit are empty: the others overdraw, least overdrawn first
            most = [(-credit.get(s, 0.0), -rank[s], s) for s in order if left[s]]
            heapify(most)
            while space:
                s = most[0][2]
                space -= serve(s, min(space, max(1, int(share.get(s, 0.0) * window * length))))
                if left[s]:
                    heapreplace(most, (-credit[s], -rank[s], s))
                else:
                    heappop(most)
        order = order[1:] + order[:1]
    return stream


def sequence_cuts(total: int, length: int) -> np.ndarray:
    """Starts of the sequences of a stream, and its end: full ones, then powers of two."""
    ends = list(range(0, total - total % length + 1, length))
    rest = total % length
    while rest:
        n = 1 << (rest.bit_length() - 1)
        ends.append(ends[-1] + n)
        rest -= n
    return np.array(ends, np.int64)


def _pack(length: int, window: int):
    def run(group: pa.Table) -> pa.Table:
        is_doc = group["ids"].is_valid()
        plan = group.filter(pc.invert(is_doc)).select(["source", "share", "credit", "first_sequence"]).to_pylist()
        docs = group.filter(is_doc).sort_by([("deal", "ascending"), ("id", "ascending")])
        first = plan[0]["first_sequence"]
        share = {r["source"]: r["share"] for r in plan}
        credit = {r["source"]: r["credit"] for r in plan}
        n, width, ids, source = (docs[c].to_pylist() for c in ("n", "width", "ids", "source"))
        rows: dict[str, list[int]] = {}
        for i, s in enumerate(source):
            rows.setdefault(s, []).append(i)
        stream = fill({s: [n[i] for i in x] for s, x in rows.items()}, credit, share, length, window)
        cuts = sequence_cuts(sum(n), length).tolist()
        out: list[tuple] = []
        at, seq = 0, 0
        for s, i, start, size in stream:
            row = rows[s][i]
            tokens = np.frombuffer(ids[row], f"<u{width[row]}")
            while size:
                m = min(size, cuts[seq + 1] - at)
                out.append((row, start, m, zlib.crc32(tokens[start : start + m].astype("<u4").tobytes()), first + seq, at - cuts[seq]))
                start, size, at = start + m, size - m, at + m
                seq += at == cuts[seq + 1]
        row, *rest = ([x[k] for x in out] for k in range(6))
        picked = docs.select(["id", "source", "n"]).take(pa.array(row, pa.int64()))
        pieces = dict(zip(("start", "length", "ids_crc32", "sequence_id", "offset"), (pa.array(x, pa.int64()) for x in rest)))
        pieces |= {"id": picked["id"], "source": picked["source"], "doc_tokens": picked["n"]}
        return pa.table({c: pieces[c] for c in ("id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")})

    return run


def running(df: DataFrame, by: list[str], order: str, block: int = 1024, **sums) -> DataFrame:
    """df with sums over the rows before each one in its group, in two steps: within blocks of the order, and over their totals.

    order: a column of whole numbers from 0, each once in a group. No task gets more than a block, or the blocks, of a group.
    """
    told = df.withColumn("_block", F.floor(F.col(order) / block))
    totals = told.groupBy(*by, "_block").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    over = (Window.partitionBy(*by) if by else Window).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_block", *[F.coalesce(F.sum(f"_{n}").over(over), F.lit(0)).alias(f"_{n}") for n in sums])
    inside = Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    told = told.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}).join(totals, [*by, "_block"])
    return told.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_block", *[f"_{n}" for n in sums])


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", targets: dict[str | None, float] | None = None, length: int = 2048, window: int = 64, shard_tokens: int = 1 << 21
) -> DataFrame:
    """A row for each piece: id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    # inside, a source is "=" and its name, so that a null one, which is empty, is not the empty name
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), source.alias("source"), F.col(text_col).alias("text"))
    rows = rows.withColumn("deal", F.xxhash64("id", "text", F.monotonically_increasing_id()))
    tokens = cut(rows.mapInArrow(_tokenize(tokenizer), f"id {kind}, source string, deal long, ids binary, width int, n long"), "pack-tokens")

    # part 0 has the targets, part 1 is what is left; share: of a source in a part, taken: of its tokens that go to part 0
    held = tokens.groupBy("source").agg(F.sum("n").alias("n"))
    if targets is None:
        tokens = tokens.withColumn("part", F.lit(0))
    else:
        wanted = spark.createDataFrame([("" if x is None else f"={x}", float(y)) for x, y in targets.items() if y > 0], "source string, target double")
        wanted = wanted.join(held, "source")
        least = wanted.agg(F.coalesce(F.sum("target"), F.lit(1.0)).alias("all"), F.min(F.col("n") / F.col("target")).alias("room")).first()
        wanted = cut(wanted.select("source", (F.col("target") / least["all"]).alias("target"), F.least(F.lit(1.0), F.col("target") * (least["room"] or 0.0) / F.col("n")).alias("taken")), "pack-targets")
        # another hash than the one that deals shards: the first part has its share of every shard
        chance = F.pmod(F.xxhash64("deal"), F.lit(1 << 40)) / float(1 << 40)
        tokens = tokens.join(wanted.select("source", "taken"), "source", "left").withColumn("part", F.when(chance < F.coalesce("taken", F.lit(0.0)), 0).otherwise(1)).drop("taken")
    total = {r["part"]: r["n"] for r in tokens.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    shards = {p: max(1, -(-n // shard_tokens)) for p, n in total.items()}
    first = F.when(F.col("part") == 0, F.lit(0)).otherwise(F.lit(shards.get(0, 0)))
    tokens = tokens.withColumn("shard", first + F.pmod("deal", F.when(F.col("part") == 0, F.lit(shards.get(0, 1))).otherwise(F.lit(shards.get(1, 1)))))
    counts = cut(tokens.groupBy("part", "shard", "source").agg(F.sum("n").alias("n")), "pack-counts")

    # as many sources as there are: their shares stay a table
    scale = F.when(F.col("part") == 0, F.lit(float(total.get(0, 1)))).otherwise(F.lit(float(total.get(1, 1))))
    shares = counts.groupBy("part", "source").agg((F.sum("n") / F.first(scale)).alias("share"))
    if targets is not None:
        shares = shares.join(wanted.select("source", "target"), "source", "left").select("part", "source", F.when(F.col("part") == 0, F.col("target")).otherwise(F.col("share")).alias("share"))
    sequences = F.floor(F.col("size") / length) + F.bit_count(F.col("size") % length)
    sizes = counts.groupBy("part", "shard").agg(F.sum("n").alias("size"))
    sizes = running(sizes, [], "shard", first_sequence=sequences, tokens_before=F.col("size"))
    sizes = sizes.withColumn("tokens_before", F.col("tokens_before") - F.when(F.col("part") == 0, F.lit(0)).otherwise(F.lit(total.get(0, 0)))).drop("size", "part")
    # a row for every source that a shard holds; what a source is owed follows from the shards before that hold it
    plan = running(counts, ["part", "source"], "shard", served=F.col("n")).join(shares, ["part", "source"]).join(sizes, "shard")
    credit = F.col("share") * F.col("tokens_before") - F.col("served")
    plan = plan.select("shard", "source", "share", credit.cast("double").alias("credit"), "first_sequence")
    out = f"id {kind}, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    both = tokens.select("shard", "id", "source", "deal", "ids", "width", "n").unionByName(plan, allowMissingColumns=True)
    packed = both.groupBy("shard").applyInArrow(_pack(length, window), out)
    return packed.withColumnRenamed("id", id_col).withColumn("source", F.when(F.col("source") != "", F.substring("source", 2, 1 << 30)))
