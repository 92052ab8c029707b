"""Mixing of sources to target weights by a low-discrepancy schedule of equal-token blocks.

Targets. Sources in code point order, null last, have the weights of a repeating cycle and share a multiple of all words
by them. A target stops at ``most`` times its source's words; the excess is reshared by weight until none is above,
which is the level at which sources without such a stop all get level * weight.

Blocks. A source's documents lie on a line in the order of a digest of their ids, so neighbours have nothing in common;
the line is cut into blocks of ``block`` words, the last of which may be shorter. The n-th time round, whole blocks come
in the order of multiples of a prime, a different one each time; the short one comes last.

Schedule. Of the N slots each source needs as many as cover its target. The van der Corput point of slot i, the bits of
i mirrored, falls into the interval of one source in the cumulative weights, so any run of slots holds all sources in
their shares. As mirrored bits are a permutation, an interval is a range of integers: a source's slots are generated from
its own range and no slot looks for its source. Slots of a source are ranked; slot and block are joined by rank. A
source's share of points is off by a few: what is above its need is left out, what is missing comes behind the others.
The last slot of each round ends where the target ends, so a source's words are its target, rounded.

Only ids and word counts are moved, never texts. Running sums are taken in ranges: each task adds up its own rows, and
one row a task is added up over tasks.

Defined results: null text has no words; documents without words are in no slot and have taken 0; a null source is one
source, apart from the empty one; null and repeated ids are documents of their own, and equal rows share what is taken of
them in any order; a table without words has targets of 0, an empty one no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from provena.llm.text import trimmed
from provena.session import cut, scratch

CYCLE, SHARE, MOST, BLOCK = (5, 2, 1), 1.5, 2, 1024
#: Strides of the first and the second time round; of each, the first that does not divide the number of blocks is used.
PRIMES = ((1000003, 1000033, 1000037), (1000039, 1000081, 1000099))
#: Slots that are generated from one row.
_RUN = 1 << 16


def word_count(text: Column) -> Column:
    """Number of words between U+0020 and U+0009-U+000D: each becomes one letter, so no list of words is built."""
    blank = r"\x20\x09-\x0D"
    trimmed_text = F.regexp_replace(text, rf"\A[{blank}]++", "")
    return F.coalesce(F.length(F.regexp_replace(trimmed_text, rf"[^{blank}]++[{blank}]*+", "x")), F.lit(0)).cast("long")


def _local_sums(values: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, sums = TaskContext.get().partitionId(), 0, dict.fromkeys(values, 0)
        for batch in batches:
            n = batch.num_rows
            out = batch.append_column("part", pa.array(np.full(n, part), pa.int64())).append_column("nr", pa.array(np.arange(at, at + n), pa.int64()))
            for v in values:
                own = batch.column(v).to_numpy(zero_copy_only=False)
                total = np.cumsum(own) + sums[v]
                out = out.append_column(f"before_{v}", pa.array(total - own, pa.int64()))
                sums[v] = int(total[-1]) if n else sums[v]
            at += n
            yield out

    return trimmed(run)


def running(df: DataFrame, order: Sequence[Column], values: Sequence[str], name: str) -> DataFrame:
    """df as a table with ``part`` and ``nr``, which number its rows in order, and before_<value>, sums over all rows before."""
    schema = StructType([*df.schema.fields, *[StructField(c, LongType()) for c in ("part", "nr", *[f"before_{v}" for v in values])]])
    told = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_local_sums(values), schema), name)
    ends = told.groupBy("part").agg(*[F.sum(v).alias(v) for v in values])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row a task
    ahead = ends.select("part", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"ahead_{v}") for v in values])
    told = told.join(F.broadcast(ahead), "part")
    return told.withColumns({f"before_{v}": F.col(f"before_{v}") + F.col(f"ahead_{v}") for v in values}).drop(*[f"ahead_{v}" for v in values])


def targets(sizes: DataFrame, cycle: Sequence[int] = CYCLE, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes with ``sid`` (place in code point order), ``weight`` and ``target``. sizes: source, source_size, a row a source."""
    ranked = running(sizes.withColumn("one", F.lit(1).cast("long")), [F.asc_nulls_last("source")], ["one"], "sources").withColumnRenamed("before_one", "sid")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in cycle]), (F.col("sid") % len(cycle) + 1).cast("int"))
    told = ranked.drop("one", "part", "nr").withColumn("weight", weight).withColumn("top", F.col("source_size") * most)
    filled = running(told, [F.col("top") / F.col("weight"), F.col("sid")], ["top", "weight"], "levels").drop("part", "nr")
    all_of = filled.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    if not all_of["size"]:
        return filled.withColumn("target", F.lit(0.0)).drop("top", "before_top", "before_weight")
    level = (F.lit(share * all_of["size"]) - F.col("before_top")) / (F.lit(all_of["weight"]) - F.col("before_weight"))
    # sources stop in the order of top / weight; the level rises as long as they do
    at = filled.orderBy(level.desc()).select("before_top", "before_weight").first()
    own = F.lit(share * all_of["size"] - at["before_top"]) * F.col("weight") / F.lit(all_of["weight"] - at["before_weight"])
    return filled.withColumn("target", F.least(F.col("top").cast("double"), own)).drop("top", "before_top", "before_weight")


def _block_of(place: Column, whole: Column, primes: Sequence[int]) -> Column:
    stride = F.lit(primes[-1])
    for p in reversed(primes[:-1]):
        stride = F.when(whole % p != 0, F.lit(p)).otherwise(stride)
    return F.when(place < whole, place * stride % F.greatest(whole, F.lit(1))).otherwise(whole)


def schedule(plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, sid, round, block, words: which words of which block every slot takes, from the block's first on.

    plan, a table: sid, source_size, words (the target, rounded), slots_1, slots_2 (slots needed in each round), before_slots.
    """
    n = plan.agg(F.sum(F.col("slots_1") + F.col("slots_2")).alias("n"), F.count("*").alias("sources")).first()
    total, sources = n["n"] or 0, n["sources"]
    bits = max(1, (total - 1).bit_length())
    edge = lambda c: F.expr(f"CAST({c} AS DECIMAL(20, 0)) * {1 << bits} DIV {max(total, 1)}")
    ranges = plan.select("sid", edge("before_slots").alias("low"), edge("(before_slots + slots_1 + slots_2)").alias("high")).where("high > low")
    runs = ranges.select("sid", "low", "high", F.explode(F.expr(f"sequence(low DIV {_RUN}, (high - 1) DIV {_RUN})")).alias("run")).repartition("sid", "run")
    points = runs.select("sid", F.explode(F.expr(f"sequence(greatest(low, run * {_RUN}), least(high, (run + 1) * {_RUN}) - 1)")).alias("point"))
    slots = points.select("sid", F.conv(F.reverse(F.lpad(F.bin("point"), bits, "0")), 2, 10).cast("long").alias("slot")).where(F.col("slot") < total)
    ranked = running(slots.withColumn("one", F.lit(1).cast("long")), [F.col("sid"), F.col("slot")], ["one"], "slots")
    own = ranked.groupBy("sid").agg(F.min("before_one").alias("first"), F.count("*").alias("got"))
    known = plan.join(own, "sid", "left").withColumns({"got": F.coalesce("got", F.lit(0)), "slots": F.col("slots_1") + F.col("slots_2")})
    # the numbers behind the others' follow the missing slots' ranks, then the sources
    late = known.where("got < slots").withColumn("rank", F.explode(F.expr("sequence(got, slots - 1)")))
    late = late.withColumn("slot", F.lit(total) + (F.col("rank") - F.col("got")) * sources + F.col("sid"))
    timely = ranked.select("sid", "slot", "before_one").join(known, "sid").withColumn("rank", F.col("before_one") - F.col("first")).where("rank < slots")
    names = ["slot", "sid", "rank", "slots_1", "source_size", "words"]
    told = timely.select(*names).unionByName(late.select(*names))
    again = F.col("rank") >= F.col("slots_1")
    place = F.when(again, F.col("rank") - F.col("slots_1")).otherwise(F.col("rank"))
    end = F.when(again, F.col("words") - F.col("source_size")).otherwise(F.least("words", "source_size"))
    whole = F.expr(f"source_size DIV {block}")
    at = F.when(again, _block_of(place, whole, PRIMES[1])).otherwise(_block_of(place, whole, PRIMES[0]))
    return told.select("slot", "sid", again.cast("int").alias("round"), at.alias("block"), F.least(F.lit(block), end - place * block).alias("words"))


def mix(docs: DataFrame, cycle: Sequence[int] = CYCLE, share: float = SHARE, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(pieces, lines), both tables.

    pieces: slot, offset (words before it there), part, nr, doc_id, start (in the document), length, round: slots in their
    order are the mix. lines: part, nr, doc_id, size, source, source_size, target: a row a document. docs: doc_id, text, source.
    """
    own = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("row"))
    own = own.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    line = running(own, [F.asc_nulls_last("source"), *map(F.col, ("key", "size", "row"))], ["size"], "lines").drop("key", "row")
    sizes = line.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("before_size").alias("begin"))
    plan = targets(sizes, cycle, share, MOST).withColumn("words", F.round("target").cast("long"))
    ceil = lambda x: F.expr(f"({x} + {block - 1}) DIV {block}")
    plan = plan.withColumns({"slots_1": ceil("least(words, source_size)"), "slots_2": ceil("greatest(words - source_size, 0)")})
    plan = running(plan.withColumn("slots", F.col("slots_1") + F.col("slots_2")), [F.col("sid")], ["slots"], "plan").drop("part", "nr")
    plan = cut(plan, "plan")
    placed = line.join(plan.select(F.col("source").alias("_s"), "sid", "begin", "source_size", "target"), F.col("source").eqNullSafe(F.col("_s")))
    placed = cut(placed.select("part", "nr", "doc_id", "size", "source", "sid", "source_size", "target", (F.col("before_size") - F.col("begin")).alias("at")), "placed")
    cuts = placed.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(at DIV {block}, (at + size - 1) DIV {block})")))
    cuts = cuts.select(
        "part", "nr", "doc_id", "sid", "block", F.expr(f"greatest(at - block * {block}, 0)").alias("low"),
        F.expr(f"least(at + size - block * {block}, {block})").alias("high"), F.expr(f"greatest(block * {block} - at, 0)").alias("start"),
    )
    met = schedule(plan, block).join(cuts, ["sid", "block"]).withColumn("length", F.least("high", "words") - F.col("low")).where("length > 0")
    return met.select("slot", F.col("low").alias("offset"), "part", "nr", "doc_id", "start", "length", "round"), placed.drop("at", "sid")


def taken(docs: DataFrame, cycle: Sequence[int] = CYCLE, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source, source_size, target, taken (words that the mix takes, repeats counted) of every document."""
    with scratch() as keep:
        pieces, lines = mix(docs, cycle, share, block)
        sums = pieces.groupBy("part", "nr").agg(F.sum("length").alias("taken"))
        told = lines.join(sums, ["part", "nr"], "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
        return keep(cut(told.drop("part", "nr"), "taken"))
