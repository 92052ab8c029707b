"""Commit graphs: which commits descend from others, in rounds that do not follow the length of a history.

A graph is cut into chains: a commit continues its first parent's chain if it is the first child that has it as first
parent. What descends from a commit is an end of every chain that it reaches, so the descendants of an event are one
number for each chain, the first place reached. Places in chains come by pointer doubling, in as many rounds as the longest
chain's length has bits. Events then go from chain to chain along the edges between chains; a round only carries places that
became smaller, so there are as many rounds as a path changes chains, which merges, not commits, decide.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provena.session import cut, remove

#: Steps of a round up to this many rows are sent to the places that are known; more meet them by exchange.
FEW = 200_000
#: Places that share a key when releases meet stretches, so that one long chain is not one group.
BLOCK = 64


def chains(edges: DataFrame, told: Callable[[str], None] = lambda what: None) -> DataFrame:
    """commit, chain (its first commit), place (from 0), a table.

    edges: commit, parent, and number (of the parent; without it the smallest parent is the first). Commits on a cycle,
    which no history has, and all that only they lead to, are left out.
    """
    number = F.col("number") if "number" in edges.columns else F.lit(0)
    edges = edges.where("commit is not null and parent is not null")
    first = edges.groupBy("commit").agg(F.min(F.struct(number.alias("n"), "parent")).alias("p")).select("commit", F.col("p.parent").alias("parent"))
    next_of = first.groupBy("parent").agg(F.min("commit").alias("commit")).select("commit", F.col("parent").alias("top"))
    every = edges.select("commit").union(edges.select("parent")).distinct()
    n = every.count()
    state = cut(every.join(next_of, "commit", "left").select("commit", F.coalesce("top", "commit").alias("top"), F.when(F.col("top").isNull(), 0).otherwise(1).cast("long").alias("place")), "chains")
    for _ in range(max(n, 1).bit_length() + 1):
        told("double")
        # a top that is nobody's next has itself as top and place 0
        up = state.select(F.col("commit").alias("top"), F.col("top").alias("far"), F.col("place").alias("more"))
        moved = cut(state.join(up, "top").select("commit", F.col("far").alias("top"), (F.col("place") + F.col("more")).alias("place"), (F.col("more") > 0).alias("moved")), "chains")
        remove(state)
        state = moved
        if state.where("moved").isEmpty():
            break
    roots = state.where("place = 0").select(F.col("commit").alias("top"))
    out = cut(state.join(roots, "top", "left_semi").select("commit", F.col("top").alias("chain"), "place"), "chains")
    remove(state)
    return out


def reached(edges: DataFrame, placed: DataFrame, events: DataFrame, told: Callable[[str], None] = lambda what: None) -> DataFrame:
    """event (a commit), chain, place: of every chain that descends from an event the first place that does, a table.

    placed: as chains makes it; events: event.
    """
    child, parent = (placed.select(F.col("commit").alias(x), F.col("chain").alias(f"{x}_chain"), F.col("place").alias(f"{x}_place")) for x in ("commit", "parent"))
    across = edges.select("commit", "parent").join(child, "commit").join(parent, "parent").where("commit_chain <> parent_chain")
    # of a chain's edges into another those count that lead further back than all that start later
    across = cut(across.groupBy("parent_chain", "parent_place", "commit_chain").agg(F.min("commit_place").alias("commit_place")), "edges-across")
    start = events.select("event").distinct().join(placed, F.col("event") == F.col("commit")).select("event", "chain", "place")
    new = cut(start, "reached")
    parts, sizes = [new], [new.count()]
    while True:
        told("cross")
        step = new.join(across, (F.col("chain") == F.col("parent_chain")) & (F.col("place") <= F.col("parent_place")))
        step = cut(step.groupBy("event", "commit_chain").agg(F.min("commit_place").alias("to")), "reached")
        had = reduce(DataFrame.unionByName, parts).toDF("e", "c", "p")
        if step.count() <= FEW:  # what is known stays where it is
            keys = step.select(F.col("event").alias("_e"), F.col("commit_chain").alias("_c"))
            had = had.join(F.broadcast(keys), (F.col("e") == F.col("_e")) & (F.col("c") == F.col("_c")), "left_semi")
        better = step.hint("shuffle_hash").join(had, (F.col("event") == F.col("e")) & (F.col("commit_chain") == F.col("c")), "left")
        if len(parts) > 1:  # a chain may be in several
            better = better.groupBy("event", "commit_chain").agg(F.min("to").alias("to"), F.min("p").alias("p"))
        better = better.where("p is null or to < p")
        found = cut(better.select("event", F.col("commit_chain").alias("chain"), F.col("to").alias("place")), "reached")
        remove(step)
        n = found.count()
        if n:
            parts, sizes, new = [*parts, found], [*sizes, n], found
        # a table is only rewritten once as many rows came since, so late rounds cost what they find
        if len(parts) > 1 and (not n or 2 * sum(sizes[1:]) > sizes[0]):
            whole = cut(reduce(DataFrame.unionByName, parts).groupBy("event", "chain").agg(F.min("place").alias("place")), "reached")
            remove(*(x for x in parts if x is not new or not n))
            parts, sizes = [whole], [whole.count()]
        if not n:
            remove(across, found)
            return parts[0]


def affected_stretches(edges: DataFrame, ranges: DataFrame, told: Callable[[str], None] = lambda what: None) -> tuple[DataFrame, DataFrame]:
    """(stretches: advisory, chain, first, end (excluded); placed: commit, chain, place), tables.

    A commit is affected by a range if it descends from introduced (or is it) and not from fixed (or is it), so a merge of
    the fix is not. ranges: advisory, introduced, fixed (null: open); each range counts by itself, an advisory's ranges
    together. A null introduced, and commits that the graph does not know, affect nothing; a fix unknown to it ends nothing.
    """
    placed = chains(edges, told)
    events = ranges.select(F.col("introduced").alias("event")).union(ranges.select(F.col("fixed").alias("event"))).where("event is not null")
    spread = reached(edges, placed, events, told)
    into = spread.select(F.col("event").alias("introduced"), "chain", F.col("place").alias("first"))
    out_of = spread.select(F.col("event").alias("fixed"), F.col("chain").alias("_chain"), F.col("place").alias("end"))
    length = placed.groupBy("chain").agg((F.max("place") + 1).alias("length"))
    ranges = ranges.select("advisory", "introduced", "fixed").distinct()
    several = ranges.groupBy(F.col("advisory").alias("_advisory")).agg((F.count("*") > 1).alias("several"))
    out_of = out_of.join(ranges.select("fixed").distinct(), "fixed", "left_semi")
    hit = ranges.join(several, F.col("advisory").eqNullSafe(F.col("_advisory"))).join(into, "introduced").withColumnRenamed("fixed", "_fixed")
    hit = hit.join(out_of, (F.col("_fixed") == F.col("fixed")) & (F.col("chain") == F.col("_chain")), "left").join(length, "chain")
    hit = cut(hit.withColumn("end", F.coalesce("end", "length")).where("first < end").select("advisory", "chain", "first", "end", "several"), "hits")
    # the ranges of an advisory on one chain may overlap: a stretch begins where none before reaches
    before = Window.partitionBy("advisory", "chain").orderBy("first", "end")
    begins = F.coalesce(F.col("first") > F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    parted = hit.where("several").select("advisory", "chain", "first", "end", begins.cast("int").alias("begins"))
    parted = parted.withColumn("n", F.sum("begins").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    merged = parted.groupBy("advisory", "chain", "n").agg(F.min("first").alias("first"), F.max("end").alias("end")).drop("n")
    return cut(hit.where("not several").select("advisory", "chain", "first", "end").unionByName(merged), "stretches"), placed


def commits_in_ranges(edges: DataFrame, ranges: DataFrame, told: Callable[[str], None] = lambda what: None) -> DataFrame:
    """advisory, commit: every affected commit, once. As affected_stretches, its stretches written out place by place."""
    stretches, placed = affected_stretches(edges, ranges, told)
    places = stretches.select("advisory", "chain", F.explode(F.expr("sequence(first, end - 1)")).alias("place"))
    return places.join(placed, ["chain", "place"]).select("advisory", "commit")


def releases_in_ranges(edges: DataFrame, ranges: DataFrame, releases: DataFrame) -> DataFrame:
    """advisory, release, commit of the releases affected. releases: release, commit."""
    stretches, placed = affected_stretches(edges, ranges)
    block = lambda c: F.floor(F.col(c) / BLOCK)
    at = releases.join(placed, "commit").withColumn("block", block("place"))
    blocks = stretches.withColumn("last", F.col("end") - 1).withColumn("block", F.explode(F.sequence(block("first"), block("last"))))
    return at.join(blocks, ["chain", "block"]).where("place >= first and place < end").select("advisory", "release", "commit")
