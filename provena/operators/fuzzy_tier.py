"""Fuzzy matching of whole texts by piecewise digests: all pairs within an edit distance, found without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One edit is allowed for so many characters of the longer digest.
PER_EDIT = 10


def distinct_digests(files: DataFrame) -> DataFrame:
    """size, digest, first (smallest file), n_files: texts with one digest are compared once. files: file, size, digest."""
    return files.groupBy("size", "digest").agg(F.min("file").alias("first"), F.count_distinct("file").alias("n_files"))


def _id(name: str = "id") -> Column:
    """A digest as a number. Segments and pairs go as two numbers; digests of one number are told apart when they are compared."""
    return F.xxhash64("size", "digest").alias(name)


def _key(segment: Column) -> Column:
    """What a segment and a probe must have in common; of one type on both sides, as hashes differ by type."""
    return F.xxhash64(*[F.col(c).cast("long") for c in ("size", "n", "t", "i")], segment).alias("key")


def _with_segments(known: DataFrame, per_edit: int) -> DataFrame:
    """key, id: a row for each segment by which a digest can be found.

    A digest r is found by a digest s that is not shorter and allows t edits: t depends on s's length alone, which is at
    most r's plus t. Cut into t + 1 segments, r has one that t edits leave whole; with at least three characters an edit no
    segment is empty.
    """
    if per_edit < 3:
        raise ValueError("one edit is allowed for three characters or more")
    told = known.select("size", "digest", F.length("digest").alias("n"))
    # s has at most (n * per_edit) div (per_edit - 1) characters: with more, even its own edits could not make up for the difference
    told = told.withColumn("t", F.explode(F.expr(f"sequence(n DIV {per_edit}, ((n * {per_edit}) DIV {per_edit - 1}) DIV {per_edit})")))
    told = told.withColumn("i", F.explode(F.expr("sequence(0, t)")))
    begin, end = "(n * i) DIV (t + 1)", "(n * (i + 1)) DIV (t + 1)"
    segment = F.expr(f"substring(digest, CAST({begin} + 1 AS INT), CAST({end} - {begin} AS INT))")
    return told.select(_key(segment), _id())


def _with_probes(asked: DataFrame, per_edit: int) -> DataFrame:
    """key, other (an id): a row for each place in a digest s at which a segment of a digest of n characters may stand: at most t places off."""
    told = asked.select("size", "digest", F.length("digest").alias("m")).withColumn("t", F.expr(f"CAST(m DIV {per_edit} AS INT)"))
    told = told.withColumn("n", F.explode(F.expr("sequence(m - t, m)"))).withColumn("i", F.explode(F.expr("sequence(0, t)")))
    begin, end = "(n * i) DIV (t + 1)", "(n * (i + 1)) DIV (t + 1)"
    told = told.withColumns({"begin": F.expr(f"CAST({begin} AS INT)"), "long": F.expr(f"CAST({end} - {begin} AS INT)")})
    # before segment i there were at most i edits, or after it at most t - i; and the lengths differ by m - n
    low = "greatest(begin - i, begin + (m - n) - (t - i), 0)"
    high = "least(begin + i, begin + (m - n) + (t - i), m - long)"
    told = told.where(f"{low} <= {high}").withColumn("at", F.explode(F.expr(f"sequence({low}, {high})")))
    return told.select(_key(F.expr("substring(digest, CAST(at + 1 AS INT), long)")), _id("other"))


def near_digests(asked: DataFrame, known: DataFrame, per_edit: int = PER_EDIT) -> DataFrame:
    """size, digest (of known), other (of asked), distance: every pair of one piece size whose edit distance is allowed.

    Both: size, digest, distinct. A pair is allowed one edit for each ``per_edit`` characters of its longer digest. The
    pair's shorter digest is cut into segments, the longer one asks at the few places where each may have moved to, so no
    pair is lost and only digests that share a segment meet.
    """
    up = _with_segments(known, per_edit).join(_with_probes(asked, per_edit), "key").select("id", "other")
    down = _with_segments(asked, per_edit).join(_with_probes(known, per_edit), "key").select(F.col("other").alias("id"), F.col("id").alias("other"))
    return _near(up.unionByName(down).distinct(), known, asked, per_edit)


def near_pairs(known: DataFrame, per_edit: int = PER_EDIT) -> DataFrame:
    """size, digest < other, distance: as near_digests, within one table."""
    met = _with_segments(known, per_edit).join(_with_probes(known, per_edit), "key").where("id <> other")
    met = met.select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other"))
    # different digests that have one number meet too
    alike = known.groupBy(_id()).agg(F.count("*").alias("n")).where("n > 1").select("id", F.col("id").alias("other"))
    near = _near(met.unionByName(alike).distinct(), known, known, per_edit).where("digest <> other")
    return near.select("size", F.least("digest", "other").alias("digest"), F.greatest("digest", "other").alias("other"), "distance").distinct()


def _near(met: DataFrame, known: DataFrame, asked: DataFrame, per_edit: int) -> DataFrame:
    """size, digest, other, distance of the pairs of ids whose digests are near."""
    one = known.select(_id(), "size", "digest")
    two = asked.select(_id("other"), F.col("size").alias("size_b"), F.col("digest").alias("digest_b"))
    told = met.join(one, "id").join(two, "other").where("size = size_b").select("size", "digest", F.col("digest_b").alias("other"))
    most = F.floor(F.greatest(F.length("digest"), F.length("other")) / per_edit).cast("int")
    told = told.withColumns({"distance": F.levenshtein("digest", "other"), "most": most})
    return told.where("distance <= most").drop("most")


def linked(files: DataFrame, per_edit: int = PER_EDIT) -> tuple[DataFrame, DataFrame]:
    """(pairs: size, first, second, distance; members: file, size, first): near texts as pairs of representatives.

    files: file, size, digest, a table. A representative is the smallest file of a digest; members says whose it is.
    """
    known = distinct_digests(files)
    near = near_pairs(known.select("size", "digest"), per_edit)
    a = known.select("size", "digest", F.col("first").alias("a"))
    b = known.select("size", F.col("digest").alias("other"), F.col("first").alias("b"))
    told = near.join(a, ["size", "digest"]).join(b, ["size", "other"])
    pairs = told.select("size", F.least("a", "b").alias("first"), F.greatest("a", "b").alias("second"), "distance")
    members = files.join(known.select("size", "digest", "first"), ["size", "digest"]).select("file", "size", "first").distinct()
    return pairs, members
