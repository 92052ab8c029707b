"""Weaker evidence of identity: version macros, path suffixes, member names, version schemes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions import text as ft

# A version macro and a header's version line.
VERSION_MACRO = r'(?m)^[ \t]*#[ \t]*define[ \t]+\w*VERSION\w*[ \t]+"?[Vv]?(\d+(?:\.\d+)+[\w.+-]*)"?'
VERSION_LINE = r"(?i)\bversion:?[ \t]+v?(\d+(?:\.\d+)+)"
SCHEME = r"^[^\d]*"


def version_hint(text: Column) -> Column:
    """The version that a macro, else a header line, states."""
    return F.coalesce(F.nullif(F.regexp_extract(text, VERSION_MACRO, 1), F.lit("")), F.nullif(F.regexp_extract(text, VERSION_LINE, 1), F.lit("")))


def license_hint(text: Column) -> Column:
    """The licence line of a raw header, before normalisation would drop it."""
    return F.nullif(F.regexp_extract(text, r"(?:SPDX-License-Identifier:[ \t]*([\w.+-]+))", 1), F.lit(""))


def common_suffix(a: Column, b: Column) -> Column:
    """Number of path parts that two paths share at their ends."""
    x, y = F.reverse(F.split(a, "/")), F.reverse(F.split(b, "/"))
    pairs = F.transform(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: p["x"].eqNullSafe(p["y"]))
    return F.coalesce(F.nullif(F.array_position(pairs, F.lit(False)), F.lit(0)) - 1, F.size(pairs).cast("long")).cast("int")


def path_hints(files: DataFrame, known: DataFrame, least: int = 2) -> DataFrame:
    """file, path, known_path, component, shared: known paths with at least ``least`` equal parts at the end.

    The join key is the last ``least`` parts, so no pair without them is made.
    """
    key = F.substring_index("path", "/", -least)
    right = known.select(F.col("path").alias("known_path"), "component", key.alias("k"))
    told = files.withColumn("k", key).join(right, "k").drop("k")
    return told.withColumn("shared", common_suffix(F.col("path"), F.col("known_path"))).where(F.col("shared") >= least)


def member_stems(rows: DataFrame, key: str = "archive") -> DataFrame:
    """key, symbol: member names without their ending, to be divided like symbols."""
    return rows.where("member is not null").select(F.col(key).alias("lib"), F.regexp_replace(ft.base_name(F.col("member")), r"\.[^.]*$", "").alias("symbol")).distinct()


def version_scheme(tag: Column) -> Column:
    """What stands before the first digit, and how many numbers follow; tags of other schemes are not compared."""
    return F.concat_ws(":", F.regexp_extract(tag, SCHEME, 0), F.size(ft.version_key(tag)).cast("string"))


def newest_by_scheme(tags: DataFrame) -> DataFrame:
    """repo, scheme, tag: the newest tag of each scheme of a repository; releases are newer than what comes before them."""
    told = tags.withColumn("scheme", version_scheme(F.col("tag")))
    return told.groupBy("repo", "scheme").agg(F.max_by("tag", F.struct(ft.version_order(F.col("tag")), "tag")).alias("tag"))


def with_provenance(matches: DataFrame, tier: str, technique: int, scope: str = "on disk", profile: str | None = None) -> DataFrame:
    """matches with tier, technique, evidence_scope and profile, to be kept on every output."""
    return matches.withColumns({"tier": F.lit(tier), "technique": F.lit(technique), "evidence_scope": F.lit(scope), "profile": F.lit(profile).cast("string")})
