"""Advisory snapshots: coverage by identity, ecosystems, version ranges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provena.functions import text as ft

SHOWN = 6
OSV = "generated string, api string, results array<struct<label:string,query:struct<package:struct<name:string,purl:string,ecosystem:string>,version:string>,result:struct<raw_vulns:int,cve_count:int,cves_sample:array<string>,error:string>>>"
NVD = "generated string, api string, results array<struct<label:string,cpe:string,result:struct<total:int,sample:array<string>,error:string>>>"
GHSA = "generated string, api string, results array<struct<label:string,query:string,result:struct<count:int,ecosystems:map<string,int>,sample:array<array<string>>,error:string>>>"


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """label and the other fields of each stored result."""
    return spark.read.schema(schema).json(path, multiLine=True).select(F.inline("results"))


def cve_counts(answers: DataFrame, json_col: str = "json", shown: int = SHOWN) -> DataFrame:
    """answers with cve_count and cves_sample of the distinct CVE ids in their text."""
    ids = ft.cve_ids(F.col(json_col))
    return answers.withColumn("cve_count", F.size(ids)).withColumn("cves_sample", F.slice(ids, 1, shown))


def ecosystems(advisories: DataFrame) -> DataFrame:
    """ecosystem, n over nested vulnerabilities. advisories: vulnerabilities array<struct<ecosystem>>."""
    return advisories.select(F.explode("vulnerabilities").alias("v")).groupBy(F.col("v.ecosystem").alias("ecosystem")).agg(F.count("*").alias("n"))


def coverage_flag(n, error=None):
    """error, none (reported as 0!) or covered; empty is not the same as safe."""
    flag = F.when(n == 0, "0!").otherwise("covered")
    return flag if error is None else F.when(error.isNotNull(), "error").otherwise(flag)


def coverage(findings: DataFrame, identities: DataFrame) -> DataFrame:
    """component, source, n, flag for every identity asked for. findings: component, source, cve."""
    n = findings.groupBy("component", "source").agg(F.count_distinct("cve").alias("n"))
    told = identities.join(n, ["component", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return told.withColumn("flag", coverage_flag(F.col("n")))


def _places(points: DataFrame, keys: list[str]) -> DataFrame:
    """points with ``place``: the dense rank of its order among the different versions of its keys."""
    return points.withColumn("place", F.dense_rank().over(Window.partitionBy(*keys).orderBy("order")) - 1)


def _met_ranges(releases: DataFrame, ranges: DataFrame) -> DataFrame:
    """_p, version, _in, _out: every different version of a product with every different range of it that holds it.

    Versions compare as `version_order` says, so 2.28.10 follows 2.28.8, 2.28 is 2.28.0 and 3.6.0-rc1 comes before 3.6.0;
    those without a digit match nothing. A product's different versions and bounds are ranked. A range of ranks is
    the union of a few dyadic stretches, a rank lies in one stretch of each length, and the two meet by equality of the
    stretch: every pair that meets is a match, and a product with many versions and ranges makes no other row.
    """
    v = releases.select("product", "version").distinct().withColumn("order", ft.version_order(F.col("version"))).where("order is not null")
    r = ranges.select("product", "introduced", "fixed").distinct()
    r = r.withColumns({"low": ft.version_order(F.col("introduced")), "high": ft.version_order(F.col("fixed"))})
    r = r.where("(introduced is null or low is not null) and (fixed is null or high is not null)")
    points = v.select("product", "order").union(r.select("product", "low").where("low is not null")).union(r.select("product", "high").where("high is not null")).distinct()
    ranked = _places(points, ["product"])
    size = ranked.groupBy("product").agg((F.max("place") + 1).alias("size"))
    at = lambda c: ranked.select(F.col("product").alias(f"{c}_product"), F.col("order").alias(f"{c}_order"), F.col("place").alias(f"{c}_place"))
    met = lambda df, c: df.join(at(c), (F.col("product") == F.col(f"{c}_product")) & (F.col(c) == F.col(f"{c}_order")), "left").drop(f"{c}_product", f"{c}_order")
    bounds = met(met(r, "low"), "high").join(size, "product")
    bounds = bounds.select("product", "introduced", "fixed", F.coalesce("low_place", F.lit(0)).cast("long").alias("a"), F.coalesce("high_place", "size").cast("long").alias("b"), "size").where("a < b")
    levels = "sequence(0, CAST(ceil(log2(size)) AS INT))"
    up = bounds.withColumn("level", F.explode(F.expr(levels))).withColumn("unit", F.expr("shiftleft(1L, level)"))
    up = up.withColumns({"lo": F.expr("(a + unit - 1) DIV unit"), "hi": F.expr("b DIV unit")}).where("lo < hi")
    ends = F.array_distinct(F.filter(F.array(F.when(F.col("lo") % 2 == 1, F.col("lo")), F.when(F.col("hi") % 2 == 1, F.col("hi") - 1)), lambda x: x.isNotNull()))
    stretches = up.select("product", "introduced", "fixed", "level", F.explode(ends).alias("stretch"))
    placed = met(v.withColumnRenamed("order", "own"), "own").join(size, "product").withColumn("level", F.explode(F.expr(levels)))
    placed = placed.select("product", "version", "level", F.expr("own_place DIV shiftleft(1L, level)").alias("stretch"))
    return placed.join(stretches, ["product", "level", "stretch"]).select(F.col("product").alias("_p"), "version", F.col("introduced").alias("_in"), F.col("fixed").alias("_out"))


def _named(met: DataFrame, ranges: DataFrame) -> DataFrame:
    """The advisories of ranges that are told by _p, _in and _out."""
    same = (F.col("_p") == F.col("product")) & F.col("_in").eqNullSafe(F.col("introduced")) & F.col("_out").eqNullSafe(F.col("fixed"))
    return met.join(ranges, same).drop("_in", "_out")


def version_range_matches(releases: DataFrame, ranges: DataFrame) -> DataFrame:
    """releases: product, version; ranges: product, advisory, introduced (null: from the first), fixed (excluded; null: open).

    A row for every release and advisory that match; versions compare as `_met_ranges` says.
    """
    return releases.join(_named(_met_ranges(releases, ranges), ranges).drop("_p"), ["product", "version"])


def version_range_totals(releases: DataFrame, ranges: DataFrame, **totals: Callable[[str], Column]) -> DataFrame:
    """advisory and totals over all its matches, advisories without a match left out: what grouping version_range_matches gives.

    A total names a column of releases and is an aggregate that may be taken of its own results (sum, min, max). It is taken for
    each different range before advisories are joined, so that no row is made for a release and an advisory.
    """
    met = _met_ranges(releases, ranges).withColumnRenamed("version", "_v")
    held = releases.join(met, (F.col("product") == F.col("_p")) & (F.col("version") == F.col("_v")))
    sums = held.groupBy("_p", "_in", "_out").agg(*[of(c).alias(c) for c, of in totals.items()])
    return _named(sums, ranges).groupBy("advisory").agg(*[of(c).alias(c) for c, of in totals.items()])


def identity_to_cpe(components: DataFrame, mapping: DataFrame) -> DataFrame:
    """components with their CPE match strings, quoted for a request. mapping: purl, cpe_part, cpe_vendor, cpe_product."""
    cpe = F.concat_ws(":", F.lit("cpe:2.3"), "cpe_part", "cpe_vendor", "cpe_product", "version")
    return components.join(mapping, "purl").withColumn("cpe", cpe).withColumn("query", ft.quote_cpe(F.col("cpe"))).drop("cpe_part", "cpe_vendor", "cpe_product")
