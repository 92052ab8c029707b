"""The tiered artifact: releases, exact, winnowing and symbol tiers as tables; build, merge, upgrade, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions import text as ft

# Fixed values of the format: tier, technique number, unit.
TIERS = [("exact", 1, "file"), ("winnowing", 2, "snippet"), ("symbol", 4, "symbol")]
RELEASE_COLUMNS = ["release_id", "vendor", "component", "version", "date", "license", "purl", "url", "source_tier"]
NO_DATE, NO_LICENSE = "1970-01-01", "NOASSERTION"
PROFILES = {"fast": ("exact",), "thorough": ("exact", "winnowing", "symbol"), "compliance-safe": ("exact", "winnowing"), "high-precision": ("exact", "symbol")}

_RELEASE = "struct<vendor:string,component:string,version:string,date:string,license:string,purl:string,url:string,source_tier:string>"
_EXACT = "map<string,struct<releases:array<string>,path:string>>"
_WFP = "map<string,array<struct<md5:string,line:int>>>"
_SYMBOL = "map<string,struct<prefix:string,releases:map<string,array<string>>>>"
SCHEMA_2 = f"schema int, generated string, source_kb string, releases map<string,{_RELEASE}>, tiers struct<exact:struct<technique:int,unit:string,files:{_EXACT}>,winnowing:struct<technique:int,unit:string,hashes:{_WFP}>,symbol:struct<technique:int,unit:string,components:{_SYMBOL}>>"
SCHEMA_1 = f"releases map<string,{_RELEASE}>, files {_EXACT}, wfp {_WFP}"


def tier_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TIERS, "tier string, technique int, unit string")


def releases_of(records: DataFrame) -> DataFrame:
    """Release table of declared records (release_id, rec_no, record): only a release's first record counts."""
    first = records.groupBy("release_id").agg(F.min_by("record", "rec_no").alias("record"))
    return first.select("release_id", ft.declared_fields(F.col("record")).alias("f")).select("release_id", "f.*", F.lit("file").alias("source_tier"))


def exact_tier(records: DataFrame) -> DataFrame:
    """md5, release_ids (sorted set), path (first that is not empty). records: md5, rec_no, release_id, path."""
    path = F.min_by("path", F.when(F.col("path") != "", F.col("rec_no")))
    return records.groupBy("md5").agg(F.array_sort(F.collect_set("release_id")).alias("release_ids"), F.coalesce(path, F.lit("")).alias("path"))


def release_index(releases: DataFrame) -> DataFrame:
    """component (lower case), version, release_id; of duplicates the last id wins."""
    return releases.groupBy(F.lower("component").alias("component"), "version").agg(F.max("release_id").alias("release_id"))


def build_symbol_fragment(refs: DataFrame, meta: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbol tier, minted releases) from symbol references.

    refs: component, tag, tag_ord, symbol; meta: component, purl, license, vendor, prefix. A tag's version is reconciled
    with the base's releases of that component and version, else an id is minted from purl and version. Of tags with one
    version the last tag's symbols count.
    """
    told = refs.withColumn("version", ft.tag_version(F.col("tag")))
    last = told.groupBy("component", "version").agg(F.max("tag_ord").alias("tag_ord"))
    told = told.join(last, ["component", "version", "tag_ord"])
    meta = meta.select(
        "component", "prefix", ft.or_default(F.col("purl"), F.concat(F.lit("pkg:generic/"), "component")).alias("purl"),
        ft.or_default(F.col("license"), F.lit(NO_LICENSE)).alias("license"), ft.or_default(F.col("vendor"), F.col("component")).alias("vendor"),
    )
    keys = told.select("component", "version").distinct().join(meta, "component")
    index = release_index(base).withColumnsRenamed({"component": "_c", "version": "_v", "release_id": "_id"})
    ids = keys.join(index, (F.lower("component") == F.col("_c")) & (F.col("version") == F.col("_v")), "left")
    ids = ids.withColumn("minted", F.col("_id").isNull()).withColumn("release_id", F.coalesce("_id", ft.mint_id(F.col("purl"), F.col("version"))))
    tier = told.join(ids.select("component", "version", "prefix", "release_id"), ["component", "version"]).select("component", "prefix", "release_id", "symbol")
    empty = F.lit("")
    minted = ids.where("minted").select("release_id", "vendor", "component", "version", empty.alias("date"), "license", "purl", empty.alias("url"), F.lit("symbol").alias("source_tier"))
    return tier, minted


def merge_releases(base: DataFrame, *minted: DataFrame) -> DataFrame:
    """Base releases updated by later fragments: the last source of an id wins, as a whole row."""
    ranked = base.withColumn("_p", F.lit(0))
    for i, m in enumerate(minted, 1):
        ranked = ranked.unionByName(m.withColumn("_p", F.lit(i)))
    rest = [c for c in RELEASE_COLUMNS if c != "release_id"]
    return ranked.groupBy("release_id").agg(F.max_by(F.struct(*rest), "_p").alias("r")).select("release_id", "r.*")


def merge_symbol_tiers(*fragments: DataFrame) -> DataFrame:
    """Symbol tier of fragments in order: a component's entry in a later fragment replaces the earlier one whole."""
    told = None
    for i, f in enumerate(fragments):
        f = f.withColumn("_p", F.lit(i))
        told = f if told is None else told.unionByName(f)
    last = told.groupBy("component").agg(F.max("_p").alias("_p"))
    return told.join(last, ["component", "_p"]).drop("_p")


def resolve_releases(found: DataFrame, releases: DataFrame, keys: list[str]) -> DataFrame:
    """keys with sorted versions, purls and licences; ids without a release are dropped. found: keys, release_id."""
    told = found.join(releases.select("release_id", "version", "purl", "license"), "release_id")
    return told.groupBy(*keys).agg(*[F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in ("version", "purl", "license")])


def select_tiers(matches: DataFrame, profile: str) -> DataFrame:
    """Matches of the tiers of a profile, with the profile recorded."""
    return matches.where(F.col("tier").isin(*PROFILES[profile])).withColumn("profile", F.lit(profile))


def write_json(path: str, releases: DataFrame, exact: DataFrame, wfp: DataFrame, symbol: DataFrame, generated: str = "", source_kb: str = "", parts: int = 1) -> None:
    """The artifact as gzipped JSON of schema 2, the form for exchange: one document, or ``parts`` that share out the keys."""
    from provena.sources.exchange import _joined, entries, part_of, write_documents

    rel = entries(releases.withColumn("part", part_of(F.col("release_id"), parts)), "release_id", F.struct(*RELEASE_COLUMNS[1:]), "releases")
    ex = entries(exact.withColumn("part", part_of(F.col("md5"), parts)), "md5", F.struct(F.col("release_ids").alias("releases"), "path"), "files")
    wf = wfp.groupBy("hash").agg(F.array_sort(F.collect_list(F.struct("md5", "line"))).alias("at"))
    wf = entries(wf.withColumn("part", part_of(F.col("hash"), parts)), "hash", F.col("at"), "hashes")
    sy = symbol.groupBy("component", "prefix", "release_id").agg(F.array_sort(F.collect_set("symbol")).alias("s"))
    sy = sy.groupBy("component", "prefix").agg(F.map_from_entries(F.collect_list(F.struct("release_id", "s"))).alias("releases_"))
    sy = entries(sy.withColumn("part", part_of(F.col("component"), parts)), "component", F.struct("prefix", F.col("releases_").alias("releases")), "components")
    doc = _joined(releases.sparkSession, parts, rel, ex, wf, sy)
    tech = {t: (F.lit(n).alias("technique"), F.lit(u).alias("unit")) for t, n, u in TIERS}
    tiers = F.struct(F.struct(*tech["exact"], "files").alias("exact"), F.struct(*tech["winnowing"], "hashes").alias("winnowing"), F.struct(*tech["symbol"], "components").alias("symbol"))
    write_documents(doc.select(F.lit(2).alias("schema"), F.lit(generated).alias("generated"), F.lit(source_kb).alias("source_kb"), "releases", tiers.alias("tiers")), path, "gzip")


def read_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """releases, exact, wfp, symbol, tiers of an artifact of schema 1 or 2; gzip by its suffix. Reading twice is the same."""
    raw = spark.read.schema(SCHEMA_2 + ", files " + _EXACT + ", wfp " + _WFP).json(path, multiLine=True)
    rel = raw.select(F.explode("releases").alias("release_id", "r")).select("release_id", "r.*")
    exact = raw.select(F.explode(F.coalesce("tiers.exact.files", "files")).alias("md5", "f")).select("md5", F.array_sort("f.releases").alias("release_ids"), "f.path")
    wfp = raw.select(F.explode(F.coalesce("tiers.winnowing.hashes", "wfp")).alias("hash", "at")).select("hash", F.inline("at"))
    symbol = raw.select(F.explode("tiers.symbol.components").alias("component", "c")).select("component", "c.prefix", F.explode("c.releases").alias("release_id", "s")).select("component", "prefix", "release_id", F.explode("s").alias("symbol"))
    rel = rel.withColumn("source_tier", F.coalesce("source_tier", F.lit("file"))).select(*RELEASE_COLUMNS)
    return {"releases": rel, "exact": exact, "wfp": wfp.select("hash", "md5", "line"), "symbol": symbol, "tiers": tier_catalogue(spark)}


def write_tables(artifact: dict[str, DataFrame], folder: str) -> None:
    """The artifact as tables, the winnowing tier clustered by hash for lookups."""
    for name, df in artifact.items():
        df = df.repartitionByRange("hash").sortWithinPartitions("hash") if name == "wfp" else df
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in ("releases", "exact", "wfp", "symbol", "tiers")}


def counts(artifact: dict[str, DataFrame]) -> DataFrame:
    """releases, files, hashes of an artifact."""
    parts = [artifact["releases"].agg(F.count("*").alias("releases")), artifact["exact"].agg(F.count("*").alias("files")), artifact["wfp"].agg(F.count_distinct("hash").alias("hashes"))]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each


def discrepancies(declared: DataFrame, detected: DataFrame) -> DataFrame:
    """component, declared_version, detected_version, state of a manifest against what was found."""
    a, b = declared.select("component", F.col("version").alias("declared_version")), detected.select("component", F.col("version").alias("detected_version"))
    state = F.when(F.col("declared_version").isNull(), "undeclared").when(F.col("detected_version").isNull(), "not found").when(F.col("declared_version") == F.col("detected_version"), "agrees").otherwise("differs")
    return a.join(b, "component", "full").withColumn("state", state)
