"""The JSON documents that databases and results are exchanged in: readers, and writers that write documents in parts.

With one part a writer's folder holds one document, the form others read. With more, each part is a whole document of the
same form that holds a share of the entries, so no task holds all of them; the readers take a file or a folder of parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A tag's entry is read as text: file -> digest in a database of one repository, {repo, files: file -> digest} in one of several.
FINGERPRINT_DB = "repo string, repos array<string>, files array<string>, content map<string,map<string,struct<winnow:array<bigint>,tags:array<string>>>>, tags map<string,string>"
SYMBOL_DB = "component string, purl string, license string, vendor string, tag_version_re string, mined_from string, prefix string, header_globs array<string>, releases map<string,array<string>>"
_MATCH = "struct<component:string,releases:array<string>,known_symbols_sample:array<string>,n_known:bigint>"
BATCH_SCAN = f"root string, libs_scanned bigint, hits bigint, errors array<struct<library:string,error:string>>, results array<struct<library:string,matches:array<{_MATCH}>>>"


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part")


def write_documents(docs: DataFrame, path: str, compression: str | None = None) -> None:
    """A file for each row."""
    writer = docs.write.option("maxRecordsPerFile", 1)
    (writer.option("compression", compression) if compression else writer).json(path)


def _joined(spark: SparkSession, parts: int, *tables: DataFrame) -> DataFrame:
    """A row for each part, with the columns of the tables (part, ...)."""
    out = spark.range(parts).select(F.col("id").cast("int").alias("part"))
    for t in tables:
        out = out.join(t, "part", "left")
    return out


def entries(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """part, name: the map key -> value of a part's rows; rows with a null key have no place in a document and are left out."""
    return rows.where(F.col(key).isNotNull()).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(F.col(key), value.alias("v")))).alias(name))


def write_fingerprint_db(path: str, repo: str | None, contents: DataFrame, tags: DataFrame, parts: int = 1) -> None:
    """contents: filename, sha256, winnow, tags; tags: tag, filename, sha256, and with no ``repo`` for all of them a repo each.

    A tag that several repositories have is that of the last of them. Rows with a null tag, file or digest are left out.
    """
    spark = contents.sparkSession
    contents = contents.where("filename is not null and sha256 is not null")
    tags = tags.where("tag is not null and filename is not null")
    files = contents.agg(F.array_sort(F.collect_set("filename")).alias("files"))
    by_file = contents.groupBy(part_of(F.col("sha256"), parts), "filename").agg(F.map_from_entries(F.collect_list(F.struct("sha256", F.struct("winnow", "tags")))).alias("m"))
    part = part_of(F.col("tag"), parts)
    own = F.map_from_entries(F.collect_list(F.struct("filename", "sha256")))
    if repo is not None:
        by_tag, head = tags.groupBy(part, "tag").agg(own.alias("m")), [F.lit(repo).alias("repo")]
    else:
        each = tags.groupBy(part, "tag", "repo").agg(own.alias("files"))
        by_tag = each.groupBy("part", "tag").agg(F.max_by(F.struct("repo", "files"), "repo").alias("m"))
        files, head = files.crossJoin(tags.agg(F.array_sort(F.collect_set("repo")).alias("repos"))), [F.col("repos")]  # one row each
    docs = _joined(spark, parts, entries(by_file, "filename", F.col("m"), "content"), entries(by_tag, "tag", F.col("m"), "tags")).crossJoin(files)
    write_documents(docs.select(*head, "files", "content", "tags"), path)


def read_fingerprint_db(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(contents: repo, filename, sha256, winnow, tags; tags: tag, filename, sha256, repo).

    Databases of one repository (repo) and of several (repos, where each tag names its own and contents have none) are read
    alike; a document of any other form is an error.
    """
    raw = spark.read.schema(FINGERPRINT_DB).json(path, multiLine=True)
    odd = F.raise_error(F.lit("a fingerprint database has repo, or repos and a repo and files for every tag"))
    raw = raw.withColumn("repo", F.when(F.col("repo").isNull() == F.col("repos").isNull(), odd).otherwise(F.col("repo")))
    contents = raw.select("repo", F.explode("content").alias("filename", "m")).select("repo", "filename", F.explode("m").alias("sha256", "c")).select("repo", "filename", "sha256", "c.winnow", "c.tags")
    each = raw.select("repo", F.explode("tags").alias("tag", "e"))
    plain, named = F.from_json("e", "map<string,string>"), F.from_json("e", "repo string, files map<string,string>")
    several = F.col("repo").isNull()
    files = F.when(several, named["files"]).otherwise(plain)
    sound = F.when(several, named["repo"].isNotNull()).otherwise(~F.exists(F.map_values(plain), lambda x: x.startswith("{") | x.startswith("[")))
    each = each.select("tag", F.when(several, named["repo"]).otherwise(F.col("repo")).alias("repo"), F.when(F.coalesce(sound & files.isNotNull(), F.lit(False)), files).otherwise(odd).alias("m"))
    return contents, each.select("tag", F.explode("m").alias("filename", "sha256"), "repo")


def write_symbol_db(path: str, refs: DataFrame, meta: DataFrame) -> None:
    """A document for each component. refs: component, release, symbol; meta: component, purl, license, vendor, tag_version_re, prefix."""
    sets = refs.groupBy("component", "release").agg(F.array_sort(F.collect_set("symbol")).alias("s"))
    sets = sets.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("release", "s"))).alias("releases"))
    write_documents(meta.join(sets, "component").select("component", "purl", "license", "vendor", "tag_version_re", "prefix", "releases"), path)


def read_symbol_db(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(refs: component, release, symbol; components: component, prefix, purl, license, vendor, tag_version_re)."""
    raw = spark.read.schema(SYMBOL_DB).json(path, multiLine=True)
    refs = raw.select("component", F.explode("releases").alias("release", "s")).select("component", "release", F.explode("s").alias("symbol"))
    return refs, raw.select("component", "prefix", "purl", "license", "vendor", "tag_version_re")


def write_batch_scan(path: str, root: str, libraries: DataFrame, matches: DataFrame, errors: DataFrame, parts: int = 1) -> None:
    """libraries: library (readable ones); matches: library, component, releases, known_symbols_sample, n_known; errors: library, error."""
    spark = libraries.sparkSession
    one = matches.groupBy("library").agg(F.array_sort(F.collect_list(F.struct("component", "releases", "known_symbols_sample", "n_known"))).alias("matches"))
    told = libraries.select("library").distinct().join(one, "library", "left").withColumn("matches", F.coalesce("matches", F.array().cast(f"array<{_MATCH}>")))
    results = told.groupBy(part_of(F.col("library"), parts)).agg(F.array_sort(F.collect_list(F.struct("library", "matches"))).alias("results"))
    bad = errors.groupBy(part_of(F.col("library"), parts)).agg(F.array_sort(F.collect_list(F.struct("library", "error"))).alias("errors"))
    counts = told.agg(F.count("*").alias("libs_scanned"), F.count_if(F.size("matches") > 0).alias("hits"))
    docs = _joined(spark, parts, results, bad).crossJoin(counts)
    none = F.array().cast("array<struct<library:string,error:string>>")
    write_documents(docs.select(F.lit(root).alias("root"), "libs_scanned", "hits", F.coalesce("errors", none).alias("errors"), "results"), path)


def read_batch_scan(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary: root, libs_scanned, hits; matches: library and the fields of each match; errors: library, error)."""
    raw = spark.read.schema(BATCH_SCAN).json(path, multiLine=True)
    matches = raw.select(F.inline("results")).select("library", F.inline("matches"))
    return raw.select("root", "libs_scanned", "hits").distinct(), matches, raw.select(F.inline("errors"))


def write_snapshot(path: str, generated: str, api: str, results: DataFrame, parts: int = 1) -> None:
    """An advisory snapshot: results are its columns (label, query or cpe, result), of which each row is an entry."""
    rows = results.groupBy(part_of(F.col("label"), parts)).agg(F.array_sort(F.collect_list(F.struct(*results.columns))).alias("results"))
    write_documents(_joined(results.sparkSession, parts, rows).select(F.lit(generated).alias("generated"), F.lit(api).alias("api"), "results"), path)

