"""Queries of trees on disk, exchange documents, weaker evidence and the operators behind the verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions import sketch
from provena.functions import text as ft
from provena.operators import advisory, artifact, commits, hints, profile, refdb, report, symbols, verdict, vote
from provena.plans import advisories, libraries
from provena.session import cut, scratch, shared_path, spread, table
from provena.sources import exchange, tree

LANGS = ["de", "en", "es", "fr"]
#: Half of the files that the made trees hold are tracked.
TRACKED = [f"{x}{k}.c" for x in LANGS for k in range(4)]


def _text(c: str) -> F.Column:
    return F.col(c).cast("string")


def _md5(*parts) -> F.Column:
    return F.md5(F.concat(*[p if isinstance(p, F.Column) else _text(p) for p in parts]))


# ---- trees and libraries on disk


def _tree(spark: SparkSession, sf_dir: str) -> str:
    """All documents as files of eight to a folder, named by language and number."""
    docs = table(spark, sf_dir, "documents").where("text is not null and lang is not null")
    path = F.concat(F.lit("t"), F.expr("doc_id div 8"), F.lit("/"), "lang", F.expr("doc_id % 8"), F.lit(".c"))
    folder = shared_path(spark, "tree")
    tree.write_files(docs.select(path.alias("path"), F.encode("text", "utf-8").alias("content")), folder)
    return folder


def tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracked files of each folder."""
    found = tree.scan_tree(spark, _tree(spark, sf_dir), TRACKED, glob="*.c")
    return found.select(ft.base_name(F.col("group")).alias("folder"), "filename", F.md5("text").alias("md5"))


def tree_scan_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracked files of the whole tree as one copy: the first path of a name wins."""
    found = tree.scan_tree(spark, _tree(spark, sf_dir), TRACKED, "TARGET_ROOT", "*.c")
    return found.select("filename", F.regexp_extract("path", r"(t\d+/[^/]+)$", 1).alias("path"), F.md5("text").alias("md5"))


def tree_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that the scan of the whole tree leaves out."""
    files = tree.list_files(spark, _tree(spark, sf_dir), "*.c").where(F.col("filename").isin(TRACKED)).select(F.lit("").alias("group"), "filename", "path")
    return verdict.duplicate_files(files).select("filename", F.regexp_extract("path", r"(t\d+/[^/]+)$", 1).alias("path"))


def library_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toolchain, core and name of library paths, and the order in which they are found."""
    part = table(spark, sf_dir, "part")
    path = F.concat(F.lit("sdk"), F.col("p_size"), F.lit("/lib/"), F.lower("p_type"), F.lit("/m"), F.expr("p_partkey % 5"), F.lit("/lib"), "p_partkey", F.when(F.col("p_partkey") % 7 == 0, ".lib").otherwise(".a"))
    folder = shared_path(spark, "libraries")
    tree.write_files(part.select(path.alias("path"), F.encode("p_name", "utf-8").alias("content")), folder)
    found = tree.library_paths(tree.find_libraries(spark, folder))
    return found.select(ft.base_name(F.col("root")).alias("root"), "toolchain", "core", "name", F.col("ord.lib").alias("late"), F.md5("content").alias("md5"))


# ---- exchange documents


def _reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null and lang is not null and source is not null")
    path = F.concat(F.when(F.col("doc_id") % 2 == 0, "a/").otherwise("b/"), "lang", F.lit(".c"))
    return docs.select(path.alias("filename"), F.sha2("text", 256).alias("sha256"), F.col("source").alias("tag"), F.length("text").cast("long").alias("n"))


def _fingerprint_db(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _reference(spark, sf_dir)
    contents = rows.groupBy("filename", "sha256").agg(F.array_sort(F.collect_set("tag")).alias("tags"), F.array(F.max("n") % 1000, F.max("n")).alias("winnow"))
    tags = rows.groupBy("tag", "filename").agg(F.min("sha256").alias("sha256"))
    path = shared_path(spark, "fingerprints")
    exchange.write_fingerprint_db(path, "made/up", contents, tags, parts=4)
    return exchange.read_fingerprint_db(spark, path)


def fingerprint_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint database written as JSON and read back, with full paths re-keyed to base names."""
    contents = _fingerprint_db(spark, sf_dir)[0].withColumnsRenamed({"repo": "component", "filename": "path"})
    told = refdb.by_basename(contents)
    return told.select("component", "filename", "path", "sha256", F.array_join("tags", ",").alias("tags"), F.aggregate("winnow", F.lit(0).cast("long"), lambda a, x: a + x).alias("winnow_sum"), "n_paths")


def fingerprint_db_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fingerprint_db(spark, sf_dir)[1].select("tag", "filename", "sha256")


def fingerprint_db_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of ten repositories in one database, written as JSON and read back."""
    rows = _reference(spark, sf_dir).withColumn("repo", F.concat(F.lit("o/"), F.right("tag", F.lit(1))))
    contents = rows.groupBy("filename", "sha256").agg(F.array_sort(F.collect_set("tag")).alias("tags"), F.array(F.max("n")).alias("winnow"))
    tags = rows.groupBy("tag", "repo", "filename").agg(F.max("sha256").alias("sha256"))
    path = shared_path(spark, "fingerprints")
    exchange.write_fingerprint_db(path, None, contents, tags, parts=3)
    back, told = exchange.read_fingerprint_db(spark, path)
    held = back.groupBy("filename", "sha256").agg(F.sum(F.size("tags")).alias("n_tags"))
    return told.join(held, ["filename", "sha256"], "left")


def symbol_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol databases of all components written as JSON and read back."""
    _, refs, components = libraries._inputs(spark, sf_dir)
    meta = components.select("component", F.concat(F.lit("pkg:generic/"), "component").alias("purl"), F.lit("MIT").alias("license"), F.lit("v").alias("vendor"), F.lit(ft.DEFAULT_TAG_VERSION).alias("tag_version_re"), "prefix")
    path = shared_path(spark, "symbols")
    exchange.write_symbol_db(path, refs.select("component", "release", "symbol"), meta)
    back, told = exchange.read_symbol_db(spark, path)
    n = back.groupBy("component", "release").agg(F.count("*").alias("n_symbols"), F.min("symbol").alias("first_symbol"), F.max("symbol").alias("last_symbol"))
    return n.join(told, "component").select("component", "release", "n_symbols", "first_symbol", "last_symbol", "prefix", "purl")


def batch_scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch scan's document: suppliers as libraries, those in debt unreadable, return flags as components."""
    line, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    library = F.concat(F.lit("s"), _text("s_suppkey"))
    sound = supplier.where("s_acctbal >= 0").select(library.alias("library"))
    errors = supplier.where("s_acctbal < 0").select(library.alias("library"), F.lit("not an archive").alias("error"))
    found = line.where("l_suppkey % 3 > 0").groupBy(F.concat(F.lit("s"), _text("l_suppkey")).alias("library"), F.col("l_returnflag").alias("component"))
    found = found.agg(F.array_sort(F.collect_set("l_linestatus")).alias("releases"), F.slice(F.array_sort(F.collect_set(F.concat(F.lit("p"), _text("l_partkey")))), 1, 10).alias("known_symbols_sample"), F.count_distinct("l_partkey").alias("n_known"))
    path = shared_path(spark, "batch-scan")
    exchange.write_batch_scan(path, "/sdk", sound, found, errors, parts=3)
    summary, matches, bad = exchange.read_batch_scan(spark, path)
    told = matches.select("library", "component", F.array_join("releases", ",").alias("releases"), F.array_join("known_symbols_sample", ",").alias("sample"), "n_known")
    return told.crossJoin(F.broadcast(summary)).crossJoin(F.broadcast(bad.agg(F.count("*").alias("n_errors"))))


def advisory_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' answers stored as a snapshot and read back, with the coverage flag of each."""
    told = advisory.cve_counts(advisories._answers(spark, sf_dir))
    error = F.when(F.col("user_id") % 10 == 0, "timeout")
    package = F.struct(F.concat(F.lit("c"), _text("user_id")).alias("name"), F.lit(None).cast("string").alias("purl"), F.lit("made").alias("ecosystem"))
    result = F.struct(F.col("cve_count").cast("int").alias("raw_vulns"), F.col("cve_count").cast("int").alias("cve_count"), "cves_sample", error.alias("error"))
    rows = told.select(F.concat(F.lit("u"), _text("user_id")).alias("label"), F.struct(package.alias("package"), F.lit("1.0").alias("version")).alias("query"), result.alias("result"))
    path = shared_path(spark, "snapshot")
    exchange.write_snapshot(path, "2024-01-01", "made up", rows, parts=2)
    back = advisory.read_snapshot(spark, path, advisory.OSV)
    n, bad = F.col("result.cve_count"), F.col("result.error")
    return back.select("label", F.col("query.package.name").alias("name"), n.cast("long").alias("cve_count"), F.array_join("result.cves_sample", ",").alias("sample"), advisory.coverage_flag(n, bad).alias("flag"))


# ---- operators behind the verdicts


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, md5, votes: suppliers vote for part groups by their line items."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("file"), _md5(F.expr("cast(l_partkey % 20 as string)")).alias("md5")).agg(F.count("*").alias("votes"))


def near_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vote.near_winners(_votes(spark, sf_dir), 0.75)
    return found.select("file", F.array_join("md5s", ",").alias("md5s"))


def vote_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.vote_lines(_votes(spark, sf_dir), 3)


def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a report on made file results: exact tags, or candidates with two decimals."""
    part = table(spark, sf_dir, "part")
    exact = F.when(F.col("p_partkey") % 3 == 0, F.array("p_brand", "p_type")).otherwise(F.array().cast("array<string>"))
    best = F.when(F.col("p_partkey") % 3 == 1, F.array(F.struct((F.col("p_size") / 64).alias("score"), F.col("p_type").alias("tag")), F.struct(F.lit(0.125).alias("score"), F.col("p_brand").alias("tag"))))
    return report.file_lines(part.select(_text("p_partkey").alias("group"), F.col("p_name").alias("filename"), exact.alias("exact_matches"), best.alias("top_candidates")))


def vote_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voted contents looked up in the records of the shards at hand."""
    best = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), _md5("o_custkey").alias("md5"))
    customer = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0")
    records = customer.select(_md5("c_custkey").alias("md5"), F.explode(F.array(F.lit(0), F.lit(1))).alias("rec_no"), "c_name").select("md5", "rec_no", F.concat("c_name", F.lit("#"), "rec_no").alias("path"))
    return vote.resolve(best, records, [f"{b:02x}" for b in range(128)])


def _cross_check(spark: SparkSession, sf_dir: str, max_keys: int | None) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    hash_, owner = F.substring(_md5("l_partkey"), 1, 8), _md5("l_suppkey")
    # hashes of third lines are nowhere in the index
    asked = F.when(F.col("l_linenumber") == 3, F.reverse(hash_)).otherwise(hash_)
    mine = line.select(F.col("l_orderkey").alias("file"), owner.alias("md5"), asked.alias("hash"), F.col("l_linenumber").cast("int").alias("line"))
    stored = F.when(F.col("l_orderkey") % 2 == 0, F.col("l_linenumber")).otherwise(F.col("l_linenumber") * 256)
    index = line.select(hash_.alias("hash"), owner.alias("md5"), stored.cast("int").alias("line")).distinct()
    return vote.cross_check(mine, index, max_keys)


def hash_cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local hashes and lines against an index whose lines are stored in either byte order."""
    return _cross_check(spark, sf_dir, None)


def hash_cross_check_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the first two hashes of each file, as the cut-off of the lookup tool has it."""
    return _cross_check(spark, sf_dir, 2)


def shard_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key byte of shard files, and how many of all content hashes a shard may hold."""
    names = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 9 == 0, "readme.txt").otherwise(F.concat(F.lit("kb/"), F.lpad(F.hex(F.col("p_partkey") % 256), 2, "0"), F.lit(".ldb"))).alias("file")).distinct()
    held = names.select("file", ft.shard_byte(F.col("file")).alias("shard")).where("shard is not null")
    hashes = table(spark, sf_dir, "orders").select(_md5("o_orderkey").alias("md5"))
    eligible = hashes.groupBy(F.conv(F.substring("md5", 1, 2), 16, 10).cast("int").alias("shard")).agg(F.count("*").alias("n"))
    return held.join(eligible, "shard", "left").select("file", "shard", F.coalesce("n", F.lit(0)).alias("n"))


def line_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of matched lines: parts of an order as lines."""
    line = table(spark, sf_dir, "lineitem")
    hits = line.select(F.col("l_suppkey").alias("file"), F.col("l_returnflag").alias("md5"), (F.col("l_partkey") % 400).cast("int").alias("line"))
    return vote.line_islands(hits, gap=2)


def set_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    none = F.array().cast("array<bigint>")
    a = F.when(F.col("p_partkey") % 7 == 0, none).otherwise(F.sequence(F.lit(0).cast("long"), F.col("p_partkey") % 9))
    b = F.when(F.col("p_partkey") % 14 < 3, none).otherwise(F.sequence(F.lit(2).cast("long"), 2 + F.col("p_partkey") % 5))
    return part.select("p_partkey", F.round(ft.jaccard(a, b), 6).alias("jaccard"))


def winnow_blake2b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches by the production hash; SQL has no BLAKE2b, tests hold the brute force."""
    docs = spread(table(spark, sf_dir, "documents").where("text is not null"))
    return docs.select("doc_id", F.explode(sketch.winnow(ft.normalize(F.col("text")))).alias("hash"))


def normalized_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files identified by the hash of their normalised text before their raw MD5."""
    docs = spread(table(spark, sf_dir, "documents").where("text is not null and doc_id is not null"))
    known = docs.where("doc_id % 2 = 0").select(ft.sha256_hex(ft.normalize(F.col("text"))).alias("sha256"), F.md5("text").alias("md5"), F.col("source").alias("release_id"))
    spaced = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/* new */  "), "text", F.lit("\n"))).otherwise(F.col("text"))
    files = docs.select(F.col("doc_id").alias("file"), ft.sha256_hex(ft.normalize(spaced)).alias("sha256"), F.md5(spaced).alias("md5"))
    sets = lambda key: known.groupBy(key).agg(F.array_sort(F.collect_set("release_id")).alias("release_ids"))
    none = files.select("file", F.lit(None).cast("string").alias("md5")).where("false")
    found = vote.tier_matches(files, sets("md5"), none, normalized=sets("sha256"))
    return found.select("file", "tier", F.array_join("release_ids", ",").alias("release_ids"))


# ---- releases, tags, advisories


def release_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release ids that suppliers hold, resolved; ids without a release are dropped."""
    found = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("lib"), _md5("l_partkey").alias("release_id")).distinct()
    part = table(spark, sf_dir, "part").where("p_size > 5")
    releases = part.select(_md5("p_partkey").alias("release_id"), F.concat(F.lit("1."), "p_size").alias("version"), F.concat(F.lit("pkg:generic/"), "p_brand").alias("purl"), F.col("p_type").alias("license"))
    told = artifact.resolve_releases(found, releases, ["lib"])
    return told.select("lib", *[F.array_join(c, ",").alias(c) for c in ("versions", "purls", "licenses")])


def artifact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Libraries matched in an artifact's symbol tier: the window of each component, resolved to versions."""
    libs, refs, components = libraries._inputs(spark, sf_dir)
    releases = refs.select(_md5("component", "release").alias("release_id"), F.col("release").alias("version"), F.concat(F.lit("pkg:generic/"), "component").alias("purl"), F.lit("MIT").alias("license")).distinct()
    found = symbols.window(libs, refs, components, "fold").select("lib", "component", _md5("component", "release").alias("release_id"))
    told = artifact.resolve_releases(found, releases, ["lib", "component"])
    return told.select("lib", "component", F.array_join("versions", ",").alias("versions"), F.array_join("purls", ",").alias("purls"))


def tag_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    line = lambda peeled: F.concat(F.sha1(_text("o_custkey")), F.lit("\trefs/tags/t"), _text("o_orderkey"), F.lit(peeled)).alias("line")
    refs = orders.select(line("")).unionByName(orders.where("o_orderkey % 3 = 0").select(line("^{}")))
    return refdb.list_tags(refdb.parse_ls_remote(refs))


def template_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of three path templates under which a tag has its file."""
    name = F.concat(F.lit("n"), _text("s_nationkey"), F.lit(".c"))
    tags = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("v"), _text("s_suppkey")).alias("tag"), name.alias("filename"))
    at = lambda by, place: tags.where(f"s_suppkey % {by} = 0").select("tag", F.concat(F.lit(place), "filename").alias("path"))
    return refdb.first_template(tags, at(2, "").unionByName(at(3, "src/")).unionByName(at(5, "lib/")), ["lib/{filename}", "src/{filename}", "{filename}"])


def alias_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of commits with all tags of their commits."""
    orders = table(spark, sf_dir, "orders")
    contents = orders.select(F.sha1(_text("o_custkey")).alias("commit"), F.col("o_orderstatus").alias("filename"), F.sha2(_text("o_custkey"), 256).alias("sha256")).distinct()
    tags = orders.select(F.sha1(_text("o_custkey")).alias("sha"), F.concat(F.lit("t"), _text("o_orderkey")).alias("tag"))
    found = refdb.alias_contents(contents, tags)
    return found.select("filename", "sha256", F.array_join("tags", ",").alias("tags"))


def newest_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hints.newest_by_scheme(advisories._tags(spark, sf_dir).select("repo", "tag"))


def version_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    text = F.when(key % 4 == 0, F.concat(F.lit("/* x */\n  # define LIB_VERSION_STR \"v1.2."), key, F.lit("-rc\"\n"))).when(key % 4 == 1, F.concat(F.lit("made by us, Version: 3."), "p_size", F.lit(" and later")))
    text = text.when(key % 4 == 2, F.concat(F.lit("version 9.9\n#define VERSION 4."), "p_size")).otherwise("#define VERSIONS many, conversion 5.5")
    return table(spark, sf_dir, "part").select("p_partkey", hints.version_hint(text).alias("version"))


def license_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    text = F.when(key % 3 == 0, F.concat(F.lit("/* SPDX-License-Identifier: "), F.element_at(F.array(F.lit("MIT"), F.lit("GPL-2.0+")), (key % 2 + 1).cast("int")), F.lit(" */"))).otherwise("no licence")
    return table(spark, sf_dir, "part").select("p_partkey", hints.license_hint(text).alias("license"))


def path_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose paths end like known ones."""
    supplier, part = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    tail = lambda brand, n, key: F.concat(F.lit("m"), F.expr(f"{n} % 3"), F.lit("/"), brand, F.lit("/f"), F.expr(f"{n} % 7"), F.lit(".c"))
    files = supplier.select(F.col("s_suppkey").alias("file"), F.concat(F.lit("top/"), tail(F.concat(F.lit("Brand#"), F.expr("cast(s_suppkey % 30 as string)")), "s_suppkey", "")).alias("path"))
    known = part.select(tail(F.col("p_brand"), "p_size", "").alias("path"), F.col("p_type").alias("component")).distinct()
    return hints.path_hints(files, known).select("file", "known_path", "component", F.col("shared").cast("long").alias("shared"))


def member_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    member = F.when(F.col("p_partkey") % 9 > 0, F.concat(F.lit("obj/m"), "p_size", F.lit(".c.o")))
    return hints.member_stems(table(spark, sf_dir, "part").select(F.col("p_brand").alias("archive"), member.alias("member")))


def _history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(edges, ranges): customers as commits, suppliers as advisories.

    A commit follows the one of half its number, or in stretches of fifty the one before it; every seventh also merges the
    commit three before it. An advisory has a range, and every third a second one; fixes are descendants or elsewhere.
    """
    c = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer")
    line = customers.where("c_custkey > 1").select(c.alias("commit"), F.when(c % 100 < 50, F.expr("c_custkey div 2")).otherwise(c - 1).alias("parent"), F.lit(1).alias("number"))
    merge = customers.where("c_custkey % 7 = 0").select(c.alias("commit"), (c - 3).alias("parent"), F.lit(2).alias("number"))
    key = F.col("s_suppkey")
    suppliers = table(spark, sf_dir, "supplier").where("s_suppkey > 0")
    one = suppliers.select(key.alias("advisory"), key.alias("introduced"), F.when(key % 2 == 0, key * 4 + 1).alias("fixed"))
    two = suppliers.where("s_suppkey % 3 = 0").select(key.alias("advisory"), (key * 2).alias("introduced"), (key * 3 + 1).alias("fixed"))
    return line.unionByName(merge), one.unionByName(two)


def commit_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits that each advisory's ranges affect."""
    with scratch() as keep:
        return keep(cut(commits.commits_in_ranges(*_history(spark, sf_dir)), "affected"))


def release_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases (orders of every eleventh number) at their commits, the customers, that each advisory affects."""
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 11 = 0").select(F.col("o_orderkey").alias("release"), F.col("o_custkey").alias("commit"))
    edges, ranges = _history(spark, sf_dir)
    with scratch() as keep:
        return keep(cut(commits.releases_in_ranges(edges, ranges, orders), "affected"))


def discrepancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = table(spark, sf_dir, "supplier").select(F.concat(F.lit("c"), _text("s_suppkey")).alias("component"), _text("s_nationkey").alias("version"))
    detected = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("c"), _text("c_custkey")).alias("component"), F.expr("cast(c_custkey % 3 * 5 as string)").alias("version"))
    return artifact.discrepancies(declared, detected)


def tier_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of three tiers with their provenance, taken in by two profiles."""
    part = table(spark, sf_dir, "part")
    told = None
    for k, (tier, technique, _) in enumerate(artifact.TIERS):
        one = hints.with_provenance(part.where(f"p_partkey % 3 = {k}").select("p_partkey"), tier, technique, "built in" if tier == "symbol" else "on disk")
        told = one if told is None else told.unionByName(one)
    both = artifact.select_tiers(told, "compliance-safe").unionByName(artifact.select_tiers(told, "high-precision"))
    return both.groupBy("tier", "technique", "evidence_scope", "profile").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


def identity_cpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    components = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("lib"), F.concat(F.lit("pkg:generic/"), _text("s_nationkey")).alias("purl"), F.concat(F.lit("1."), _text("s_suppkey"), F.lit(" b/c")).alias("version"))
    mapping = table(spark, sf_dir, "nation").select(F.concat(F.lit("pkg:generic/"), _text("n_nationkey")).alias("purl"), F.lit("a").alias("cpe_part"), F.col("n_name").alias("cpe_vendor"), F.concat(F.lit("p+"), _text("n_regionkey")).alias("cpe_product"))
    return advisory.identity_to_cpe(components, mapping).select("lib", "cpe", "query")


def random_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records drawn at random are records, and as many as asked for."""
    drawn = profile.random_rows(table(spark, sf_dir, "orders").select("o_orderkey"), 25)
    held = drawn.join(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "left_semi")
    return held.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("n_distinct"))


def slot_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample with replacement; which rows it holds is up to the generator."""
    return profile.sample_rows(table(spark, sf_dir, "orders").select("o_orderkey"), 0.1)


QUERIES = {
    f.__name__: f
    for f in (
        tree_scan, tree_scan_root, tree_duplicates, library_layout, fingerprint_db, fingerprint_db_tags, fingerprint_db_repos, symbol_db, batch_scan_json, advisory_snapshot, near_winners, vote_report, score_report, vote_resolve,
        hash_cross_check, hash_cross_check_first, shard_eligibility, line_islands, set_jaccard, winnow_blake2b, normalized_tier, release_metadata, artifact_match, tag_listing, template_fetch, alias_contents, newest_tags,
        version_hints, license_hints, path_hints, member_stems, commit_ranges, release_ranges, discrepancies, tier_profiles, identity_cpe, random_records, slot_sample,
    )
}

_TRACKED = "text IS NOT NULL AND lang IN ('de', 'en', 'es', 'fr') AND doc_id % 8 < 4"
_TREE = f"f AS (SELECT 't' || (doc_id // 8) AS folder, lang || (doc_id % 8) || '.c' AS filename, 't' || (doc_id // 8) || '/' || lang || (doc_id % 8) || '.c' AS path, md5(text) AS md5 FROM documents WHERE {_TRACKED})"
_REF = "r AS (SELECT (CASE WHEN doc_id % 2 = 0 THEN 'a/' ELSE 'b/' END) || lang || '.c' AS path, lang || '.c' AS filename, sha256(text) AS sha256, source AS tag, length(text) AS n FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL)"
_VOTES = "v AS (SELECT l_suppkey AS file, md5((l_partkey % 20)::VARCHAR) AS md5, count(*) AS votes FROM lineitem GROUP BY 1, 2)"
_STRIP = f"trim(regexp_replace(regexp_replace(x, '(?s)/\\*.*?\\*/|//[^\\n]*', ' ', 'g'), '{ft.WHITE}', ' ', 'g'))"
_CROSS = """WITH i AS (SELECT DISTINCT substr(md5(l_partkey::VARCHAR), 1, 8) AS hash, md5(l_suppkey::VARCHAR) AS m, CASE WHEN l_orderkey % 2 = 0 THEN l_linenumber ELSE l_linenumber * 256 END AS l FROM lineitem),
t AS (SELECT l_orderkey AS file, md5(l_suppkey::VARCHAR) AS md5, CASE WHEN l_linenumber = 3 THEN reverse(substr(md5(l_partkey::VARCHAR), 1, 8)) ELSE substr(md5(l_partkey::VARCHAR), 1, 8) END AS hash, l_linenumber AS line FROM lineitem {first}),
h AS (SELECT file, t.hash, bool_or(m IS NOT NULL) AS p, coalesce(bool_or(m = md5), false) AS o, coalesce(bool_or(m = md5 AND l = line), false) AS le, coalesce(bool_or(m = md5 AND (l % 256) * 256 + l // 256 = line), false) AS be FROM t LEFT JOIN i USING (hash) GROUP BY 1, 2)
SELECT file, count(*) FILTER (p) AS present, count(*) FILTER (NOT p) AS absent, count(*) FILTER (o) AS same_md5, count(*) FILTER (le) AS same_line_le, count(*) FILTER (be) AS same_line_be FROM h GROUP BY 1"""
# every event's descendants by walking all edges
_HISTORY = """WITH RECURSIVE e AS (SELECT c_custkey AS commit, CASE WHEN c_custkey % 100 < 50 THEN c_custkey // 2 ELSE c_custkey - 1 END AS parent FROM customer WHERE c_custkey > 1
  UNION SELECT c_custkey, c_custkey - 3 FROM customer WHERE c_custkey % 7 = 0),
k AS (SELECT commit FROM e UNION SELECT parent FROM e),
r AS (SELECT s_suppkey AS advisory, s_suppkey AS introduced, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 4 + 1 END AS fixed FROM supplier WHERE s_suppkey > 0
  UNION ALL SELECT s_suppkey, s_suppkey * 2, s_suppkey * 3 + 1 FROM supplier WHERE s_suppkey > 0 AND s_suppkey % 3 = 0),
d(event, commit) AS (SELECT event, event FROM (SELECT introduced AS event FROM r UNION SELECT fixed FROM r) JOIN k ON commit = event UNION SELECT d.event, e.commit FROM d JOIN e ON e.parent = d.commit),
hit AS (SELECT advisory, i.commit FROM r JOIN d i ON i.event = introduced LEFT JOIN d f ON f.event = fixed AND f.commit = i.commit WHERE f.commit IS NULL)"""

SQL = {
    "tree_scan": f"WITH {_TREE} SELECT folder, filename, md5 FROM f",
    "tree_scan_root": f"WITH {_TREE} SELECT filename, min(path) AS path, arg_min(md5, path) AS md5 FROM f GROUP BY 1",
    "tree_duplicates": f"WITH {_TREE} SELECT filename, path FROM f QUALIFY path <> min(path) OVER (PARTITION BY filename)",
    "library_layout": "SELECT 'sdk' || p_size AS root, lower(p_type) AS toolchain, 'm' || (p_partkey % 5) AS core, 'lib' || p_partkey || CASE WHEN p_partkey % 7 = 0 THEN '.lib' ELSE '.a' END AS name, p_partkey % 7 = 0 AS late, md5(p_name) AS md5 FROM part",
    "fingerprint_db": f"WITH {_REF}, c AS (SELECT path, filename, sha256, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags, max(n) % 1000 + max(n) AS winnow_sum FROM r GROUP BY ALL), k AS (SELECT filename, count(DISTINCT path) AS n_paths FROM r GROUP BY 1) SELECT 'made/up' AS component, filename, path, sha256, tags, winnow_sum, n_paths FROM c JOIN k USING (filename)",
    "fingerprint_db_repos": f"WITH {_REF}, n AS (SELECT path, sha256, count(DISTINCT tag) AS n_tags FROM r GROUP BY 1, 2), t AS (SELECT tag, 'o/' || right(tag, 1) AS repo, path, max(sha256) AS sha256 FROM r GROUP BY ALL) SELECT tag, repo, path AS filename, sha256, n_tags FROM t JOIN n USING (path, sha256)",
    "fingerprint_db_tags": f"WITH {_REF} SELECT tag, path AS filename, min(sha256) AS sha256 FROM r GROUP BY ALL",
    "symbol_db": f"WITH {libraries._BASE} SELECT component, release, count(*) AS n_symbols, min(symbol) AS first_symbol, max(symbol) AS last_symbol, 'p[1-9]' AS prefix, 'pkg:generic/' || component AS purl FROM refs GROUP BY 1, 2",
    "batch_scan_json": """WITH m AS (SELECT 's' || l_suppkey AS library, l_returnflag AS component, array_to_string(list_sort(list(DISTINCT l_linestatus)), ',') AS releases, array_to_string(list_sort(list(DISTINCT 'p' || l_partkey))[1:10], ',') AS sample, count(DISTINCT l_partkey) AS n_known FROM lineitem WHERE l_suppkey % 3 > 0 GROUP BY 1, 2),
g AS (SELECT 's' || s_suppkey AS library FROM supplier WHERE s_acctbal >= 0), h AS (SELECT m.* FROM m JOIN g USING (library))
SELECT library, component, releases, sample, n_known, '/sdk' AS root, (SELECT count(*) FROM g) AS libs_scanned, (SELECT count(DISTINCT library) FROM h) AS hits, (SELECT count(*) FROM supplier WHERE s_acctbal < 0) AS n_errors FROM h""",
    "advisory_snapshot": f"WITH {advisories._CVES} SELECT 'u' || user_id AS label, 'c' || user_id AS name, len(ids)::BIGINT AS cve_count, coalesce(array_to_string(ids[1:6], ','), '') AS sample, CASE WHEN user_id % 10 = 0 THEN 'error' WHEN len(ids) = 0 THEN '0!' ELSE 'covered' END AS flag FROM c",
    "near_winners": f"WITH {_VOTES}, m AS (SELECT *, max(votes) OVER (PARTITION BY file) AS most FROM v) SELECT file, array_to_string(list_sort(list(md5)), ',') AS md5s FROM m WHERE votes >= 0.75 * most GROUP BY 1",
    "vote_report": f"WITH {_VOTES}, k AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY votes DESC, md5) AS place FROM v) SELECT file || ': ' || string_agg(md5 || ' ' || votes, ', ' ORDER BY place) AS line FROM k WHERE place <= 3 GROUP BY file",
    "score_report": "SELECT p_partkey || ' ' || p_name || ' ' || CASE p_partkey % 3 WHEN 0 THEN 'exact: ' || p_brand || ', ' || p_type WHEN 1 THEN 'closest: ' || printf('%.2f', round_even(p_size / 64.0, 2)) || ' ' || p_type || ', 0.12 ' || p_brand ELSE 'closest: none' END AS line FROM part",
    "vote_resolve": "WITH r AS (SELECT md5(c_custkey::VARCHAR) AS md5, c_name || '#0' AS path FROM customer WHERE c_custkey % 3 > 0), b AS (SELECT o_orderkey AS file, md5(o_custkey::VARCHAR) AS md5 FROM orders) SELECT file, md5, path, CASE WHEN substr(md5, 1, 1) > '7' THEN 'shard unavailable' WHEN path IS NULL THEN 'absent' ELSE 'resolved' END AS outcome FROM b LEFT JOIN r USING (md5)",
    "hash_cross_check": _CROSS.replace("{first}", ""),
    "hash_cross_check_first": _CROSS.replace("{first}", "QUALIFY dense_rank() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linenumber = 3 THEN reverse(substr(md5(l_partkey::VARCHAR), 1, 8)) ELSE substr(md5(l_partkey::VARCHAR), 1, 8) END) <= 2"),
    "shard_eligibility": "WITH f AS (SELECT DISTINCT p_partkey % 256 AS shard FROM part WHERE p_partkey % 9 > 0), h AS (SELECT ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 2))::INT AS shard, count(*) AS n FROM orders GROUP BY 1) SELECT 'kb/' || lpad(upper(to_hex(shard)), 2, '0') || '.ldb' AS file, shard::INT AS shard, coalesce(n, 0) AS n FROM f LEFT JOIN h USING (shard)",
    "line_islands": "WITH h AS (SELECT DISTINCT l_suppkey AS file, l_returnflag AS md5, l_partkey % 400 AS line FROM lineitem), g AS (SELECT *, CASE WHEN line - lag(line) OVER w > 2 THEN 1 ELSE 0 END AS new FROM h WINDOW w AS (PARTITION BY file, md5 ORDER BY line)), i AS (SELECT *, sum(new) OVER (PARTITION BY file, md5 ORDER BY line) AS island FROM g) SELECT file, md5, min(line)::INT AS first_line, max(line)::INT AS last_line, count(*) AS n FROM i GROUP BY file, md5, island",
    "set_jaccard": "WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN [] ELSE range(0, p_partkey % 9 + 1) END AS a, CASE WHEN p_partkey % 14 < 3 THEN [] ELSE range(2, p_partkey % 5 + 3) END AS b FROM part) SELECT p_partkey, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0::DOUBLE ELSE round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) END AS jaccard FROM s",
    "normalized_tier": f"""WITH d AS (SELECT doc_id, source, text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL), k AS (SELECT sha256({_STRIP.replace('(x,', '(text,')}) AS sha256, md5(text) AS md5, source FROM d WHERE doc_id % 2 = 0),
n AS (SELECT sha256, array_to_string(list_sort(list(DISTINCT source)), ',') AS own FROM k GROUP BY 1), s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '/* new */  ' || text || chr(10) ELSE text END AS x FROM d),
t AS (SELECT doc_id AS file, sha256({_STRIP}) AS sha256 FROM s) SELECT file, CASE WHEN own IS NOT NULL THEN 'normalized' END AS tier, own AS release_ids FROM t LEFT JOIN n USING (sha256)""",
    "release_metadata": "WITH f AS (SELECT DISTINCT l_suppkey AS lib, l_partkey AS k FROM lineitem) SELECT lib, array_to_string(list_sort(list(DISTINCT '1.' || p_size)), ',') AS versions, array_to_string(list_sort(list(DISTINCT 'pkg:generic/' || p_brand)), ',') AS purls, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS licenses FROM f JOIN part ON p_partkey = k WHERE p_size > 5 GROUP BY 1",
    "artifact_match": f"WITH w AS ({libraries.SQL['symbol_window_fold']}) SELECT lib, component, array_to_string(list_sort(list(DISTINCT release)), ',') AS versions, 'pkg:generic/' || component AS purls FROM w GROUP BY 1, 2",
    "tag_listing": "SELECT DISTINCT 't' || o_orderkey AS tag FROM orders",
    "template_fetch": "SELECT 'v' || s_suppkey AS tag, 'n' || s_nationkey || '.c' AS filename, CASE WHEN s_suppkey % 5 = 0 THEN 'lib/' WHEN s_suppkey % 3 = 0 THEN 'src/' ELSE '' END || 'n' || s_nationkey || '.c' AS path FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0 OR s_suppkey % 5 = 0",
    "alias_contents": "WITH c AS (SELECT DISTINCT o_custkey, o_orderstatus AS filename FROM orders) SELECT filename, sha256(c.o_custkey::VARCHAR) AS sha256, array_to_string(list_sort(list(DISTINCT 't' || o_orderkey)), ',') AS tags FROM c JOIN orders USING (o_custkey) GROUP BY 1, 2",
    "newest_tags": f"WITH {advisories._TAG}, n AS (SELECT repo, tag, regexp_extract(tag, '^[^\\d]*', 0) AS head, list_transform(regexp_extract_all(tag, '\\d{{1,9}}'), lambda x: x::BIGINT) AS v FROM g) SELECT repo, head || ':' || len(v) AS scheme, arg_max(tag, v) AS tag FROM n GROUP BY 1, 2",
    "version_hints": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '1.2.' || p_partkey || '-rc' WHEN 1 THEN '3.' || p_size WHEN 2 THEN '4.' || p_size END AS version FROM part",
    "license_hints": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'MIT' ELSE 'GPL-2.0+' END END AS license FROM part",
    "path_hints": """WITH f AS (SELECT s_suppkey AS file, 's' AS t, 'Brand#' || (s_suppkey % 30) AS brand, s_suppkey % 7 AS f, s_suppkey % 3 AS m FROM supplier), k AS (SELECT DISTINCT p_brand AS brand, p_size % 7 AS f, p_size % 3 AS m, p_type AS component FROM part)
SELECT file, 'm' || k.m || '/' || k.brand || '/f' || k.f || '.c' AS known_path, component, CASE WHEN f.m = k.m THEN 3 ELSE 2 END::BIGINT AS shared FROM f JOIN k USING (brand, f)""",
    "member_stems": "SELECT DISTINCT p_brand AS lib, 'm' || p_size || '.c' AS symbol FROM part WHERE p_partkey % 9 > 0",
    "commit_ranges": f"{_HISTORY} SELECT DISTINCT advisory, commit FROM hit",
    "release_ranges": f"{_HISTORY} SELECT DISTINCT advisory, o_orderkey AS release, commit FROM hit JOIN orders ON o_custkey = commit WHERE o_orderkey % 11 = 0",

    "discrepancies": """WITH a AS (SELECT 'c' || s_suppkey AS component, s_nationkey::VARCHAR AS declared_version FROM supplier), b AS (SELECT 'c' || c_custkey AS component, (c_custkey % 3 * 5)::VARCHAR AS detected_version FROM customer WHERE c_custkey % 2 = 0)
SELECT component, declared_version, detected_version, CASE WHEN declared_version IS NULL THEN 'undeclared' WHEN detected_version IS NULL THEN 'not found' WHEN declared_version = detected_version THEN 'agrees' ELSE 'differs' END AS state FROM a FULL JOIN b USING (component)""",
    "tier_profiles": """WITH t AS (SELECT p_partkey, p_partkey % 3 AS k FROM part), n AS (SELECT CASE k WHEN 0 THEN 'exact' WHEN 1 THEN 'winnowing' ELSE 'symbol' END AS tier, CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END::INT AS technique, CASE WHEN k = 2 THEN 'built in' ELSE 'on disk' END AS evidence_scope, p_partkey FROM t),
p AS (SELECT *, unnest(CASE tier WHEN 'exact' THEN ['compliance-safe', 'high-precision'] WHEN 'winnowing' THEN ['compliance-safe'] ELSE ['high-precision'] END) AS profile FROM n) SELECT tier, technique, evidence_scope, profile, count(*) AS n, min(p_partkey) AS first FROM p GROUP BY ALL""",
    "identity_cpe": "WITH c AS (SELECT s_suppkey AS lib, 'cpe:2.3:a:' || n_name || ':p+' || n_regionkey || ':1.' || s_suppkey || ' b/c' AS cpe FROM supplier JOIN nation ON n_nationkey = s_nationkey) SELECT lib, cpe, replace(replace(replace(cpe, ':', '%3A'), '+', '%2B'), ' ', '%20') AS query FROM c",
    "random_records": "SELECT least(25, count(*)) AS n, least(25, count(*)) AS n_distinct FROM orders",
}
