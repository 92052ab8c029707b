"""Queries of the knowledge base: artifacts, shards, fingerprint text, archives, incremental scans."""

from __future__ import annotations

import struct
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions import sketch
from provena.functions import text as ft
from provena.operators import artifact, profile, vote
from provena.sources import archive, ldb, wfp
from provena.session import cut, one_at_once, shared_path, table
from provena.streaming import incremental


def _declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared records: a release is a part; every third has fewer fields, every seventh a surplus one."""
    part = table(spark, sf_dir, "part")
    fields = F.concat_ws(",", "p_type", F.col("p_brand"), F.concat(F.lit("1."), "p_size"), F.lit("2024-01-01"), F.lit("MIT"), F.concat(F.lit("pkg:generic/"), "p_brand"), F.lit("http://x/y"))
    record = F.when(F.col("p_partkey") % 3 == 0, F.substring_index(fields, ",", 4)).when(F.col("p_partkey") % 7 == 0, F.concat(fields, F.lit(",more"))).otherwise(fields)
    rows = part.select(F.md5(F.col("p_partkey").cast("string")).alias("release_id"), F.lit(0).alias("rec_no"), record.alias("record"))
    return rows.unionByName(rows.select("release_id", F.lit(1).alias("rec_no"), F.lit("later,record,is,not,used").alias("record")))


def declared_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifact.releases_of(_declared(spark, sf_dir))


def exact_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    record = F.concat(F.unhex(F.md5("source")), F.when(F.col("doc_id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("src/é"), "doc_id")).cast("binary"))
    told = docs.select(F.md5("text").alias("md5"), F.col("doc_id").alias("rec_no"), ft.release_and_path(record).alias("r")).select("md5", "rec_no", "r.*")
    found = artifact.exact_tier(told)
    return found.select("md5", F.array_join("release_ids", ",").alias("release_ids"), "path")


def reconcile_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol references by brand against base releases of the suppliers' nations; ids are reused or minted, then merged."""
    part = table(spark, sf_dir, "part")
    refs = part.select(F.col("p_brand").alias("component"), F.concat(F.lit("v1."), "p_size").alias("tag"), F.col("p_partkey").alias("tag_ord"), F.concat(F.lit("p"), "p_partkey").alias("symbol"))
    brand = F.col("p_brand")
    meta = part.select(brand.alias("component"), F.when(brand.endswith("1"), "").otherwise(F.concat(F.lit("pkg:x/"), brand)).alias("purl"), F.when(brand.endswith("2"), F.lit(None)).otherwise("MIT").alias("license"), F.lit("").alias("vendor"), F.lit("p").alias("prefix")).distinct()
    base = table(spark, sf_dir, "supplier").select(
        F.md5(F.col("s_suppkey").cast("string")).alias("release_id"), F.lit("v").alias("vendor"), F.concat(F.lit("BRAND#"), F.col("s_nationkey").cast("string")).alias("component"),
        F.concat(F.lit("1."), (F.col("s_suppkey") % 50).cast("string")).alias("version"), F.lit(artifact.NO_DATE).alias("date"), F.lit("MIT").alias("license"), F.lit("p").alias("purl"), F.lit("u").alias("url"), F.lit("file").alias("source_tier"),
    )
    tier, minted = artifact.build_symbol_fragment(refs, meta, base)
    merged = artifact.merge_releases(base, minted)
    n = artifact.merge_symbol_tiers(tier).groupBy("release_id").agg(F.count("*").alias("n_symbols"))
    return merged.join(n, "release_id", "left").select("release_id", "component", "version", "license", "purl", "source_tier", F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"))


def artifact_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables to a JSON document of schema 2 and back: counts by tier."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    releases = artifact.releases_of(_declared(spark, sf_dir))
    exact = artifact.exact_tier(docs.select(F.md5("text").alias("md5"), F.col("doc_id").alias("rec_no"), F.md5("source").alias("release_id"), F.col("lang").alias("path")))
    index = docs.select(F.substring(F.sha1("text"), 1, 8).alias("hash"), F.md5("text").alias("md5"), (F.col("doc_id") % 100).cast("int").alias("line"))
    symbol = docs.select(F.col("lang").alias("component"), F.lit("s").alias("prefix"), F.md5("source").alias("release_id"), F.concat(F.lit("s"), F.expr("doc_id % 50")).alias("symbol"))
    path = shared_path(spark, "artifact")
    artifact.write_json(path, releases, exact, index, symbol, parts=8)
    back = artifact.read_json(spark, path)
    files = back["exact"].agg(F.sum(F.size("release_ids")).alias("pairs"), F.count("*").alias("files"), F.sum(F.length("path")).cast("long").alias("path_chars"))
    lines = back["wfp"].agg(F.count_distinct("hash").alias("hashes"), F.count("*").alias("postings"), F.sum("line").alias("lines"))
    rel = back["releases"].agg(F.count("*").alias("releases"), F.count_if(F.col("source_tier") == "file").alias("from_files"))
    symbols = back["symbol"].agg(F.count("*").alias("symbols"), F.count_distinct("release_id").alias("symbol_releases"))
    return files.crossJoin(lines).crossJoin(rel).crossJoin(symbols)  # one row each


def _shards(spark: SparkSession, sf_dir: str) -> str:
    """All documents as a shard table in the shared folder: key md5 of the text (its first digit one of four, so four
    shards), record source,url,count."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    key = F.concat(F.lit("0"), (F.col("doc_id") % 4).cast("string"), F.substring(F.md5("text"), 3, 30))
    record = F.concat_ws(",", "source", F.concat(F.lit("http://h"), F.col("lang"), F.lit("/x")), (F.col("doc_id") % 9).cast("string"))
    folder = shared_path(spark, "shards")
    ldb.write_shards(docs.select(F.unhex(key).alias("key"), record.cast("binary").alias("record")), folder)
    ldb.register(spark)
    return folder


def _read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("ldb").option("slot_parts", 2).load(folder)


def ldb_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, _shards(spark, sf_dir)).select("key", ft.split_record(F.col("record").cast("string")).alias("r"))
    return rows.select("key", "r.path", "r.url", "r.cnt")


def ldb_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, _shards(spark, sf_dir)).where(F.col("key").startswith("01a"))
    return rows.select("key", F.col("record").cast("string").alias("record"))


def ldb_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of every third document's key and of as many absent ones, of which only the slots are read."""
    docs = table(spark, sf_dir, "documents")
    key = F.concat(F.lit("0"), (F.col("doc_id") % 4).cast("string"), F.substring(F.md5("text"), 3, 30))
    asked = docs.where("text is not null").select(F.when(F.col("doc_id") % 3 == 0, F.upper(key)).otherwise(F.md5(F.col("doc_id").cast("string"))).alias("key"))
    found = ldb.probe(asked, _shards(spark, sf_dir))
    return found.select("key", F.col("record").cast("string").alias("record"))


def wfp_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's parts as hashes of a file, checked against shards of fixed records (content and line) by a probe."""
    line = table(spark, sf_dir, "lineitem")
    hash_ = F.substring(F.md5(F.concat(F.lit("w"), (F.col("l_partkey") % 997).cast("string"))), 1, 6)
    own = F.concat(F.lit("1"), F.substring(F.md5((F.col("l_suppkey") % 3).cast("string")), 1, 1), hash_)
    number = (F.col("l_partkey") % 700).cast("int")
    le = F.concat(F.lpad(F.hex(number % 256), 2, "0"), F.lpad(F.hex(F.floor(number / 256)), 2, "0"))
    held = line.where("l_returnflag <> 'N'").select(own.alias("h"), F.unhex(F.concat(F.md5(F.col("l_orderkey").cast("string")), le)).alias("record"))
    folder = shared_path(spark, "hash-shards")
    ldb.write_shards(held.select(F.unhex("h").alias("key"), "record"), folder, record_len=18)
    files = line.select(F.col("l_orderkey").alias("file"), F.md5(F.col("l_orderkey").cast("string")).alias("md5"), own.alias("hash"), number.alias("line")).distinct()
    found = ldb.probe(files.select(F.col("hash").alias("key")), folder, record_len=18)
    low, high = (F.conv(F.hex(F.substring("record", 17 + i, 1)), 16, 10).cast("int") for i in (0, 1))
    index = found.select(F.col("key").alias("hash"), F.lower(F.hex(F.substring("record", 1, 16))).alias("md5"), (low + 256 * high).alias("line")).distinct()
    return vote.cross_check(files, index).select(F.col("file").alias("l_orderkey"), "present", "absent", "same_md5", "same_line_le", "same_line_be")


def ldb_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.record_stats(_read(spark, _shards(spark, sf_dir)))


def wfp_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches rendered as fingerprint text and parsed again."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    line = lambda i: F.struct(F.lit(i).alias("line"), F.upper(F.regexp_replace(F.substring(F.sha1(F.concat("text", F.lit(str(i)))), 1, 8), "^0+", "")).alias("hash"))
    rows = docs.select(F.concat(F.lit("a,b/"), F.col("doc_id").cast("string")).alias("path"), F.md5("text").alias("md5"), F.length("text").cast("long").alias("size"), F.inline(F.array(line(1), line(7), line(7), line(20))))
    return wfp.parse(wfp.render(rows)).select("path", "md5", "size", F.col("line").cast("long").alias("line"), "hash")


def elf_archive(members: Iterable[tuple[str, list[tuple[str, int, int, int]]]], wide: bool = True) -> bytes:
    """An archive of relocatable files with the given (symbol, bind, type, section); a member without symbols is text."""
    out = bytearray(archive.AR_MAGIC)
    for name, symbols in members:
        body = _elf(symbols, wide) if symbols else b"not an object"
        out += f"{name + '/':<16}{0:<12}{0:<6}{0:<6}{644:<8}{len(body):<10}`\n".encode()
        out += body
        out += b"\n" * (len(body) % 2)
    return bytes(out)


def _elf(symbols: list[tuple[str, int, int, int]], wide: bool) -> bytes:
    names, table_, at = b"\0", b"", 1
    for name, bind, kind, section in [("", 0, 0, 0), *symbols]:
        info = bind << 4 | kind
        where = at if name else 0
        table_ += struct.pack("<IBBHQQ", where, info, 0, section, 0, 0) if wide else struct.pack("<IIIBBH", where, 0, 0, info, 0, section)
        names += name.encode() + b"\0" if name else b""
        at = len(names)
    head = 64 if wide else 52
    start, text, sections = head, head + len(table_), head + len(table_) + len(names)
    ident = b"\x7fELF" + bytes([2 if wide else 1, 1, 1]) + b"\0" * 9
    if wide:
        header = ident + struct.pack("<HHIQQQIHHHHHH", 1, 62, 1, 0, 0, sections, 0, 64, 0, 0, 64, 3, 2)
        part = lambda kind, a, n, link, each: struct.pack("<IIQQQQIIQQ", 0, kind, 0, 0, a, n, link, 0, 8, each)
    else:
        header = ident + struct.pack("<HHIIIIIHHHHHH", 1, 3, 1, 0, 0, sections, 0, 52, 0, 0, 40, 3, 2)
        part = lambda kind, a, n, link, each: struct.pack("<10I", 0, kind, 0, 0, a, n, link, 0, 4, each)
    return header + table_ + names + part(0, 0, 0, 0, 0) + part(archive.SYMTAB, start, len(table_), 2, 24 if wide else 16) + part(3, text, len(names), 0, 0)


def ar_elf_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive for each brand, a member for each part, written and read: defined external symbols by archive."""
    part = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size")

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("p_partkey")
        members = ((f"m{k % 1000}.o", [(f"part_{k}", 1 + (k % 2), 1 + (k % 3), k % 5), (f"local_{k}", 0, 2, 1)] if s % 10 else []) for k, s in zip(rows["p_partkey"].tolist(), rows["p_size"].tolist()))
        data = elf_archive(members, wide=key[0].endswith("1"))
        return pd.DataFrame({"archive": [key[0]], "content": [data[:-3] if key[0] == "Brand#7" else data]})

    made = cut(part.groupBy("p_brand").applyInPandas(build, "archive string, content binary"), "archives")
    with one_at_once(spark):
        return archive.defined_globals(cut(archive.read_libraries(made), "archive-rows"))  # a table, as two jobs read it


def incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over the documents' files that keeps each content once: the hashes by language."""
    docs = table(spark, sf_dir, "documents")
    source, target, marks = (shared_path(spark, n) for n in ("incoming", "scanned", "stream-marks"))
    docs.where("text is not null").select("doc_id", "lang", "text").write.parquet(source)
    files = incremental.stream_files(spark, source, "doc_id long, lang string, text string").select("text")
    incremental.scan_available(files, target, marks)
    return spark.read.parquet(target).select("sha256")


QUERIES = {f.__name__: f for f in (declared_releases, exact_tier, reconcile_releases, artifact_roundtrip, ldb_roundtrip, ldb_prefix, ldb_probe, wfp_probe, ldb_profile, wfp_parse, ar_elf_symbols, incremental_scan)}

_W = ft.WHITE
_REC = "d AS (SELECT '0' || (doc_id % 4) || substr(md5(text), 3, 30) AS key, source AS path, 'http://h' || lang || '/x' AS url, doc_id % 9 AS cnt FROM documents WHERE text IS NOT NULL)"
_DECL = """x AS (SELECT p_partkey, md5(p_partkey::VARCHAR) AS release_id, p_type || ',' || p_brand || ',1.' || p_size || ',2024-01-01' AS four, ',MIT,pkg:generic/' || p_brand || ',http://x/y' AS rest FROM part),
y AS (SELECT release_id, string_split(CASE WHEN p_partkey % 3 = 0 THEN four WHEN p_partkey % 7 = 0 THEN four || rest || ',more' ELSE four || rest END, ',') AS f FROM x)"""
SQL = {
    "declared_releases": f"WITH {_DECL} SELECT release_id, f[1] AS vendor, f[2] AS component, f[3] AS version, f[4] AS date, f[5] AS license, f[6] AS purl, f[7] AS url, 'file' AS source_tier FROM y",
    "exact_tier": "SELECT md5(text) AS md5, array_to_string(list_sort(list(DISTINCT md5(source))), ',') AS release_ids, coalesce(arg_min('src/é' || doc_id, doc_id) FILTER (doc_id % 4 <> 0), '') AS path FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "reconcile_releases": """WITH b AS (SELECT md5(s_suppkey::VARCHAR) AS release_id, 'BRAND#' || s_nationkey AS component, '1.' || (s_suppkey % 50) AS version, 'MIT' AS license, 'p' AS purl, 'file' AS source_tier FROM supplier),
i AS (SELECT lower(component) AS c, version AS v, max(release_id) AS id FROM b GROUP BY 1, 2),
r AS (SELECT p_brand AS component, '1.' || p_size AS version, count(*) FILTER (p_partkey = k) AS n FROM (SELECT *, max(p_partkey) OVER (PARTITION BY p_brand, p_size) AS k FROM part) GROUP BY 1, 2),
m AS (SELECT r.component, r.version, n, id, CASE WHEN r.component LIKE '%1' THEN 'pkg:generic/' || r.component ELSE 'pkg:x/' || r.component END AS purl, CASE WHEN r.component LIKE '%2' THEN 'NOASSERTION' ELSE 'MIT' END AS license FROM r LEFT JOIN i ON c = lower(r.component) AND v = r.version),
z AS (SELECT coalesce(id, md5(purl || '@' || version)) AS release_id, component, version, license, purl, 'symbol' AS source_tier, n, id IS NULL AS minted FROM m)
SELECT b.release_id, b.component, b.version, b.license, b.purl, b.source_tier, coalesce(z.n, 0) AS n_symbols FROM b LEFT JOIN z ON z.release_id = b.release_id UNION ALL SELECT release_id, component, version, license, purl, source_tier, n FROM z WHERE minted""",
    "artifact_roundtrip": """WITH d AS (SELECT * FROM documents WHERE text IS NOT NULL), e AS (SELECT md5(text) AS m, count(DISTINCT source) AS n, arg_min(lang, doc_id) AS p FROM d GROUP BY 1)
SELECT (SELECT sum(n) FROM e)::BIGINT AS pairs, (SELECT count(*) FROM e) AS files, (SELECT sum(length(p)) FROM e)::BIGINT AS path_chars, count(DISTINCT substr(sha1(text), 1, 8)) AS hashes, count(*) AS postings, sum(doc_id % 100)::BIGINT AS lines,
(SELECT count(*) FROM part) AS releases, (SELECT count(*) FROM part) AS from_files, count(DISTINCT (lang, source, doc_id % 50)) AS symbols, count(DISTINCT source) AS symbol_releases FROM d""",
    "ldb_roundtrip": f"WITH {_REC} SELECT key, path, url, cnt FROM d",
    "ldb_prefix": f"WITH {_REC} SELECT key, path || ',' || url || ',' || cnt AS record FROM d WHERE starts_with(key, '01a')",
    "ldb_probe": f"WITH {_REC}, a AS (SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN '0' || (doc_id % 4) || substr(md5(text), 3) ELSE md5(doc_id::VARCHAR) END AS key FROM documents WHERE text IS NOT NULL) SELECT key, path || ',' || url || ',' || cnt AS record FROM d SEMI JOIN a USING (key)",
    "wfp_probe": """WITH l AS (SELECT l_orderkey, md5(l_orderkey::VARCHAR) AS own, '1' || substr(md5((l_suppkey % 3)::VARCHAR), 1, 1) || substr(md5('w' || (l_partkey % 997)), 1, 6) AS hash, l_partkey % 700 AS line, l_returnflag FROM lineitem),
x AS MATERIALIZED (SELECT DISTINCT hash, own, line FROM l WHERE l_returnflag <> 'N'), f AS (SELECT DISTINCT l_orderkey, own, hash, line FROM l),
c AS (SELECT l_orderkey, hash, max((EXISTS (SELECT 1 FROM x WHERE x.hash = f.hash))::INT) AS p, max((EXISTS (SELECT 1 FROM x WHERE x.hash = f.hash AND x.own = f.own))::INT) AS o,
  max((EXISTS (SELECT 1 FROM x WHERE x.hash = f.hash AND x.own = f.own AND x.line = f.line))::INT) AS le, max((EXISTS (SELECT 1 FROM x WHERE x.hash = f.hash AND x.own = f.own AND x.line % 256 * 256 + x.line // 256 = f.line))::INT) AS be FROM f GROUP BY 1, 2)
SELECT l_orderkey, sum(p)::BIGINT AS present, sum(1 - p)::BIGINT AS absent, sum(o)::BIGINT AS same_md5, sum(le)::BIGINT AS same_line_le, sum(be)::BIGINT AS same_line_be FROM c GROUP BY 1""",
    "ldb_profile": f"WITH {_REC} SELECT 3 AS n_fields, count(*) AS n, count(DISTINCT key) AS slots, count(*) AS records, 0 AS bad_utf8 FROM d",
    "wfp_parse": "WITH d AS (SELECT 'a,b/' || doc_id AS path, md5(text) AS md5, length(text) AS size, text, unnest([1, 7, 7, 20]) AS line FROM documents WHERE text IS NOT NULL) SELECT path, md5, size, line, substr(sha1(text || line), 1, 8) AS hash FROM d",
    "ar_elf_symbols": "WITH p AS (SELECT p_brand AS archive, p_partkey AS k, p_size, max(p_partkey) OVER (PARTITION BY p_brand, p_partkey % 1000) AS last FROM part) SELECT archive, 'part_' || k AS symbol FROM p WHERE k = last AND p_size % 10 <> 0 AND k % 5 <> 0 AND k % 3 < 2 AND archive <> 'Brand#7'",
    "incremental_scan": f"SELECT DISTINCT sha256(trim(regexp_replace(regexp_replace(text, '(?s)/\\*.*?\\*/|//[^\\n]*', ' ', 'g'), '{_W}', ' ', 'g'))) AS sha256 FROM documents WHERE text IS NOT NULL",
}
