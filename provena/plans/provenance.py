"""Queries of source-tree identification over the driver's documents.

A file is a document, its name the language, its release tag the source. Documents of the lower 60 % of ids are the
reference, the others are targets, eight ids to a tree; made-up trees (verbatim, mixed, edited and foreign copies) cover
the verdicts that the raw split does not reach.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions import sketch
from provena.functions import text as ft
from provena.operators import match, refdb, verdict, vote
from provena.session import bound_batches, cut, scratch, spread, table

REQUIRED = ["de", "en", "es", "fr"]
WHITE = ft.WHITE


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").where("text is not null and doc_id is not null"))


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(reference, targets): doc_id, filename, tag, text."""
    docs = _documents(spark, sf_dir).select("doc_id", F.col("lang").alias("filename"), F.col("source").alias("tag"), "text")
    end = table(spark, sf_dir, "documents").agg(F.floor(0.6 * (F.max("doc_id") + 1)).alias("end")).scalar()
    return docs.where(F.col("doc_id") < end), docs.where(F.col("doc_id") >= end)


def _comma(c) -> F.Column:
    return F.array_join(c, ",")


def normalize_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat("text", F.lit(" /* of "), "source", F.lit(" */\t// "), "lang").alias("text"))
    norm = ft.normalize(F.col("text"))
    return docs.select("doc_id", ft.sha256_hex(norm).alias("sha256"), ft.md5_hex(F.col("text")).alias("md5"), F.length(norm).cast("long").alias("n_norm"))


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").where("text is not null"))
    return docs.select(F.col("lang").alias("filename"), F.col("source").alias("tag"), ft.sha256_hex(ft.normalize(F.col("text"))).alias("sha256"))


def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refdb.content_table(_hashed(spark, sf_dir)).select("filename", "sha256", _comma("tags").alias("tags"), F.size("tags").cast("long").alias("n_tags"))


def tag_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refdb.tag_table(_hashed(spark, sf_dir)).select("tag", F.explode("files").alias("filename", "sha256"))


def build_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refdb.build_stats(_hashed(spark, sf_dir))


def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, targets = _split(spark, sf_dir)
    sha = ft.sha256_hex(ft.normalize(F.col("text"))).alias("sha256")
    found = match.exact_tags(targets.select("doc_id", "filename", sha), refdb.content_table(ref.select("filename", "tag", sha)))
    return found.select("doc_id", "filename", _comma("exact_matches").alias("tags"))


def winnow_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", ft.normalize(F.col("text")).alias("t"))
    return docs.select("doc_id", F.explode(sketch.winnow(F.col("t"), hash_name="md5")).alias("hash"))


def line_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = _documents(spark, sf_dir)
    return docs.select("doc_id", F.inline(sketch.line_sketch(F.col("text").cast("binary")))).select("doc_id", "hash", "line")


def _contents(ref: DataFrame) -> DataFrame:
    """filename, sha256, winnow, tags; every distinct text is sketched once."""
    sha = ref.select("filename", "tag", ft.normalize(F.col("text")).alias("_n")).withColumn("sha256", ft.sha256_hex(F.col("_n")))
    contents = sha.groupBy("filename", "sha256").agg(F.array_sort(F.collect_set("tag")).alias("tags"), F.any_value("_n").alias("_n"))
    return contents.select("filename", "sha256", "tags", sketch.winnow(F.col("_n"), hash_name="md5").alias("winnow"))


def _targets(files: DataFrame) -> DataFrame:
    norm = ft.normalize(F.col("text"))
    return files.withColumn("_n", norm).withColumn("sha256", ft.sha256_hex(F.col("_n"))).withColumn("winnow", sketch.winnow(F.col("_n"), hash_name="md5")).drop("_n", "text")


def similarity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, targets = _split(spark, sf_dir)
    told = _targets(targets.select(F.col("doc_id").alias("target"), "filename", "text"))
    found = match.similar(told, _contents(ref))
    return found.select(F.col("target").alias("doc_id"), F.col("rank").cast("long").alias("rank"), "tag", F.round("score", 6).alias("score"))


def tree_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(reference, files: group, filename, path, text) with the made-up trees."""
    ref, targets = _split(spark, sf_dir)
    raw = targets.select(F.concat(F.lit("tree-"), F.expr("doc_id div 8")).alias("group"), "filename", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), "text")
    one = ref.groupBy("tag", "filename").agg(F.min_by("text", "doc_id").alias("text"))
    path = F.lit("a").alias("path")
    named = lambda kind, text: one.select(F.concat(F.lit(f"{kind}-"), "tag").alias("group"), "filename", path, text.alias("text"))
    note = F.concat("text", F.lit(" an appended remark on "), "tag")
    latin = F.col("filename").isin("en", "fr")
    other = one.where("tag = 'src0' and filename in ('de', 'es')").select("filename", "text")
    mixed = one.where(latin).select(F.concat(F.lit("mixed-"), "tag").alias("group"), "filename", path, "text")
    mixed = mixed.unionByName(one.select(F.concat(F.lit("mixed-"), "tag").alias("group")).distinct().withColumn("filename", F.explode(F.array(F.lit("de"), F.lit("es")))).join(other, "filename").select("group", "filename", path, "text"))
    item = table(spark, sf_dir, "benchmark")
    alien = item.select(F.concat(F.lit("alien-"), F.expr("item_id div 4")).alias("group"), F.element_at(F.array(*[F.lit(x) for x in REQUIRED]), (F.col("item_id") % 4 + 1).cast("int")).alias("filename"), path, "text")
    parts = [raw, named("copy", F.col("text")), mixed, named("edit", F.when(latin, F.col("text")).otherwise(note)), named("loose", note), alien]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return ref, out


def _verdicts(spark: SparkSession, sf_dir: str, floor: float | None) -> DataFrame:
    ref, files = tree_files(spark, sf_dir)
    with scratch() as keep:
        told = match.file_results(_targets(verdict.first_file(files)), _contents(ref))
        found = verdict.tree_verdicts(told, REQUIRED, floor)
        found = keep(cut(found.select("group", "verdict", _comma("tags").alias("tags"), _comma("missing").alias("missing")), "tree-verdicts"))
    return found


def tree_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir, verdict.FLOOR)


def tree_verdict_nofloor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir, None)


def _hash_text(h) -> F.Column:
    return F.lower(F.lpad(F.hex(h), 8, "0")).alias("hash")


def _sketch() -> F.Column:
    return sketch.winnow(ft.normalize(F.col("text")), hash_name="md5")


def _postings(texts: DataFrame) -> DataFrame:
    """hash, md5, line of every distinct text."""
    contents = texts.select(F.md5("text").alias("md5"), "text").dropDuplicates(["md5"])
    return contents.select("md5", F.posexplode(_sketch()).alias("line", "h")).select(_hash_text(F.col("h")), "md5", "line")


def _known_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index: hash, md5, line of all benchmark items; sketches: file, hashes of all documents; targets: file, hash, those in the index).

    Index and sketches are tables: a text is sketched once, and only hashes that the index has become rows.
    """
    docs, items = _documents(spark, sf_dir), table(spark, sf_dir, "benchmark").where("text is not null")
    index = cut(_postings(items), "item-index")
    mine = docs.select(F.col("doc_id").alias("file"), _sketch().alias("hashes"))
    mine = cut(mine.groupBy("file").agg(F.array_distinct(F.flatten(F.collect_list("hashes"))).alias("hashes")), "document-sketches")
    rows = mine.select("file", F.explode("hashes").alias("h")).select("file", _hash_text(F.col("h")))
    return index, mine, rows.join(index.select("hash").distinct(), "hash", "left_semi")


def wfp_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all documents and benchmark items."""
    texts = _documents(spark, sf_dir).select("text").unionByName(table(spark, sf_dir, "benchmark").where("text is not null").select("text"))
    contents = texts.select(F.md5("text").alias("md5"), "text").dropDuplicates(["md5"])
    # numbers and bytes, half as long as their text and in the same order
    rows = contents.select(F.unhex("md5").alias("md5"), F.explode(_sketch()).alias("h"))
    found = rows.groupBy("h").agg(F.count("*").alias("n_contents"), F.min("md5").alias("md5"))
    return found.select(_hash_text(F.col("h")), "n_contents", F.lower(F.hex("md5")).alias("first_md5"))


def wfp_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch() as keep:
        index, _, mine = _known_items(spark, sf_dir)
        found = vote.winners(vote.votes(mine, index)).select(F.col("file").alias("doc_id"), "md5", "votes", "candidates")
        return keep(cut(found, "winners"))


def vote_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch() as keep:
        index, _, mine = _known_items(spark, sf_dir)
        return keep(cut(vote.histogram(vote.votes(mine, index)).select(F.col("file").alias("doc_id"), "votes", "n"), "vote-histogram"))


def snippet_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch() as keep:
        index, sketches, mine = _known_items(spark, sf_dir)
        known = vote.usable(mine, index).select("file", "usable")
        counts = sketches.select("file", F.size("hashes").cast("long").alias("n_hashes")).where("n_hashes > 0").join(known, "file", "left")
        found = vote.accept(counts.withColumn("usable", F.coalesce("usable", F.lit(0))), vote.winners(vote.votes(mine, index)))
        told = found.select(F.col("file").alias("doc_id"), "md5", "votes", "n_hashes", "usable", F.round("ratio", 6).alias("ratio"), "accepted")
        return keep(cut(told, "snippets"))


def artifact_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, targets = (x.select("doc_id", "tag", F.md5("text").alias("md5"), _sketch().alias("hashes")) for x in _split(spark, sf_dir))
    with scratch() as keep:
        known = cut(ref.groupBy("md5").agg(F.array_sort(F.collect_set("tag")).alias("release_ids"), F.any_value("hashes").alias("hashes")), "contents")
        files = cut(targets.select(F.col("doc_id").alias("file"), "md5", "hashes"), "files")
        exact = known.select("md5", "release_ids")
        # a file that the exact tier knows is not asked for snippets
        others = files.join(exact.select("md5"), "md5", "left_anti").select("file", "hashes")
        found = vote.tier_matches(files.select("file", "md5"), exact, vote.accepted(others, known.select("md5", "hashes")))
        told = keep(cut(verdict.artifact_verdicts(found.withColumn("group", F.expr("file div 8"))), "artifact-verdicts"))
    return told.select("group", "verdict", _comma("release_ids").alias("release_ids"), "n_matched")


def license_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared against detected licence: the raw text's licence line, and what the source declares."""
    docs = spread(table(spark, sf_dir, "documents").where("text is not null"))
    named = F.nullif(F.regexp_extract("text", LICENSE_LINE, 1), F.lit(""))
    declared = F.when(F.col("source").isin("src0", "src1"), "MIT").otherwise("Apache")
    found = docs.select("doc_id", declared.alias("declared"), F.regexp_extract(named, r"^(\w+)", 1).alias("detected")).where("detected is not null and detected <> ''")
    return found.withColumn("agrees", F.col("declared") == F.col("detected"))


# Fixed value: the licence line that is looked for.
LICENSE_LINE = r"(?:[Ll]icensed|[Rr]eleased) under (?:the )?([A-Z][A-Za-z-]+)"

QUERIES = {
    f.__name__: f
    for f in (
        normalize_hash, content_dedup, tag_index, build_stats, exact_match, winnow_fingerprint, line_sketch, similarity_topk, tree_verdict,
        tree_verdict_nofloor, wfp_index, wfp_vote, vote_histogram, snippet_accept, artifact_verdict, license_check,
    )
}


# ---- the same in SQL -------------------------------------------------------------------------------------------------


def _norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '(?s)/\*.*?\*/|//[^\n]*', ' ', 'g'), '{WHITE}', ' ', 'g'))"


_SPLIT = """cutoff AS (SELECT CAST(floor(0.6 * (max(doc_id) + 1)) AS BIGINT) AS c FROM documents),
ref AS (SELECT doc_id, lang AS filename, source AS tag, text FROM documents, cutoff WHERE doc_id < c AND text IS NOT NULL),
tgt AS (SELECT doc_id, lang AS filename, source AS tag, text FROM documents, cutoff WHERE doc_id >= c AND text IS NOT NULL)"""


def _winnow(src: str, out: str) -> str:
    """CTEs: out(k, h) of src(k, t), t normalised and not empty."""
    hx = lambda g: f"('0x' || substr(md5({g}), 1, 8))::BIGINT"
    return f"""{out}_g AS (SELECT k, p, {hx('substr(t, p, 30)')} AS h, n FROM (SELECT k, t, length(t) - 29 AS n, unnest(range(1, length(t) - 28)) AS p FROM {src} WHERE length(t) > 30)),
{out}_w AS (SELECT k, p, n, min(h) OVER (PARTITION BY k ORDER BY p ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS h FROM {out}_g),
{out} AS (SELECT DISTINCT k, h FROM {out}_w WHERE p <= n - 49 OR n < 50 AND p = 1 UNION SELECT k, {hx('t')} FROM {src} WHERE length(t) BETWEEN 1 AND 30)"""


_HASHED = f"h AS (SELECT lang AS filename, source AS tag, sha256({_norm('text')}) AS sha256 FROM documents WHERE text IS NOT NULL)"

# every candidate of a bucket with its score; files(fid, filename, t), ref
_SIMILAR = f"""rn AS (SELECT filename, tag, {_norm('text')} AS t FROM ref),
cont AS (SELECT filename, sha256(t) AS sha, list_sort(list(DISTINCT tag)) AS tags FROM rn GROUP BY 1, 2),
alltext AS (SELECT DISTINCT sha256(t) AS k, t FROM (SELECT t FROM rn UNION SELECT t FROM files)),
{_winnow('alltext', 'sk')},
size_of AS (SELECT k, count(*) AS n FROM sk GROUP BY k),
ts AS (SELECT DISTINCT filename, sha256(t) AS sha FROM files),
cross_n AS (SELECT a.filename, a.sha AS tsha, b.sha AS csha, count(*) AS inter FROM ts a JOIN sk x ON x.k = a.sha JOIN sk y USING (h) JOIN cont b ON b.sha = y.k AND b.filename = a.filename GROUP BY 1, 2, 3),
cand AS (SELECT a.filename, a.sha AS tsha, b.sha AS csha, coalesce(i.inter, 0) AS inter, coalesce(p.n, 0) + coalesce(q.n, 0) - coalesce(i.inter, 0) AS uni, unnest(b.tags) AS tag
  FROM ts a JOIN cont b USING (filename) LEFT JOIN size_of p ON p.k = a.sha LEFT JOIN size_of q ON q.k = b.sha
  LEFT JOIN cross_n i ON i.filename = a.filename AND i.tsha = a.sha AND i.csha = b.sha WHERE coalesce(p.n, 0) + coalesce(q.n, 0) > 0),
best AS (SELECT filename, tsha, tag, inter / uni AS score, row_number() OVER (PARTITION BY filename, tsha ORDER BY inter / uni DESC, tag DESC) AS rank FROM cand QUALIFY rank <= 5)"""

_TREE = f"""one AS (SELECT tag, filename, arg_min(text, doc_id) AS text FROM ref GROUP BY 1, 2),
raw AS (SELECT 'tree-' || (doc_id // 8) AS "group", filename, lpad(doc_id::VARCHAR, 12, '0') AS path, text FROM tgt
  UNION ALL SELECT 'copy-' || tag, filename, 'a', text FROM one
  UNION ALL SELECT 'mixed-' || tag, filename, 'a', text FROM one WHERE filename IN ('en', 'fr')
  UNION ALL SELECT DISTINCT 'mixed-' || a.tag, b.filename, 'a', b.text FROM one a JOIN one b ON b.tag = 'src0' AND b.filename IN ('de', 'es')
  UNION ALL SELECT 'edit-' || tag, filename, 'a', CASE WHEN filename IN ('en', 'fr') THEN text ELSE text || ' an appended remark on ' || tag END FROM one
  UNION ALL SELECT 'loose-' || tag, filename, 'a', text || ' an appended remark on ' || tag FROM one
  UNION ALL SELECT 'alien-' || (item_id // 4), (['de', 'en', 'es', 'fr'])[item_id % 4 + 1], 'a', text FROM benchmark),
files AS (SELECT "group", filename, {_norm('arg_min(text, path)')} AS t FROM raw GROUP BY 1, 2)"""


def _tree_sql(floor: float | None) -> str:
    floor_case = f"WHEN least < {floor} THEN 'NOT THIS COMPONENT'" if floor is not None else ""
    return f"""WITH {_SPLIT}, {_TREE}, {_SIMILAR},
f AS (SELECT "group", files.filename AS filename, coalesce(c.tags, []) AS exact, b.tag AS top, b.score FROM files LEFT JOIN cont c ON c.filename = files.filename AND c.sha = sha256(t)
  LEFT JOIN best b ON b.filename = files.filename AND b.tsha = sha256(t) AND b.rank = 1),

g AS (SELECT "group", list(filename) AS present, count(*) AS n, count(*) FILTER (len(exact) > 0) AS n_exact, list(exact) FILTER (len(exact) > 0) AS sets,
  list(DISTINCT top) FILTER (len(exact) = 0 AND top IS NOT NULL) AS fuzzy, min(score) AS least, count(*) FILTER (top IS NULL) AS n_none, list(DISTINCT top) FILTER (top IS NOT NULL) AS tops FROM f GROUP BY 1),
v AS (SELECT *, list_filter(['de', 'en', 'es', 'fr'], lambda x: NOT list_contains(present, x)) AS missing,
  CASE WHEN sets IS NULL THEN [] ELSE list_reduce(sets, lambda a, b: list_intersect(a, b)) END AS common,
  CASE WHEN sets IS NULL OR fuzzy IS NULL THEN [] ELSE list_intersect(list_distinct(flatten(sets)), fuzzy) END AS base FROM g),
w AS (SELECT *, CASE WHEN len(missing) > 0 THEN 'INCOMPLETE' WHEN n_exact = n AND len(common) > 0 THEN 'CONFIRMED' WHEN n_exact = n THEN 'MIXED VERSION WARNING'
  WHEN n_exact > 0 THEN 'PARTIALLY MODIFIED' {floor_case} WHEN n_none > 0 THEN 'INCONCLUSIVE' WHEN len(tops) = 1 THEN 'LIKELY CONSISTENT' ELSE 'INCONSISTENT' END AS verdict FROM v)
SELECT "group", verdict, coalesce(array_to_string(list_sort(CASE verdict WHEN 'CONFIRMED' THEN common WHEN 'PARTIALLY MODIFIED' THEN base WHEN 'LIKELY CONSISTENT' THEN tops ELSE [] END), ','), '') AS tags,
  coalesce(array_to_string(list_sort(missing), ','), '') AS missing FROM w"""


def _votes(index: str, targets: str) -> str:
    """CTEs: votes, win, use, acc of the targets' hashes in an index of texts."""
    return f"""rm AS (SELECT DISTINCT md5(text) AS k, {_norm('text')} AS t FROM {index}),
tm AS (SELECT doc_id AS k, {_norm('text')} AS t FROM {targets}),
{_winnow('rm', 'ix')}, {_winnow('tm', 'th')},
votes AS (SELECT th.k AS file, ix.k AS md5, count(*) AS votes FROM th JOIN ix USING (h) GROUP BY 1, 2),
win AS (SELECT file, arg_min(md5, (-votes, md5)) AS md5, max(votes) AS votes, count(*) AS candidates FROM votes GROUP BY 1),
use AS (SELECT th.k AS file, count(*) AS n_hashes, count(i.h) AS usable FROM th LEFT JOIN (SELECT DISTINCT h FROM ix) i USING (h) GROUP BY 1),
acc AS (SELECT file, coalesce(votes, 0) AS votes, n_hashes, usable, coalesce(votes, 0) / n_hashes AS ratio, usable >= 5 AND coalesce(votes, 0) / n_hashes >= 0.5 AS accepted, md5 AS won FROM use LEFT JOIN win USING (file))"""


_ITEMS = _votes("(SELECT text FROM benchmark WHERE text IS NOT NULL)", "(SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)")

SQL = {
    "normalize_hash": f"WITH x AS (SELECT doc_id, text || ' /* of ' || source || ' */' || chr(9) || '// ' || lang AS r FROM documents), y AS (SELECT doc_id, r, {_norm('r')} AS t FROM x) SELECT doc_id, sha256(t) AS sha256, md5(r) AS md5, length(t) AS n_norm FROM y",
    "content_dedup": f"WITH {_HASHED} SELECT filename, sha256, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags, count(DISTINCT tag) AS n_tags FROM h GROUP BY 1, 2",
    "tag_index": f"WITH {_HASHED} SELECT tag, filename, min(sha256) AS sha256 FROM h GROUP BY 1, 2",
    "build_stats": f"WITH {_HASHED} SELECT count(DISTINCT tag) AS tags, count(DISTINCT (filename, sha256)) AS contents, count(*) AS entries, count(*) - count(DISTINCT (filename, sha256)) AS duplicates FROM h",
    "exact_match": f"WITH {_SPLIT}, r AS (SELECT filename, sha256({_norm('text')}) AS s, list_sort(list(DISTINCT tag)) AS tags FROM ref GROUP BY 1, 2) SELECT doc_id, tgt.filename, coalesce(array_to_string(tags, ','), '') AS tags FROM tgt LEFT JOIN r ON r.filename = tgt.filename AND r.s = sha256({_norm('text')})",
    "winnow_fingerprint": f"WITH src AS (SELECT doc_id AS k, {_norm('text')} AS t FROM documents WHERE text IS NOT NULL), {_winnow('src', 'sk')} SELECT k AS doc_id, h AS hash FROM sk",
    "similarity_topk": f"WITH {_SPLIT}, files AS (SELECT doc_id, filename, {_norm('text')} AS t FROM tgt), {_SIMILAR} SELECT doc_id, rank, tag, round(score, 6) AS score FROM files JOIN best ON best.filename = files.filename AND best.tsha = sha256(t)",
    "tree_verdict": _tree_sql(verdict.FLOOR),
    "tree_verdict_nofloor": _tree_sql(None),
    "wfp_index": f"WITH rm AS (SELECT DISTINCT md5(text) AS k, {_norm('text')} AS t FROM (SELECT text FROM documents WHERE doc_id IS NOT NULL UNION ALL SELECT text FROM benchmark) WHERE text IS NOT NULL), {_winnow('rm', 'ix')} SELECT printf('%08x', h) AS hash, count(*) AS n_contents, min(k) AS first_md5 FROM ix GROUP BY h",
    "wfp_vote": f"WITH {_ITEMS} SELECT file AS doc_id, md5, votes, candidates FROM win",
    "vote_histogram": f"WITH {_ITEMS} SELECT file AS doc_id, votes, count(*) AS n FROM votes GROUP BY 1, 2",
    "snippet_accept": f"WITH {_ITEMS} SELECT file AS doc_id, CASE WHEN accepted THEN won END AS md5, votes, n_hashes, usable, round(ratio, 6) AS ratio, accepted FROM acc",
    "artifact_verdict": f"""WITH {_SPLIT}, {_votes("ref", "tgt")}, ex AS (SELECT md5(text) AS md5, list_sort(list(DISTINCT tag)) AS ids FROM ref GROUP BY 1),
fm AS (SELECT doc_id // 8 AS "group", CASE WHEN e.ids IS NOT NULL THEN e.ids WHEN a.accepted THEN coalesce(w.ids, []) END AS ids FROM tgt LEFT JOIN ex e ON e.md5 = md5(text) LEFT JOIN acc a ON a.file = doc_id LEFT JOIN ex w ON w.md5 = a.won),
g AS (SELECT "group", count(ids) AS n_matched, list(ids) FILTER (ids IS NOT NULL) AS sets FROM fm GROUP BY 1),
i AS (SELECT "group", n_matched, CASE WHEN n_matched = 0 THEN [] ELSE list_sort(list_reduce(sets, lambda a, b: list_intersect(a, b))) END AS ids FROM g)
SELECT "group", CASE WHEN n_matched = 0 THEN 'NOT IDENTIFIED' WHEN len(ids) > 0 THEN 'CONSISTENT' ELSE 'MIXED VERSION WARNING' END AS verdict, coalesce(array_to_string(ids, ','), '') AS release_ids, n_matched FROM i""",
    "license_check": f"""WITH d AS (SELECT doc_id, CASE WHEN source IN ('src0', 'src1') THEN 'MIT' ELSE 'Apache' END AS declared, regexp_extract(regexp_extract(text, '{LICENSE_LINE}', 1), '^(\\w+)', 1) AS detected FROM documents)
SELECT doc_id, declared, detected, declared = detected AS agrees FROM d WHERE detected <> ''""",
}
