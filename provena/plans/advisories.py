"""Queries of tags, advisories and record parsing over part, events, pages and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions import text as ft
from provena.operators import advisory, profile, refdb
from provena.session import table

QUANTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, repo, tag: release tags in several styles made of a part's numbers."""
    key, size = F.col("p_partkey"), F.col("p_size")
    number = F.concat_ws(".", (key % 4).cast("string"), (size % 30).cast("string"), (key % 11).cast("string"))
    style = F.when(key % 5 == 0, F.concat(F.lit("v"), number)).when(key % 5 == 1, F.concat(F.lit("mbedtls-"), number)).when(key % 5 == 2, F.concat(F.lit("V"), number))
    style = style.when(key % 5 == 3, F.concat(number, F.lit("-rc1"))).otherwise(F.concat(number, F.lit(".7")))
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_type").alias("repo"), style.alias("tag"))


def tag_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = _tags(spark, sf_dir)
    rules = spark.createDataFrame([("ECONOMY", r"^v\d+\.\d+\.\d+$"), ("SMALL", r"^[vV]?\d+(\.\d+)+$")], "repo string, tag_regex string")
    scoped = refdb.in_repo_scope(tags.select("p_partkey", "repo", "tag"), rules).select("p_partkey", F.lit(True).alias("in_repo"))
    out = tags.join(scoped, "p_partkey", "left")
    return out.select("p_partkey", "tag", ft.in_release_scope(F.col("tag")).alias("in_scope"), F.coalesce("in_repo", F.lit(False)).alias("in_repo"))


def tag_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.col("tag")
    return _tags(spark, sf_dir).select("p_partkey", ft.tag_version(tag).alias("plain"), ft.tag_version(tag, r"^(?:mbedtls-|v)(\d.*)$").alias("stripped"))


def alias_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags (orders) by commit (customer); a peeled entry wins over the tag object's."""
    orders = table(spark, sf_dir, "orders")
    line = F.concat(F.sha1(F.col("o_custkey").cast("string")), F.lit("\trefs/tags/t"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "^{}").otherwise(""))
    object_ = F.concat(F.sha1(F.concat(F.lit("object"), F.col("o_orderkey").cast("string"))), F.lit("\trefs/tags/t"), F.col("o_orderkey").cast("string"))
    refs = orders.select(line.alias("line")).unionByName(orders.where("o_orderkey % 3 = 0").select(object_.alias("line")))
    found = refdb.commit_aliases(refdb.tag_commits(refdb.parse_ls_remote(refs)))
    return found.select("sha", F.array_join("tags", ",").alias("tags"))


def prototype_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with the prefix before a parenthesis in the script parts of pages, after comments and directives are gone."""
    head = F.concat(F.lit("#define pb_x(a) \\\n  pb_no(a)\nint pb_get(void); /* int pb_hidden(void); */ bool *pb_"), F.expr("page_id % 7"), F.lit("_open (int x);\n"), "html")
    found = table(spark, sf_dir, "pages").where("html is not null").select("page_id", ft.prototypes(ft.strip_code(head), "pb_|track|th").alias("names"))
    return found.select("page_id", F.explode("names").alias("symbol"))


def record_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    record = F.concat(F.lit("src/a,b/"), F.expr("page_id % 10"), F.lit(","), "url", F.lit(","), F.col("page_id").cast("string"))
    return pages.select("page_id", ft.split_record(record).alias("r")).select("page_id", "r.*")


def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", ft.url_host(F.col("url")).alias("host"))


def host_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.hosts(table(spark, sf_dir, "pages"))


def count_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.positional_percentiles(table(spark, sf_dir, "lineitem"), F.col("l_quantity").cast("long"), QUANTILES)


def count_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("cnt"))
    return profile.route_by_count(told, 45).groupBy("route").agg(F.count("*").alias("n"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, json: an answer with made-up CVE ids from a user's events."""
    events = table(spark, sf_dir, "events")
    cve = F.concat(F.lit("CVE-20"), F.lpad((F.col("event_id") % 20).cast("string"), 2, "0"), F.lit("-"), (F.col("user_id") * 37 + 1000).cast("string"))
    one = F.concat(F.lit('{"id":"'), F.when(F.col("event_type") == "error", cve).otherwise("none"), F.lit('","props":'), "props", F.lit("}"))
    return events.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(one)), ",").alias("json"))


def cve_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = advisory.cve_counts(_answers(spark, sf_dir))
    return found.select("user_id", F.col("cve_count").cast("long").alias("cve_count"), F.array_join("cves_sample", ",").alias("cves_sample"))


def ecosystem_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is an advisory with one vulnerability, of the ecosystem that its type names."""
    events = table(spark, sf_dir, "events")
    return advisory.ecosystems(events.select(F.array(F.struct(F.col("event_type").alias("ecosystem"))).alias("vulnerabilities")))


def coverage_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as components, event types as sources: errors are findings, every pair is asked for."""
    events = table(spark, sf_dir, "events")
    findings = events.where("event_type = 'error'").select(F.col("user_id").alias("component"), F.lit("error").alias("source"), F.get_json_object("props", "$.k").alias("cve"))
    return advisory.coverage(findings, events.select(F.col("user_id").alias("component"), F.col("event_type").alias("source")).distinct())


def version_range_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders name a product (status) and version, of two or three numbers or a candidate; parts are advisories with ranges."""
    number = F.concat_ws(".", (F.col("o_custkey") % 12).cast("string"), (F.col("o_orderkey") % 30).cast("string"))
    kind = F.col("o_orderkey") % 7
    version = F.when(kind == 1, F.concat(F.lit("v"), number, F.lit(".0"))).when(kind == 2, F.concat(number, F.lit("-rc"), (F.col("o_custkey") % 3).cast("string"))).when(kind == 3, F.concat(number, F.lit(".0.4"))).otherwise(number)
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("product"), version.alias("version")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least"))
    key = F.col("p_partkey")
    ranges = table(spark, sf_dir, "part").select(
        F.when(key % 3 == 0, "F").when(key % 3 == 1, "O").otherwise("P").alias("product"), key.alias("advisory"),
        F.when(key % 10 > 0, F.concat((key % 12).cast("string"), F.lit(".9"), F.when(key % 2 == 0, ".0").otherwise(""))).alias("introduced"),
        F.when(key % 4 > 0, F.concat((key % 12 + 1).cast("string"), F.lit(".10"), F.when(key % 5 == 0, "-rc1").otherwise(""))).alias("fixed"),
    )
    return advisory.version_range_totals(orders, ranges, n=F.sum, least=F.min).select("advisory", F.col("n").alias("n_orders"), F.col("least").alias("first_order"))


QUERIES = {
    f.__name__: f
    for f in (tag_scope, tag_version, alias_dedup, prototype_mining, record_split, url_host, host_histogram, count_percentiles, count_routes, cve_extract, ecosystem_counts, coverage_flag, version_range_match)
}

_HOST = "coalesce(nullif(regexp_extract(url, '^https?://([^/]+)/', 1), ''), left(url, 40))"
_TAG = """t AS (SELECT p_partkey, p_type AS repo, (p_partkey % 4) || '.' || (p_size % 30) || '.' || (p_partkey % 11) AS n FROM part),
g AS (SELECT p_partkey, repo, CASE p_partkey % 5 WHEN 0 THEN 'v' || n WHEN 1 THEN 'mbedtls-' || n WHEN 2 THEN 'V' || n WHEN 3 THEN n || '-rc1' ELSE n || '.7' END AS tag FROM t)"""
_CVES = """e AS (SELECT user_id, '{"id":"' || CASE WHEN event_type = 'error' THEN 'CVE-20' || lpad((event_id % 20)::VARCHAR, 2, '0') || '-' || (user_id * 37 + 1000) ELSE 'none' END || '","props":' || props || '}' AS j FROM events),
a AS (SELECT user_id, string_agg(j, ',') AS json FROM e GROUP BY 1), c AS (SELECT user_id, list_sort(list_distinct(regexp_extract_all(json, 'CVE-\\d{4}-\\d+'))) AS ids FROM a)"""
SQL = {
    "tag_scope": f"WITH {_TAG} SELECT p_partkey, tag, regexp_extract(tag, '^(?:mbedtls-)?v?(\\d+)\\.\\d+\\.\\d+(?:\\.\\d+)?$', 1) IN ('2', '3') AS in_scope, repo = 'ECONOMY' AND regexp_matches(tag, '^v\\d+\\.\\d+\\.\\d+$') OR repo = 'SMALL' AND regexp_matches(tag, '^[vV]?\\d+(\\.\\d+)+$') AS in_repo FROM g",
    "tag_version": f"WITH {_TAG} SELECT p_partkey, coalesce(nullif(regexp_extract(tag, '^(?:v)?(.+)$', 1), ''), tag) AS plain, coalesce(nullif(regexp_extract(tag, '^(?:mbedtls-|v)(\\d.*)$', 1), ''), tag) AS stripped FROM g",
    "alias_dedup": "SELECT sha1(o_custkey::VARCHAR) AS sha, array_to_string(list_sort(list(DISTINCT 't' || o_orderkey)), ',') AS tags FROM orders GROUP BY 1",
    "prototype_mining": r"""WITH x AS (SELECT page_id, '#define pb_x(a) \' || chr(10) || '  pb_no(a)' || chr(10) || 'int pb_get(void); /* int pb_hidden(void); */ bool *pb_' || (page_id % 7) || '_open (int x);' || chr(10) || html AS r FROM pages WHERE html IS NOT NULL),
s AS (SELECT page_id, regexp_replace(regexp_replace(r, '(?s)/\*.*?\*/|//[^\n]*', ' ', 'g'), '(?m)^[ \t]*#(?:[^\n\\]|\\\n)*', ' ', 'g') AS t FROM x)
SELECT DISTINCT page_id, unnest(regexp_extract_all(t, '\b[A-Za-z_][0-9A-Za-z_]*[ \t\n*]+((?:pb_|track|th)[0-9A-Za-z_]*)[ \t\n]*\(', 1)) AS symbol FROM s""",
    "record_split": "SELECT page_id, 'src/a,b/' || (page_id % 10) AS path, url, page_id AS cnt FROM pages WHERE url IS NOT NULL UNION ALL SELECT page_id, NULL, NULL, NULL FROM pages WHERE url IS NULL",
    "url_host": f"SELECT page_id, {_HOST} AS host FROM pages",
    "host_histogram": f"SELECT {_HOST} AS host, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, host LIMIT 10",
    "count_percentiles": "WITH v AS (SELECT list_sort(list(l_quantity::BIGINT)) AS s FROM lineitem) SELECT s[1] AS least, s[CAST(floor(len(s) * 0.5) AS BIGINT) + 1] AS p50, s[CAST(floor(len(s) * 0.9) AS BIGINT) + 1] AS p90, s[CAST(floor(len(s) * 0.99) AS BIGINT) + 1] AS p99, s[len(s)] AS most, len(list_filter(s, lambda x: x = 1)) AS ones, len(s) AS n FROM v",
    "count_routes": "SELECT CASE WHEN l_quantity = 1 THEN 'exemplar' WHEN l_quantity >= 45 THEN 'curated' ELSE 'match' END AS route, count(*) AS n FROM lineitem GROUP BY 1",
    "cve_extract": f"WITH {_CVES} SELECT user_id, len(ids) AS cve_count, coalesce(array_to_string(ids[1:6], ','), '') AS cves_sample FROM c",
    "ecosystem_counts": "SELECT event_type AS ecosystem, count(*) AS n FROM events GROUP BY 1",
    "coverage_flag": "WITH f AS (SELECT user_id AS component, count(DISTINCT json_extract_string(props, '$.k')) AS n FROM events WHERE event_type = 'error' GROUP BY 1), i AS (SELECT DISTINCT user_id AS component, event_type AS source FROM events) SELECT i.component, source, CASE WHEN source = 'error' THEN coalesce(n, 0) ELSE 0 END AS n, CASE WHEN source = 'error' AND coalesce(n, 0) > 0 THEN 'covered' ELSE '0!' END AS flag FROM i LEFT JOIN f USING (component)",
    "version_range_match": """WITH o AS (SELECT o_orderkey, o_orderstatus AS product, CASE WHEN o_orderkey % 7 = 2 THEN [o_custkey % 12, o_orderkey % 30, 0, 0, o_custkey % 3] ELSE [o_custkey % 12, o_orderkey % 30, CASE WHEN o_orderkey % 7 = 3 THEN 4 ELSE 0 END, 1, 0] END AS v FROM orders),
r AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS product, p_partkey AS advisory, CASE WHEN p_partkey % 10 > 0 THEN [p_partkey % 12, 9, 0, 1, 0] END AS i,
  CASE WHEN p_partkey % 4 > 0 THEN CASE WHEN p_partkey % 5 = 0 THEN [p_partkey % 12 + 1, 10, 0, 0, 1] ELSE [p_partkey % 12 + 1, 10, 0, 1, 0] END END AS f FROM part)
SELECT advisory, sum(n)::BIGINT AS n_orders, min(k) AS first_order FROM (SELECT product, v, count(*) AS n, min(o_orderkey) AS k FROM o GROUP BY ALL) JOIN r USING (product) WHERE (i IS NULL OR v >= i) AND (f IS NULL OR v < f) GROUP BY 1""",

}
