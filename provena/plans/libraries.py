"""Queries of static-library identification over lineitem, orders and part.

A component is a brand, a release a shipping month, a symbol a part, a library an order. The symbols of a release are the
parts of the brand that were shipped in the month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.operators import symbols
from provena.session import table

PREFIX = "p[1-9]"


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(libs: lib, symbol; refs: component, release, ord, symbol; components: component, prefix)."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    symbol = F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("symbol")
    month = F.date_format("l_shipdate", "yyyy-MM").alias("release")
    number = ((F.year("l_shipdate") - 1990) * 12 + F.month("l_shipdate")).cast("long").alias("ord")
    refs = line.join(part, line.l_partkey == part.p_partkey).select(F.col("p_brand").alias("component"), month, number, symbol).distinct()
    libs = line.select(F.col("l_orderkey").alias("lib"), symbol)
    return libs, refs, part.select(F.col("p_brand").alias("component"), F.lit(PREFIX).alias("prefix")).distinct()


def _windows(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    found = symbols.window(*_inputs(spark, sf_dir), mode)
    return found.select("lib", "component", "release", "unexplained", "soft", "kind")


def symbol_window_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, "fold")


def symbol_window_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, "strict")


def symbol_window_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, "rank")


def window_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = symbols.spans(*_inputs(spark, sf_dir))
    return found.withColumn("shown", symbols.show_span(F.col("first_release"), F.col("last_release"), F.col("n_releases")))


def discriminating_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.discriminating(_inputs(spark, sf_dir)[1])


def batch_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = symbols.batch_scan(*_inputs(spark, sf_dir))
    return found.withColumn("known_sample", F.array_join("known_sample", ","))


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are libraries; those without a line item count as unreadable."""
    libs, refs, components = _inputs(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("lib"))
    return symbols.scan_summary(libs, symbols.known(libs, refs, components), orders.join(libs, "lib", "left_anti"))


def _flavours(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    told = line.join(part, line.l_partkey == part.p_partkey)
    return told.select(F.concat_ws("/", "p_brand", "p_type").alias("name"), F.col("l_linestatus").alias("core"), F.col("l_returnflag").alias("toolchain"), F.col("l_partkey").alias("symbol"))


def toolchain_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.toolchain_variance(_flavours(spark, sf_dir), ["name", "core"], "toolchain")


def cross_core_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.toolchain_variance(_flavours(spark, sf_dir), ["name", "toolchain"], "core")


def differing_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = symbols.differing_symbols(_flavours(spark, sf_dir), ["name", "core"], "toolchain")
    return found.withColumn("holders", F.array_join("holders", ","))


QUERIES = {
    f.__name__: f
    for f in (symbol_window_fold, symbol_window_strict, symbol_window_rank, window_span, discriminating_symbols, batch_scan, batch_summary, toolchain_variance, cross_core_variance, differing_symbols)
}

_BASE = """refs AS (SELECT DISTINCT p_brand AS component, strftime(l_shipdate, '%Y-%m') AS release, (year(l_shipdate) - 1990) * 12 + month(l_shipdate) AS ord, 'p' || l_partkey AS symbol FROM lineitem JOIN part ON l_partkey = p_partkey),
libs AS (SELECT DISTINCT l_orderkey AS lib, 'p' || l_partkey AS symbol FROM lineitem),
known AS (SELECT DISTINCT lib, component, symbol FROM libs JOIN (SELECT DISTINCT component, symbol FROM refs) USING (symbol) WHERE regexp_matches(symbol, '^(?:p[1-9])')),
nk AS (SELECT lib, component, count(*) AS n_known FROM known GROUP BY 1, 2),
m AS (SELECT lib, component, release, count(*) AS matched FROM known JOIN refs USING (component, symbol) GROUP BY 1, 2, 3),
rel AS (SELECT component, release, any_value(ord) AS ord, count(*) AS size FROM refs GROUP BY 1, 2)"""
_SOFT = "held AS (SELECT w.lib, w.component, w.release, count(*) AS held FROM w JOIN refs USING (component, release) JOIN libs ON libs.lib = w.lib AND libs.symbol = refs.symbol GROUP BY 1, 2, 3), s AS (SELECT w.*, rel.size - coalesce(held, 0) AS soft FROM w JOIN rel USING (component, release) LEFT JOIN held USING (lib, component, release))"
_ALL = "u AS (SELECT lib, component, release, ord, n_known - coalesce(matched, 0) AS unexplained FROM nk JOIN rel USING (component) LEFT JOIN m USING (lib, component, release)), l AS (SELECT *, min(unexplained) OVER (PARTITION BY lib, component) AS least FROM u)"
_KIND = "CASE WHEN least = 0 THEN 'consistent' ELSE 'closest (+' || least || ' unexplained)' END"
_FLAVOUR = "f AS (SELECT DISTINCT p_brand || '/' || p_type AS name, l_linestatus AS core, l_returnflag AS toolchain, l_partkey AS symbol FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _variance(keys: str, flavour: str) -> str:
    return f"""WITH {_FLAVOUR}, n AS (SELECT {keys}, count(DISTINCT {flavour}) AS n_flavours FROM f GROUP BY ALL), h AS (SELECT {keys}, symbol, count(*) AS c FROM f GROUP BY ALL)
SELECT {keys}, n_flavours, count(*) AS n_symbols, count(*) FILTER (c < n_flavours) AS n_differing, CASE WHEN count(*) FILTER (c < n_flavours) = 0 THEN 'IDENTICAL' ELSE 'DIFFERS' END AS verdict
FROM h JOIN n USING ({keys}) WHERE n_flavours > 1 GROUP BY ALL"""


_STRICT = f"WITH {_BASE}, w AS (SELECT lib, component, release, ord, 0 AS unexplained FROM m JOIN nk USING (lib, component) JOIN rel USING (component, release) WHERE matched = n_known)"
SQL = {
    "symbol_window_fold": f"WITH {_BASE}, {_ALL}, w AS (SELECT * FROM l WHERE unexplained = least), {_SOFT}, q AS (SELECT *, min(soft) OVER (PARTITION BY lib, component) AS fewest FROM s) SELECT lib, component, release, unexplained, soft, {_KIND} AS kind FROM q WHERE soft = fewest",
    "symbol_window_strict": f"{_STRICT}, {_SOFT} SELECT lib, component, release, unexplained, soft, 'consistent' AS kind FROM s",
    "symbol_window_rank": f"WITH {_BASE}, {_ALL}, r AS (SELECT *, row_number() OVER (PARTITION BY lib, component ORDER BY unexplained, ord) AS place FROM l), w AS (SELECT * FROM r WHERE unexplained = 0 OR least > 0 AND place <= 5), {_SOFT}, q AS (SELECT *, min(soft) OVER (PARTITION BY lib, component) AS fewest FROM s) SELECT lib, component, release, unexplained, soft, {_KIND} AS kind FROM q WHERE least > 0 OR soft = fewest",
    "window_span": f"{_STRICT} SELECT lib, component, count(*) AS n_releases, arg_min(release, ord) AS first_release, arg_max(release, ord) AS last_release, CASE WHEN count(*) > 4 THEN arg_min(release, ord) || ' … ' || arg_max(release, ord) ELSE arg_min(release, ord) END AS shown FROM w GROUP BY 1, 2",
    "discriminating_symbols": f"WITH {_BASE}, t AS (SELECT component, count(*) AS total FROM rel GROUP BY 1) SELECT component, symbol, count(*) AS n, arg_min(release, ord) AS first_release, arg_max(release, ord) AS last_release FROM refs JOIN t USING (component) GROUP BY component, symbol, total HAVING count(*) < total",
    "batch_scan": f"""WITH {_BASE}, o AS (SELECT nk.lib, nk.component, any_value(n_known) AS n_known, count(*) AS n_observed FROM nk JOIN libs ON libs.lib = nk.lib WHERE regexp_matches(symbol, '^(?:p[1-9])') GROUP BY 1, 2),
k AS (SELECT lib, component, array_to_string(list_sort(list(symbol))[1:10], ',') AS known_sample FROM known GROUP BY 1, 2),
c AS (SELECT lib, component, count(*) AS n, arg_min(release, ord) AS first_release, arg_max(release, ord) AS last_release FROM m JOIN nk USING (lib, component) JOIN rel USING (component, release) WHERE matched = n_known GROUP BY 1, 2)
SELECT lib, component, n_observed, n_known, n_observed - n_known AS n_unknown, known_sample, coalesce(n, 0) AS n_consistent, first_release, last_release FROM o JOIN k USING (lib, component) LEFT JOIN c USING (lib, component)""",
    "batch_summary": f"WITH {_BASE} SELECT (SELECT count(DISTINCT lib) FROM libs) + x AS libs_scanned, (SELECT count(DISTINCT lib) FROM known) AS hits, (SELECT count(DISTINCT lib) FROM libs) - (SELECT count(DISTINCT lib) FROM known) AS no_match, x AS unreadable FROM (SELECT count(DISTINCT o_orderkey) AS x FROM orders WHERE o_orderkey NOT IN (SELECT lib FROM libs))",
    "toolchain_variance": _variance("name, core", "toolchain"),
    "cross_core_variance": _variance("name, toolchain", "core"),
    "differing_symbols": f"WITH {_FLAVOUR}, n AS (SELECT name, core, count(DISTINCT toolchain) AS c FROM f GROUP BY 1, 2) SELECT name, core, symbol, array_to_string(list_sort(list(toolchain)), ',') AS holders FROM f JOIN n USING (name, core) GROUP BY name, core, symbol, c HAVING count(*) < c",
}
