"""URL filters by hashed host-suffix and path-prefix expressions, in DataFrame functions only.

A rule is a host and a path prefix. A URL is expanded into the expressions host suffix + path prefix: all suffixes of its
host at label boundaries, all prefixes of its path that have the length of some rule's path. Expressions and rules are
hashed; the first four bytes of the digest are equi-joined, a hit counts only if the full digests agree. Of the rules
that fit, the longest wins (host and path together; then the longer host, then block before allow).

Distinct URLs are expanded, not rows, so a URL that repeats is judged once; the URLs that have a rule are broadcast back to
the rows if together they have at most ``broadcast_bytes``, else joined as a written table, whose hot keys Spark splits.
The rule table is broadcast only if it has at most ``broadcast_rows`` rows.

Defined results: a null URL or one without ``://`` has an empty host and path, and no rule fits it; where no rule fits
the verdict is ``default``; rules with a null or empty host or path part, or a null verdict, are ignored; repeated rows
give equal results; empty tables give empty results; other columns are kept, whatever their names, but for those named as a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.session import cut, fresh

PREFIX_BYTES = 4


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def short(full: Column) -> Column:
    return F.substring(full, 1, 2 * PREFIX_BYTES)


def host_suffixes(host: Column) -> Column:
    """example.org, org for example.org; none for an empty host."""
    labels = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    )


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", broadcast_rows: int = 1_000_000, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """urls with host, path, rule and verdict; rules: host, path, verdict (allow or block).

    Columns of urls that have one of these four names give way to the result's.
    """
    rules = rules.where("host <> '' and path <> '' and verdict is not null").select("host", "path", "verdict")
    expression = F.concat("host", "path")
    rules = rules.select(expression.alias("rule"), F.col("verdict").alias("told"), F.length("path").alias("cut"), F.length("host").alias("hosts"), F.length(expression).alias("size"), digest(expression).alias("full"))
    # distinct lengths of rule paths: at most as many as the longest path has characters
    cuts = sorted(r[0] for r in rules.select("cut").distinct().collect())
    told = rules.withColumn("k", short(F.col("full")))
    told = F.broadcast(told) if told.count() <= broadcast_rows else told

    distinct = urls.select(F.col(url_col).alias("u")).where("u is not null").distinct()
    parts = distinct.select("u", host_of(F.col("u")).alias("h"), path_of(F.col("u")).alias("p"))
    expanded = parts.select("u", F.explode(host_suffixes(F.col("h"))).alias("s"), "p")
    lengths = F.array(*[F.lit(c) for c in cuts]).cast("array<int>")
    expanded = expanded.select("u", "s", "p", F.explode(F.filter(lengths, lambda n: n <= F.length("p"))).alias("n"))
    expanded = expanded.select("u", digest(F.concat("s", F.substring(F.col("p"), F.lit(1), F.col("n")))).alias("d")).withColumn("k", short(F.col("d")))
    fits = expanded.join(told, "k").where("d = full")
    rank = F.struct("size", "hosts", (F.col("told") == "block").alias("blocks"))
    u, key, best = (fresh(urls, x) for x in ("filter_url", "filter_key", "filter_best"))
    found = cut(fits.groupBy(F.col("u").alias(key)).agg(F.max_by(F.struct("rule", "told"), rank).alias(best)), "url-rules")
    size = found.agg(F.sum(F.octet_length(key) + F.octet_length(f"{best}.rule"))).first()[0] or 0
    found = F.broadcast(found) if size <= broadcast_bytes else found

    own = {"host", "path", "rule", "verdict"}
    kept = [F.col(f"`{c}`") for c in urls.columns if c.lower() not in own]
    judged = urls.select(*kept, F.col(f"`{url_col}`").alias(u)).join(found, F.col(u) == F.col(key), "left")
    return judged.select(*kept, host_of(F.col(u)).alias("host"), path_of(F.col(u)).alias("path"), F.col(f"{best}.rule").alias("rule"), F.coalesce(f"{best}.told", F.lit(default)).alias("verdict"))
