"""Profiles of record tables: field counts, hosts, positional percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.functions import text as ft
from provena.session import cut


def record_stats(records: DataFrame) -> DataFrame:
    """slots, records, n_fields, n, bad_utf8: histogram of the comma-separated fields. records: key, record binary."""
    sound = F.call_function("is_valid_utf8", F.col("record").cast("string"))
    fields = F.when(sound, F.size(F.split(F.col("record").cast("string"), ",")))
    told = records.select("key", sound.alias("sound"), fields.alias("n_fields"))
    total = told.agg(F.count_distinct("key").alias("slots"), F.count("*").alias("records"), F.count_if(~F.col("sound")).alias("bad_utf8"))
    hist = told.where("sound").groupBy("n_fields").agg(F.count("*").alias("n"))
    return hist.crossJoin(F.broadcast(total)).select("n_fields", "n", "slots", "records", "bad_utf8")


def hosts(records: DataFrame, url_col: str = "url", top: int = 10) -> DataFrame:
    """The most frequent hosts."""
    return records.groupBy(ft.url_host(F.col(url_col)).alias("host")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(top)


def positional_percentiles(values: DataFrame, value: Column, quantiles: dict[str, float]) -> DataFrame:
    """min, one column for each quantile, max, ones and n; a quantile is the value at place int(n q) of the sorted values.

    Values are counted first, so what is sorted is as long as the number of distinct values, not of rows, and no task
    sorts them all.
    """
    hist = values.select(value.alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("c"))
    # sorted ranges of values, each with a running sum of its own, on top of the totals of the ranges before it
    hist = cut(hist.repartitionByRange("v").withColumn("range", F.spark_partition_id()), "histogram")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = hist.groupBy("range").agg(F.sum("c").alias("t")).withColumn("below", F.coalesce(F.sum("t").over(before), F.lit(0)))
    total = ranges.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("n"))
    told = hist.join(F.broadcast(ranges), "range").crossJoin(F.broadcast(total))  # a row for each partition; one row
    told = told.withColumn("upto", F.col("below") + F.sum("c").over(Window.partitionBy("range").orderBy("v")))
    at = [F.min(F.when(F.col("upto") > F.floor(F.col("n") * q), F.col("v"))).alias(name) for name, q in quantiles.items()]
    return told.agg(F.min("v").alias("least"), *at, F.max("v").alias("most"), F.coalesce(F.sum(F.when(F.col("v") == 1, F.col("c"))), F.lit(0)).alias("ones"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"))


def route_by_count(records: DataFrame, curated: int = 100) -> DataFrame:
    """records with route: a single holder is trusted, very frequent ones go to the curated list, others to matching."""
    return records.withColumn("route", F.when(F.col("cnt") == 1, "exemplar").when(F.col("cnt") >= curated, "curated").otherwise("match"))


def sample_rows(records: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """A sample with replacement, the statistic of random slot draws."""
    return records.sample(withReplacement=True, fraction=fraction, seed=seed)


def random_rows(records: DataFrame, n: int, seed: int = 42) -> DataFrame:
    return records.orderBy(F.rand(seed)).limit(n)
