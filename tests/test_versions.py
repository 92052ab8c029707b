import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from provena.functions import text as ft
from provena.operators import advisory, hints

IN_ORDER = [
    ["0.9"], ["1.0.2", "v1.0.2", "1.0.2.0"], ["1.0.2a"], ["1.0.2b"], ["1.0.2-p1", "1.0.2p1", "1.0.2-patch1"], ["1.0.2_p2"], ["1.0.10"], ["2.28-dev"], ["2.28.0-alpha"], ["2.28-alpha2"], ["2.28.0-beta1"], ["2.28rc1", "2.28.0-rc.1", "2.28.0~pre1"], ["2.28-rc2"], ["2.28-rc10"],
    ["2.28", "2.28.0", "mbedtls-2.28.0", "V2.28", "2.28.0+build7", "2_28_0", "2.28-win32"], ["2.28.0.1"], ["2.28.8"], ["2.28.10"], ["3.6.0-rc1"], ["3.6.0"], ["20240131"], ["123456789012345678"],
]


def test_order(spark):
    rows = [(i, v) for i, vs in enumerate(IN_ORDER) for v in vs]
    got = spark.createDataFrame(rows, "i int, v string").select("i", "v", F.dense_rank().over(Window.orderBy(ft.version_order(F.col("v")))).alias("rank")).collect()
    assert [(r.v, r.rank - 1) for r in got if r.rank - 1 != r.i] == []
    none = spark.createDataFrame([("",), (None,), ("master",)], "v string").select(ft.version_order(F.col("v")).alias("o"))
    assert [r.o for r in none.collect()] == [None] * 3


def test_ranges_against_brute_force(spark):
    rnd = random.Random(9)
    place = {v: i for i, vs in enumerate(IN_ORDER) for v in vs}
    versions = sorted(place) + ["master", ""]
    releases = [(rnd.choice("pq"), rnd.choice(versions)) for _ in range(200)] + [("r", "1.0.2"), ("p", None)]
    ranges = [(rnd.choice("pq"), f"A{i}", rnd.choice([None, *versions]), rnd.choice([None, *versions])) for i in range(150)]
    got = advisory.version_range_matches(spark.createDataFrame(releases, "product string, version string"), spark.createDataFrame(ranges, "product string, advisory string, introduced string, fixed string")).collect()
    want = [
        (p, v, a) for p, v in releases if v in place for q, a, i, f in ranges if p == q
        and (i is None or place.get(i, 1000) <= place[v]) and (f is None or f in place and place[v] < place[f])
    ]
    assert sorted((r.product, r.version, r.advisory) for r in got) == sorted(want) and len(want) > 2000


def test_cases_of_the_feeds(spark):
    releases = spark.createDataFrame([("m", v) for v in ("2.28", "3.6.0-rc1", "3.6.0")], "product string, version string")
    ranges = spark.createDataFrame([("m", "A", "2.28.0", "3.6.0"), ("m", "B", "3.6.0", None)], "product string, advisory string, introduced string, fixed string")
    got = {(r.version, r.advisory) for r in advisory.version_range_matches(releases, ranges).collect()}
    assert got == {("2.28", "A"), ("3.6.0-rc1", "A"), ("3.6.0", "B")}
    none = advisory.version_range_matches(releases, ranges.where("false"))
    assert none.collect() == [] and advisory.version_range_matches(releases.where("false"), ranges).collect() == []
    tags = spark.createDataFrame([("r", t) for t in ("v3.6.0-rc1", "v3.5.9-rc9", "v3.6.0-rc0")], "repo string, tag string")
    assert [r.tag for r in hints.newest_by_scheme(tags).collect()] == ["v3.6.0-rc1"]


def test_no_pair_is_made_in_vain(spark):
    """Versions and ranges that do not meet make no row, however many a product has."""
    releases = spark.range(2000).selectExpr("'p' AS product", "concat('1.', 2 * id) AS version")
    ranges = spark.range(2000).selectExpr("'p' AS product", "concat('A', id) AS advisory", "concat('1.', 2 * id + 1) AS introduced", "concat('1.', 2 * id + 2, '-rc1') AS fixed")
    assert advisory.version_range_matches(releases, ranges).count() == 0
    wide = spark.createDataFrame([("p", "W", "1.10", "1.20")], "product string, advisory string, introduced string, fixed string")
    assert advisory.version_range_matches(releases, wide).count() == 5


def test_totals_make_no_row_for_a_release_and_an_advisory(spark):
    """Advisories with one range share its totals; every row of a release and an advisory took an hour in one task at scale."""
    releases = spark.range(300).selectExpr("'p' AS product", "concat('1.', id % 100) AS version", "id AS n")
    ranges = spark.range(2000).selectExpr("'p' AS product", "id % 1900 AS advisory", "if(id % 3 = 0, null, concat('1.', id % 7)) AS introduced", "if(id % 2 = 0, null, '1.50') AS fixed")
    totals = advisory.version_range_totals(releases, ranges, n=F.sum)
    want = advisory.version_range_matches(releases, ranges).groupBy("advisory").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, totals.collect())) == sorted(map(tuple, want.collect())) and totals.count() == 1900

    def rows(plan):
        plan = plan.executedPlan() if "Adaptive" in plan.nodeName() else plan
        plan = plan.plan() if hasattr(plan, "plan") and "QueryStage" in plan.nodeName() else plan
        n = [plan.metrics().apply("numOutputRows").value()] if "Join" in plan.nodeName() else []
        children = plan.children()
        return n + [x for i in range(children.size()) for x in rows(children.apply(i))]

    assert max(rows(totals._jdf.queryExecution().executedPlan())) <= 20_000
