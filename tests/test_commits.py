import random

import pytest

from provena.operators import commits


def brute(edges, ranges):
    children = {}
    for c, p in edges:
        children.setdefault(p, []).append(c)
    known = {x for e in edges for x in e}

    def down(x):
        seen, todo = set(), [x] if x in known else []
        while todo:
            if (at := todo.pop()) not in seen:
                seen.add(at)
                todo += children.get(at, [])
        return seen

    return {(a, c) for a, i, f in ranges for c in down(i) - (down(f) if f is not None else set())}


def tables(spark, edges, ranges, kind="string"):
    return spark.createDataFrame(edges, f"commit {kind}, parent {kind}"), spark.createDataFrame(ranges, f"advisory string, introduced {kind}, fixed {kind}")


def test_merges(spark):
    edges = [(2, 1), (3, 1), (4, 2), (4, 3), (5, 4)]
    got = commits.commits_in_ranges(*tables(spark, edges, [("A", 1, 2)], "long"))
    assert {tuple(r) for r in got.collect()} == {("A", 1), ("A", 3)}  # the merge and what follows have the fix
    edges = [("b", "a"), ("c", "b"), ("d", "c"), ("x", "b"), ("y", "x"), ("d", "x")]
    ranges = [("A", "b", "c"), ("B", "c", None), ("C", "b", "b"), ("D", None, "b"), ("E", "nowhere", None), ("F", "b", "nowhere"), ("F", "b", "nowhere"), ("G", "x", "y"), ("G", "d", None)]
    got = commits.commits_in_ranges(*tables(spark, edges, ranges)).collect()
    want = {("A", "b"), ("A", "x"), ("A", "y"), ("B", "c"), ("B", "d"), *(("F", c) for c in "bcdxy"), ("G", "x"), ("G", "d")}
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_histories_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    edges = set()
    for c in range(1, 150):
        edges |= {(c, c - 1 if rnd.random() < 0.7 else rnd.randrange(c)) for _ in range(rnd.choice([0, 1, 1, 1, 2, 3]))}
    ranges = [(f"A{i % 25}", rnd.randrange(160), rnd.choice([None, rnd.randrange(160), rnd.randrange(160)])) for i in range(40)]
    df, r = tables(spark, sorted(edges), ranges, "long")
    got = commits.commits_in_ranges(df, r).collect()
    assert len(got) == len(set(got)) and {tuple(x) for x in got} == brute(edges, ranges)
    releases = spark.createDataFrame([(f"v{i}", i * 3) for i in range(60)], "release string, commit long")
    found = {(x.advisory, x.release) for x in commits.releases_in_ranges(df, r, releases).collect()}
    assert found == {(a, f"v{c // 3}") for a, c in brute(edges, ranges) if c % 3 == 0}


def test_a_long_history_takes_few_rounds(spark):
    n, rounds = 100_000, []
    line = spark.range(1, n).selectExpr("id AS commit", "id - 1 AS parent", "1 AS number")
    branch = spark.range(n, n + 1000).selectExpr("id AS commit", f"(id - {n}) * 99 AS parent", "1 AS number")
    merged = spark.range(n, n + 1000).selectExpr(f"(id - {n}) * 99 + 50 AS commit", "id AS parent", "2 AS number")
    edges = line.unionByName(branch).unionByName(merged)
    ranges = spark.createDataFrame([("A", 0, 50_000), ("B", n + 10, None)], "advisory string, introduced long, fixed long")
    stretches, placed = commits.affected_stretches(edges, ranges, rounds.append)
    rows = {(r.advisory, r.n) for r in stretches.groupBy("advisory").agg({"end": "count"}).toDF("advisory", "n").collect()}
    total = {r.advisory: r.n for r in stretches.selectExpr("advisory", "end - first AS n").groupBy("advisory").sum("n").toDF("advisory", "n").collect()}
    assert total["A"] == 50_000 + 506 and total["B"] == 1 + (n - 1040) + 989 and len(rows) == 2
    assert len(rounds) <= 24 and rounds.count("double") <= 20


def test_cycles_and_empty_tables(spark):
    edges = [("b", "a"), ("y", "x"), ("x", "y"), (None, "a"), ("c", None)]
    got = commits.commits_in_ranges(*tables(spark, edges, [("A", "a", None), ("B", "x", None)]))
    assert {tuple(r) for r in got.collect()} == {("A", "a"), ("A", "b")}
    assert commits.commits_in_ranges(*tables(spark, [], [("A", "a", None)])).collect() == []
    assert commits.commits_in_ranges(*tables(spark, edges, [])).collect() == []


def test_rounds_write_what_they_find(spark, monkeypatch):
    """Every round wrote all places known so far again."""
    hops, rows = 16, []

    def counted(df, name, cut=commits.cut):
        out = cut(df, name)
        rows.append(out.count() if name == "reached" else 0)
        return out

    monkeypatch.setattr(commits, "cut", counted)
    # each commit's smaller child continues its chain, so the other one starts the next
    edges = [(100 + i + 1, 100 + i) for i in range(hops)] + [(i + 1, 100 + i) for i in range(hops)]
    df, ranges = tables(spark, edges, [("A", 100, None)], "long")
    stretches, _ = commits.affected_stretches(df, ranges)
    assert stretches.count() == hops + 1 and sum(rows) <= 6 * hops


@pytest.mark.parametrize("few", [0, 200_000])
def test_many_ranges_of_an_advisory_on_a_long_chain(spark, monkeypatch, few):
    monkeypatch.setattr(commits, "FEW", few)
    rnd = random.Random(few)
    edges = [(c, c - 1) for c in range(1, 400)] + [(c, c - 90) for c in range(100, 400, 50)]
    ranges = [(f"A{i % 6}", a, rnd.choice([None, a + rnd.randrange(1, 40), a + rnd.randrange(1, 40)])) for i, a in enumerate(rnd.randrange(400) for _ in range(30))] + [(None, 5, 9), (None, 200, 203)]
    df, r = tables(spark, edges, ranges, "long")
    got = commits.commits_in_ranges(df, r).collect()
    assert len(got) == len(set(got)) and {tuple(x) for x in got} == brute(edges, ranges)
    releases = spark.createDataFrame([(f"v{i}", i) for i in range(0, 400, 7)], "release string, commit long")
    found = commits.releases_in_ranges(df, r, releases).collect()
    assert len(found) == len(set(found)) and {(x.advisory, x.commit) for x in found} == {(a, c) for a, c in brute(edges, ranges) if c % 7 == 0}
