import hashlib
import math
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from provena.llm import mixing
from provena.llm.queries import oracle_sql, queries

CLASH = ["size", "part", "nr", "key", "row", "sid", "block", "slot", "one", "top", "weight", "target", "taken", "words", "begin", "at", "rank", "low", "high", "_s", "length", "round"]


def brute_targets(sizes, cycle=(5, 2, 1), share=1.5):
    """By rounds: give out what is left by weight, stop who is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def docs(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * len(CLASH)) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASH))


ROWS = [(i, " ".join(["w"] * (i * 37 % 211)), f"s{i % 7}") for i in range(300)]
ROWS += [(i, "a b\tc\nd\x0be\x0cf\rg \x1ch", "hot") for i in range(1000, 1400)]
ROWS += [(5, " lead and trail ", None), (5, " lead and trail ", None), (None, "w " * 5000, None), (None, None, ""), (7, "", ""), (8, " \t ", "none"), (9, "é ü", ""), (10, "solo", "only")]


def test_taken_of_clashing_null_and_repeated_rows(spark):
    got = mixing.taken(docs(spark, ROWS), block=16).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), len((t or "").encode().split())) for i, t, _ in ROWS)
    sizes, took, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r.size
        took[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    want = brute_targets(sizes)
    assert target == pytest.approx(want) and all(r.source_size == sizes[r.source] for r in got)
    assert all(took[s] == round(want[s]) for s in want) and sum(took.values()) == pytest.approx(1.5 * sum(sizes.values()), abs=len(sizes))
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.taken(docs(spark, ROWS).repartition(5), block=16).collect()))  # reruns agree


def test_schedule_is_even_everywhere(spark):
    pieces, lines = mixing.mix(docs(spark, ROWS), block=16)
    where = {(r.part, r.nr): r for r in lines.collect()}
    rows = sorted(pieces.collect(), key=lambda r: (r.slot, r.offset))
    ends = {}
    for r in rows:  # the pieces of a slot follow each other and come from one source, no word comes twice in a round
        assert r.offset == ends.get(r.slot, 0) and r.length > 0
        ends[r.slot] = r.offset + r.length
    seen = Counter((r.part, r.nr, r.round, w) for r in rows for w in range(r.start, r.start + r.length))
    assert max(seen.values()) == 1
    assert all(r.start + r.length <= where[r.part, r.nr]["size"] for r in rows)
    source = {r.slot: where[r.part, r.nr].source for r in rows}
    order = [source[s] for s in sorted(source)]
    share = {s: n / len(order) for s, n in Counter(order).items()}
    told = Counter()
    for i, s in enumerate(order[: int(len(order) * 0.95)], 1):
        told[s] += 1
        assert abs(told[s] - share[s] * i) <= 2 + math.log2(len(order)), (i, s)
    rounds = defaultdict(list)
    for r in rows:
        rounds[where[r.part, r.nr].source].append((r.slot, r.round))
    assert {max(x for _, x in v) for v in rounds.values()} == {0, 1}


def test_targets_against_rounds(spark):
    for sizes in ({"a": 1000, "b": 10, "c": 10, None: 500, "d": 0}, {"a": 1}, {"a": 7, "b": 900, "c": 3, "d": 1, "e": 2, "é": 4, "": 6}, {"a": 0}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").coalesce(1)
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        assert got == pytest.approx(brute_targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0))


def test_word_counts_and_empty_tables(spark):
    texts = [None, "", " ", "a", " a ", "a b", "a\x0b\x0c\x1fb", "x " * 100_000, "y" * 300_000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.word_count(F.col("t"))).collect()
    assert [r[0] for r in got] == [len((t or "").encode().split()) for t in texts]
    assert mixing.taken(docs(spark, [])).collect() == []
    assert [(r.size, r.source_size, r.target, r.taken) for r in mixing.taken(docs(spark, [(1, None, None), (2, " ", "a")])).collect()] == [(0, 0, 0.0, 0)] * 2


def test_orders_by_digest(spark):
    """A round that ends early takes the documents whose digests come first."""
    rows = [(i, "w " * 10, "a") for i in range(100)] + [(1000 + i, "w " * 10, "b") for i in range(100)]
    got = {r.doc_id: r.taken for r in mixing.taken(docs(spark, rows), cycle=(1, 3), block=10**6).collect()}
    first = sorted((i for i, _, s in rows if s == "a"), key=lambda i: hashlib.md5(str(i).encode()).digest())
    assert [got[i] for i in first] == [10] * 100 and sum(got[1000 + i] for i in range(100)) == 2000


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{Path(sf) / 'documents.parquet'}'")
    want = con.execute(oracle_sql()["op13_mixing"]).fetchall()
    got = queries()["op13_mixing"](spark, sf).collect()
    told = lambda rows: sorted((i, n, s, round(t, 6), k) for i, n, s, t, k in rows)
    assert told(got) == told(want) and len(got) == 1000
