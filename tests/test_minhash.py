import random
from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from provena.operators import minhash_tier as mh


def family(rnd, n, size, changed, words=5000):
    base = [f"w{rnd.randint(0, words)}" for _ in range(size)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(changed):
            text[rnd.randrange(size)] = f"x{rnd.randint(0, 10**9)}"
        out.append(" ".join(text))
    return out


def brute(texts, threshold=0.8):
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").split()
        if w:
            sets.setdefault(frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))), i)
    return {tuple(sorted((i, j))): len(a & b) / len(a | b) for (a, i), (b, j) in combinations(sets.items(), 2) if len(a & b) / len(a | b) >= threshold - 1e-9}


def found(spark, texts, **how):
    files = spark.createDataFrame(list(enumerate(texts)), "file long, text string").select("file", mh.shingle_set(F.col("text")).alias("shingles"))
    sets = mh.distinct_sets(files)
    name = {r.node: r.file for r in sets.collect()}
    return {tuple(sorted((name[r.a], name[r.b]))): r.similarity for r in mh.similar_sets(sets, **how).collect()}


@pytest.mark.parametrize("recall", [0.95, 0.99999])
def test_recall_over_families(spark, recall):
    rnd = random.Random(4)
    texts = [t for k in range(60) for t in family(rnd, 4, rnd.randint(20, 300), rnd.randint(1, 4))] + [None, "", "one two", "one two", "one"]
    want = brute(texts)
    got = found(spark, texts, recall=recall)
    assert all(want[p] == pytest.approx(s) for p, s in got.items()) and len(want) > 100
    assert len(got) >= (0.95 if recall < 0.99 else 1) * len(want)


def test_crowds(spark):
    """A large family near the threshold: its bands are crowded, and its rare shingles find the same pairs."""
    rnd = random.Random(5)
    texts = family(rnd, 120, 300, 3) + family(rnd, 120, 300, 12)  # the second is alike, but below the threshold
    want = brute(texts)
    assert found(spark, texts, recall=0.99999, crowd=4) == pytest.approx(want) and len(want) > 1000


def test_rare_prefixes_leave_out_what_all_share(spark):
    """Sets that share 70 % pair in no prefix: rows do not grow with the square of the crowd."""
    sets = spark.createDataFrame([(f"n{i}", list(range(70)) + list(range(1000 * (i + 1), 1000 * (i + 1) + 30))) for i in range(200)], "node string, shingles array<bigint>")
    assert mh._pairs(mh.rare_prefixes(sets, 0.8), "h", 0.8).count() == 0


def test_bands():
    for threshold, recall in ((0.8, 0.95), (0.5, 0.9), (0.95, 0.999), (0.8, 0.99999)):
        n, rows = mh.bands(threshold, recall)
        assert n * rows <= mh.MOST_HASHES and 1 - (1 - threshold**rows) ** n >= recall
        assert 1 - (1 - threshold ** (rows + 1)) ** (mh.MOST_HASHES // (rows + 1)) < recall
    with pytest.raises(ValueError):
        mh.bands(0.01, 0.999, 4)


def test_empty(spark):
    assert found(spark, [None, ""]) == {}


def test_bands_of_a_batch_are_those_of_each_set(monkeypatch):
    """A row for each set, none for a shingle; sets that are hashed together do not change each other's bands."""
    rnd = random.Random(6)
    sets = [sorted({rnd.randrange(-(2**63), 2**63) for _ in range(n)}) for n in (1, 40, 300, 7, 7)]
    batch = lambda some: pa.RecordBatch.from_pydict({"node": [str(len(s)) for s in some], "shingles": pa.array(some, pa.list_(pa.int64()))})
    told = lambda batches: [x for b in mh._set_bands(5, 4)(iter(batches)) for x in b.to_pylist()]
    want = told([batch([s]) for s in sets])
    assert [x["n"] for x in want] == list(map(len, sets)) and all(len(x["bands"]) == 5 for x in want)
    for most in (1, 50, 10**6):
        monkeypatch.setattr(mh, "_AT_ONCE", most)
        assert told([batch(sets).slice(1), batch(sets)]) == want[1:] + want
