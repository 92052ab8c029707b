import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provena.functions import fuzzy
from provena.operators import fuzzy_tier


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def pairs_within(known, per_edit):
    return {(s, a, b, d) for s, a in known for t, b in known if s == t and a < b and (d := distance(a, b)) <= max(len(a), len(b)) // per_edit}


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=400))
def test_pieces_against_a_loop(text):
    if not text or any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    size = 3
    while size * 64 < len(text):
        size *= 2
    for s, digest in fuzzy.digests(text):
        assert s in (size, 2 * size)
        n, piece = 0, ""
        for i, c in enumerate(text):
            piece += c
            h = sum(ord(text[i - k]) * 31**k for k in range(7) if i >= k) % 2**32
            if h % s == s - 1 or i == len(text) - 1:
                assert digest[n] == fuzzy._pieces(piece, fuzzy.rolling(fuzzy.np.zeros(len(piece), "<u4")), 10**6)
                n, piece = n + 1, ""
        assert n == len(digest)


def test_edits_move_few_pieces():
    rnd = random.Random(1)
    text = " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "x", "yy", "zzz"]) + str(rnd.randint(0, 99)) for _ in range(900))
    a = dict(fuzzy.digests(text))
    b = dict(fuzzy.digests(text[:500] + "EDITED" + text[500:2000] + text[2010:]))
    for s in a.keys() & b.keys():
        assert 0 < distance(a[s], b[s]) <= 8 and len(a[s]) > 15
    assert fuzzy.digests(None) == fuzzy.digests("") == [] and [len(d) for _, d in fuzzy.digests("a")] == [1, 1]


@pytest.mark.parametrize("per_edit", [3, 4, 10])
def test_all_pairs_of_random_strings(spark, per_edit):
    rnd = random.Random(per_edit)
    known = set()
    for _ in range(40):
        a = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 130)))
        for _ in range(5):
            known.add((rnd.choice([3, 6]), a))
            cut = rnd.randint(0, len(a))
            a = a[:cut] + rnd.choice(["", "x", "abc"]) + a[cut + rnd.randint(0, 3) :]
    known = {(s, a) for s, a in known if a}
    df = spark.createDataFrame(sorted(known), "size long, digest string")
    got = {tuple(r) for r in fuzzy_tier.near_pairs(df, per_edit).collect()}
    assert got == pairs_within(known, per_edit) and len(got) > 50
    asked = sorted(known)[::3]
    near = {tuple(r) for r in fuzzy_tier.near_digests(spark.createDataFrame(asked, "size long, digest string"), df, per_edit).collect()}
    both = got | {(s, b, a, d) for s, a, b, d in got} | {(s, a, a, 0) for s, a in known}
    assert near == {(s, a, b, d) for s, a, b, d in both if (s, b) in set(asked)}


def test_all_pairs_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null")
    files = docs.select(F.col("doc_id").alias("file"), F.inline(fuzzy.fuzzy_digests(F.col("text"))))
    rows = files.collect()
    first = {}
    for r in rows:
        first[r["size"], r.digest] = min(first.get((r["size"], r.digest), r.file), r.file)
    pairs, members = fuzzy_tier.linked(files, 5)
    want = {(s, min(first[s, a], first[s, b]), max(first[s, a], first[s, b]), d) for s, a, b, d in pairs_within(set(first), 5)}
    assert {tuple(r) for r in pairs.collect()} == want and want
    assert {tuple(r) for r in members.collect()} == {(r.file, r["size"], first[r["size"], r.digest]) for r in rows}


def test_probes_and_pairs_go_as_numbers(spark, monkeypatch):
    """No row that is exchanged carries a digest's text; digests that share a number are still told apart and paired."""
    known = spark.createDataFrame([(3, "abcdefghijkl"), (3, "abcdefghijkx"), (3, "zzzzzzzzzzzzzzzz")], "size long, digest string")
    kinds = {c for df in (fuzzy_tier._with_segments(known, 10), fuzzy_tier._with_probes(known, 10)) for _, c in df.dtypes}
    assert kinds == {"bigint"}
    monkeypatch.setattr(fuzzy_tier, "_id", lambda name="id": F.lit(7).cast("long").alias(name))
    assert [tuple(r) for r in fuzzy_tier.near_pairs(known).collect()] == [(3, "abcdefghijkl", "abcdefghijkx", 1)]
