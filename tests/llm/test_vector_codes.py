import hashlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from provena.llm import vector_codes as vc
from provena.llm.queries import oracle_sql, queries

CLASH = ["v", "code", "error", "label_error", "part", "entry", "dim", "n", "high", "low", "size", "q", "id", "_of"]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 4), st.integers(1, 16), st.integers(0, 40), st.sampled_from([3, 5000, 1 << 40, 1 << 62]), st.randoms(use_true_random=False))
def test_partial_distances_find_the_nearest(dims, k, n, most, rnd):
    draw = lambda rows: np.array([[rnd.randint(-most, most) for _ in range(dims)] for _ in range(rows)], np.int64).reshape(rows, dims)
    part, book = draw(n), draw(k)
    code, least = vc.nearest(part, book)
    for row, c, d in zip(part.tolist(), code.tolist(), least.tolist()):
        all_of = [sum((x - y) ** 2 for x, y in zip(row, e)) for e in book.tolist()]
        assert (d, c) == (min(all_of), all_of.index(min(all_of)))


def brute(rows):
    """vec_id, label -> as the contract says, row by row in Python's integers."""
    kept = [(i, lab, [int(np.floor(4096 * float(x))) for x in v]) for i, v, lab in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    sizes = [len(q) for _, _, q in kept]
    length = max(set(sizes), key=lambda s: (sizes.count(s), s))
    width = -(-length // 8)
    kept = sorted(((i, lab, q + [0] * (8 * width - length)) for i, lab, q in kept if len(q) == length), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    cut = lambda q: [q[p * width : (p + 1) * width] for p in range(8)]
    books = [[cut(q)[p] for _, _, q in kept[:16]] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def code(q):
        return [min((far(part, e), k) for k, e in enumerate(books[p])) for p, part in enumerate(cut(q))]

    for _ in range(6):
        codes = [code(q) for _, _, q in kept]
        for p in range(8):
            for e in range(len(books[p])):
                mine = [cut(q)[p] for (_, _, q), c in zip(kept, codes) if c[p][1] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    told = [(i, lab, "".join(f"{e:02x}" for _, e in code(q)), sum(d for d, _ in code(q))) for i, lab, q in kept]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(map(repr, ((i, c, d, sum(x for _, other, _, x in told if other == lab), digest) for i, lab, c, d in told)))


def folder(spark, tmp_path, rows):
    df = spark.createDataFrame([(*r, *["x"] * len(CLASH)) for r in rows], "vec_id long, embedding array<float>, label int, " + ", ".join(f"{c} string" for c in CLASH))
    df.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("n,length", [(60, 16), (7, 8), (40, 11)])
def test_query_matches_brute_force(spark, tmp_path, n, length):
    rnd = np.random.default_rng(n)
    rows = [(i, rnd.normal(size=length).astype(np.float32).tolist(), int(i % 3) if i % 4 else None) for i in range(n)]
    rows += [rows[1], rows[1], (None, rows[2][1], None), (0, [0.0] * length, 1), (n, [0.0] * length, 1), (n + 1, [-0.0] * length, 2)]
    rows += [(n + 2, None, 1), (n + 3, [], 1), (n + 4, [None] * length, 1), (n + 5, [float("nan")] * length, 1), (n + 6, [float("inf")] + [1.0] * (length - 1), 1), (n + 7, [1.0], 1)]
    got = queries()["op12_vector_codes"](spark, folder(spark, tmp_path, rows)).collect()
    assert sorted(repr((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256)) for r in got) == brute(rows)


def test_extreme_and_no_vectors(spark, tmp_path):
    rows = [(i, [x] * 8, 1) for i, x in enumerate([3e38, -3e38, 1e12, 0.0, 5e-324])]
    got = {r.vec_id: r for r in queries()["op12_vector_codes"](spark, folder(spark, tmp_path / "a", rows)).collect()}
    assert len(got) == 5 and got[0].error == 0 and len({r.code for r in got.values()}) == 4  # the two smallest are the same integers
    none = queries()["op12_vector_codes"](spark, folder(spark, tmp_path / "b", [(1, None, 1)]))
    assert none.collect() == [] and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert queries()["op12_vector_codes"](spark, folder(spark, tmp_path / "c", [])).collect() == []


def test_decoded_vectors_are_near(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    coded, books = vc.compress(df)
    real = {r.vec_id: r.embedding for r in df.collect()}
    for r in coded.limit(50).collect():
        told = vc.decode(r.code, books)
        off = sum((a - b) ** 2 for a, b in zip(told, real[r.vec_id]))
        assert off == pytest.approx(r.error / 4096**2, rel=0.05)


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{Path(sf) / 'embeddings.parquet'}'")
    want = con.execute(oracle_sql()["op12_vector_codes"]).fetchall()
    got = queries()["op12_vector_codes"](spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(got) > 400
