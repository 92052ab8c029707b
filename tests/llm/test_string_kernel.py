import numpy as np
from pyspark.sql import functions as F

from provena.llm import string_kernel as sk
from provena.llm.queries import queries


def brute_kernel(a, b):
    def sets(t):
        s = "".join(chr(200 + int(x)) for x in sk._fold()[[ord(c) for c in t.lower()]])
        return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)}

    x, y = sets(a), sets(b)
    return len(x & y) / np.sqrt(len(x) * len(y))


def test_kernel_matches_its_definition():
    texts = ["The cat sat on the mat", "le chat était là", "Der Hund läuft 12 mal", "zz"]
    rows = [("abcd"[i], np.unique(sk.grams(t))) for i, t in enumerate(texts)]
    m = sk.fit(rows, landmarks=8)
    for t in texts + ["another short text", "été"]:
        g = np.unique(sk.grams(t))
        row = np.isin(m.codes, g).astype(np.float32)[None, :]
        got = m.kernel(row, np.array([len(g)], np.float32))[0]
        assert np.allclose(got, [brute_kernel(t, x) for x in texts], atol=1e-5)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = queries()["op4_string_kernel"](spark, sf).join(docs, "doc_id").where("held_out and lang is not null")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 250 and right > 0.97


def test_edges(spark):
    rows = [(i, ["The quick brown fox jumps over it", "Der schnelle braune Fuchs springt über ihn", None, "", "12 34 !!", "  ² "][i % 6], ["en", "de", "en", "de", "en", None][i % 6], 1.0) for i in range(60)]
    rows += [(None, "the " * 100_000, "en", 0.0), (7, "The quick brown fox", "en", 0.0), (7, "The quick brown fox", "en", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = df.select("text", sk.predict(df, sk.train(df)).alias("p")).collect()
    assert len(got) == len(rows)
    for r in got:
        letters = r.text and any(c.isalpha() for c in r.text)
        assert (r.p.lang == "und") == (not letters) and 0 <= r.p.score <= 1 and (letters or r.p.score == 0)
        if letters:
            assert r.p.lang == ("de" if "Fuchs" in r.text else "en")
    nothing = sk.train(df.where("false"))
    assert {r.p.lang for r in df.select(sk.predict(df, nothing).alias("p")).collect()} == {"und"}
    assert df.where("false").select(sk.predict(df, nothing)).collect() == []


def folded(text):
    """Written apart from the operator: a-z are themselves, other letters one of 37 slots, all else one symbol."""
    return [("abcdefghijklmnopqrstuvwxyz".index(c) + 1 if c in "abcdefghijklmnopqrstuvwxyz" else 27 + ord(c) % 37 if c.isalpha() and ord(c) > 127 else 0) for c in text.lower()]


def test_query_matches_brute_force(spark):
    """Kernels of sets of n-grams, Nystroem features and ridge regression in plain matrices, over all rows."""
    import zlib

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text", "lang", F.pmod(F.xxhash64(F.lit(4), "doc_id", "text"), F.lit(1 << 30)).alias("h")).collect()

    def sets(t):
        s = folded(t)
        return {tuple(s[i : i + n]) for n in (1, 2, 3) for i in range(len(s) - n + 1)}

    grams = {r.doc_id: sets(r.text) for r in rows if r.text}
    letter = lambda t: bool(t) and any(map(str.isalpha, t))
    train = sorted((r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.lang and letter(r.text)), key=lambda r: r.h)
    langs = sorted({r.lang for r in train})
    assert all(sum(r.lang == x for r in train) <= 200 for x in langs)  # none is left out by the bound
    marks = [r for x in langs for r in [r for r in train if r.lang == x][: max(2, 128 // len(langs))]]
    seen = set().union(*(grams[m.doc_id] for m in marks))
    k = lambda a: np.array([len(grams[a] & seen & grams[m.doc_id]) / np.sqrt(len(grams[a]) * len(grams[m.doc_id])) for m in marks])
    inner = np.stack([k(m.doc_id) for m in marks])
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    sound = values > values.max() * 1e-6
    root = vectors[:, sound] / np.sqrt(values[sound])
    x = np.stack([k(r.doc_id) for r in train]) @ root
    y = np.array([[r.lang == c for c in langs] for r in train], float)
    w = np.linalg.solve(x.T @ x + 1e-3 * len(train) * np.eye(x.shape[1]), x.T @ (y - y.mean(0)))
    got = {r.doc_id: r for r in queries()["op4_string_kernel"](spark, sf).collect()}
    assert sorted(got) == sorted(r.doc_id for r in rows)
    for r in rows:
        g = got[r.doc_id]
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if not letter(r.text):
            assert (g.lang_pred, g.score) == ("und", 0)
            continue
        s = k(r.doc_id) @ root @ w + y.mean(0)
        assert abs(g.score - min(1, max(0, s.max()))) < 5e-3
        assert g.lang_pred == langs[int(s.argmax())] or np.sort(s)[-1] - np.sort(s)[-2] < 5e-3
