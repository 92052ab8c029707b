"""Suffix-tree scores and unigram base against plain Python."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from provena.llm import pst
from provena.llm.queries import queries

SF = "/root/testdata/sf0.001"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_tree(train, min_count, divergence):
    """The same definition, with dictionaries: (probability of a symbol in a context, retained contexts)."""
    D = pst.DEPTH
    counts = {k: {} for k in range(D + 1)}
    for t in train:
        s = b"\0" * D + " ".join(tokens(t)).encode().replace(b"\0", b"\x7f") + b"\0"
        for i in range(D, len(s)):
            for k in range(D + 1):
                counts[k].setdefault(s[i - k : i], Counter())[s[i]] += 1
    root = [0.1 + counts[0].get(b"", {}).get(x, 0) for x in range(256)]
    mass = sum(root)
    known = {c: n for k in range(1, D + 1) for c, n in counts[k].items() if sum(n.values()) >= min_count}

    def p(ctx, x):
        if not ctx:
            return root[x] / mass
        n = known[ctx]
        return (n[x] + len(n) * p(ctx[1:], x)) / (sum(n.values()) + len(n))

    kept = {b""}
    for ctx, n in known.items():
        size = sum(n.values())
        if sum(c / size * math.log(c / size / p(ctx[1:], x)) for x, c in n.items()) - (len(n) - 1) / (2 * size) >= divergence:
            kept |= {ctx[j:] for j in range(len(ctx))}
    return p, kept


def brute_tree_scores(train, texts, min_count, divergence):
    D = pst.DEPTH
    p, kept = brute_tree(train, min_count, divergence)
    out = []
    for t in texts:
        s = b"\0" * D + " ".join(tokens(t)).encode().replace(b"\0", b"\x7f") + b"\0"
        lp = 0.0
        for i in range(D, len(s)):
            k = 0
            while k < D and s[i - k - 1 : i] in kept:
                k += 1
            lp += math.log10(p(s[i - k : i], s[i]))
        out.append(lp)
    return out


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    train = [d.text for d in docs if zlib.crc32(str(d.doc_id).encode()) % 10]
    c = Counter(w for t in train for w in tokens(t))
    c["</end>"] = len(train)  # no word of the table
    n, v = sum(c.values()), len(c)
    tree = brute_tree_scores(train, [d.text for d in docs], 4, 0.02)
    got = {r.doc_id: r for r in queries()["op10_pst"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d, lp in zip(docs, tree):
        w = [*tokens(d.text), "</end>"]
        r = got[d.doc_id]
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, zlib.crc32(str(d.doc_id).encode()) % 10 == 0)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(lp, rel=1e-4)


def trained(spark, texts, **kw):
    return pst.train(spark.createDataFrame([(t,) for t in texts], "text string"), **kw)


def test_distributions_sum_to_one(spark):
    rng = random.Random(0)
    texts = ["".join(rng.choice("abcde ") for _ in range(300)) for _ in range(30)]
    tree = pst.gathered(trained(spark, texts, min_count=2, divergence=0.01), None)
    assert sum(len(c) for c, *_ in tree.levels) > 20
    for k, (contexts, *_) in enumerate(tree.levels, 1):
        for c in contexts[:5]:
            p = 10.0 ** tree.grams((int(c) << pst.BITS) + np.arange(256))
            assert p.sum() == pytest.approx(1, abs=1e-4)


def test_the_tree_grows_with_the_corpus(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    small, large = ([" ".join(rng.choice(words) for _ in range(400)) for _ in range(n)] for n in (10, 60))
    a, b = (trained(spark, t, min_count=8).contexts.count() for t in (small, large))
    assert b > 2.5 * a > 0


def test_parts_of_the_tree_give_the_same_scores(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(40)] + [None, "", "zz\0 never seen ÿ"]
    model = trained(spark, texts[:30], min_count=3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r.doc_id: r for r in pst.score(docs, model).collect()}
    assert len(pst.parts(model, 200)) > 4
    split = {r.doc_id: r for r in pst.score(docs, model, part_entries=200).collect()}
    assert set(whole) == set(split) == set(range(len(texts)))
    for i, r in whole.items():
        assert r.score == pytest.approx(split[i].score) and r.base_score == split[i].base_score
    for i, lp in enumerate(brute_tree_scores(texts[:30], texts, 3, 0.02)):
        assert whole[i].score == pytest.approx(lp, rel=1e-4)


def test_edge_rows_and_small_head(spark):
    rows = [(1, "a b b", "x", 1), (2, None, "x", 2), (3, "", None, 3), (None, "A\tB  c", "y", 4), (2, None, "x", 2), (5, "a" * 50_000, "z", 5), (6, "nul\0 é ü 漢字", "z", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, row int")
    model = pst.train(df)
    wide = {(r.doc_id, r.n_tokens): r for r in pst.score(df, model).collect()}
    slim = {(r.doc_id, r.n_tokens): r for r in pst.score(df, model, head_words=1).collect()}
    assert len(pst.score(df, model).collect()) == 7 and set(wide) == set(slim)
    for k in wide:
        assert wide[k].n_known == slim[k].n_known == k[1] and wide[k].base_score == pytest.approx(slim[k].base_score) and wide[k].score == slim[k].score
    empty = df.where("false")
    assert pst.score(empty, model).collect() == []
    nothing = pst.train(empty)
    r = pst.score(df.where("doc_id = 1"), nothing).first()
    assert (nothing.train_tokens, r.n_known) == (0, 0) and r.base_score == pytest.approx(0) and r.score < 0


def test_tree_beats_the_base_on_held_out_documents(spark):
    r = queries()["op10_pst"](spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert r[1] > r[0]
