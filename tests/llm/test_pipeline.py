"""The pipeline's stages on planted cases, and its rows against the stages' own definitions."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from provena.llm.queries import TOKENIZER

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def planted():
    rng = random.Random(0)
    vocab = {l: [f"{l}{''.join(rng.choice(a) for _ in range(6))}" for _ in range(800)] for l, a in (("en", "thewandr"), ("fr", "éèaouxle"))}
    prose = lambda l, n: " ".join(rng.choice(vocab[l]) for _ in range(n))
    items = [prose("en", 30) for _ in range(3)]
    docs = [(i, prose("en" if i % 3 else "fr", 150), "en" if i % 3 else "fr", f"s{i % 4}") for i in range(60)]
    near = docs[5][1].split()
    near[70] = "changed"
    docs += [(100, docs[4][1], "en", "s0"), (101, " ".join(near), "en", "s1")]
    docs += [(110, f"{prose('en', 40)} {items[0]} {prose('en', 400)}", "en", "s0"), (111, items[1], "en", "s0")]
    docs += [(120, None, "en", "s0"), (121, "12 34 !!", "en", "s0"), (122, "", None, None)]
    docs += [(130, prose("en", 60) + " write to ab.12@mail.example.com or 8.8.8.8", "en", "s2"), (None, prose("en", 50), "en", None)]
    return [(i, t, l, s, len(t or "")) for i, t, l, s in docs], items


def test_stages_on_planted_cases(spark, tmp_path):
    rows, items = planted()
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, SCHEMA)
    want = {r[0] for r in rows}
    for (name, stage), gone in zip(cp.STAGES[:-1], ({120, 121, 122}, {100, 101}, {110, 111}, set())):
        docs = stage(spark, docs, str(tmp_path)).cache()
        want -= gone
        assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", "), name
        assert sorted(map(str, (r.doc_id for r in docs.collect()))) == sorted(map(str, want)), name
    text = {r.doc_id: r.text for r in docs.collect()}
    assert "ab.12@" not in text[130] and "8.8.8.8" not in text[130] and text[7] == rows[7][1]
    tok = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    pieces = cp.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    total = 0
    for i, t in text.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        mine = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert sum(p.length for p in mine) == len(ids) and all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in mine)
        total += len(ids)
    assert sum(p.length for p in pieces) == total


def test_run_matches_brute_force(spark):
    """Every stage's rows from its definition: sets of shingles, pseudonyms text by text, ids of a plain tokenizer."""
    import re
    from collections import Counter, defaultdict

    from provena.llm import pii, string_kernel
    from provena.llm.queries import DEMO_KEY

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = string_kernel.train(docs)
    rows = {r.doc_id: r for r in docs.collect()}
    found = dict(zip(rows, zip(*model.predict([r.text for r in rows.values()]))))
    left = [i for i, (lang, score) in found.items() if lang != "und" and score >= cp.MIN_LANGUAGE_SCORE]

    def shingles(words, n=5):
        return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} or ({tuple(words)} if words else set())

    sets = {i: shingles(re.sub("[A-Z]", lambda m: m[0].lower(), rows[i].text).split()) for i in left}
    low = {i: i for i in left}

    def root(i):
        return i if low[i] == i else root(low[i])

    for i in left:
        for j in left:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = sorted((root(i), root(j)))
                low[b] = a
    left = [i for i in left if low[i] == i]
    words = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    items = [s for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if len(w := words(r.text)) >= 5 and (s := shingles(w))]
    held = {i: shingles(words(rows[i].text)) for i in left}
    left = [i for i in left if not any(len(held[i] & s) >= 0.8 * len(s) - 1e-9 for s in items)]
    assert 50 < len(left) < len(rows)
    key = pii.Permuter(DEMO_KEY)
    tok = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    ids = {i: np.array([*tok.encode(pii.pseudonymise(rows[i].text, key)[0], add_special_tokens=False).ids, 1], "<u4") for i in left}
    by_doc = defaultdict(list)
    for p in cp.run(spark, sf).collect():
        by_doc[p.doc_id].append(p)
    assert sorted(by_doc) == sorted(left)
    for i, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[i][at : at + p.length].tobytes()) and p.doc_tokens == len(ids[i])
            at += p.length
        assert at == len(ids[i])
    assert max(Counter((p.sequence_id, p.offset) for x in by_doc.values() for p in x).values()) == 1
