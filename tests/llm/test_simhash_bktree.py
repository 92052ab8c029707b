"""Fingerprints, links and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from provena.llm import simhash_bktree as sb
from provena.llm.queries import queries

SCHEMA = "doc_id long, text string, fp string, component string"


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints, radius):
    """prints: {row: (id, fp)} -> the smallest id reachable from each row."""
    todo, out = set(prints), {}
    while todo:
        group, edge = set(), [min(todo)]
        while edge:
            x = edge.pop()
            if x in group:
                continue
            group.add(x)
            edge += [y for y in todo if (prints[x][1] ^ prints[y][1]).bit_count() <= radius]
        ids = [prints[x][0] for x in group if prints[x][0] is not None]
        for x in group:
            out[x] = min(ids) if ids else None
        todo -= group
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocab = ["w%d" % i for i in range(300)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(1, 250))] for _ in range(60)]
    rows = [" ".join(b) for b in base]
    for b in base[:40]:
        for _ in range(3):
            c = list(b)
            c[rng.randrange(len(c))] = rng.choice(vocab)
            rows.append("  ".join(c).upper() if rng.random() < 0.3 else "\n".join(c))
    rows += [None, "", "  \t\n", "one", "one two", "One TWO", "é ü İ x y z ẞ", "x " * 30_000, rows[0], rows[0]]
    data = [(i * 3 % 601, t, "clash", "clash") for i, t in enumerate(rows)]
    return [*data, data[5], data[5], (None, "no id but text one two three four five six", None, None)]


def test_components_match_brute_force(spark, texts):
    for shard_rows, size in ((2048, 1 << 20), (7, 1 << 20), (7, 0)):  # 7: shards of copies are split, their trees broadcast or exchanged
        got = sb.simhash_components(spark.createDataFrame(texts, SCHEMA), shard_rows=shard_rows, broadcast_bytes=size).collect()
        prints = {i: (r[0], brute_print(r[1])) for i, r in enumerate(texts)}
        want = brute_components(prints, 4)
        assert sorted((str(r[0]), r[1] & (2**64 - 1), str(r[2])) for r in got) == sorted((str(prints[i][0]), prints[i][1], str(want[i])) for i in prints)


def test_bk_forest_finds_all_pairs():
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 2**63, (300, 2), dtype=np.uint64)
    fps[100:200] = fps[:100] ^ (np.uint64(1) << rng.integers(0, 64, (100, 2), dtype=np.uint64))
    shard = np.sort(rng.integers(0, 4, 300))
    tree = rng.random(300) < 0.8
    for radius in (0, 2, 40):
        q, n, d = sb.BKForest(fps, shard, tree).within(np.arange(300), radius)
        want = {(i, j) for i in range(300) for j in range(300) if i != j and tree[j] and shard[i] == shard[j] and np.bitwise_count(fps[i] ^ fps[j]).sum() <= radius}
        assert set(zip(q.tolist(), n.tolist())) == want and len(q) == len(want)


def test_pigeonhole_masks_lose_no_pair():
    rng = random.Random(1)
    for n in (10, 10**7, 10**9):
        masks = sb.pigeonhole_masks(n, 4)
        for _ in range(300):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), 4):
                y ^= 1 << b
            assert any(x & m == y & m for m in masks)


def test_empty_table(spark):
    assert sb.simhash_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_matches_brute_force_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries()["op8_simhash_bktree"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    prints = {i: (r.doc_id, brute_print(r.text)) for i, r in enumerate(docs)}
    want = brute_components(prints, 4)
    assert got == {prints[i][0]: (f"{prints[i][1]:016x}", want[i]) for i in prints}
