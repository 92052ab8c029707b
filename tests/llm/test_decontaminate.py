import random
import re

from pyspark.sql import Row

from provena.llm import decontaminate as dc

DOC, ITEM = "doc_id long, text string, item_id string, q int", "item_id long, text string, doc string"


def grams(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs, items):
    out = {}
    for d, t, *_ in docs:
        for i, s, *_ in items:
            g = grams(s)
            n = len(grams(t) & g)
            if g and n >= 0.8 * len(g) - 1e-9:
                out[d, i] = (max(n, out.get((d, i), (0,))[0]), len(g))
    return out


def test_matches_brute_force_at_every_size(spark):
    rng = random.Random(0)
    row = Row("doc_id", "text", "item_id", "q")
    vocab = ["w%d" % i for i in range(200)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n)), "x") for i, n in enumerate([1, 4, 5, 5, 6, 8, 9, 12, 20, 33, 64, 130, 300])]
    items += [items[7], (50, None, "x"), (51, "", "x"), (52, "Same same same same same same same", "x")]
    docs = []
    for k in range(150):
        body = [rng.choice(vocab) for _ in range(rng.choice([0, 5, 30, 400, 3000]))]
        item = rng.choice(items)[1]
        part = (item or "").split()
        for _ in range(rng.choice([0, 0, 1, 2, 6]) if part else 0):
            part[rng.randrange(len(part))] = rng.choice(vocab)
        cut = rng.randint(0, len(part))
        docs.append((k, " ".join(part[:cut] + body * (k % 3 > 0) + part[cut:]).title() if k % 2 else ", ".join(part + body), "c", 0))
    docs += [docs[3], (None, items[9][1], "c", 0), (900, None, "c", 0), (901, "same " * 50_000, "c", 0), (3, items[10][1], "c", 0)]
    d, i = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    want = brute(docs, items)
    assert len(want) > 30
    for limit in (1_000_000, 0):  # both ways to look up
        found = dc.contained_items(d, i, broadcast_rows=limit)
        assert {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in found.collect()} == want
        kept = dc.without_items(d, i, broadcast_rows=limit)
        sound = [x for x in docs if not brute([x], items)]
        assert kept.columns == d.columns and sorted(map(str, kept.collect())) == sorted(map(str, (row(*x) for x in sound)))
        assert any(x[0] == 3 for x in sound)  # another text of an id that holds an item


def test_rows_stay_or_go_by_their_own_text(spark):
    item = " ".join(f"w{i}" for i in range(12))
    rows = [(None, f"x {item} y", "", 0), (None, "quite another text of some more words", "", 0), (1, item, "", 0), (1, "clean", "", 0), (1, None, "", 0), (1, item, "copy", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, leak_id string, leak_mark int")
    kept = dc.without_items(d, spark.createDataFrame([(7, item, "")], ITEM))
    assert sorted(map(str, (r.text for r in kept.collect()))) == sorted(map(str, (rows[1][1], "clean", None))) and kept.columns == d.columns


def test_empty_tables(spark):
    d, i = spark.createDataFrame([], DOC), spark.createDataFrame([(1, "a b c d e f", "")], ITEM)
    assert dc.contained_items(d, i).collect() == []
    one = spark.createDataFrame([(1, "a b c d e f", "", 0)], DOC)
    assert dc.contained_items(one, i.where("false")).collect() == [] and dc.without_items(one, i.where("false")).count() == 1


def test_plan_runs_no_python(spark):
    d, i = spark.createDataFrame([(1, "a b c d e f", "", 0)], DOC), spark.createDataFrame([(1, "a b c d e f", "")], ITEM)
    plan = dc.contained_items(d, i)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
