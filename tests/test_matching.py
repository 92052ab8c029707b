"""Verdicts, votes, symbol windows on small trees that reach every branch."""

import random

import pytest
from pyspark.sql import functions as F

from provena.operators import match, refdb, symbols, verdict, vote
from provena.session import scratch

FILES = "group string, filename string, exact_matches array<string>, top_candidates array<struct<score:double,tag:string>>"


@pytest.mark.parametrize(
    "rows,floor,want,tags",
    [
        ([("a", ["v1"], [(1.0, "v1")])], 0.05, "INCOMPLETE", []),
        ([("a", ["v1", "v2"], [(1.0, "v2")]), ("b", ["v2"], [(1.0, "v2")])], 0.05, "CONFIRMED", ["v2"]),
        ([("a", ["v1"], [(1.0, "v1")]), ("b", ["v2"], [(1.0, "v2")])], 0.05, "MIXED VERSION WARNING", []),
        ([("a", ["v1", "v2"], [(1.0, "v2")]), ("b", [], [(0.9, "v2")])], 0.05, "PARTIALLY MODIFIED", ["v2"]),
        ([("a", ["v1"], [(1.0, "v1")]), ("b", [], [(0.0, "v9")])], 0.05, "PARTIALLY MODIFIED", []),
        ([("a", [], [(0.01, "v1")]), ("b", [], [(0.9, "v1")])], 0.05, "NOT THIS COMPONENT", []),
        ([("a", [], [(0.01, "v1")]), ("b", [], [(0.9, "v1")])], None, "LIKELY CONSISTENT", ["v1"]),
        ([("a", [], None), ("b", [], [(0.9, "v1")])], 0.05, "INCONCLUSIVE", []),
        ([("a", [], [(0.8, "v1")]), ("b", [], [(0.9, "v1")])], 0.05, "LIKELY CONSISTENT", ["v1"]),
        ([("a", [], [(0.8, "v2")]), ("b", [], [(0.9, "v1")])], 0.05, "INCONSISTENT", []),
    ],
)
def test_tree_verdicts(spark, rows, floor, want, tags):
    df = spark.createDataFrame([("g", *r) for r in rows], FILES)
    r = verdict.tree_verdicts(df, ["a", "b"], floor).first()
    assert (r.verdict, r.tags) == (want, tags) and r.missing == sorted({"a", "b"} - {x[0] for x in rows})


def test_similar_keeps_candidates_without_overlap(spark):
    rng = random.Random(0)
    sketches = {f"s{i}": sorted(rng.sample(range(60), rng.randint(0, 8))) for i in range(40)}
    contents = [("f" if i % 2 else "g", s, sk, sorted(rng.sample([f"t{j}" for j in range(12)], rng.randint(1, 4)))) for i, (s, sk) in enumerate(sketches.items())]
    targets = [(f"x{i}", rng.choice("fgh"), sorted(rng.sample(range(60), rng.randint(0, 6)))) for i in range(30)]
    got = {}
    c = spark.createDataFrame(contents, "filename string, sha256 string, winnow array<long>, tags array<string>")
    for r in match.similar(spark.createDataFrame(targets, "target string, filename string, winnow array<long>"), c).collect():
        got.setdefault(r.target, []).append((r["rank"], round(r.score, 9), r.tag))
    for t, name, w in targets:
        cand = []
        for f, _, sk, tags in contents:
            if f == name and (w or sk):
                cand += [(len(set(w) & set(sk)) / len(set(w) | set(sk)), tag) for tag in tags]
        want = [(k, round(s, 9), tag) for k, (s, tag) in enumerate(sorted(cand, reverse=True)[:5], 1)]
        assert sorted(got.get(t, [])) == want


def test_similar_with_common_hashes(spark):
    rng = random.Random(1)

    def some(n):
        """Half of the hashes are among ten that most contents hold, some among passages, the rest are rare."""
        return sorted({int(rng.random() ** 2 * 10) for _ in range(rng.randint(0, n))} | {20 + 5 * rng.randint(0, 3) + i for i in range(rng.choice([0, 0, 3, 5]))} | {rng.randint(50, 400) for _ in range(rng.randint(0, n))})

    contents = [("f" if i % 3 else "g", f"s{i:03}", some(6), sorted(rng.sample([f"t{j}" for j in range(9)], rng.randint(1, 3)))) for i in range(240)]
    targets = [(f"x{i}", rng.choice("fgh"), some(5)) for i in range(90)]
    c = spark.createDataFrame(contents, "filename string, sha256 string, winnow array<long>, tags array<string>")
    t = spark.createDataFrame(targets, "target string, filename string, winnow array<long>")
    for often, masked in ((2, 3), (8, 8), (20, 0)):
        match.MASKED, before = masked, match.MASKED
        try:
            got = {}
            for r in match.similar(t, c, often=often).collect():
                got.setdefault(r.target, []).append((r["rank"], r.sha256, r.tag, r.inter, r.uni))
        finally:
            match.MASKED = before
        for name, f, w in targets:
            cand = [(-len(set(w) & set(sk)) / len(set(w) | set(sk)), [-ord(x) for x in tag], sha, tag, len(set(w) & set(sk)), len(set(w) | set(sk))) for g, sha, sk, tags in contents if f == g and (w or sk) for tag in tags]
            assert sorted(got.get(name, [])) == [(k, *x[2:]) for k, x in enumerate(sorted(cand)[:5], 1)]


def test_a_hash_of_all_contents_pairs_no_contents(spark):
    """A passage in every text made a row for each target and content."""
    c = spark.range(300).select(F.col("id").alias("c"), F.lit("f").alias("filename"), F.array(F.lit(7), F.lit(8), 1000 + F.col("id")).cast("array<long>").alias("winnow"))
    t = spark.range(200).select(F.col("id").alias("t"), F.lit("f").alias("filename"), F.array(F.lit(7), F.lit(8), 1100 + F.col("id")).cast("array<long>").alias("winnow"))
    assert match.rare_pairs(t, c, match.common_hashes(c, match.OFTEN)).count() == 200


def test_hashes_meet_in_rounds(spark, monkeypatch):
    """All hashes were in exchanges at once, those of contents in two, and each pair of a target and a content had a row for each hash."""
    rng = random.Random(3)
    sets = lambda n, k: [(i, rng.choice("fg"), sorted(set(rng.sample(range(60), 6)) | {7, 1000 + i})) for i in range(n)]
    targets, contents = sets(40, "t"), sets(60, "c")
    t = spark.createDataFrame(targets, "t long, filename string, winnow array<long>")
    c = spark.createDataFrame(contents, "c long, filename string, winnow array<long>")
    df = {}
    for _, f, w in contents:
        for h in w:
            df[f, h] = df.get((f, h), 0) + 1
    want = sorted((i, sorted(k for k, g, v in contents if f == g and h in v)) for i, f, w in targets for h in w if 0 < df.get((f, h), 0) < 4)
    monkeypatch.setattr(match, "ROUND", 100)
    names = []
    real = match.cut
    monkeypatch.setattr(match, "cut", lambda x, name: names.append(name) or real(x, name))
    with scratch():
        met, common = match._met(t, c, 4)
        assert sorted((r.t, sorted(r.cs)) for r in met.collect()) == want and len(want) > 50
        assert sorted(map(tuple, common.collect()), key=str) == sorted(map(tuple, match.common_hashes(c, 4).collect()), key=str) and common.count() > 5
    assert names.count("match-met") == 8


def test_documents_are_sketched_once_for_votes(spark, tmp_path):
    """The vote queries sketched every document for each use, and sent hashes to the vote that no item has."""
    from provena.functions.sketch import winnow_text
    from provena.plans import provenance

    rng = random.Random(3)
    some = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    items = [(i, some(30)) for i in range(5)]
    docs = [(k, some(20) + " " + items[k % 5][1] if k % 3 else some(25)) for k in range(12)] + [(3, items[0][1]), (50, ""), (51, None)]
    docs = [(k, t, "en", "src0", 0) for k, t in docs]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = provenance.snippet_accept(spark, str(tmp_path))
    assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()
    known, want = [set(winnow_text(t, hash_name="md5").tolist()) for _, t in items], {}
    for k, t, *_ in docs:
        want.setdefault(k, set()).update(winnow_text(t, hash_name="md5").tolist())
    want = {k: (max(len(h & x) for x in known), len(h), len(h & set().union(*known))) for k, h in want.items() if h}
    assert {r.doc_id: (r.votes, r.n_hashes, r.usable) for r in found.collect()} == want


def test_the_index_moves_numbers_not_text(spark):
    """wfp_index sent every hash and every MD5 as hexadecimal text."""
    from provena.plans import provenance

    found = provenance.wfp_index(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(h#" in plan and "hashpartitioning(hash#" not in plan
    assert found.where("hash rlike '^[0-9a-f]{8}$' and first_md5 rlike '^[0-9a-f]{32}$' and n_contents > 0").count() == found.count() > 0


def test_first_file_and_reference_tables(spark):
    files = spark.createDataFrame([("g", "a.c", "z/a.c", 1), ("g", "a.c", "b/a.c", 2), ("g", "b.c", "b.c", 3)], "group string, filename string, path string, n int")
    assert sorted((r.filename, r.n) for r in verdict.first_file(files).collect()) == [("a.c", 2), ("b.c", 3)]
    assert [r.path for r in verdict.duplicate_files(files).collect()] == ["z/a.c"]
    lines = ["aa\trefs/tags/v1", "bb\trefs/tags/v1^{}", "cc\trefs/tags/v2", "bb\trefs/tags/v1.0", "dd\trefs/heads/main"]
    refs = refdb.parse_ls_remote(spark.createDataFrame([(x,) for x in lines], "line string"))
    assert {(r.tag, r.sha) for r in refdb.tag_commits(refs).collect()} == {("v1", "bb"), ("v2", "cc"), ("v1.0", "bb")}
    assert {r.tag for r in refdb.list_tags(refs).collect()} == {"v1", "v2", "v1.0"}
    aliases = refdb.commit_aliases(refdb.tag_commits(refs))
    assert {(r.sha, tuple(r.tags)) for r in aliases.collect()} == {("bb", ("v1", "v1.0")), ("cc", ("v2",))}
    fetched = spark.createDataFrame([("bb", "a.c", "s1"), ("cc", "a.c", "s1")], "commit string, filename string, sha256 string")
    assert refdb.alias_contents(fetched, refdb.tag_commits(refs)).first().tags == ["v1", "v1.0", "v2"]
    have = spark.createDataFrame([("v1", "src/a.c"), ("v1", "a.c"), ("v2", "a.c")], "tag string, path string")
    want = spark.createDataFrame([("v1", "a.c"), ("v2", "a.c"), ("v2", "b.c")], "tag string, filename string")
    assert {(r.tag, r.path) for r in refdb.first_template(want, have, ["src/{filename}", "{filename}"]).collect()} == {("v1", "src/a.c"), ("v2", "a.c")}


def test_votes(spark):
    index = spark.createDataFrame([("h1", "m1", 1), ("h1", "m1", 9), ("h2", "m1", 2), ("h2", "m2", 2), ("h3", "m2", 513)], "hash string, md5 string, line int")
    mine = spark.createDataFrame([("f", "m1", h, n) for h, n in (("h1", 1), ("h1", 1), ("h2", 2), ("h3", 2), ("h9", 3))] + [("e", "m2", "h8", 1), ("g", "m2", "h3", 258)], "file string, md5 string, hash string, line int")
    voted = vote.votes(mine, index)
    assert {(r.file, r.md5, r.votes) for r in voted.collect()} == {("f", "m1", 2), ("f", "m2", 2), ("g", "m2", 1)}
    best = vote.winners(voted)
    assert {(r.file, r.md5, r.candidates) for r in best.collect()} == {("f", "m1", 2), ("g", "m2", 1)}
    told = {r.file: r for r in vote.accept(vote.usable(mine, index), best, min_usable=3).collect()}
    assert told["f"].accepted and told["f"].ratio == 0.5 and told["f"].md5 == "m1" and not told["e"].accepted and told["g"].usable == 1
    assert vote.near_winners(voted).where("file = 'f'").first().md5s == ["m1", "m2"]
    checked = {r.file: r for r in vote.cross_check(mine, index).collect()}
    assert (checked["f"].present, checked["f"].absent, checked["f"].same_md5, checked["f"].same_line_le) == (3, 1, 2, 2)
    assert (checked["g"].same_line_le, checked["g"].same_line_be) == (0, 1 if 513 == 0x0201 and 258 == 0x0102 else 0)
    records = spark.createDataFrame([("m1", 1, "late"), ("m1", 0, "first")], "md5 string, rec_no int, path string")
    out = vote.resolve(spark.createDataFrame([("f", "m1"), ("g", "m2"), ("h", "x1")], "file string, md5 string"), records, ["m1", "m2"])
    assert {(r.file, r.path, r.outcome) for r in out.collect()} == {("f", "first", "resolved"), ("g", None, "absent"), ("h", None, "shard unavailable")}
    isles = vote.line_islands(spark.createDataFrame([("f", "m", n) for n in (1, 2, 3, 7, 8, 20)], "file string, md5 string, line int"))
    assert {(r.first_line, r.last_line, r.n) for r in isles.collect()} == {(1, 3, 3), (7, 8, 2), (20, 20, 1)}


def test_artifact_verdicts_and_tiers(spark):
    files = spark.createDataFrame([("g1/a", "m1"), ("g1/b", "m2"), ("g2/a", "m1"), ("g2/b", "mx"), ("g3/a", "my"), ("g4/a", "mz")], "file string, md5 string")
    exact = spark.createDataFrame([("m1", ["r1", "r2"]), ("m2", ["r2"]), ("m3", ["r3"])], "md5 string, release_ids array<string>")
    accepted = spark.createDataFrame([("g2/b", "m3"), ("g4/a", "unknown")], "file string, md5 string")
    told = vote.tier_matches(files, exact, accepted).withColumn("group", F.substring("file", 1, 2))
    assert {(r.file, r.tier) for r in told.collect()} == {("g1/a", "exact"), ("g1/b", "exact"), ("g2/a", "exact"), ("g2/b", "snippet"), ("g3/a", None), ("g4/a", "snippet")}
    got = {r.group: (r.verdict, r.release_ids) for r in verdict.artifact_verdicts(told).collect()}
    assert got == {"g1": ("CONSISTENT", ["r2"]), "g2": ("MIXED VERSION WARNING", []), "g3": ("NOT IDENTIFIED", []), "g4": ("MIXED VERSION WARNING", [])}


def test_symbol_windows(spark):
    sets = {"r1": "ab", "r2": "abc", "r3": "abcd", "r4": "xy", "r5": "x"}
    refs = spark.createDataFrame([("c", r, i, "p" + s) for i, (r, x) in enumerate(sets.items()) for s in x], "component string, release string, ord int, symbol string")
    comp = spark.createDataFrame([("c", "p")], "component string, prefix string")
    libs = spark.createDataFrame([("l1", "pa"), ("l1", "pb"), ("l1", "pz"), ("l1", "other"), ("l2", "pc"), ("l2", "px"), ("l3", "q")], "lib string, symbol string")
    rows = lambda mode, lib: {(r.release, r.unexplained, r.soft, r.kind) for r in symbols.window(libs, refs, comp, mode).where(F.col("lib") == lib).collect()}
    assert rows("fold", "l1") == {("r1", 0, 0, "consistent")}
    assert rows("strict", "l1") == {("r1", 0, 0, "consistent"), ("r2", 0, 1, "consistent"), ("r3", 0, 2, "consistent")}
    assert rows("fold", "l2") == {("r5", 1, 0, "closest (+1 unexplained)")}
    assert {x[0] for x in rows("rank", "l2")} == set(sets) and rows("strict", "l2") == set() and rows("fold", "l3") == set()
    s = symbols.batch_scan(libs, refs, comp).where("lib = 'l1'").first()
    assert (s.n_observed, s.n_known, s.n_unknown, s.known_sample, s.n_consistent, s.first_release, s.last_release) == (3, 2, 1, ["pa", "pb"], 3, "r1", "r3")
    bad = spark.createDataFrame([("broken",)], "lib string")
    assert tuple(symbols.scan_summary(libs, symbols.known(libs, refs, comp), bad).first()) == (4, 2, 1, 1)
    d = {r.symbol: (r.n, r.first_release, r.last_release) for r in symbols.discriminating(refs).collect()}
    assert d["pa"] == (3, "r1", "r3") and d["pd"] == (1, "r3", "r3")
    # a release that is there twice does not change the window
    assert {r.release for r in symbols.window(libs, refs.unionByName(refs), comp, "fold").where("lib = 'l1'").collect()} == {"r1"}


def test_toolchain_variance(spark):
    df = spark.createDataFrame([("n", "m4", t, s) for t, s in (("gcc", "a"), ("gcc", "b"), ("iar", "a"))] + [("k", "m4", "gcc", "a")], "name string, core string, toolchain string, symbol string")
    r = symbols.toolchain_variance(df, ["name", "core"], "toolchain").collect()
    assert [(x.name, x.verdict, x.n_differing) for x in r] == [("n", "DIFFERS", 1)]
    assert [(x.symbol, x.holders) for x in symbols.differing_symbols(df, ["name", "core"], "toolchain").collect()] == [("b", ["gcc"])]


def test_accepted_is_accept_without_the_votes_of_hashes_that_all_share(spark):
    rng = random.Random(3)
    common = list(range(6))
    contents = [(f"m{i:03}", sorted({*common, *rng.sample(range(100, 400), 8)})) for i in range(60)]
    files = [(i, sorted({*rng.sample(common, 3), *rng.sample(contents[i % 60][1], rng.randint(1, 8)), *rng.sample(range(100, 800), 4)})) for i in range(120)]
    files += [(200, common), (201, []), (202, [1, 2, 3])]
    f, c = spark.createDataFrame(files, "file long, hashes array<long>"), spark.createDataFrame(contents, "md5 string, hashes array<long>")
    one, two = f.select("file", F.explode("hashes").alias("hash")), c.select("md5", F.explode("hashes").alias("hash"))
    for ratio in (0.0, 0.3, 0.5, 1.0):
        want = vote.accept(vote.usable(one, two), vote.winners(vote.votes(one, two)), min_ratio=ratio).where("md5 is not null").select("file", "md5")
        got = vote.accepted(f, c, min_ratio=ratio)
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_cross_check_of_a_hash_that_all_share(spark):
    """4,000 files and contents with one hash: 16 million rows met by hash alone, none does now; the index is not broadcast."""
    n = 4000
    files = spark.range(n).select(F.col("id").alias("file"), F.md5(F.col("id").cast("string")).alias("md5"), F.lit("h").alias("hash"), (F.col("id") % 300).cast("int").alias("line"))
    index = files.where("file % 2 = 0").select("hash", "md5", F.when(F.col("file") % 4 == 0, F.col("line")).otherwise(F.expr("line % 256 * 256 + line div 256")).cast("int").alias("line"))
    checked = vote.cross_check(files, index)
    got = checked.agg(*[F.sum(c).alias(c) for c in ("present", "absent", "same_md5", "same_line_le", "same_line_be")]).first()
    both = sum(1 for i in range(0, n, 2) if (i % 300) % 256 * 256 + i % 300 // 256 == i % 300)
    le, be = len(range(0, n, 4)), len(range(2, n, 4))
    assert tuple(got) == (n, 0, n // 2, le + sum(1 for i in range(2, n, 4) if i % 300 in (0, 257)), be + sum(1 for i in range(0, n, 4) if i % 300 in (0, 257)))
    assert both == sum(1 for i in range(0, n, 2) if i % 300 in (0, 257))
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
