"""Round trips of shards, archives, fingerprint text, trees and artifacts; incremental scans."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from provena.operators import advisory, artifact, profile
from provena.plans.knowledge import elf_archive
from provena.sources import archive, ldb, tree, wfp
from provena.streaming import incremental


@pytest.fixture(scope="module")
def shards(spark, tmp_path_factory):
    rng = random.Random(0)
    keys = [bytes([rng.choice([0, 0x3F]), 0, 0, rng.randrange(3)]) + rng.randbytes(12) for _ in range(40)]
    records = [(k, f"path,{i},{rng.randrange(9)}".encode() * rng.randint(0, 60)) for i, k in enumerate(keys * 3)]
    folder = tmp_path_factory.mktemp("ldb").as_uri()
    told = ldb.write_shards(spark.createDataFrame(records, "key binary, record binary"), folder, node_bytes=900).collect()
    assert sorted(r.shard for r in told) == ["00", "3f"] and sum(r.lists for r in told) == len({k[:4] for k in keys})
    return folder, records


def test_variable_records(spark, shards):
    folder, records = shards
    ldb.register(spark)
    for parts in (1, 3):
        rows = spark.read.format("ldb").option("slot_parts", parts).load(folder).collect()
        assert sorted((r.key, bytes(r.record)) for r in rows) == sorted((k.hex(), v) for k, v in records)
    key = records[7][0].hex()
    found = spark.read.format("ldb").load(folder).where(F.col("key") == key)
    assert sorted(bytes(r.record) for r in found.collect()) == sorted(v for k, v in records if k.hex() == key)
    assert found.rdd.getNumPartitions() == 1
    prefix = spark.read.format("ldb").load(folder).where(F.col("key").startswith(key[:9])).count()
    assert prefix == sum(k.hex().startswith(key[:9]) for k, _ in records)
    assert spark.read.format("ldb").load(folder).where("key = 'ff'").count() == 0


def test_fixed_records(spark, tmp_path):
    rng = random.Random(1)
    records = [(bytes([7, 0, 1, rng.randrange(4)]), rng.randbytes(16) + i.to_bytes(2, "little")) for i in range(900)]
    folder = (tmp_path / "w").as_uri()
    ldb.write_shards(spark.createDataFrame(records, "key binary, record binary"), folder, record_len=18)
    ldb.register(spark)
    rows = spark.read.format("ldb").option("record_len", 18).load(folder).collect()
    assert sorted((r.key, bytes(r.record)) for r in rows) == sorted((k.hex(), v) for k, v in records)
    with pytest.raises(Exception, match="a shard takes keys"):
        ldb.write_shards(spark.createDataFrame([(b"1234", b"17 bytes of this.")], "key binary, record binary"), folder, record_len=18)
    none = ldb.write_shards(spark.createDataFrame([(None, b"x")], "key binary, record binary"), (tmp_path / "none").as_uri())
    assert none.count() == 0


def by_hand(path, lists):
    """A shard file of {slot: [(size field, data), ...]}, nodes of all lists interleaved, every list behind a pointer to its last node."""
    where, out, at = {}, {}, 5 << 24
    for slot, found in lists.items():
        out[at] = (slot, b"")
        where[slot] = [at + 5]
        at += 5 + 7 + len(found[0][1])
    for k in range(1, max(map(len, lists.values()))):
        for slot, found in lists.items():
            if k < len(found):
                where[slot].append(at)
                at += 7 + len(found[k][1])
    with open(path, "wb") as f:
        f.truncate(at)
        for slot, found in lists.items():
            f.seek(slot * 5)
            f.write((where[slot][0] - 5).to_bytes(5, "little"))
            f.seek(where[slot][0] - 5)
            f.write(where[slot][-1].to_bytes(5, "little"))
            for place, follow, (size, data) in zip(where[slot], [*where[slot][1:], 0], found):
                f.seek(place)
                f.write(follow.to_bytes(5, "little") + size.to_bytes(2, "little") + data)


def test_shards_made_by_hand(spark, tmp_path):
    short = lambda n: n.to_bytes(2, "little")
    a, b = bytes(range(12)), bytes(range(50, 62))
    group = lambda key, *records: key + short(sum(2 + len(r) for r in records)) + b"".join(short(len(r)) + r for r in records)
    data = [group(a, b"one", b"two") + group(b, b"three"), group(a, b"four"), group(b, b"", b"six") + group(a, b"seven")]
    (tmp_path / "v").mkdir()
    by_hand(tmp_path / "v/0b.ldb", {5: [(len(d), d) for d in data], 70_000: [(len(data[1]), data[1])]})
    ldb.register(spark)
    rows = spark.read.format("ldb").load(str(tmp_path / "v")).collect()
    first, other = "0b000005", "0b011170"
    want = [(first, a, b"one"), (first, a, b"two"), (first, b, b"three"), (first, a, b"four"), (first, b, b""), (first, b, b"six"), (first, a, b"seven"), (other, a, b"four")]
    assert [(r.key, bytes(r.record)) for r in sorted(rows, key=lambda r: (r.key[:8], r.rec_no))] == [(k + rest.hex(), v) for k, rest, v in want]
    one = spark.read.format("ldb").load(str(tmp_path / "v")).where(F.col("key") == first + a.hex())
    assert {bytes(r.record) for r in one.collect()} == {b"one", b"two", b"four", b"seven"}

    fixed = [bytes([i]) * 18 for i in range(9)]
    (tmp_path / "f").mkdir()
    by_hand(tmp_path / "f/c9.ldb", {0: [(1, fixed[0])], (1 << 24) - 1: [(5, b"".join(fixed[1:6])), (2, b"".join(fixed[6:8])), (1, fixed[8])]})
    rows = spark.read.format("ldb").option("record_len", 18).load((tmp_path / "f").as_uri()).collect()
    assert sorted((r.key, r.rec_no, bytes(r.record)) for r in rows) == [("c9000000", 0, fixed[0]), *(("c9ffffff", i, fixed[i + 1]) for i in range(8))]


def test_archives(spark, tmp_path):
    members = [("a.o", [("f", 1, 2, 1), ("w", 2, 1, 1), ("u", 1, 2, 0), ("l", 0, 2, 1), ("t", 1, 6, 1), ("x", 1, 13, 1)]), ("text", []), ("dup.o", [("old", 1, 2, 1)]), ("dup.o", [("new", 1, 0, 1)])]
    good, narrow = elf_archive(members), elf_archive(members, wide=False)
    long_name = b"//" + b" " * 14 + b"0           0     0     644     22        `\n" + b"a_very_long_member.o/\n"
    body = archive.members(good)
    first = next(body)[1]
    head = lambda name, n: f"{name:<16}{0:<12}{0:<6}{0:<6}{644:<8}{n:<10}`\n".encode()
    gnu = archive.AR_MAGIC + head("/", 4) + b"\0\0\0\0" + long_name + head("/0", len(first)) + first
    bsd = archive.AR_MAGIC + head("#1/8", 8 + len(first)) + b"b.o\0\0\0\0\0" + first
    big = bytearray(first)
    big[5] = 2
    assert archive.elf_symbols(bytes(big)) is None
    rows = [("good", good), ("narrow", narrow), ("gnu", gnu), ("bsd", bsd), ("cut", good[:-4]), ("magic", b"no archive"), ("empty", archive.AR_MAGIC)]
    read = archive.read_libraries(spark.createDataFrame(rows, "archive string, content binary")).cache()
    got = {}
    for r in archive.defined_globals(read).collect():
        got.setdefault(r.archive, set()).add(r.symbol)
    assert got == {"good": {"f", "w", "new"}, "narrow": {"f", "w", "new"}, "gnu": {"f", "w"}, "bsd": {"f", "w"}}
    told = {r.archive: r for r in archive.summary(read).collect()}
    assert told["good"].skipped == ["text"] and told["cut"].error and told["magic"].error and told["gnu"].error is None
    assert {r.member for r in read.where("archive in ('gnu', 'bsd')").select("member").distinct().collect()} == {"a_very_long_member.o", "b.o"}
    assert {r.type for r in read.where("archive = 'good' and symbol = 'x'").collect()} == {"13"}
    (tmp_path / "sdk/lib/gcc/m4").mkdir(parents=True)
    (tmp_path / "sdk/lib/gcc/m4/x.a").write_bytes(good)
    files = tree.library_paths(tree.read_files(spark, str(tmp_path), "*.{a,lib}")).first()
    assert (files.toolchain, files.core, files.name) == ("gcc", "m4", "x.a")


def test_fingerprint_text(spark):
    text = "file=ABCDEF,10,a,b.c\n1=1f,ABCDEF01\n\nnoise\n5=00ff\nfile=11,2,d.c\nfile=22,3,e.c\n9=1,2\n"
    rows = {(r.path, r.md5, r["size"], r.line, r.hash) for r in wfp.parse(spark.createDataFrame([(text,)], "text string")).collect()}
    assert rows == {("a,b.c", "abcdef", 10, 1, "0000001f"), ("a,b.c", "abcdef", 10, 1, "abcdef01"), ("a,b.c", "abcdef", 10, 5, "000000ff"), ("e.c", "22", 3, 9, "00000001"), ("e.c", "22", 3, 9, "00000002")}
    again = wfp.parse(wfp.render(spark.createDataFrame(list(rows), "path string, md5 string, size long, line int, hash string")))
    assert {tuple(r) for r in again.collect()} == rows


def test_trees(spark, tmp_path):
    for p, t in (("a/x/list.c", b"one"), ("a/y/list.c", b"two\xff"), ("a/x/other.c", b"no"), ("a/x/queue.c", b"q")):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(t)
    by_dir = tree.scan_tree(spark, str(tmp_path), ["list.c", "queue.c"], glob="*.c")
    assert sorted((r.group.rsplit("/", 1)[1], r.filename, r.text) for r in by_dir.collect()) == [("x", "list.c", "one"), ("x", "queue.c", "q"), ("y", "list.c", "two�")]
    whole = tree.scan_tree(spark, str(tmp_path), ["list.c", "queue.c"], "TARGET_ROOT")
    assert sorted((r.filename, r.text) for r in whole.collect()) == [("list.c", "one"), ("queue.c", "q")]


def test_trees_are_listed_by_executors(spark, tmp_path):
    """The driver listed all files, and was sent all their paths."""
    for p in ("t/a/x.c", "t/a/deep/er/y.c", "t/a b#1?/x.c", "t/z.lib", "t/.git/x.c", "t/_x.c", "t/a/x.h"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(p)
    (tmp_path / "t/none").mkdir()
    for glob in (None, "*.c", "*.{c,lib}", "?.[ch]"):
        for root in (f"{tmp_path}/t", f"file:{tmp_path}/t/", f"file://{tmp_path}/t"):
            want = {(r.path, bytes(r.content)) for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob or "*").load(root).collect()}
            assert {(r.path, bytes(r.content)) for r in tree.read_files(spark, root, glob).collect()} == want
    assert {r.filename for r in tree.read_files(spark, f"{tmp_path}/t", names=["y.c"]).collect()} == {"y.c"}
    assert tree.read_files(spark, f"{tmp_path}/t/a/x.c").count() == 1
    found = tree.list_files(spark, f"{tmp_path}/t", "*.c")
    assert found.inputFiles() and not any(x.endswith(".c") for x in found.inputFiles())
    assert tree.list_files(spark, f"{tmp_path}/t/none").count() == 0


def test_artifacts(spark, tmp_path):
    release = {"vendor": "v", "component": "c", "version": "1", "date": "d", "license": "MIT", "purl": "p", "url": "u"}
    old = {"releases": {"r1": release}, "files": {"m1": {"releases": ["r1"], "path": "a.c"}}, "wfp": {"0000000a": [{"md5": "m1", "line": 3}]}}
    with gzip.open(tmp_path / "old.json.gz", "wt") as f:
        json.dump(old, f)
    one = artifact.read_json(spark, str(tmp_path / "old.json.gz"))
    assert one["releases"].first().source_tier == "file" and one["symbol"].count() == 0
    symbol = spark.createDataFrame([("c", "pb_", "r1", "pb_a"), ("c", "pb_", "r1", "pb_b")], "component string, prefix string, release_id string, symbol string")
    artifact.write_json(str(tmp_path / "new"), one["releases"], one["exact"], one["wfp"], symbol)
    two = artifact.read_json(spark, str(tmp_path / "new"))
    for name in ("releases", "exact", "wfp"):
        assert sorted(map(str, two[name].collect())) == sorted(map(str, one[name].collect()))
    assert two["symbol"].count() == 2
    artifact.write_tables(two, str(tmp_path / "tables"))
    assert tuple(artifact.counts(artifact.read_tables(spark, str(tmp_path / "tables"))).first()) == (1, 1, 1)


def test_build_and_merge(spark):
    base = spark.createDataFrame([("b1", "v", "Comp", "1.0", "d", "MIT", "p", "u", "file")], ", ".join(f"{c} string" for c in artifact.RELEASE_COLUMNS))
    refs = spark.createDataFrame([("comp", "v1.0", 0, "s0"), ("comp", "1.0", 1, "s1"), ("comp", "v2.0", 2, "s2")], "component string, tag string, tag_ord int, symbol string")
    meta = spark.createDataFrame([("comp", "", None, "", "s")], "component string, purl string, license string, vendor string, prefix string")
    tier, minted = artifact.build_symbol_fragment(refs, meta, base)
    assert {(r.release_id == "b1", r.symbol) for r in tier.collect()} == {(True, "s1"), (False, "s2")}
    m = minted.first()
    assert (m.version, m.purl, m.license, m.vendor) == ("2.0", "pkg:generic/comp", "NOASSERTION", "comp")
    merged = artifact.merge_releases(base, minted, minted.withColumn("url", F.lit("later")))
    assert {(r.version, r.url) for r in merged.collect()} == {("1.0", "u"), ("2.0", "later")}
    again = artifact.merge_symbol_tiers(tier, tier.limit(1).withColumn("symbol", F.lit("only")))
    assert [r.symbol for r in again.collect()] == ["only"]
    found = artifact.resolve_releases(spark.createDataFrame([("l", "b1"), ("l", "missing")], "lib string, release_id string"), merged, ["lib"])
    assert found.first().versions == ["1.0"]
    both = artifact.discrepancies(spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "component string, version string"), spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "3")], "component string, version string"))
    assert {(r.component, r.state) for r in both.collect()} == {("a", "agrees"), ("b", "differs"), ("c", "not found"), ("d", "undeclared")}
    kept = artifact.select_tiers(spark.createDataFrame([("exact",), ("symbol",)], "tier string"), "fast").collect()
    assert [(r.tier, r.profile) for r in kept] == [("exact", "fast")]


def test_advisories_and_profiles(spark, tmp_path):
    doc = {"generated": "x", "api": "y", "results": [{"label": "l", "query": {"version": "1"}, "result": {"raw_vulns": 3, "cve_count": 2, "cves_sample": ["CVE-1-1"]}}, {"label": "e", "result": {"error": "timeout"}}]}
    (tmp_path / "osv.json").write_text(json.dumps(doc))
    rows = advisory.read_snapshot(spark, str(tmp_path / "osv.json"), advisory.OSV)
    flags = {r.label: r.flag for r in rows.select("label", advisory.coverage_flag(F.col("result.cve_count"), F.col("result.error")).alias("flag")).collect()}
    assert flags == {"l": "covered", "e": "error"}
    rel = spark.createDataFrame([("p", v) for v in ("2.28.8", "2.28.10", "3.0")], "product string, version string")
    ranges = spark.createDataFrame([("p", "A", "2.28.9", "3.0"), ("p", "B", "2.0", None)], "product string, advisory string, introduced string, fixed string")
    assert {(r.version, r.advisory) for r in advisory.version_range_matches(rel, ranges).collect()} == {("2.28.10", "A"), ("2.28.8", "B"), ("2.28.10", "B"), ("3.0", "B")}
    values = spark.createDataFrame([(v,) for v in (5, 1, 1, 9, 3)], "v long")
    r = profile.positional_percentiles(values, F.col("v"), {"p50": 0.5, "p99": 0.99}).first()
    assert (r.least, r.p50, r.p99, r.most, r.ones, r.n) == (1, 3, 9, 9, 2, 5)
    recs = spark.createDataFrame([("k", b"a,b,c"), ("k", b"a"), ("j", b"\xff,\xfe")], "key string, record binary")
    assert {tuple(r) for r in profile.record_stats(recs).collect()} == {(3, 1, 2, 3, 1), (1, 1, 2, 3, 1)}


def test_incremental_scan_takes_only_what_is_new(spark, tmp_path):
    src, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "a"), (2, "a /* x */"), (3, "b")], schema).write.parquet(src)
    incremental.scan_available(incremental.stream_files(spark, src, schema), out, marks)
    assert spark.read.parquet(out).count() == 2
    spark.createDataFrame([(4, "b"), (5, "c")], schema).write.mode("append").parquet(src)
    incremental.scan_available(incremental.stream_files(spark, src, schema), out, marks)
    assert sorted(r.text for r in spark.read.parquet(out).collect())[-1] == "c" and spark.read.parquet(out).count() == 3


def test_a_large_archive_takes_little_more_memory_than_its_bytes():
    """Headers and rows of a whole archive were Python objects at once, several times its size."""
    import tracemalloc

    members = ((f"m{k}.o", [(f"part_{k}", 1, 2, 1), (f"local_{k}", 0, 2, 1)]) for k in range(20_000))
    data = elf_archive(members)
    tracemalloc.start()
    n = sum(1 for _ in archive.ReadArchive.func().eval(data))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 60_000 and peak < len(data)
