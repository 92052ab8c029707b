"""Sketches and text functions against plain Python."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provena.functions import sketch
from provena.functions import text as ft


def brute_winnow(text, gram=30, window=50):
    if not text:
        return set()
    h = lambda g: int.from_bytes(hashlib.blake2b(g.encode(), digest_size=4).digest(), "big")
    if len(text) <= gram:
        return {h(text)}
    hs = [h(text[i : i + gram]) for i in range(len(text) - gram + 1)]
    return {min(hs)} if len(hs) <= window else {min(hs[i : i + window]) for i in range(len(hs) - window + 1)}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é", max_size=200))
def test_winnow(text):
    assert set(sketch.winnow_text(text).tolist()) == brute_winnow(text)


@pytest.mark.parametrize("window", [1, 2, 3, 50, 64, 100])
def test_sliding_min(window):
    x = np.random.default_rng(0).integers(0, 1000, 100)
    assert sketch.sliding_min(x, window).tolist() == [x[i : i + window].min() for i in range(101 - window)]


def test_crc32c_check_value():
    assert sketch.crc32c(np.frombuffer(b"123456789", np.uint8)[None, :])[0] == 0xE3069283


def test_line_sketch():
    rng = random.Random(0)
    raw = "\n".join("".join(rng.choice("abcXYZ_ 12") for _ in range(40)) for _ in range(30)).encode()
    crc = lambda b: int(sketch.crc32c(np.frombuffer(b, np.uint8)[None, :])[0])
    kept, line = [], 1
    for b in raw.lower():
        line += b == 10
        if chr(b).isalnum():
            kept.append((b, line))
    grams = [crc(bytes(b for b, _ in kept[i : i + 30])) for i in range(len(kept) - 29)]
    want, last = [], None
    for i in range(len(grams) - 63):
        low = min(grams[i : i + 64])
        if low != last:
            want.append((f"{crc(low.to_bytes(4, 'little')):08x}", kept[i + 92][1]))
            last = low
    assert sketch.winnow_lines(raw) == want and len(want) > 5
    assert sketch.winnow_lines(None) == sketch.winnow_lines(b"short") == []


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'binary' if isinstance(v, bytes) else 'array<long>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


SPACES = "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0       　"


@pytest.mark.parametrize("text", ["a /* b\n c */ d // e\nf", SPACES + "x" + SPACES + "y" + SPACES, 'u = "http://x"; // tail', "/* open", "", "a/**/b"])
def test_normalize(spark, text):
    want = re.sub(r"\s+", " ", re.sub(r"/\*.*?\*/|//[^\n]*", " ", text, flags=re.S)).strip()
    assert one(spark, ft.normalize(F.col("t")), t=text) == want


def test_comment_edits_do_not_change_the_hash(spark):
    h = ft.sha256_hex(ft.normalize(F.col("t")))
    assert one(spark, h, t="int a; /* x */ int b;") == one(spark, h, t="int a;\n\t// other\nint b;")


def test_long_directive_and_prototypes(spark):
    code = "#define LONG " + "x \\\n" * 60_000 + "end\nint pb_a(void); static pb_type *pb_b (int); /* pb_no(1) */\n#if pb_c(2)\nreturn pb_a(); x=pb_d(1);"
    assert one(spark, ft.prototypes(ft.strip_code(F.col("t")), "pb_"), t=code) == ["pb_a", "pb_b"]


def test_small_functions(spark):
    assert one(spark, ft.jaccard(F.col("a"), F.col("b")), a=[], b=[]) == 1.0
    assert one(spark, ft.jaccard(F.col("a"), F.col("b")), a=[1], b=[]) == 0.0
    assert one(spark, ft.jaccard(F.col("a"), F.col("b")), a=[1, 2, 3], b=[2, 3, 4]) == 0.5
    assert tuple(one(spark, ft.split_record(F.col("t")), t="a,b/c.h,http://x,12")) == ("a,b/c.h", "http://x", 12)
    assert tuple(one(spark, ft.split_record(F.col("t")), t="nothing")) == (None, None, None)
    assert one(spark, ft.url_host(F.col("t")), t="https://h.org/a/b") == "h.org"
    assert one(spark, ft.url_host(F.col("t")), t="x" * 60) == "x" * 40
    assert tuple(one(spark, ft.declared_fields(F.col("t")), t="v,c,1,d")) == ("v", "c", "1", "d", None, None, None)
    assert tuple(one(spark, ft.release_and_path(F.col("t")), t=bytes(range(16)) + "é/a".encode())) == (bytes(range(16)).hex(), "é/a")
    assert one(spark, ft.cve_ids(F.col("t")), t="CVE-2024-2 x CVE-2023-10 CVE-2024-2") == ["CVE-2023-10", "CVE-2024-2"]
    assert one(spark, ft.quote_cpe(F.col("t")), t="cpe:2.3:a:x/y z") == "cpe%3A2.3%3Aa%3Ax/y%20z"
    assert one(spark, ft.mint_id(F.col("a"), F.col("b")), a="p", b="1") == hashlib.md5(b"p@1").hexdigest()
    assert one(spark, ft.shard_byte(F.col("t")), t="/a/f3.ldb") == 0xF3
    assert one(spark, ft.decode(F.col("t")), t=b"a\xffb") == "a�b"
    assert one(spark, ft.version_key(F.col("t")), t="v2.28.10") == [2, 28, 10]


@pytest.mark.parametrize("tag,inside", [("v2.28.1", True), ("mbedtls-3.6.0", True), ("2.1.0.4", True), ("v1.3.0", False), ("v3.6.0-rc1", False), ("v3.6", False)])
def test_release_scope(spark, tag, inside):
    assert one(spark, ft.in_release_scope(F.col("t")), t=tag) is inside


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é漢😀", max_size=300)), max_size=12))
def test_winnow_of_many_texts_is_that_of_each(texts):
    for got, text in zip(sketch.winnow_texts(texts, hash_name="md5"), texts, strict=True):
        assert got.tolist() == sketch.winnow_text(text, hash_name="md5").tolist()


def test_md5_of_a_batch():
    raw = random.Random(0).randbytes(60_000)
    start = np.arange(0, 50_000)
    size = np.array([i % 71 for i in range(50_000)])
    want = [int.from_bytes(hashlib.md5(raw[i : i + n]).digest()[:4], "big") for i, n in zip(start.tolist(), size.tolist())]
    assert sketch.md5_firsts(np.frombuffer(raw, np.uint8), start, size).tolist() == want


def test_md5_grams_are_hashed_together(monkeypatch):
    """No call of a hash for each gram: that took most of the seconds of all winnowing queries."""
    calls = []
    monkeypatch.setattr(sketch, "_md5", lambda g: calls.append(g) or 0)
    monkeypatch.setitem(sketch.HASHES, "md5", sketch._md5)
    sketch.winnow_texts(["some words of a text that is longer than a gram " * 50] * 3, hash_name="md5")
    assert not calls


def test_line_sketches_take_little_memory(spark):
    """A batch's sketches are arrays: a dictionary for each hash took many times the text."""
    rng = random.Random(3)
    text = "\n".join("".join(rng.choice("abcXYZ_ 12") for _ in range(40)) for _ in range(5000)).encode()
    contents = [text, None, b"", b"short", text[:3000]] * 4
    got = sketch.line_sketches(pa.array(contents, pa.binary()))
    assert [[(x["hash"], x["line"]) for x in row] for row in got.to_pylist()] == [sketch.winnow_lines(c) for c in contents]
    tracemalloc.start()
    sketch.line_sketches(pa.array([text] * 20, pa.binary()))
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 3 * 20 * len(text)
    assert sketch.line_sketches(pa.array([], pa.binary())).to_pylist() == []


def test_rows_of_one_row_group_are_spread(spark, tmp_path):
    """A file of one row group that is large enough for a split a core was left as it is, so one task had all its rows."""
    from provena.session import spread

    path = str(tmp_path / "one")
    spark.range(4000).selectExpr("id", "sha2(cast(id AS string), 512) AS text").coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() >= 8
        rows = [r["count"] for r in spread(df.where("text is not null")).selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(rows) == 4000 and max(rows) <= 1000
