import base64
import hashlib
import io
import random
import struct

import pytest

from provena.llm import warc
from provena.llm.queries import queries

SCHEMA = "page_id long, url string, html string, sha string, first long"


def expected(rows):
    last = {}
    for p, _, h, *_ in rows:
        k = h or ""
        last[k] = p if last.get(k) is None or p is not None and p > last[k] else last[k]
    out = []
    for p, _, h, *_ in rows:
        b = (h or "").encode()
        top = last[h or ""]
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if p == top else "revisit", None if p == top else top))
    return sorted(out, key=str)


def read(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    manifest = warc.write_archives(df, warc.archive_folder(spark), **kw)
    num = lambda x: int(x) if x and x != "null" else None
    back = warc.read_archives(manifest, payload=True).collect()
    return sorted(((num(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, num(r.refers_to)) for r in back), key=str), back


def test_round_trip_with_edges(spark):
    rng = random.Random(0)
    rows = [(i, f"http://h/{i}\r\nx", "<p>" + " ".join(rng.choice(["alpha", "beta", "é", "\r\n\r\n"]) for _ in range(300)), "c", 1) for i in range(80)]
    rows += [(100 + i, None, rows[i % 5][2], "c", 1) for i in range(40)]
    rows += [(200, "u", None, "c", 1), (201, "u", "", "c", 1), (202, "u", "x" * 3_000_000, "c", 1), (202, "u", "x" * 3_000_000, "c", 1), (None, "u", "no id", "c", 1), (None, "u", rows[0][2], "c", 1)]
    got, back = read(spark, rows)
    assert got == expected(rows)
    text = {r[0]: (r[2] or "").encode() for r in rows}
    assert all(r.payload == text[int(r.record_id)] for r in back if r.record_type == "response" and r.record_id != "null")
    assert read(spark, rows, min_bytes=10**9)[0] == sorted(((p, len((h or "").encode()), warc.payload_digest((h or "").encode()), "response", None) for p, _, h, *_ in rows), key=str)
    assert read(spark, [])[0] == []
    assert read(spark, rows, broadcast_rows=0)[0] == got


def test_archive_layout():
    rng = random.Random(1)
    records = [warc.record(i, "http://a", b"<html>" + b" ".join(rng.choice([b"one", b"two", b"three"]) for _ in range(200)), None) for i in range(300)]
    out = io.BytesIO()
    n, size = warc.write_archive(out, iter(records), sample_bytes=100_000)
    data = out.getvalue()
    assert (n, size) == (300, len(data)) and struct.unpack("<I", data[:4])[0] == warc.DICT_MAGIC
    assert data.count(struct.pack("<I", warc.ZSTD_MAGIC)) >= 300
    assert list(warc.read_archive(io.BytesIO(data))) == records
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(data[:-5])))
    for n in (1, 2):
        small = io.BytesIO()
        warc.write_archive(small, iter(records[:n]))
        assert struct.unpack("<I", small.getvalue()[:4])[0] == warc.DICT_MAGIC
        assert list(warc.read_archive(io.BytesIO(small.getvalue()))) == records[:n]
    assert warc.write_archive(io.BytesIO(), iter([])) == (0, 0)


def test_a_file_to_a_task(spark):
    df = spark.range(400).selectExpr("id page_id", "'u' url", "repeat(string(id), 50) html", "'' sha", "0L first").repartition(8)
    manifest = warc.write_archives(df, warc.archive_folder(spark))
    assert manifest.count() == 8
    assert warc.read_archives(manifest).rdd.getNumPartitions() == 8


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in queries()["op3_warc"](spark, sf).collect()), key=str) == expected(rows)
