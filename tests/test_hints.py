import io
import urllib.error

import pytest
from pyspark.sql import functions as F

from provena.operators import hints, report
from provena.sources import fetch


def test_hints(spark):
    df = spark.createDataFrame([('#define X_VERSION_STRING "2.28.3"\n',), ("/* Version: 1.4 */",), ("none",), ("# define TF_VERSION V10.4.3-rc",)], "t string")
    assert [r[0] for r in df.select(hints.version_hint(F.col("t"))).collect()] == ["2.28.3", "1.4", None, "10.4.3-rc"]
    files = spark.createDataFrame([("f1", "x/src/lib/a.c"), ("f2", "a.c")], "file string, path string")
    known = spark.createDataFrame([("up/lib/a.c", "c"), ("z/src/lib/a.c", "d"), ("other/a.c", "e")], "path string, component string")
    assert {(r.component, r.shared) for r in hints.path_hints(files, known).collect()} == {("c", 2), ("d", 3)}
    tags = spark.createDataFrame([("r", t) for t in ("v2.8", "v2.10", "mbedtls-2.9", "v2.9.1")], "repo string, tag string")
    assert {(r.scheme, r.tag) for r in hints.newest_by_scheme(tags).collect()} == {("v:2", "v2.10"), ("mbedtls-:2", "mbedtls-2.9"), ("v:3", "v2.9.1")}
    rows = spark.createDataFrame([("a", "x/list.o"), ("a", "queue.obj"), ("a", None)], "archive string, member string")
    assert {r.symbol for r in hints.member_stems(rows).collect()} == {"list", "queue"}


def test_reports(spark):
    files = spark.createDataFrame([("g", "a.c", ["v1", "v2"], None), ("g", "b.c", [], [(0.5, "v1"), (0.251, "v0")]), ("g", "c.c", [], None)], "group string, filename string, exact_matches array<string>, top_candidates array<struct<score:double,tag:string>>")
    assert [r.line for r in report.file_lines(files).collect()] == ["g a.c exact: v1, v2", "g b.c closest: 0.50 v1, 0.25 v0", "g c.c closest: none"]
    v = spark.createDataFrame([("g", "CONFIRMED", ["v1"], []), ("h", "INCOMPLETE", [], ["a.c"])], "group string, verdict string, tags array<string>, missing array<string>")
    assert [r.line for r in report.verdict_lines(v).collect()] == ["g CONFIRMED v1", "h INCOMPLETE missing a.c"]
    votes = spark.createDataFrame([("f", "m1", 3), ("f", "m2", 9)], "file string, md5 string, votes long")
    assert report.vote_lines(votes, 1).first().line == "f: m2 9"


def test_fetch_waits_and_gives_up():
    calls, slept = [], []

    def opener(codes):
        it = iter(codes)

        def open_(request):
            calls.append(request.full_url)
            code = next(it)
            if code != 200:
                raise urllib.error.HTTPError(request.full_url, code, "", {}, None)
            return io.BytesIO(b"ok")

        return open_

    assert fetch.fetch("http://x", opener=opener([429, 429, 200]), sleep=slept.append) == b"ok"
    assert slept == [0.3, 5.0, 0.3, 10.0, 0.3]
    assert fetch.fetch("http://x", opener=opener([404]), sleep=slept.append) is None
    assert fetch.fetch_first(["http://a", "http://b"], opener=opener([404, 200]), sleep=slept.append) == ("http://b", b"ok")
    with pytest.raises(urllib.error.HTTPError):
        fetch.fetch("http://x", attempts=2, opener=opener([429, 429]), sleep=slept.append)
    assert fetch.probe("l", "http://x", {"a": 1}, opener=opener([500]), sleep=slept.append)["error"]
    assert fetch.package_query(name="n", version="1") == {"package": {"name": "n"}, "version": "1"}
