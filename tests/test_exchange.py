import json

import pytest

from provena.sources import exchange

CONTENT = {"x/c.h": {"s1": {"winnow": [1, 2], "tags": ["5.0", "5.1"]}, "s2": {"winnow": [], "tags": ["4.0"]}}}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("repo", ["one/kernel", "two/library"])
def test_databases_of_one_repository(spark, tmp_path, repo):
    db = {"repo": repo, "files": ["x/c.h"], "content": CONTENT, "tags": {"5.0": {"x/c.h": "s1"}, "5.1": {"x/c.h": "s1", "repo": "s9"}}}
    (tmp_path / "db.json").write_text(json.dumps(db))
    contents, tags = exchange.read_fingerprint_db(spark, f"{tmp_path}/db.json")
    assert rows(tags) == [("5.0", "x/c.h", "s1", repo), ("5.1", "repo", "s9", repo), ("5.1", "x/c.h", "s1", repo)]
    assert rows(contents) == [(repo, "x/c.h", "s1", [1, 2], ["5.0", "5.1"]), (repo, "x/c.h", "s2", [], ["4.0"])]


def test_database_of_several_repositories(spark, tmp_path):
    tags = {"5.0": {"repo": "o/A", "files": {"x/c.h": "s1"}}, "5.1": {"repo": "o/A", "files": {"x/c.h": "s1", "y.h": "s3"}}, "4.0": {"repo": "o/B", "files": {"x/c.h": "s2"}}}
    (tmp_path / "db.json").write_text(json.dumps({"repos": ["o/A", "o/B"], "files": ["x/c.h"], "content": CONTENT, "tags": tags}, indent=1))
    contents, told = exchange.read_fingerprint_db(spark, f"{tmp_path}/db.json")
    assert rows(told) == [("4.0", "x/c.h", "s2", "o/B"), ("5.0", "x/c.h", "s1", "o/A"), ("5.1", "x/c.h", "s1", "o/A"), ("5.1", "y.h", "s3", "o/A")]
    assert {r.repo for r in contents.collect()} == {None}


@pytest.mark.parametrize(
    "db",
    [
        {"files": [], "content": {}, "tags": {"1": {"a": "b"}}},
        {"repo": "r", "repos": ["r"], "tags": {"1": {"a": "b"}}},
        {"repo": "r", "tags": {"1": {"repo": "r", "files": {"a": "b"}}}},
        {"repos": ["r"], "tags": {"1": {"a": "b"}}},
        {"repos": ["r"], "tags": {"1": {"repo": "r"}}},
        {"repo": "r", "tags": {"1": ["a"]}},
    ],
)
def test_other_forms_are_errors(spark, tmp_path, db):
    (tmp_path / "db.json").write_text(json.dumps(db))
    with pytest.raises(Exception, match="fingerprint database"):
        exchange.read_fingerprint_db(spark, f"{tmp_path}/db.json")[1].collect()


@pytest.mark.parametrize("parts", [1, 3])
@pytest.mark.parametrize("repo", ["one/repo", None])
def test_round_trip(spark, tmp_path, parts, repo):
    contents = spark.createDataFrame([("a.c", "s1", [3], ["1", "2"]), ("b.c", "s2", [], ["2"]), (None, "s3", [], []), ("c.c", None, [], [])], "filename string, sha256 string, winnow array<bigint>, tags array<string>")
    tags = spark.createDataFrame([("1", "a.c", "s1", "o/A"), ("2", "a.c", "s1", "o/A"), ("2", "b.c", "s2", "o/A"), ("9", "b.c", "s1", "o/A"), ("9", "b.c", "s2", "o/B"), (None, "b.c", "s2", "o/B")], "tag string, filename string, sha256 string, repo string")
    own = tags if repo is None else tags.where("repo = 'o/A'").drop("repo")
    exchange.write_fingerprint_db(f"{tmp_path}/db", repo, contents, own, parts)
    back, told = exchange.read_fingerprint_db(spark, f"{tmp_path}/db")
    assert rows(back) == [(repo, "a.c", "s1", [3], ["1", "2"]), (repo, "b.c", "s2", [], ["2"])]
    where = lambda r: r if repo is None else repo
    assert rows(told) == sorted([("1", "a.c", "s1", where("o/A")), ("2", "a.c", "s1", where("o/A")), ("2", "b.c", "s2", where("o/A")), ("9", "b.c", *(("s2", "o/B") if repo is None else ("s1", repo)))], key=repr)
    if parts == 1:
        (doc,) = [json.loads(f.read_text()) for f in (tmp_path / "db").glob("part*.json") if f.stat().st_size]
        assert set(doc) == {"repos" if repo is None else "repo", "files", "content", "tags"}
        assert repo or doc["repos"] == ["o/A", "o/B"] and doc["tags"]["1"] == {"repo": "o/A", "files": {"a.c": "s1"}}
