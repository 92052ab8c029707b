from provena.llm import url_filter
from provena.llm.queries import URL_RULES, queries


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:end]), rest[end:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else default


URLS = [
    None, "", "no scheme", "http://", "://x.org/", "http://EXAMPLE.org/es/1?q=1#f", "http://a.b.example.org/en/1", "http://example.org/en/2", "http://example.org",
    "http://example.org?x=/es/", "http://badexample.org/es/", "http://x.com/fr/a", "http://x.com/de/", "http://x.com/DE/", "http://org/", "http://x.org./", "http://é.org/ü/",
    "http://u.com:80/fr/", "a://b://x.org/", "http://x.org/" + "p" * 50_000, "http://..org//", "http://x.org/a\nb", "http://İ.COM/fr/", "http://x.com/fr",
]


def test_matches_brute_force(spark):
    rules = [*URL_RULES, ("x.com", "/fr/a", "block"), ("m", "/fr/", "block"), ("com", "/de/é", "block"), ("b.example.org", "/en", "allow")]
    extra = [(None, "/", "block"), ("org", None, "block"), ("", "/", "block"), ("org", "", "block"), ("net", "/", None), URL_RULES[0]]
    names = ["u", "__u", "__key", "__best", "filter_url", "filter_key", "filter_best", "k", "d"]
    df = spark.createDataFrame([(i % 9, u, "clash", *["c"] * len(names)) for i, u in enumerate(URLS + URLS)], "page_id long, url string, rule string, " + ", ".join(f"{c} string" for c in names))
    for limit in (10**6, 0):
        got = url_filter.judge(df, spark.createDataFrame(rules + extra, "host string, path string, verdict string"), broadcast_rows=limit, broadcast_bytes=limit)
        assert got.columns == ["page_id", "url", *names, "host", "path", "rule", "verdict"]
        rows = got.collect()
        assert len(rows) == 2 * len(URLS)
        for r in rows:
            assert (r.host, r.path, r.rule, r.verdict) == brute(r.url, rules), r.url
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_empty(spark):
    df = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    assert url_filter.judge(df.where("false"), rules).collect() == []
    assert url_filter.judge(df, rules.where("false"), default="block").first().verdict == "block"


def test_plan_runs_no_python(spark):
    df = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    got = url_filter.judge(df, spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries()["op9_url_filter"](spark, sf).collect()
    assert len(got) == len(urls) and all((r.host, r.path, r.rule, r.verdict) == brute(urls[r.page_id], URL_RULES) for r in got)
    assert len({r.rule for r in got}) > 3
