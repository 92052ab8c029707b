import random

import pytest

from provena.operators import symbols


@pytest.mark.parametrize("n_releases", [3, 64, 150])
def test_windows_against_brute_force(spark, n_releases):
    rnd = random.Random(n_releases)
    names = [f"p{i}" for i in range(40)] + [f"q{i}" for i in range(10)]
    has = {("c", r): set(rnd.sample(names, rnd.randint(1, 45))) for r in range(n_releases)} | {("d", 0): {"p1", "q1"}, ("e", 0): {"q2"}}
    libs = {f"l{i}": set(rnd.sample([*names, "p_other", "x"], rnd.randint(1, 9))) for i in range(40)}
    refs = spark.createDataFrame([(c, f"r{r:03}", r * 7, s) for (c, r), ss in has.items() for s in ss for _ in range(2)], "component string, release string, ord long, symbol string")
    lib = spark.createDataFrame([(k, s) for k, ss in libs.items() for s in ss], "lib string, symbol string")
    comp = spark.createDataFrame([("c", "p"), ("d", "p"), ("e", "p")], "component string, prefix string")
    for mode in ("strict", "fold", "rank"):
        want = set()
        for k, own in libs.items():
            for c in ("c", "d", "e"):
                known = {s for s in own if s.startswith("p") and any(s in ss for (x, _), ss in has.items() if x == c)}
                if not known:
                    continue
                told = [(len(known - ss), r, len(ss - own), len(known & ss)) for (x, r), ss in has.items() if x == c]
                if mode == "strict":
                    kept, least = [t for t in told if not t[0]], 0
                else:
                    least = min(t[0] for t in told if t[3])
                    kept = [t for t in told if t[0] == least and t[3]]
                    if mode == "rank" and least:
                        kept = sorted(told)[:5]
                    else:
                        kept = [t for t in kept if t[2] == min(x[2] for x in kept)]
                want |= {(k, c, f"r{r:03}", u, s, f"closest (+{least} unexplained)" if least else "consistent") for u, r, s, _ in kept}
        got = symbols.window(lib, refs, comp, mode).select("lib", "component", "release", "unexplained", "soft", "kind").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want, mode
    strict = symbols.window(lib, refs, comp, "strict")
    assert {tuple(r) for r in symbols.spans(lib, refs, comp).collect()} == {tuple(r) for r in symbols.span(strict).collect()}


def test_no_libraries_or_releases(spark):
    libs = spark.createDataFrame([("l", "p1"), (None, "p1")], "lib string, symbol string")
    refs = spark.createDataFrame([("c", "r", 1, "p1")], "component string, release string, ord long, symbol string")
    comp = spark.createDataFrame([("c", "p")], "component string, prefix string")
    for mode in ("strict", "fold", "rank"):
        assert symbols.window(libs, refs.where("false"), comp, mode).collect() == []
        assert symbols.window(libs.where("false"), refs, comp, mode).collect() == []
        assert {r.lib for r in symbols.window(libs, refs, comp, mode).collect()} == {"l", None}


def test_a_scan_joins_libraries_with_references_once(spark, monkeypatch):
    """Counts, samples and windows come from one row for a library and a component: its symbols were joined and exchanged for each of them."""
    monkeypatch.setattr(symbols, "known", None)
    refs = spark.createDataFrame([("c", f"r{r}", r, f"p{s}") for r in range(1, 6) for s in range(r)] + [("c", "r1", 1, "q1")], "component string, release string, ord long, symbol string")
    libs = spark.createDataFrame([("l", "p1"), ("l", "p2"), ("l", "p2"), ("l", "p_other"), ("l", "q1"), ("m", "q1"), ("n", "p9"), (None, "p1")], "lib string, symbol string")
    comp = spark.createDataFrame([("c", "p")], "component string, prefix string")
    out = symbols.batch_scan(libs, refs, comp).collect()
    assert [tuple(r) for r in out] == [("l", "c", 3, 2, 1, ["p1", "p2"], 3, "r3", "r5")]
