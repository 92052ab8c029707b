import re

import pytest

from provena.llm import licenses
from provena.llm.queries import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries()["op1_licenses"](spark, sf).collect()
    assert len(got) == len(docs) and any(r.n_base for r in got)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(docs[r.doc_id])
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


@pytest.mark.parametrize(
    "expression,postfix,labels,value",
    [
        ("MIT", "mit", {"mit"}, 0.95),
        ("MIT OR GPL-2.0-only AND BSD-3-Clause", "mit gpl-2.0-only bsd-3-clause and or", {"mit", "gpl-2", "bsd"}, 0.95),
        ("(MIT OR GPL-2.0-only) AND CC-BY-NC-4.0", "mit gpl-2.0-only or cc-by-nc-4.0 and", {"mit", "gpl-2", "cc-by-nc"}, 0.25),
        ("GPL-3.0+ WITH Classpath-exception-2.0", "gpl-3.0+ classpath-exception-2.0 with", {"gpl-3"}, 0.7),
        ("LicenseRef-x and (mit", "licenseref-x mit and", {"licenseref-x", "mit"}, 0.2),
        ("MIT or", "mit", {"mit"}, 0.95),
        ("mit some prose", "mit", {"mit"}, 0.95),
        ("", "", set(), None),
        (") and (", "", set(), None),
    ],
)
def test_shunting_yard(expression, postfix, labels, value):
    rpn, _ = licenses.postfix(expression)
    assert " ".join(rpn) == postfix
    assert licenses.evaluate(rpn) == (labels, pytest.approx(value) if value is not None else None)


def test_places_and_tags():
    s = licenses.scan("x Under the MIT-License. CC BY NC\nSPDX-License-Identifier: (Apache-2.0 OR MIT) */ rest\nunder the mit license")
    assert [p for p in s["places"] if p[2] == "base"] == [(1, "mit", "base"), (5, "cc-by-nc", "base"), (17, "mit", "base")]
    assert s["labels"] == ["apache-2", "cc-by-nc", "mit"] and s["score"] == 0.25 and s["expressions"][0][1] == "apache-2.0 mit or"


def test_edges(spark):
    rows = [(1, None), (1, ""), (1, "a " * 200_000 + "under the mit license"), (2, "under the mit license " * 3), (None, "Cc-by-nc éa")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "text AS score")
    got = [r.s for r in df.select(licenses.scans(df.text).alias("s")).collect()]
    assert [(s.n_words, len(s.places), s.score) for s in got] == [(0, 0, 0.0), (0, 0, 0.0), (200_004, 2, 0.95), (12, 6, 0.95), (4, 1, 0.25)]
    assert df.where("false").select(licenses.scans(df.text)).collect() == []
