import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from provena.llm import pii

P = pii.Permuter(b"key")


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_index_is_a_permutation(size):
    assert sorted(P.index(x, size, "k") for x in range(size)) == list(range(size))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcXYZ019.-_", max_size=200))
def test_characters_keep_their_classes(s):
    out = P.characters(s, "k")
    shape = lambda x: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", x)))
    assert shape(out) == shape(s) and P.characters(s, "k") == out


VALUES = {
    "card": ["4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "378282246310005"],
    "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"],
    "phone": ["+1 (988) 555-2485", "988-555-2485", "(988) 555-2485", "+44 20 7946 0958", "+1 (017) 555-7713"],
    "ssn": ["123-45-6789"],
    "ip": ["8.8.8.8", "192.168.1.20", "10.1.2.3", "172.20.0.1", "127.0.0.1"],
    "date": ["2021-02-28", "02/28/2021", "28/02/2021", "28.2.2021", "March 5, 2020", "5 Mar 2020", "1850-01-01"],
    "email": ["loogm.24@mail6.example.com", "A.b+c@x.org"],
}


@pytest.mark.parametrize("kind,value", [(k, v) for k, x in VALUES.items() for v in x])
def test_valid_values_stay_valid_and_linked(kind, value):
    text, found = pii.pseudonymise(f"é {value}, and again {value}.", P)
    assert found == Counter({kind: 2})
    new = re.fullmatch(r"é (.*), and again (.*)\.", text)
    assert new[1] == new[2] != value
    again, found = pii.pseudonymise(new[1], P)
    assert found == Counter({kind: 1})  # still valid
    if kind not in ("date", "ip"):
        assert len(new[1]) == len(value)


def test_same_number_in_other_layouts_stays_linked():
    a, b = (re.sub(r"\D", "", pii.pseudonymise(v, P)[0]) for v in ("4111 1111 1111 1111", "4111-1111-1111-1111"))
    assert a == b
    assert re.sub(r"\D", "", pii.pseudonymise("(988) 555-2485", P)[0]) == re.sub(r"\D", "", pii.pseudonymise("988-555-2485", P)[0])
    assert pii.pseudonymise("8.8.8.8", P)[0] != pii.pseudonymise("8.8.8.8", pii.Permuter(b"other"))[0]


@pytest.mark.parametrize("text", ["4111111111111112", "1111111111111111", "2021-02-30", "13/13/2020", "300.1.1.1", "1.2.3.4.5", "000-12-3456", "DE00 3704 0044 0532 0130 00", "version 2.0.", "188-555-0000", "a@b", "in 1999 and 2000", ""])
def test_what_is_not_valid_is_left_alone(text):
    assert pii.pseudonymise(text, P) == (text, Counter())


LAYOUTS = {
    "iso": lambda d: d.isoformat(),
    "month first": lambda d: f"{d.month}/{d.day}/{d.year}",
    "month first, zeros": lambda d: f"{d.month:02d}/{d.day:02d}/{d.year}",
    "dots": lambda d: f"{d.day}.{d.month}.{d.year}",
    "dots, zeros": lambda d: f"{d.day:02d}.{d.month:02d}.{d.year}",
    "name": lambda d: f"{pii.MONTHS[d.month - 1]} {d.day}, {d.year}",
    "short name, zeros": lambda d: f"{d.day:02d} {pii.MONTHS[d.month - 1][:3]} {d.year}",
}


def told_day(value):
    """The day that a reader takes a pseudonym for, by its layout."""
    from datetime import date

    n = list(map(int, re.findall(r"\d+", value)))
    if name := re.search("[A-Z][a-z]+", value):
        return date(n[1], [m[:3] for m in pii.MONTHS].index(name[0][:3]) + 1, n[0])
    return date(*n) if "-" in value else date(n[2], n[1], n[0]) if "." in value else date(n[2], n[0], n[1])


def test_every_layout_of_a_day_gives_the_same_day():
    from datetime import date, timedelta

    for i in range(0, 73049, 37):
        day = date(1900, 1, 1) + timedelta(i)
        values = [f(day) for f in LAYOUTS.values()] + [f"{day.day}/{day.month}/{day.year}", f"{day.day:02d}/{day.month:02d}/{day.year}"] * (day.day > 12)
        out = [pii.pseudonymise(v, P)[0] for v in values]
        assert len(set(map(told_day, out))) == 1, day


@pytest.mark.parametrize("layout", LAYOUTS)
def test_two_hundred_years_are_permuted_one_to_one(layout):
    from datetime import date, timedelta

    days = [date(1900, 1, 1) + timedelta(i) for i in range(73049)]
    out = {pii._date(P, LAYOUTS[layout](d)) for d in days[:: 1 if layout == "month first" else 7]}
    assert len(out) == len(days[:: 1 if layout == "month first" else 7]) and len(set(map(told_day, out))) == len(out)


def test_zeros_and_timestamps():
    assert all(re.fullmatch(r"\d\d March|\d\d \w+ \d{4}", pii.pseudonymise(f"05 March {y}", P)[0]) for y in range(1990, 2020))
    assert all(re.fullmatch(r"\d\d/\d\d/\d{4}", pii.pseudonymise(f"05/03/{y}", P)[0]) for y in range(1990, 2020))
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT10:00", pii.pseudonymise("1985-03-14T10:00", P)[0])


@pytest.mark.parametrize("before,value", [("PASSWORD=", "Hunter2x"), ("Password: ", "abcdefgh"), ("password:", "abcdefgh"), ("", "müller.åsa@example.org"), ("", "почта@пример.рф"), ("", "田中@example.jp")])
def test_secrets_in_any_case_and_addresses_in_any_script(before, value):
    text, found = pii.pseudonymise(before + value, P)
    assert sum(found.values()) == 1 and text.startswith(before) and text != before + value
    local, new = value.split("@")[0], text.removeprefix(before).split("@")[0]
    assert len(local) == len(new) and all(a.isalpha() == b.isalpha() and a.isupper() == b.isupper() for a, b in zip(local, new))
    assert not any(a == b for a, b in zip(local, new) if not a.isascii() and a.isalpha()) or len(local) > 2


#: Written apart from the operator's own patterns: what a value of each kind looks like where it stands alone.
SHAPES = {"email": r"\S+@\S+\.[a-z]+", "ssn": r"\d{3}-\d\d-\d{4}", "ip": r"\d+\.\d+\.\d+\.\d+", "iso date": r"\d{4}-\d\d-\d\d", "card": r"(?:\d[ -]?){13,19}", "secret": r"password=\S+", "key": r"AKIA[0-9A-Z]{16}"}


def test_query_on_documents(spark):
    """Texts are equal but for values; a value has one pseudonym in all documents, of its shape, and no two share one."""
    from difflib import SequenceMatcher

    from provena.llm.queries import queries

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries()["op7_pseudonyms"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert sorted(got) == sorted(r.doc_id for r in docs)
    told, seen = {}, Counter()
    for r in docs:
        new, kinds = got[r.doc_id].text, got[r.doc_id].kinds
        if r.text is None or not kinds:
            assert new == r.text and got[r.doc_id].n_values == 0
            continue
        a, b = r.text.split(" "), new.split(" ")
        assert len(a) == len(b)  # no value changes its blanks
        for tag, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            assert tag in ("equal", "replace") and (tag == "equal" or j - i == m - k)
        for x, y in zip(a, b):
            assert re.sub(r"[\w@.+%-]", "", x) == re.sub(r"[\w@.+%-]", "", y)
            for kind, shape in SHAPES.items():
                if x != y and re.fullmatch(shape, x):
                    assert re.fullmatch(shape, y) and told.setdefault((kind, x), y) == y
                    seen[kind] += 1
    assert len(set(told.items())) == len({(k[0], v) for k, v in told.items()}) and len(seen) >= 3
    assert sum(r.n_values for r in got.values()) >= len(told)


def test_column(spark):
    rows = [(1, None), (2, ""), (3, "call +1 (988) 555-2485"), (3, "call +1 (988) 555-2485"), (None, "x " * 100_000 + "8.8.8.8"), (4, "password=" + "a1" * 5000 + " token = \"ab12\"")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.p for r in df.select(pii.pseudonyms(df.text, b"key").alias("p")).collect()]
    assert [p.n for p in got] == [0, 0, 1, 1, 1, 2] and got[0].text is None and got[1].text == "" and got[2] == got[3]
    assert got[4].kinds == "ip" and len(got[5].text) == len(rows[5][1])
    assert df.where("false").select(pii.pseudonyms(df.text, b"key")).collect() == []


@pytest.mark.parametrize(
    "value,behind,kind",
    [
        ("4111 1111 1111 1111", " 12/25", "card"), ("4111111111111111", " 123", "card"), ("378282246310005", " 1234", "card"), ("DE89 3704 0044 0532 0130 00", " I paid", "iban"),
        ("DE89370400440532013000", " BIC COBADEFFXXX", "iban"), ("GB82WEST12345698765432", " 4 OK", "iban"), ("2024-01-05", "T10:00", "date"), ("2024-01-05", "T10:00:00Z", "date"),
    ],
)
def test_valid_values_are_found_whatever_follows(value, behind, kind):
    text, found = pii.pseudonymise(f"x {value}{behind}", P)
    assert found == Counter({kind: 1}) and text.endswith(behind) and text[2:].removesuffix(behind) == pii.pseudonymise(value, P)[0] != value


def test_values_behind_invalid_ones_are_found():
    for text in ("12 4111 1111 1111 1111", "4111111111111112 8.8.8.8", "DE00 3704 0044 0532 0130 00 DE89 3704 0044 0532 0130 00", "2024 4111 1111 1111 1111 12"):
        assert sum(pii.pseudonymise(text, P)[1].values()) == 1
