import hashlib
import random
import re
import zlib
from itertools import product
from pathlib import Path

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from provena.llm import conversation_repair as cr
from provena.llm.queries import oracle_sql, queries

CLASH = ["part", "seq", "copies", "blank", "truncated", "digest", "row", "rows", "whole", "place", "first", "again", "start", "turns", "_c", "_r", "_d", "at", "r"]
FORM = re.compile(r"(s?(ua)+)?\Z")


def brute(rows):
    """The least (cost, letters) and its turns by trying all edits. rows: (role, text, gone, truncated); few of them."""
    n, best = len(rows), None
    for inserts in product(range(3), repeat=n + 1):
        if sum(inserts) > 3:
            continue
        for edits in product(*["D" if gone else "DKR" for _, _, gone, _ in rows]):
            audit, cost, slots = "", 0, []
            for i in range(n + 1):
                audit += "I" * inserts[i]
                cost += 5 * inserts[i]
                slots += [("ua", "")] * inserts[i]
                if i < n:
                    role, text, _, cut = rows[i]
                    audit += edits[i]
                    cost += {"D": 2, "K": 0, "R": 1}[edits[i]] + (5 if cut and edits[i] != "D" else 0)
                    if edits[i] != "D":
                        slots.append((role[:1] if edits[i] == "K" else "ua", text))
            for form in ("", "s"):
                want = form + "ua" * ((len(slots) - len(form)) // 2)
                if len(want) == len(slots) and FORM.match(want) and not (form and len(slots) == 1) and all(w in s and s for w, (s, _) in zip(want, slots)):
                    kept = iter([r for r, e in zip(rows, edits) if e != "D"])
                    lines, at = [], 0
                    for c in audit:
                        if c == "D":
                            continue
                        own = next(kept) if c in "KR" else None
                        lines.append((own[0] if c == "K" else {"u": "user", "a": "assistant"}[want[at]], own[1] if own else ""))
                        at += 1
                    if best is None or (cost, audit) < best[:2]:
                        best = (cost, audit, lines)
    return best


def told(convs):
    """conv_id -> what the contract says of its (turn, role, text) rows after damage."""
    out = {}
    for conv, rows in convs.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, marked, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in rows:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            kind = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None
            seen.add((role, text))
            if kind:
                n[kind] += 1
            marked.append((role, text, kind in ("blank", "duplicate"), kind == "truncated"))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, lines = brute(marked)
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, "\n".join(f"{a}:{b}" for a, b in lines))
    return out


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        own = out.setdefault(conv, [])
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        own += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def folder(spark, path, rows):
    df = spark.createDataFrame([(*r, *["x"] * len(CLASH)) for r in rows], "conv_id long, turn long, role string, text string, " + ", ".join(f"{c} string" for c in CLASH))
    df.repartition(3).write.parquet(f"{path}/conversations.parquet")
    return str(path)


def some(seed, convs, longest):
    rnd = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "uncle"], ["Yes.", "no", "", " \t", "What?", "a ", "Go! \n", None, "é", "Sí."]
    rows = []
    for conv in [*range(convs), None]:
        for turn in range(rnd.randint(1, longest)):
            role = rnd.choice(["user", "assistant"]) if rnd.random() < 0.7 else rnd.choice(roles)
            rows.append((conv, rnd.choice([turn, turn, turn + 5, None]), role, rnd.choice(texts) if rnd.random() < 0.5 else f"text {turn}."))
    return rows + [r for r in rows if rnd.random() < 0.1]


step = st.one_of(st.none(), st.tuples(st.sampled_from(["s", "u", "a", "", "t"]), st.booleans()))


@settings(max_examples=150, deadline=None)
@given(st.lists(step, max_size=5))
def test_search_finds_the_least_edits(steps):
    rows = [("x", "", True, False) if s is None else ({"s": "system", "u": "user", "a": "assistant"}.get(s[0], s[0]), "", False, s[1]) for s in steps]
    ((_, (cost, audit)),) = cr.search(steps, cr.NONE, cr.ENDS).items()
    assert (cost + 2 * steps.count(None), audit) == brute(rows)[:2]


@settings(max_examples=150, deadline=None)
@given(st.lists(step, min_size=1, max_size=14), st.data())
def test_stretches_add_up(steps, data):
    """Least ways of blocks, put together, are the least way of the whole."""
    rows = [{"turn": i, "role": (s or ("u", 0))[0], "text": str(i), "copies": 1, "blank": s is None, "truncated": bool(s and s[1]), "duplicate": False, "digest": str(i)} for i, s in enumerate(steps)]
    cuts = sorted(data.draw(st.sets(st.integers(1, len(rows)))))
    conv = None
    for seq, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        own = cr.Stretch(rows[a:b])
        ways = [{"start": s, "end": e, "cost": c, "audit": x} for s in range(4) for e, (c, x) in own.ways(s).items()]
        block = {"conv_id": 1, "part": 0, "seq": seq, "ways": ways, "blank": own.blank, "duplicate": own.duplicate, "truncated": own.truncated, "illegal": own.illegal, "first": own.first, "last": own.last, "low": own.low, "high": own.high, "distinct": own.distinct}
        conv = conv or cr.Conversation(block)
        conv.add(block)
    whole = cr.Stretch(rows)
    ((_, want),) = whole.ways(cr.NONE, cr.ENDS).items()
    final, *chosen = conv.end()
    assert (final["cost"], final["audit"]) == want and {k: final[k] for k in whole.counts()} == whole.counts()
    pieces = [cr.Stretch(rows[a:b]).turns(c["start"], c["audit"]) for c, a, b in zip(chosen, [0, *cuts], [*cuts, len(rows)])]
    assert [t for p in pieces for t in p] == whole.turns(cr.NONE, want[1])


@pytest.mark.parametrize("seed,partitions", [(1, 8), (2, 40)])
def test_query_matches_brute_force(spark, tmp_path, seed, partitions):
    rows = some(seed, 60, 5)
    want = {c: v for c, v in told(damage(rows)).items()}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = queries()["op11_conversation_repair"](spark, folder(spark, tmp_path, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert len(got) == len(want)
    for r in got:
        *counts, text = want[r.conv_id]
        assert [r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit] == counts, (r.conv_id, counts)
        assert r.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("block_rows,block_bytes", [(1, 1 << 20), (3, 1 << 20), (1000, 20), (1000, 1 << 20)])
def test_blocks_make_no_difference(spark, block_rows, block_bytes):
    """A conversation of 3,000 turns, and one row that occurs 4,000 times, by blocks of any size."""
    rnd = random.Random(7)
    rows = [(1, t, rnd.choice(["user", "assistant", "system"]), rnd.choice(["Yes.", "no", "", f"turn {t}."]), "x") for t in range(3000)]
    rows += [(2, 5, "user", "Again.", "x")] * 4000 + [(2, 6, "assistant", "Well.", "x"), (3, None, "assistant", None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string").repartition(16)
    convs, turns = cr.repair(df, block_rows=block_rows, block_bytes=block_bytes)
    got = {r.conv_id: r for r in convs.join(cr.digests(turns), ["part", "seq"]).collect()}
    assert (got[2].audit, got[2].cost, got[2].duplicate, got[2].illegal) == ("K" + "D" * 3999 + "K", 7998, 3999, 3999)
    assert (got[3].audit, got[3].blank, got[3].sha256) == ("D", 1, hashlib.sha256(b"").hexdigest())
    seen, steps = set(), []
    for _, _, role, text, _ in rows[:3000]:
        steps.append(None if not text or (role, text) in seen else (role[0], text[-1] != "."))
        seen.add((role, text))
    ((_, (cost, audit)),) = cr.search(steps, cr.NONE, cr.ENDS).items()
    assert (got[1].cost, got[1].audit) == (cost + 2 * steps.count(None), audit)
    lines = [t for r in sorted(turns.collect(), key=lambda r: (r.piece_part, r.piece_seq)) if (r.part, r.seq) == (got[1].part, got[1].seq) for t in r.turns]
    assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in lines).encode()).hexdigest() == got[1].sha256
    assert FORM.match("".join(t.role[0] for t in lines)) and len(lines) == len(audit) - audit.count("D")


def test_dropped_long_and_empty(spark, tmp_path):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    whole = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 > 4)
    rows = [(dropped, 1, "user", "Gone."), (whole, 1, "user", "long " * 400_000 + ".")]
    got = {r.conv_id: r for r in queries()["op11_conversation_repair"](spark, folder(spark, tmp_path / "a", rows)).collect()}
    assert tuple(got[dropped])[1:8] == (0, 0, 0, 0, 0, 0, "") and got[dropped].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[whole].audit == "D"  # 2, where an answer would cost 5
    assert queries()["op11_conversation_repair"](spark, folder(spark, tmp_path / "b", [])).collect() == []


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{Path(sf) / 'conversations.parquet'}'")
    got = queries()["op11_conversation_repair"](spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(oracle_sql()["op11_conversation_repair"]).fetchall()) and len(got) == 100
