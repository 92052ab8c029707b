"""Conversation structure repair: the cheapest edits that give a conversation its form, found by A* on the edit lattice.

Turns are ordered by turn (nulls first), role and the MD5 of the text; a turn's first fault counts: blank (no letter but
white space), duplicate (role and text seen earlier) or truncated (the last letter is no full stop, exclamation or
question mark). Edits: K keeps a turn, R gives it the role user or assistant (1), D deletes it (2, required for blank
and duplicate), I inserts an empty turn of user or assistant (5); a truncated turn that stays costs 5 more. The initials
of the roles that result must read (s?(ua)+)?. Of the cheapest edits those whose letters come first in ASCII are taken.

A node of the lattice is (turns consumed, state of the form). The heuristic adds up, over the turns to come, mandatory
deletions and the charge that a truncated turn can't avoid (the cheaper of deletion and staying); it never falls by more
than an edit costs, so nodes are closed once. Nodes leave the heap by (cost plus heuristic, letters so far), so the first
way to reach a node is the cheapest and of those the first in ASCII. Ways of one cost that have consumed the same turns
are never the beginning of one another, so what is least for a stretch is least in any whole that contains it.

That is why a conversation may be cut into blocks: turns are sorted in ranges, and a conversation that lies inside one
task and block is repaired there. One that is cut, however long, is repaired by blocks of up to 1,024 turns: a block gives
the least way from each state to each state, the ways are put together block by block along the conversation, and each
block then makes its own turns. Only states and letters meet in one task, never texts. No task holds more of a
conversation's texts than a block, at most one of them larger than 8 MB.

Defined results: null roles and texts are one space; null turns come first and are not counted for gaps; null
conversations are one conversation. Equal rows count as often as they occur. A conversation whose rows have 0 copies, and
so one without rows, has no edits and counts of 0. Gaps beyond 2**63 - 1 are held there. Roles count by their first letter;
an empty role has none. Very long texts are only moved, never searched in Python; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from provena.llm.text import trimmed
from provena.session import bound_batches, cut

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLOCK_ROWS, BLOCK_BYTES = 1024, 8 << 20
#: States by the last role: none yet, system, user, assistant; a conversation may end in the first and the last.
NONE, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NONE, ASSISTANT)
_STEP = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_OTHER = {NONE: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
LONGEST = (1 << 63) - 1

_ROWS = "array<struct<turn:bigint,role:string,text:string,copies:bigint,blank:boolean,truncated:boolean,duplicate:boolean,digest:string>>"
_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long"
_TURNS = "array<struct<edit:string,role:string,text:string>>"


def faults(text: Column) -> tuple[Column, Column]:
    """(blank, truncated) of a text that is not null."""
    end = F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return end == "", ~F.right(end, F.lit(1)).isin(".", "!", "?")


def search(steps: list[tuple[str, bool] | None], start: int, ends: tuple[int, ...] | None = None) -> dict[int, tuple[int, str]]:
    """state -> (cost, letters) of the least way from ``start`` through all steps, by A*.

    A step is (initial, truncated), or None for turns that must be deleted, which have one letter and no cost here. With
    ``ends`` the search stops at the first of these states; else it goes on until it has been everywhere.
    """
    ahead = [0] * (len(steps) + 1)
    for i in range(len(steps) - 1, -1, -1):
        step = steps[i]
        ahead[i] = ahead[i + 1] + (min(DELETE, TRUNCATED) if step and step[1] else 0)
    heap: list[tuple[int, str, int, int]] = [(ahead[0], "", 0, start)]
    closed: set[tuple[int, int]] = set()
    found: dict[int, tuple[int, str]] = {}
    while heap:
        total, letters, i, state = heappop(heap)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        heappush(heap, (total + INSERT, letters + "I", i, _OTHER[state]))
        if i == len(steps):
            found[state] = (total, letters)
            if ends and state in ends:
                return {state: found[state]}
            continue
        step = steps[i]
        if step is None:
            heappush(heap, (total, letters + "D", i + 1, state))
            continue
        initial, truncated = step
        base = total - ahead[i] + ahead[i + 1]
        stays = base + (TRUNCATED if truncated else 0)
        heappush(heap, (base + DELETE, letters + "D", i + 1, state))
        if (to := _STEP.get((state, initial))) is not None:
            heappush(heap, (stays, letters + "K", i + 1, to))
        heappush(heap, (stays + REROLE, letters + "R", i + 1, _OTHER[state]))
    return found


class Stretch:
    """Consecutive turns of a conversation: dicts of _ROWS, equal neighbours merged into one with more copies."""

    def __init__(self, rows: list[dict]):
        self.steps: list[tuple[str, bool] | None] = []
        self.runs: list[int] = []  # turns of each step
        self.owner: list[dict | None] = []  # the row of a step that may stay
        self.cost = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = None
        self.low = self.high = None
        self.distinct = 0
        for row in rows:
            if row["copies"]:
                self._add(row)

    def _add(self, row: dict) -> None:
        n, initial, turn = row["copies"], row["role"][:1], row["turn"]
        if turn is not None:
            self.distinct += turn != self.high
            self.high = turn
            self.low = turn if self.low is None else self.low
        self.illegal += (self.last is not None and (self.last, initial) not in _LEGAL) + (n - 1)
        self.last = initial
        self.first = initial if self.first is None else self.first
        gone = n
        if row["blank"]:
            self.blank += n
        elif row["duplicate"]:
            self.duplicate += n
        else:
            self.duplicate += n - 1
            self.truncated += row["truncated"]
            self.steps.append((initial, bool(row["truncated"])))
            self.runs.append(1)
            self.owner.append(row)
            gone -= 1
        if gone:
            self.cost += DELETE * gone
            if self.steps and self.steps[-1] is None:
                self.runs[-1] += gone
            else:
                self.steps.append(None)
                self.runs.append(gone)
                self.owner.append(None)

    def ways(self, start: int, ends: tuple[int, ...] | None = None) -> dict[int, tuple[int, str]]:
        """As search, with a letter for every turn and the cost of all of them."""
        return {state: (cost + self.cost, self._spelt(letters)) for state, (cost, letters) in search(self.steps, start, ends).items()}

    def _spelt(self, letters: str) -> str:
        if len(self.runs) == sum(self.runs):
            return letters
        out, i = [], 0
        for c in letters:
            out.append(c if c == "I" else c * self.runs[i])
            i += c != "I"
        return "".join(out)

    def turns(self, state: int, audit: str) -> list[dict]:
        """The turns that the edits make."""
        out, i, left = [], 0, 0
        for c in audit:
            if c == "I":
                state = _OTHER[state]
                out.append({"edit": c, "role": _ROLE[state], "text": ""})
                continue
            if not left:
                left, i = self.runs[i], i + 1
            left -= 1
            row = self.owner[i - 1]
            if c == "K":
                state = _STEP[state, row["role"][:1]]
                out.append({"edit": c, "role": row["role"], "text": row["text"]})
            elif c == "R":
                state = _OTHER[state]
                out.append({"edit": c, "role": _ROLE[state], "text": row["text"]})
        return out

    def counts(self) -> dict:
        return {"gaps": gaps(self.low, self.high, self.distinct), "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}


def gaps(low: int | None, high: int | None, distinct: int) -> int:
    return 0 if low is None else min(high - low + 1 - distinct, LONGEST)


def _merge(rows: list[dict], row: dict, seen: set[tuple[str, str]]) -> None:
    """Adds a row to its block; ``seen`` has what the block holds already."""
    if rows and all(rows[-1][k] == row[k] for k in ("turn", "role", "digest")):
        rows[-1]["copies"] += row["copies"]
        return
    if row["copies"] and not row["blank"]:
        row["duplicate"] = (row["role"], row["digest"]) in seen
        seen.add((row["role"], row["digest"]))
        if row["duplicate"]:
            row["text"] = None
    rows.append(row)


def _blocks(batches: Iterator[pa.RecordBatch], block_rows: int, block_bytes: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted rows; conversations inside the task and of one block are repaired at once."""
    part, seq, conv, rows, seen, size = TaskContext.get().partitionId(), 0, None, [], set(), 0
    open_ = cut_before = False  # a conversation has begun; what we have of it is not its beginning
    out: list[dict] = []
    weight = 0

    def close(ended: bool) -> None:
        """Ends a block; ``ended``: the conversation is known to end here."""
        nonlocal seq, weight
        block = {"conv_id": conv, "part": part, "seq": seq, "whole": ended and not cut_before, "rows": None, "turns": None}
        if block["whole"]:
            own = Stretch(rows)
            ((state, (cost, audit)),) = own.ways(NONE, ENDS).items()
            block |= own.counts() | {"cost": cost, "audit": audit, "turns": own.turns(NONE, audit)}
        else:
            block["rows"] = rows
        out.append(block)
        seq += 1
        weight += size + 200 * len(rows)

    def flush() -> pa.RecordBatch:
        nonlocal out, weight
        batch, out, weight = pa.RecordBatch.from_pylist(out, schema), [], 0
        return batch

    first = True
    for batch in batches:
        for row in batch.to_pylist():
            own = row.pop("conv_id")
            if not open_ or own != conv:
                if open_:
                    close(not first)
                    first = False
                conv, rows, seen, size, open_, cut_before = own, [], set(), 0, True, False
            elif len(rows) >= block_rows or size >= block_bytes:
                close(False)
                rows, seen, size, cut_before = [], set(), 0, True
            if row["blank"]:
                row["text"] = None
            row["duplicate"] = False
            size += len(row["text"] or "")
            _merge(rows, row, seen)
            if weight >= block_bytes or len(out) >= 4096:
                yield flush()
    if open_:
        close(False)
    if out:
        yield flush()


def _ways(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A cut conversation's blocks: counts, and the least ways from state to state."""
    for batch in batches:
        for i in range(batch.num_rows):
            (block,) = batch.slice(i, 1).to_pylist()
            own = Stretch(_marked(block))
            ways = [{"start": s, "end": e, "cost": c, "audit": a} for s in range(4) for e, (c, a) in own.ways(s).items()]
            told = {k: block[k] for k in ("conv_id", "part", "seq")} | own.counts() | {"ways": ways}
            told |= {"first": own.first, "last": own.last, "low": own.low, "high": own.high, "distinct": own.distinct}
            yield pa.RecordBatch.from_pylist([told], schema)


def _marked(block: dict) -> list[dict]:
    again = set(block["again"] or ())
    for at, row in enumerate(block["rows"]):
        row["duplicate"] = row["duplicate"] or at in again
    return block["rows"]


class Conversation:
    """Blocks of one conversation in order, put together."""

    def __init__(self, first: dict):
        self.key = {"conv_id": first["conv_id"], "part": first["part"], "seq": first["seq"]}
        self.live: dict[int, tuple[int, list[tuple]]] = {NONE: (0, [])}
        self.done: list[tuple] = []
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "distinct"), 0)
        self.last = self.low = self.high = None

    def add(self, block: dict) -> None:
        for k in self.sums:
            self.sums[k] += block[k]
        if block["first"] is not None:
            self.sums["illegal"] += self.last is not None and (self.last, block["first"]) not in _LEGAL
            self.last = block["last"]
        if block["low"] is not None:
            self.sums["distinct"] -= self.high == block["low"]
            self.low = block["low"] if self.low is None else self.low
            self.high = block["high"]
        best: dict[int, tuple[int, list[tuple]]] = {}
        for way in block["ways"]:
            if way["start"] not in self.live:
                continue
            cost, path = self.live[way["start"]]
            cost, path = cost + way["cost"], [*path, (block["part"], block["seq"], way["start"], way["audit"])]
            had = best.get(way["end"])
            if had is None or (cost, "" if cost != had[0] else _letters(path)) < (had[0], "" if cost != had[0] else _letters(had[1])):
                best[way["end"]] = (cost, path)
        self.live = best
        # what all ways share is settled
        while all(path for _, path in best.values()) and len({path[0] for _, path in best.values()}) == 1:
            self.done.append(next(iter(best.values()))[1][0])
            for _, path in best.values():
                del path[0]

    def end(self) -> Iterator[dict]:
        cost, path = min((self.live[s] for s in ENDS if s in self.live), key=lambda x: (x[0], _letters(x[1])))
        path = self.done + path
        told = self.key | {k: self.sums[k] for k in ("blank", "duplicate", "truncated", "illegal")}
        yield told | {"gaps": gaps(self.low, self.high, self.sums["distinct"]), "cost": cost, "audit": _letters(path), "piece_part": None, "piece_seq": None, "start": None}
        for part, seq, start, audit in path:
            yield {"part": self.key["part"], "seq": self.key["seq"], "piece_part": part, "piece_seq": seq, "start": start, "audit": audit}


def _letters(path: list[tuple]) -> str:
    return "".join(p[3] for p in path)


def _together(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by conversation and place: a row for each conversation, and one for each block's part in it."""
    now = None
    for batch in batches:
        for i in range(batch.num_rows):
            (block,) = batch.slice(i, 1).to_pylist()
            if now is None or now.key["conv_id"] != block["conv_id"]:
                if now:
                    yield from _rows(now.end(), schema)
                now = Conversation(block)
            now.add(block)
    if now:
        yield from _rows(now.end(), schema)


def _rows(rows: Iterator[dict], schema: pa.Schema, at_once: int = 64) -> Iterator[pa.RecordBatch]:
    some: list[dict] = []
    for row in rows:
        some.append(row)
        if len(some) == at_once:
            yield pa.RecordBatch.from_pylist(some, schema)
            some = []
    if some:
        yield pa.RecordBatch.from_pylist(some, schema)


def _made(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            (block,) = batch.slice(i, 1).to_pylist()
            told = {k: block[k] for k in ("part", "seq", "piece_part", "piece_seq")}
            yield pa.RecordBatch.from_pylist([told | {"alone": False, "turns": Stretch(_marked(block)).turns(block["start"], block["audit"])}], schema)


def _hashed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each conversation in order, which need not be in memory together."""
    key, digest, begun = None, None, False
    told = lambda: pa.RecordBatch.from_pylist([{"part": key[0], "seq": key[1], "sha256": digest.hexdigest()}], schema)
    for batch in batches:
        for part, seq, lines in zip(*(batch.column(c) for c in ("part", "seq", "lines"))):
            own = (part.as_py(), seq.as_py())
            if own != key:
                if key:
                    yield told()
                key, digest, begun = own, hashlib.sha256(), False
            if data := lines.as_py().encode("utf-8"):
                digest.update(b"\n" * begun + data)
                begun = True
    if key:
        yield told()


def _arrow(run, schema: StructType, *args):
    """run with the Arrow form of a schema, for mapInArrow."""
    from pyspark.sql.pandas.types import to_arrow_schema

    own = to_arrow_schema(schema)
    return trimmed(lambda batches: run(batches, *args, own))


def repair(convs: DataFrame, copies: str | None = None, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns), both over tables.

    conversations: conv_id, part, seq (the conversation's key), gaps, blank, duplicate, truncated, illegal, cost, audit.
    turns: part, seq, piece_part, piece_seq (order of pieces), alone (the only piece), turns: array of edit, role, text.
    convs: conv_id, turn, role, text; ``copies`` names a column with how often a row occurs (0: only its conversation counts).
    """
    spark = convs.sparkSession
    bound_batches(spark)
    # Spark's own row number breaks ties, so that equal rows may go to several tasks; which of them comes first makes no difference
    own = convs.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.col(copies) if copies else F.lit(1)).cast("long").alias("copies"), F.monotonically_increasing_id().alias("row"))
    there = F.col("copies") > 0
    blank, truncated = faults(F.col("text"))
    own = own.select("conv_id", F.when(there, F.col("turn")).alias("turn"), F.when(there, F.col("role")).alias("role"), F.when(there, F.col("text")).alias("text"), "copies", blank.alias("blank"), truncated.alias("truncated"), F.when(there, F.md5(F.col("text").cast("binary"))).alias("digest"), "row")
    order = ["conv_id", "turn", "role", "digest", "row"]
    ordered = own.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    conv_type = convs.schema["conv_id"].dataType.simpleString()
    blocks_of = _schema(f"conv_id {conv_type}, part long, seq long, whole boolean, {_COUNTS}, cost long, audit string, turns {_TURNS}, rows {_ROWS}")
    blocks = cut(ordered.mapInArrow(_arrow(_blocks, blocks_of, block_rows, block_bytes), blocks_of), "turns")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    whole = blocks.where("whole")
    split = blocks.where("not whole").select("conv_id", "part", "seq", "rows")
    # what a block holds for the first time may stand in an earlier block
    keys = split.select("conv_id", "part", "seq", F.posexplode("rows").alias("at", "r")).where("r.copies > 0 and not r.blank and not r.duplicate")
    keys = keys.select("conv_id", F.col("r.role").alias("role"), F.col("r.digest").alias("digest"), F.struct("part", "seq", "at").alias("place"))
    first = keys.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "first")
    later = keys.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))).where("place <> first")
    later = later.groupBy(F.col("place.part").alias("part"), F.col("place.seq").alias("seq")).agg(F.collect_set("place.at").alias("again"))
    split = split.join(later, ["part", "seq"], "left")
    ways_of = _schema(f"conv_id {conv_type}, part long, seq long, {_COUNTS}, first string, last string, low long, high long, distinct long, ways array<struct<start:int,end:int,cost:bigint,audit:string>>")
    ways = split.mapInArrow(_arrow(_ways, ways_of), ways_of)
    folded_of = _schema(f"conv_id {conv_type}, part long, seq long, {_COUNTS}, cost long, audit string, piece_part long, piece_seq long, start int")
    folded = cut(ways.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_arrow(_together, folded_of), folded_of), "folded")

    conversations = whole.select("conv_id", "part", "seq", *counts).unionByName(folded.where("piece_part is null").select("conv_id", "part", "seq", *counts))
    chosen = folded.where("piece_part is not null").select("part", "seq", "piece_part", "piece_seq", "start", "audit")
    pieces = split.select(F.col("part").alias("piece_part"), F.col("seq").alias("piece_seq"), "rows", "again").join(chosen, ["piece_part", "piece_seq"])
    made_of = _schema(f"part long, seq long, piece_part long, piece_seq long, alone boolean, turns {_TURNS}")
    made = pieces.mapInArrow(_arrow(_made, made_of), made_of)
    turns = whole.select("part", "seq", F.col("part").alias("piece_part"), F.col("seq").alias("piece_seq"), F.lit(True).alias("alone"), "turns").unionByName(made)
    return conversations, turns


def _schema(ddl: str) -> StructType:
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(ddl)


def digests(turns: DataFrame) -> DataFrame:
    """part, seq, sha256 (hex) of each conversation's role:text lines, joined by newlines."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    alone = turns.where("alone").select("part", "seq", F.sha2(lines, 256).alias("sha256"))
    cut_ones = turns.where("not alone").select("part", "seq", "piece_part", "piece_seq", lines.alias("lines"))
    cut_ones = cut_ones.repartition("part", "seq").sortWithinPartitions("part", "seq", "piece_part", "piece_seq").drop("piece_part", "piece_seq")
    schema = _schema("part long, seq long, sha256 string")
    return alone.unionByName(cut_ones.mapInArrow(_arrow(_hashed, schema), schema))


def damaged(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows with faults that follow from the CRC-32 of conversation and turn.

    Of twenty remainders 0 drops the row, 1 empties the text, 2 takes out full stops, exclamation and question marks,
    3 repeats the row, 4 makes the role user. Nulls are one space, but the turn stays null.
    """
    blank = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    return convs.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )
