"""Static libraries: `ar` members and ELF symbols as table functions.

A malformed library or member becomes an error row; a job never fails on it.
"""

from __future__ import annotations

import pickle
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

AR_MAGIC = b"!<arch>\n"
BINDS = {0: "LOCAL", 1: "GLOBAL", 2: "WEAK"}
TYPES = {0: "NOTYPE", 1: "OBJECT", 2: "FUNC", 3: "SECTION", 4: "FILE", 5: "COMMON", 6: "TLS"}
EXTERNAL, KINDS = ("GLOBAL", "WEAK"), ("FUNC", "OBJECT", "NOTYPE")
SYMTAB = 2
#: Rows of an archive that are objects at once.
HELD = 4096
# The header of a member (name, then date, owner, group and mode, then size and an end mark) and its kinds of names.
HEADER, HEADER_END = struct.Struct("16s32x10s2s"), b"`\n"
NAME_FIELD = re.compile(rb"(?P<index>(?:/|/SYM64/|__\.SYMDEF.*?) *)|(?P<table>// *)|/(?P<long>\d+) *|#1/(?P<inside>\d+) *|(?P<plain>.*?)/* *", re.DOTALL)


@dataclass(frozen=True)
class Layout:
    """Records of an ELF file: those fields of its head, sections and symbols that are used."""

    head: np.dtype
    section: np.dtype
    symbol: np.dtype


def _fields(size: int, /, **at: tuple[str, int]) -> np.dtype:
    return np.dtype({"names": list(at), "formats": [kind for kind, _ in at.values()], "offsets": [place for _, place in at.values()], "itemsize": size})


# Where the two classes of little-endian files have these fields.
LAYOUTS = {
    b"\x7fELF\x01\x01": Layout(
        _fields(52, sections=("<u4", 32), section_size=("<u2", 46), n_sections=("<u2", 48)),
        _fields(40, type=("<u4", 4), place=("<u4", 16), size=("<u4", 20), link=("<u4", 24), each=("<u4", 36)),
        _fields(16, name=("<u4", 0), info=("u1", 12), section=("<u2", 14)),
    ),
    b"\x7fELF\x02\x01": Layout(
        _fields(64, sections=("<u8", 40), section_size=("<u2", 58), n_sections=("<u2", 60)),
        _fields(64, type=("<u4", 4), place=("<u8", 24), size=("<u8", 32), link=("<u4", 40), each=("<u8", 56)),
        _fields(24, name=("<u4", 0), info=("u1", 4), section=("<u2", 6)),
    ),
}


@dataclass(frozen=True)
class Entry:
    """A header's name field and where its body lies."""

    field: bytes
    body: slice


def directory(data: bytes) -> Iterator[Entry]:
    """The headers of an archive, one after the other."""
    if not data.startswith(AR_MAGIC):
        raise ValueError("no ar archive")
    rest = len(AR_MAGIC)
    for _ in range(len(data) // HEADER.size):
        if rest + HEADER.size > len(data):
            break
        field, size, mark = HEADER.unpack_from(data, rest)
        body = slice(rest + HEADER.size, rest + HEADER.size + int(size))
        if mark != HEADER_END or body.stop > len(data):
            raise ValueError(f"the member at byte {rest} has {'no sound header' if mark != HEADER_END else 'less data than it says'}")
        yield Entry(field, body)
        rest = body.stop + body.stop % 2  # bodies begin at even places


def members(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(name, body) of the members; the symbol index and the table of long names are read, not returned.

    All headers are gone through before any member is returned, and again then, so that none is held.
    """
    long_names = None
    for e in directory(data):
        if NAME_FIELD.fullmatch(e.field)["table"] and long_names is None:
            long_names = data[e.body]
    long_names = long_names or b""
    for e in directory(data):
        kind, where = NAME_FIELD.fullmatch(e.field), e.body
        match kind.lastgroup:
            case "long":
                name = long_names[int(kind["long"]) :].partition(b"\n")[0].rstrip(b"/")
            case "inside":
                ahead = int(kind["inside"])
                name, where = data[where][:ahead].rstrip(b"\0"), slice(where.start + ahead, where.stop)
            case "plain":
                name = kind["plain"]
            case _:
                continue
        yield name.decode("utf-8", "replace"), data[where]


def _records(body: bytes, kind: np.dtype, place: int, count: int, step: int) -> np.ndarray:
    """count records of a kind, ``step`` bytes apart."""
    return np.ndarray(count, kind, body, place, (step,)) if count else np.empty(0, kind)


def elf_symbols(body: bytes) -> list[tuple[str, str, str, bool]] | None:
    """(symbol, bind, type, defined) of the symbol table; null for what is no little-endian ELF file."""
    layout = LAYOUTS.get(body[:6])
    if layout is None:
        return None
    (head,) = _records(body, layout.head, 0, 1, 1)
    sections = _records(body, layout.section, int(head["sections"]), int(head["n_sections"]), int(head["section_size"]))
    out: list[tuple[str, str, str, bool]] = []
    for table in sections[sections["type"] == SYMTAB]:
        step = int(table["each"]) or layout.symbol.itemsize
        found = _records(body, layout.symbol, int(table["place"]), int(table["size"]) // step, step)
        names = found["name"].astype(np.int64) + int(sections[table["link"]]["place"])
        for at, bind, kind, defined in zip(names.tolist(), (found["info"] >> 4).tolist(), (found["info"] & 15).tolist(), (found["section"] != 0).tolist()):
            out.append((body[at : body.index(0, at)].decode("utf-8", "replace"), BINDS.get(bind, str(bind)), TYPES.get(kind, str(kind)), defined))
    return out


@udtf(returnType="member string, member_no int, symbol string, bind string, type string, defined boolean, skipped boolean, error string")
class ReadArchive:
    """All symbols of an archive; a member that is no ELF file is one skipped row, a fault one error row."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        rows: list[tuple] = []
        held: list[bytes] = []  # nothing is told before the whole archive is read, and rows as objects take ten times its size
        try:
            for k, (name, body) in enumerate(members(bytes(content))):
                symbols = elf_symbols(body)
                if symbols is None:
                    rows.append((name, k, None, None, None, None, True, None))
                rows += [(name, k, *s, False, None) for s in symbols or []]
                if len(rows) >= HELD:
                    held.append(pickle.dumps(rows))
                    rows = []
        except Exception as e:  # a malformed library of any kind is one row
            rows, held = [(None, None, None, None, None, None, None, str(e) or type(e).__name__)], []
        for some in held:
            yield from pickle.loads(some)
        yield from rows


def read_libraries(libraries: DataFrame, key: str = "archive", content: str = "content") -> DataFrame:
    """key with all rows of ReadArchive."""
    spark = libraries.sparkSession
    spark.udtf.register("read_archive", ReadArchive)
    libraries.select(key, content).createOrReplaceTempView("_libraries")
    return spark.sql(f"SELECT l.{key}, s.* FROM _libraries l, LATERAL read_archive(l.{content}) s")


def defined_globals(rows: DataFrame, key: str = "archive") -> DataFrame:
    """key, symbol: distinct defined external functions, objects and untyped symbols. Of members with one name the last counts."""
    last = rows.where("error is null").groupBy(key, "member").agg(F.max("member_no").alias("member_no"))
    kept = rows.join(last, [key, "member", "member_no"]).where(F.col("defined") & F.col("bind").isin(*EXTERNAL) & F.col("type").isin(*KINDS) & (F.col("symbol") != ""))
    return kept.select(key, "symbol").distinct()


def summary(rows: DataFrame, key: str = "archive") -> DataFrame:
    """key, n_members, skipped (sorted names), error."""
    names = F.array_sort(F.collect_set(F.when(F.col("skipped"), F.col("member"))))
    return rows.groupBy(key).agg(F.count_distinct("member_no").alias("n_members"), names.alias("skipped"), F.max("error").alias("error"))
