"""Key-value shards as a Spark data source, and a distributed writer of the same layout.

A table is a folder of files XX.ldb, XX the first key byte. A file is a map of 2^24 five-byte pointers, one for each value
of the next three key bytes (big-endian), 0 for an empty slot, then lists. A list is a pointer to its last node (5 bytes)
and its first node. A node is: pointer to the next node (5 bytes, 0 for the last), size (2 bytes), data; numbers are
little-endian. With ``record_len`` n the key is the four bytes of shard and slot, size counts records, and data are
records of n bytes. Otherwise keys have 16 bytes, size counts bytes, and data are groups: 12 bytes of key, the group's
length (2 bytes), records, each behind its length (2 bytes). The records of a key may be spread over nodes.

    spark.read.format("ldb").option("record_len", 18).load(folder) -> key, rec_no, record
    probe(keys, folder, record_len=18) -> key, rec_no, record of many keys, of which only the slots are read

Each shard is a partition, or several when ``slot_parts`` is set. An equality on key reads one slot, a prefix of at least
six digits a range of slots, shorter ones the shards they name; the rest is filtered again by Spark. Files are read by
place through their own file system (local paths, file:, and what pyarrow knows: hdfs:, s3:, gs:), a piece of the map and
a node at a time.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith

from provena.session import cut

SLOTS, POINTER = 1 << 24, 5
MAP_BYTES = SLOTS * POINTER
_BLOCK = 1 << 16

#: Bytes at a place of a file.
Read = Callable[[int, int], bytes]


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/(?!//)", "file:///", uri))


def reader_of(source) -> Read:
    """Reads by place of a random-access file."""

    def read(at: int, n: int) -> bytes:
        source.seek(at)
        return source.read(n)

    return read


def u16(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 2], "little")


def u40(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + POINTER], "little")


@dataclass
class Slots(InputPartition):
    path: str
    shard: int
    first: int
    last: int


def occupied(read: Read, first: int, last: int) -> Iterator[tuple[int, int]]:
    """(slot, place of its list) of the slots in [first, last) that have one."""
    for lo in range(first, last, _BLOCK):
        n = min(_BLOCK, last - lo)
        block = np.frombuffer(read(lo * POINTER, n * POINTER), np.uint8)
        if block.any():
            block = block.reshape(n, POINTER)
            slots = np.flatnonzero(block.any(1))
            places = (block[slots].astype(np.int64) << (8 * np.arange(POINTER))).sum(1)
            yield from zip((lo + slots).tolist(), places.tolist())


def nodes(read: Read, place: int) -> Iterator[tuple[int, int]]:
    """(size field, place of the data) of a list's nodes; what stands before the first one points to the last."""
    seen = set()
    at = place + POINTER
    while at and at not in seen:
        seen.add(at)
        head = read(at, POINTER + 2)
        yield u16(head, POINTER), at + POINTER + 2
        at = u40(head, 0)


def list_records(read: Read, shard: int, slot: int, place: int, record_len: int) -> Iterator[tuple[str, bytes]]:
    """(key in hex, record) of a slot's list."""
    head = bytes([shard]) + slot.to_bytes(3, "big")
    for size, start in nodes(read, place):
        if record_len:
            data = read(start, size * record_len)
            for at in range(0, len(data), record_len):
                yield head.hex(), data[at : at + record_len]
            continue
        data, at = read(start, size), 0
        while at + 14 <= len(data):
            key, end = (head + data[at : at + 12]).hex(), min(len(data), at + 14 + u16(data, at + 12))
            at += 14
            while at + 2 <= end:
                n = u16(data, at)
                yield key, data[at + 2 : at + 2 + n]
                at += 2 + n
            at = end


class LdbReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.record_len = int(options.get("record_len", 0))
        self.parts = int(options.get("slot_parts", 1))
        self.prefix = ""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, StringStartsWith)) and f.attribute == ("key",) and isinstance(f.value, str) and re.fullmatch("[0-9a-f]*", f.value):
                self.prefix = max(self.prefix, f.value, key=len)
            yield f  # slots are only the first bytes of a key

    def partitions(self) -> list[InputPartition]:
        out = []
        system, base = filesystem(self.path)
        for name in sorted(f.base_name for f in system.get_file_info(fs.FileSelector(base)) if f.is_file):
            m = re.fullmatch(r"([0-9a-fA-F]{2})\.ldb", name)
            if not m or not f"{int(m[1], 16):02x}".startswith(self.prefix[:2]):
                continue
            digits = self.prefix[2:8]
            first, last = int(digits.ljust(6, "0"), 16), int(digits.ljust(6, "f"), 16) + 1
            parts = min(self.parts, last - first)
            edge = [first + (last - first) * k // parts for k in range(parts + 1)]
            out += [Slots(f"{self.path}/{name}", int(m[1], 16), a, b) for a, b in zip(edge, edge[1:])]
        return out or [Slots("", 0, 0, 0)]

    def read(self, partition: Slots) -> Iterator[tuple]:
        if not partition.path:
            return
        system, path = filesystem(partition.path)
        with system.open_input_file(path) as source:
            read = reader_of(source)
            for slot, place in occupied(read, partition.first, partition.last):
                for rec_no, (key, record) in enumerate(list_records(read, partition.shard, slot, place, self.record_len)):
                    yield key, rec_no, record


class LdbSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ldb"

    def schema(self) -> str:
        return "key string, rec_no int, record binary"

    def reader(self, schema) -> LdbReader:
        return LdbReader(dict(self.options))


def register(spark) -> None:
    """Makes format("ldb") known, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LdbSource)


class Counted:
    """Reads by place that are counted: number of reads and bytes."""

    def __init__(self, source):
        self.read_at, self.reads, self.bytes = reader_of(source), 0, 0

    def __call__(self, at: int, n: int) -> bytes:
        data = self.read_at(at, n)
        self.reads += 1
        self.bytes += len(data)
        return data


def _probe(folder: str, record_len: int, counter):
    """Records of sorted keys: a task opens each of its shards once and reads the slots that its keys name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(folder)
        files = {int(m[1], 16): f.path for f in system.get_file_info(fs.FileSelector(base)) if f.is_file and (m := re.fullmatch(r"([0-9a-fA-F]{2})\.ldb", f.base_name))}
        source = read = shard = slot = None
        wanted: set[str] = set()
        told: list[tuple[str, int, bytes]] = []
        size = 0

        def batch() -> pa.RecordBatch:
            nonlocal told, size
            keys, numbers, records = zip(*told) if told else ((), (), ())
            told, size = [], 0
            return pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string()), "rec_no": pa.array(numbers, pa.int32()), "record": pa.array(records, pa.binary())})

        def look_up() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if read is None or not wanted:
                return
            place = u40(read(slot * POINTER, POINTER), 0)
            if not place:
                return
            for number, (key, record) in enumerate(list_records(read, shard, slot, place, record_len)):
                if key in wanted:
                    told.append((key, number, record))
                    size += len(record) + 64
                    if size > 1 << 22:
                        yield batch()

        def leave() -> None:
            if source is not None:
                source.close()
                if counter is not None:
                    counter.add(read.bytes)

        try:
            for b in batches:
                for key in b.column("key").to_pylist():
                    at = int(key[:2], 16), int(key[2:8], 16)
                    if at != (shard, slot):
                        yield from look_up()
                        wanted.clear()
                        if at[0] != shard:
                            leave()
                            source = system.open_input_file(files[at[0]]) if at[0] in files else None
                            read = Counted(source) if source else None
                        shard, slot = at
                    wanted.add(key)
            yield from look_up()
        finally:
            leave()
        yield batch()

    return run


def probe(keys: DataFrame, folder: str, record_len: int = 0, counter=None) -> DataFrame:
    """key, rec_no, record of all keys asked for. keys: key, hexadecimal, of 32 digits or, with record_len, eight.

    Keys are made distinct and sorted in ranges, so a task has neighbouring slots of few shards and reads five bytes of the
    map and one list for each slot asked for, whatever the shards hold. Keys of shards that are not there, absent keys and
    null ones give no row; upper-case digits are lowered, any other key is an error. counter: an accumulator of bytes read.
    """
    digits = 8 if record_len else 32
    sound = F.when(F.lower("key").rlike(f"^[0-9a-f]{{{digits}}}$"), F.lower("key")).otherwise(F.raise_error(F.lit(f"a probe takes keys of {digits} hexadecimal digits")))
    asked = keys.where("key is not null").select(sound.alias("key")).distinct()
    return asked.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_probe(folder, record_len, counter), "key string, rec_no int, record binary")


def _node_data(records: list[tuple[bytes, bytes]], record_len: int, node_bytes: int) -> Iterator[tuple[int, bytes]]:
    """(size field, data) of the nodes that hold a slot's records, given in the order of their keys."""
    if record_len:
        each = max(1, min(node_bytes // record_len, (1 << 16) - 1))
        for i in range(0, len(records), each):
            part = b"".join(r for _, r in records[i : i + each])
            yield len(part) // record_len, part
        return
    data, group, key = b"", b"", None
    for rest, record in records:
        piece = struct.pack("<H", len(record)) + record
        if group and (rest != key or len(data) + len(group) + len(piece) + 14 > node_bytes):
            data += key + struct.pack("<H", len(group)) + group
            group = b""
        if data and len(data) + len(group) + len(piece) + 14 > node_bytes:
            yield len(data), data
            data = b""
        key, group = rest, group + piece
    data += key + struct.pack("<H", len(group)) + group
    yield len(data), data


def _lists(record_len: int, node_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(head: bytes, records: list[tuple[bytes, bytes]]) -> dict:
            found = list(_node_data(records, record_len, node_bytes))
            size = POINTER + sum(POINTER + 2 + len(d) for _, d in found)
            return {"shard": head[0], "slot": int.from_bytes(head[1:], "big"), "sizes": [n for n, _ in found], "data": [d for _, d in found], "bytes": size}

        kind = pa.schema([("shard", pa.int32()), ("slot", pa.int32()), ("sizes", pa.list_(pa.int32())), ("data", pa.list_(pa.binary())), ("bytes", pa.int64())])
        held, head, done, size = [], None, [], 0
        for b in batches:
            for key, record in zip(b.column("key").to_pylist(), b.column("record").to_pylist()):
                if key[:4] != head:
                    if held:
                        done.append(out(head, held))
                        size += done[-1]["bytes"]
                    held, head = [], key[:4]
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(done, kind)
                        done, size = [], 0
                held.append((key[4:], record))
        if held:
            yield pa.RecordBatch.from_pylist([*done, out(head, held)], kind)

    return run


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(folder)
        system.create_dir(base, recursive=True)
        attempt = TaskContext.get().taskAttemptId()  # attempts of one task write files of their own, and any of them may be the last to name it
        shard, out, pointers, n = None, None, None, 0

        def close() -> pa.RecordBatch:
            if pointers is not None:
                out.write(pointers.tobytes())
            out.close()
            system.move(f"{base}/.{shard:02x}-{attempt}", f"{base}/{shard:02x}.ldb")
            return pa.RecordBatch.from_pydict({"shard": [f"{shard:02x}"], "lists": pa.array([n], pa.int64())})

        for b in batches:
            for row in b.to_pylist():
                if row["shard"] != shard:
                    if shard is not None:
                        yield close()
                    shard, pointers, n = row["shard"], np.zeros((SLOTS, POINTER), np.uint8), 0
                    out = system.open_output_stream(f"{base}/.{shard:02x}-{attempt}")
                if row["data"] is None:  # the map's entries come before the lists
                    pointers[row["slot"]] = np.frombuffer(row["at"].to_bytes(POINTER, "little"), np.uint8)
                    continue
                if pointers is not None:
                    out.write(pointers.tobytes())
                    pointers = None
                n += 1
                at = row["at"] + POINTER
                places = np.cumsum([at, *[POINTER + 2 + len(d) for d in row["data"]]]).tolist()
                parts = [places[-2].to_bytes(POINTER, "little")]
                for k, (size, data) in enumerate(zip(row["sizes"], row["data"])):
                    follow = places[k + 1] if k + 1 < len(row["data"]) else 0
                    parts += [follow.to_bytes(POINTER, "little"), struct.pack("<H", size), data]
                out.write(b"".join(parts))
        if shard is not None:
            yield close()

    return run


def write_shards(records: DataFrame, folder: str, record_len: int = 0, node_bytes: int = 4096) -> DataFrame:
    """Writes records (key, record: binary) as shards below folder; a row (shard, lists) for each file.

    Rows are sorted into lists, the lists' places are a running sum in each shard, and a task streams a shard: its map,
    then list after list, under a name of its own until the file is whole. Keys have 16 bytes, or four with record_len. A record that the layout's two-byte lengths cannot
    hold, or of another length than record_len, is an error; rows with a null key or record are ignored.
    """
    wide = 4 if record_len else 16
    most = (1 << 16) - 1 - 14 - 2
    fits = F.octet_length("record") == record_len if record_len else F.octet_length("record") <= most
    checked = F.when((F.octet_length("key") == wide) & fits, F.col("record")).otherwise(F.raise_error(F.lit(f"a shard takes keys of {wide} bytes and records of {record_len or f'at most {most}'}")))
    rows = records.select("key", "record").where("key is not null and record is not null").select("key", checked.alias("record"))
    rows = rows.repartition(F.substring("key", 1, 4)).sortWithinPartitions("key", "record")
    lists = cut(rows.mapInArrow(_lists(record_len, node_bytes), "shard int, slot int, sizes array<int>, data array<binary>, bytes long"), "shard-lists")
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    places = lists.select("shard", "slot", "bytes").withColumn("at", F.lit(MAP_BYTES) + F.coalesce(F.sum("bytes").over(before), F.lit(0))).drop("bytes")
    told = lists.drop("bytes").join(places, ["shard", "slot"]).unionByName(places, allowMissingColumns=True)
    told = told.repartition("shard").sortWithinPartitions("shard", F.col("data").isNotNull(), "slot")
    return cut(told.mapInArrow(_write(folder), "shard string, lists long"), "shard-manifest")
