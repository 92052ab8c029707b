"""WARC archives with a Zstandard dictionary.

Each task writes one file: a leading skippable frame with the dictionary (itself compressed), then every record as a
frame of its own, so a reader needs the dictionary and can start at any record. The dictionary is trained on the file's
own first records, at most ``sample_bytes`` of them; records too few or too small to train on are one as they are.

Records with equal payloads of at least ``min_bytes`` bytes: the one with the largest id is a response, the others are
revisits that refer to it and carry no payload. Equality is by SHA-1; the ids of repeated payloads come from one
aggregation over digests, so a payload that a third of all rows share is no hot task. The repeated digests are broadcast
if they are at most ``broadcast_rows``: payloads then stay in the task that read them. Beyond that both sides are
exchanged by digest, as plain exchanges whose hot keys Spark splits.

Files go to the shared folder through its own file system, under a name of the task attempt; the manifest lists those of
the attempts that count, so a lost executor or a repeated task leaves at most an unlisted file.

Defined results: null html is an empty payload; rows that repeat the largest id are all responses; a null id is archived
as ``null`` and is never referred to unless its payload has no other id; empty tables give no file; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.session import cut, shared_path

#: The skippable frame of a dictionary.
DICT_MAGIC = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
CRLF = b"\r\n"
RECORD_URI = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = 1 << 20


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: object, url: str | None, payload: bytes, refers_to: object | None) -> bytes:
    """One WARC/1.1 record, uncompressed; a revisit if refers_to is given."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        b"WARC/1.1", f"WARC-Type: {kind}".encode(), f"WARC-Record-ID: <{RECORD_URI}{page_id}>".encode(), b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Target-URI: " + (url or "").encode("utf-8", "replace").replace(b"\r", b"%0D").replace(b"\n", b"%0A"),
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}".encode(), f"X-Payload-Length: {len(payload)}".encode(),
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{RECORD_URI}{refers_to}>".encode(), f"WARC-Profile: {PROFILE}".encode()]
        payload = b""
    block = b"HTTP/1.1 200 OK" + CRLF + b"Content-Type: text/html; charset=utf-8" + CRLF + CRLF + payload
    head += [b"Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}".encode()]
    return CRLF.join(head) + CRLF + CRLF + block + CRLF + CRLF


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = data.partition(CRLF + CRLF)
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if len(block) != int(headers["Content-Length"]) or rest[len(block) :] != CRLF + CRLF:
        raise ValueError("a record is cut short")
    return headers, block.partition(CRLF + CRLF)[2]


def build_dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the samples' first bytes if they are too few or too small to train on."""
    total = sum(map(len, samples))
    if len(samples) >= 8 and total >= 16 * 1024:
        try:
            return zstandard.train_dictionary(min(size, total // 8), samples, k=1024, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[:size]


def write_archive(out, records: Iterator[bytes], dict_bytes: int = 65_536, sample_bytes: int = 1 << 21, level: int = 3) -> tuple[int, int]:
    """Writes dictionary frame and record frames; (records, bytes written)."""
    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r)
        if size >= sample_bytes:
            break
    trained = build_dictionary([r[:65_536] for r in held], dict_bytes)
    written = n = 0
    compressor = zstandard.ZstdCompressor(level=level, write_content_size=True)
    if trained:  # there is a record
        packed = compressor.compress(trained)
        written += out.write(struct.pack("<II", DICT_MAGIC, len(packed)) + packed)
        compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained), write_content_size=True)
    for part in (held, records):
        for r in part:
            written += out.write(compressor.compress(r))
            n += 1
    return n, written


def read_archive(source) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    start = source.read(8)
    decompressor = zstandard.ZstdDecompressor()
    if len(start) == 8 and struct.unpack("<I", start[:4])[0] == DICT_MAGIC:
        frame = source.read(struct.unpack("<I", start[4:])[0])
        if frame[:4] == struct.pack("<I", ZSTD_MAGIC):
            frame = decompressor.decompress(frame)
        decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(frame))
        start = b""
    data = start
    while data or (data := source.read(_READ)):
        one, parts = decompressor.decompressobj(), []
        while not one.eof:
            if not data and not (data := source.read(_READ)):
                raise ValueError("the archive is cut short")
            parts.append(one.decompress(data))
            data = one.unused_data if one.eof else b""
        yield b"".join(parts)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Archives all rows below the shared folder; the manifest: path, records, bytes."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    repeated = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    repeated = cut(repeated, "warc-repeated")
    repeated = F.broadcast(repeated) if repeated.count() <= broadcast_rows else repeated
    told = rows.join(repeated, "sha", "left").select("id", "url", "payload", F.when(F.col("id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for b in batches:
                columns = [b.column(c) for c in ("id", "url", "payload", "refers_to")]
                for k in range(b.num_rows):
                    page, url, payload, refers = (c[k].as_py() for c in columns)
                    yield record("null" if page is None else page, url, payload, refers)

        feed = records()
        first = next(feed, None)
        if first is None:
            return
        system, base = _filesystem(folder)
        system.create_dir(base, recursive=True)
        path = f"{base}/{uuid.uuid4().hex}.warc.zst"

        def chained() -> Iterator[bytes]:
            yield first
            yield from feed

        with system.open_output_stream(path, compression=None) as out:
            n, size = write_archive(out, chained())
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path.rsplit('/', 1)[1]}"], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return cut(told.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


READ_SCHEMA = "record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string, url string"


def read_archives(manifest: DataFrame, payload: bool = False) -> DataFrame:
    """A row for each record of the manifest's files, a file to a task; with payload also the payload (null for revisits).

    A response's length and digest are taken from the payload that is read, and must agree with its headers.
    """
    names = [f.split()[0] for f in READ_SCHEMA.split(", ")] + ["payload"] * payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(len(names))], names)

        for b in batches:
            for uri in b.column("path").to_pylist():
                system, path = _filesystem(uri)
                rows, held = [], 0
                with system.open_input_stream(path, compression=None) as source:
                    for data in read_archive(source):
                        h, body = parse(data)
                        digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
                        refers = h.get("WARC-Refers-To")
                        if refers is None and (payload_digest(body) != digest or len(body) != size):
                            raise ValueError(f"{uri}: a payload differs from its digest")
                        strip = lambda x: x and x.strip("<>").removeprefix(RECORD_URI)
                        rows.append((strip(h["WARC-Record-ID"]), h["WARC-Type"], strip(refers), size, digest, h["WARC-Target-URI"], None if refers else body))
                        held += len(body) if payload else 100
                        if held > 1 << 23:
                            yield flush(rows)
                            rows, held = [], 0
                if rows:
                    yield flush(rows)

    files = manifest.select("path")
    return files.repartition(max(1, files.count())).mapInArrow(read, READ_SCHEMA + ", payload binary" * payload)


def archive_folder(spark) -> str:
    return shared_path(spark, "warc")
