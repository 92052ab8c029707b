"""Source trees and libraries as file tables."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions import text as ft
from provena.operators.verdict import first_file
from provena.session import cut, spread

#: Bytes of contents that a task passes on at once, and files that it reads.
READ_AT_ONCE, FILES_A_TASK = 4 << 20, 4096


def _matcher(glob: str | None) -> Callable[[str], bool]:
    """Whether a name fits a glob of *, ? and alternatives in braces."""
    if glob is None:
        return lambda name: True
    kinds = {"*": ".*", "?": ".", "{": "(?:", "}": ")", ",": "|"}
    depth, out = 0, ""
    for c in glob:
        depth += (c == "{") - (c == "}")
        out += kinds[c] if c in kinds and (c != "," or depth) else re.escape(c)
    return lambda name, fits=re.compile(out, re.DOTALL).fullmatch: fits(name) is not None


def _named(paths: DataFrame) -> DataFrame:
    return paths.select("path", ft.base_name(F.col("path")).alias("filename"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("parent"))


def _root(path: str, glob: str | None) -> tuple[str, str] | None:
    """(what Spark writes before a place of the file system, the folder's place), or None for what executors can't list themselves:
    a file system that Arrow lacks, a name that is no URI, a single file, classes of characters in the glob."""
    from pyarrow import fs

    from provena.sources.ldb import filesystem

    if set(glob or "") & set("[]\\^"):
        return None
    try:
        system, base = filesystem(path)
        if system.get_file_info(base).type != fs.FileType.Directory:
            return None
    except (pa.ArrowException, OSError):
        return None
    plain = re.sub("^file:/*", "/", path).rstrip("/")
    return ("file:" if plain.startswith("/") else plain[: len(plain) - len(base)], base) if plain.endswith(base) else None


def _by_spark(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return files.select("path", ft.base_name(F.col("path")).alias("filename"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("parent"), "content")


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, filename, parent of all files below a folder, a table; names that start with _ or . are left out, as Spark does.

    Executors list the folders, those of one depth at a time, so no list of files passes the driver. Places that only Spark
    can list are listed by its reader.
    """
    if (root := _root(path, glob)) is None:
        return _by_spark(spark, path, glob).drop("content")
    head, top = root

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        from provena.sources.ldb import filesystem

        fits, (system, _) = _matcher(glob), filesystem(path)
        wanted = lambda x: not x.base_name.startswith((".", "_")) and (x.type == fs.FileType.Directory or x.type == fs.FileType.File and fits(x.base_name))
        for b in batches:
            for place in b.column("path").to_pylist():
                found = [x for x in system.get_file_info(fs.FileSelector(place.removeprefix(head))) if wanted(x)]
                for lo in range(0, len(found), 4096):
                    part = found[lo : lo + 4096]
                    yield pa.RecordBatch.from_pydict({"path": pa.array([head + x.path for x in part], pa.string()), "folder": pa.array([x.type == fs.FileType.Directory for x in part])})

    todo = spark.createDataFrame([(head + top,)], "path string")
    tables = []
    while True:
        done = cut(todo.mapInArrow(entries, "path string, folder boolean"), "tree-list")
        tables.append(done.where("not folder").select("path"))
        todo = done.where("folder").select("path")
        if todo.isEmpty():
            break
        todo = todo.repartition(spark.sparkContext.defaultParallelism, "path")
    return _named(reduce(DataFrame.unionByName, tables))


def read_files(spark: SparkSession, path: str, glob: str | None = None, names: list[str] | None = None) -> DataFrame:
    """path, filename, parent, content of all files below a folder, or of those with the given names; the glob prunes the listing."""
    if (root := _root(path, glob)) is None:
        files = _by_spark(spark, path, glob)
        return files if names is None else files.where(F.col("filename").isin(*names))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from provena.sources.ldb import filesystem

        system, _ = filesystem(path)
        for b in batches:
            first, held, contents = 0, 0, []
            for k, place in enumerate(b.column("path").to_pylist(), 1):
                with system.open_input_stream(place.removeprefix(root[0])) as source:
                    contents.append(source.read())
                held += len(contents[-1])
                if held >= READ_AT_ONCE or k == b.num_rows:
                    part = b.slice(first, k - first)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("path", "filename", "parent")), pa.array(contents, pa.binary())], ["path", "filename", "parent", "content"])
                    first, held, contents = k, 0, []

    files = list_files(spark, path, glob)
    files = files if names is None else files.where(F.col("filename").isin(*names))
    parts = max(spark.sparkContext.defaultParallelism, -(-files.count() // FILES_A_TASK))
    return files.repartition(parts, "path").mapInArrow(read, "path string, filename string, parent string, content binary")


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes files (path below folder, content binary) through the folder's file system; their paths and sizes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from provena.sources.ldb import filesystem

        system, base = filesystem(folder)
        made = set()
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                place = posixpath.dirname(f"{base}/{path}")
                if place not in made:
                    system.create_dir(place, recursive=True)
                    made.add(place)
                with system.open_output_stream(f"{base}/{path}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_pydict({"path": b.column("path"), "size": pa.array([len(x) for x in b.column("content").to_pylist()], pa.int64())})

    return cut(spread(files.select("path", "content").where("path is not null and content is not null")).mapInArrow(write, "path string, size long"), "tree-files")


def find_libraries(spark: SparkSession, path: str) -> DataFrame:
    """ord, path, content of the static libraries below a folder: *.a by path, then *.lib by path; they sort by ord."""
    files = read_files(spark, path, "*.{a,lib}")
    return files.select(F.struct(F.col("path").endswith(".lib").alias("lib"), "path").alias("ord"), "path", "content")


def scan_tree(spark: SparkSession, path: str, tracked: list[str], grouping: str = "PARENT_DIR", glob: str | None = None) -> DataFrame:
    """group, filename, path, text of tracked files, one a group and name (the first by path).

    grouping: PARENT_DIR (a copy is a folder) or TARGET_ROOT (the whole target is one copy).
    """
    files = read_files(spark, path, glob, tracked)
    group = F.col("parent") if grouping == "PARENT_DIR" else F.lit(path)
    return first_file(files.select(group.alias("group"), "filename", "path", ft.decode(F.col("content")).alias("text")))


def library_paths(files: DataFrame, path_col: str = "path") -> DataFrame:
    """files with root, toolchain, core and name of the layout <root>/lib/<toolchain>/<core>/<name>."""
    part = lambda i: F.regexp_extract(F.col(path_col), r"^(.*)/lib/([^/]+)/([^/]+)/([^/]+)$", i)
    return files.withColumns({"root": part(1), "toolchain": part(2), "core": part(3), "name": part(4)})
