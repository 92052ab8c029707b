"""Fingerprint text: `file=md5,size,path` headers, each followed by `line=hash,hash` rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.operators.vote import canonical_hash


def parse(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """path, md5, size, line, hash of every snippet hash; hashes are lower case, padded to 8 digits.

    A text is cut before each header, so a header and its rows stay in one piece and nothing is carried from row to row.
    """
    part = texts.select(F.explode(F.split(F.col(text_col), r"(?m)(?=^file=)")).alias("p")).where(F.col("p").startswith("file="))
    head = lambda i: F.regexp_extract("p", r"^file=([^,\n]*),([^,\n]*),([^\n]*)", i)
    told = part.select(head(3).alias("path"), F.lower(head(1)).alias("md5"), head(2).cast("long").alias("size"), F.explode(F.regexp_extract_all("p", F.lit(r"(?m)^(\d+=[0-9A-Fa-f,]+)"), F.lit(1))).alias("row"))
    told = told.select("path", "md5", "size", F.substring_index("row", "=", 1).cast("int").alias("line"), F.explode(F.split(F.substring_index("row", "=", -1), ",")).alias("h"))
    return told.where("h <> ''").select("path", "md5", "size", "line", canonical_hash(F.col("h")).alias("hash"))


def render(sketches: DataFrame) -> DataFrame:
    """path, text in the format above. sketches: path, md5, size, line, hash."""
    lines = sketches.groupBy("path", "md5", "size", "line").agg(F.array_join(F.array_sort(F.collect_list("hash")), ",").alias("h"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("line", "h"))), lambda r: F.concat(r["line"].cast("string"), F.lit("="), r["h"]))
    head = F.concat(F.lit("file="), F.concat_ws(",", "md5", F.col("size").cast("string"), "path"), F.lit("\n"))
    files = lines.groupBy("path", "md5", "size").agg(F.array_join(rows, "\n").alias("body"))
    return files.select("path", F.concat(head, "body", F.lit("\n")).alias("text"))
