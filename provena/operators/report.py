"""Text forms of results, for people; everything else returns DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_lines(files: DataFrame) -> DataFrame:
    """line for each file result: its exact tags, or its best candidates with two decimals."""
    best = F.array_join(F.transform("top_candidates", lambda c: F.concat(F.format_number(c["score"], 2), F.lit(" "), c["tag"])), ", ")
    told = F.when(F.size("exact_matches") > 0, F.concat(F.lit("exact: "), F.array_join("exact_matches", ", "))).otherwise(F.concat(F.lit("closest: "), F.coalesce(best, F.lit("none"))))
    return files.select(F.concat_ws(" ", "group", "filename", told).alias("line"))


def verdict_lines(verdicts: DataFrame) -> DataFrame:
    extra = F.when(F.size("missing") > 0, F.concat(F.lit("missing "), F.array_join("missing", ", "))).when(F.size("tags") > 0, F.array_join("tags", ", "))
    return verdicts.select(F.concat_ws(" ", "group", "verdict", extra).alias("line"))


def vote_lines(voted: DataFrame, shown: int = 12) -> DataFrame:
    """The most voted contents of each file, at most ``shown``."""
    ranked = voted.groupBy("file").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), "md5"))), 1, shown).alias("r"))
    return ranked.select(F.concat("file", F.lit(": "), F.array_join(F.transform("r", lambda x: F.concat_ws(" ", x["md5"], (-x["v"]).cast("string"))), ", ")).alias("line"))
