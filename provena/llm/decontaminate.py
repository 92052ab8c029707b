"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only.

Words are the runs of letters and digits of the lower-cased text, shingles are five words. An item is inside a document
when the document holds at least ``containment`` of the item's distinct shingles, wherever they stand.

MinHash signatures of a fixed length cannot see thirty shingles inside twenty thousand, so the sketch depends on size:
items are partitioned by the power of two of their shingle count q, and an item's sketch is its k smallest shingle
hashes, k = q - ceil(containment q) + hits. A document that contains the item lacks at most q - ceil(containment q) of
its shingles, so it has at least ``hits`` of the sketch: no item is missed at any length of the document. Each size
partition has the largest hash of its sketches as threshold; only document hashes below the threshold of a partition
whose items fit into the document are looked up. Lookup is an equi-join on the hash, in which a document's hashes are
made and dropped within its own row; the sketch table is broadcast only if its counted rows are at most
``broadcast_rows``, else both sides are shuffled. Candidates are then verified on the shingles themselves: the texts of
documents that have one (their keys are broadcast if they are at most ``broadcast_rows``, so no other text is moved) meet
the shingles of all their items in one row.

Defined results: null and empty texts, and items of fewer than five words, have no shingle and take no part; rows that
repeat a doc_id with the same text or another give one result for each item, the largest count, but stay or go each by its
own text; a null doc_id is reported as null; empty tables give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.session import cut, fresh

WORD_GAP = r"[^\p{L}\p{N}]+"
HITS = 3


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORD_GAP), lambda w: w != "")


def _starts(array: Column, n: int) -> Column:
    return F.when(F.size(array) >= n, F.sequence(F.lit(0), F.size(array) - n)).otherwise(F.array().cast("array<int>"))


def shingle_texts(array: Column, n: int) -> Column:
    """Distinct shingles of an array of words."""
    return F.array_distinct(F.transform(_starts(array, n), lambda i: F.concat_ws(" ", *[F.get(array, i + k) for k in range(n)])))


def shingle_hashes(array: Column, n: int) -> Column:
    """Hashes of all shingles of an array of words' hashes, repeats included."""
    return F.transform(_starts(array, n), lambda i: F.xxhash64(*[F.get(array, i + k) for k in range(n)]))


def _word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def item_sketches(items: DataFrame, id_col: str, text_col: str, shingle: int, containment: float) -> DataFrame:
    """item, q, partition (power of two of q), need (sketch hashes that must be met), sketch (sorted hashes)."""
    hashed = items.select(F.col(id_col).alias("item"), _word_hashes(F.col(text_col)).alias("w")).where(F.size("w") >= shingle)
    sets = hashed.select("item", F.array_sort(F.array_distinct(shingle_hashes(F.col("w"), shingle))).alias("s")).select("item", "s", F.size("s").alias("q"))
    lacking = F.col("q") - F.ceil(F.lit(containment) * F.col("q") - 1e-9)
    k = F.least(F.col("q"), lacking + HITS).cast("int")
    return sets.select("item", "q", F.floor(F.log2("q")).cast("int").alias("partition"), (k - lacking).alias("need"), F.slice("s", F.lit(1), k).alias("sketch"))


def _found(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, shingle: int, containment: float, broadcast_rows: int) -> DataFrame:
    """doc, mark (hash of the text), item, shared, q: every item inside every text."""
    docs = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    sketches = item_sketches(items, item_col, item_text, shingle, containment)
    partitions = sketches.groupBy("partition").agg(F.max(F.element_at("sketch", -1)).alias("top"), F.min(F.col("q")).alias("q"), F.sum(F.size("sketch")).alias("rows")).collect()
    rows = sum(p["rows"] for p in partitions)
    lookup = sketches.select("item", "q", "need", F.explode("sketch").alias("h"))
    lookup = F.broadcast(lookup) if rows <= broadcast_rows else lookup

    # the threshold of a document: the largest of the partitions whose smallest item fits into it
    top = F.lit(None).cast("long")
    for p in partitions:
        top = F.greatest(top, F.when(F.col("n") >= containment * p["q"], F.lit(p["top"])))
    hashed = docs.where(F.col("text").isNotNull()).select("doc", "mark", _word_hashes(F.col("text")).alias("w"))
    hashed = hashed.select("doc", "mark", "w", (F.size("w") - (shingle - 1)).alias("n")).where("n > 0").withColumn("top", top)
    found = hashed.select("doc", "mark", "n", F.explode(F.filter(shingle_hashes(F.col("w"), shingle), lambda h: h <= F.col("top"))).alias("h"))
    met = found.join(lookup, "h").where(F.col("n") >= F.lit(containment) * F.col("q") - 1e-9)
    pairs = met.groupBy("doc", "mark", "item").agg(F.count_distinct("h").alias("met"), F.max("need").alias("need")).where("met >= need")
    pairs = cut(pairs.select(F.col("doc").alias("_doc"), F.col("mark").alias("_mark"), "item"), "leak-pairs")

    # verification: only texts with a candidate move, and a text's shingles are made once for all its candidates
    own = items.select(F.col(item_col).alias("item"), words(F.col(item_text)).alias("w")).where(F.size("w") >= shingle)
    own = cut(own.select("item", shingle_texts(F.col("w"), shingle).alias("i")), "leak-items")
    wanted = pairs.join(F.broadcast(own) if rows <= broadcast_rows else own, "item").groupBy("_doc", "_mark").agg(F.collect_list(F.struct("item", "i")).alias("items"))
    here = docs["doc"].eqNullSafe(F.col("_doc")) & (docs["mark"] == F.col("_mark"))
    keys = pairs.select("_doc", "_mark").distinct()
    texts = docs.join(F.broadcast(keys), here, "left_semi") if keys.count() <= broadcast_rows else docs
    texts = texts.dropDuplicates(["doc", "mark"])
    texts = texts.join(wanted, texts["doc"].eqNullSafe(F.col("_doc")) & (texts["mark"] == F.col("_mark"))).select("doc", "mark", "items", words(F.col("text")).alias("w"))
    # through a generator, so that the shingles are not made again for every item
    texts = texts.select("doc", "mark", "items", F.explode(F.array(shingle_texts(F.col("w"), shingle))).alias("s"))
    shared = F.transform("items", lambda x: F.struct(x["item"].alias("item"), F.size(F.array_intersect(x["i"], F.col("s"))).cast("long").alias("shared"), F.size(x["i"]).cast("long").alias("q")))
    checked = texts.select("doc", "mark", F.inline(shared))
    return checked.where(F.col("shared") >= F.lit(containment) * F.col("q") - 1e-9)


def contained_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    shingle: int = 5, containment: float = 0.8, broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """id_col, item_col, n_shared, n_item: every item inside every document."""
    sound = _found(docs, items, id_col, text_col, item_col, item_text, shingle, containment, broadcast_rows)
    return sound.groupBy(F.col("doc").alias(id_col), F.col("item").alias(item_col)).agg(F.max("shared").alias("n_shared"), F.max("q").alias("n_item"))


def without_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    shingle: int = 5, containment: float = 0.8, broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """The rows of docs whose text holds no item."""
    id_, mark = fresh(docs, "leak_id"), fresh(docs, "leak_mark")
    bad = _found(docs, items, id_col, text_col, item_col, item_text, shingle, containment, broadcast_rows)
    bad = cut(bad.select(F.col("doc").alias(id_), F.col("mark").alias(mark)).distinct(), "leaks")
    bad = F.broadcast(bad) if bad.count() <= broadcast_rows else bad
    return docs.join(bad, docs[id_col].eqNullSafe(bad[id_]) & (F.xxhash64(F.col(f"`{text_col}`")) == bad[mark]), "left_anti")
