"""Language-model scoring with a probabilistic suffix tree.

The tree reads UTF-8 bytes. A document is its lower-cased words joined by one space and closed by an end mark, so the
probability of the bytes is the probability of the word sequence with its end. Contexts are up to DEPTH bytes long;
before the first word stand end marks (byte 0; a NUL in a text is read as DEL).

Training counts every (DEPTH + 1)-gram of every training text (a partial count in each task, then one aggregation);
shorter contexts are its marginals. A context may become a node when it occurs at least ``min_count`` times, so the tree
grows with the corpus. A node is retained if the divergence of its next-symbol distribution from its parent's, less the
bias of the estimate, is at least ``divergence`` nats, or if a longer retained context ends in it. Distributions are
smoothed towards the parent's (Witten-Bell), down to an add-0.1 root over all symbols. A symbol is scored in the state of
its longest retained suffix.

The tree is tables: a row for each retained context and symbol that was seen there, and one for each context with the
weight of its parent for all other symbols. It is built by joins and windows and never gathered as a whole. For scoring
it is cut into parts of at most ``part_entries`` rows by the last two symbols of the contexts; a part is broadcast, the
texts are read once for each part, and a position is scored by the part that owns its last two symbols.

The unigram base needs counts of all words. The most frequent, at most ``head_words``, are broadcast; the rest of a document's
words, rare by construction and so never a hot key, are joined with the full table of counts.

Defined results: null text is empty (one end token); a null id counts as the empty text in the hash, so it is held out;
repeated rows are scored and counted one by one; with no training rows the tree is its root; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.llm.text import blank_words, trimmed
from provena.session import cut, remove

DEPTH = 5
BITS = 8
LAST = (1 << BITS) - 1
#: Last two symbols of a context.
CELLS = 1 << 2 * BITS
_CHUNK = 1 << 20
_FLUSH = 1 << 21


def held_out(id_: Column, folds: int = 10) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % folds == 0


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, starts, ends): each text after DEPTH end marks; its positions to score are starts[i]..ends[i]."""
    gap = b"\0" * DEPTH
    joined = np.frombuffer(gap + gap.join(t.replace(b"\0", b"\x7f") for t in texts) + gap, np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = DEPTH + np.cumsum(size + DEPTH) - size - DEPTH
    return joined, starts, starts + size


def packed(syms: np.ndarray) -> np.ndarray:
    """The (DEPTH + 1)-gram that ends at each symbol from the one at DEPTH on, the latest symbol in the low bits."""
    gram = syms[: len(syms) - DEPTH].astype(np.int64)
    for k in range(1, DEPTH + 1):
        gram = (gram << BITS) | syms[k : len(syms) - DEPTH + k]
    return gram


def _chunks(texts: list[bytes]) -> Iterator[list[int]]:
    part, n = [], 0
    for i, t in enumerate(texts):
        part.append(i)
        n += len(t) + DEPTH
        if n >= _CHUNK:
            yield part
            part, n = [], 0
    if part:
        yield part


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts of a task: words, and character (DEPTH + 1)-grams, let go whenever they grow large."""
    words: Counter = Counter()
    ends, grams, held = 0, [], 0

    def out_words() -> pd.DataFrame:
        pdf = pd.DataFrame({"word": [w.decode("utf-8", "replace") for w in words], "gram": None, "n": list(words.values())})
        words.clear()
        return pdf

    def out_grams() -> pd.DataFrame:
        keys, n = _merge(grams)
        grams.clear()
        return pd.DataFrame({"word": None, "gram": keys, "n": n})

    for pdf in batches:
        texts = []
        for t in pdf["text"]:
            w = blank_words(t)
            words.update(w)
            ends += 1
            texts.append(b" ".join(w))
            if len(words) > _FLUSH // 4:
                yield out_words()
        for part in _chunks(texts):
            syms, _, last = symbols([texts[i] for i in part])
            wanted = syms != 0
            wanted[last] = True
            grams.append(np.unique(packed(syms)[wanted[DEPTH:]], return_counts=True))
            held += len(grams[-1][0])
            if held > _FLUSH:
                grams[:] = [_merge(grams)]
                held = len(grams[0][0])
                if held > _FLUSH // 2:
                    yield out_grams()
                    held = 0
    if words:
        yield out_words()
    if grams:
        yield out_grams()
    if ends:
        yield pd.DataFrame({"word": [None], "gram": [None], "n": [ends]})


@dataclass
class Tree:
    """A part of the tree. root: log10 probability of each symbol; levels[k - 1]: (contexts, weights, entries, logs) of the
    retained contexts of k symbols, sorted, the log10 weight of their parents, the sorted keys context * 256 + symbol
    of what was seen, and its log10 probability; owned: which last two symbols are scored here (None: all)."""

    root: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    owned: np.ndarray | None = None

    def grams(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each (DEPTH + 1)-gram."""
        sym, history = grams & LAST, grams >> BITS
        at = np.zeros((DEPTH + 1, len(grams)), np.int64)
        state = np.zeros(len(grams), np.int64)
        for k, (contexts, _, _, _) in enumerate(self.levels, 1):
            if not len(contexts):
                break
            context = history & ((1 << BITS * k) - 1)
            at[k] = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            state[(state == k - 1) & (contexts[at[k]] == context)] = k
        out, left = np.zeros(len(grams)), np.ones(len(grams), bool)
        for k in range(len(self.levels), 0, -1):
            _, weights, entries, logs = self.levels[k - 1]
            here = np.flatnonzero(left & (state >= k))
            if not len(here):
                continue
            key = (history[here] & ((1 << BITS * k) - 1)) << BITS | sym[here]
            place = np.minimum(np.searchsorted(entries, key), len(entries) - 1)
            seen = entries[place] == key
            out[here] += np.where(seen, logs[place], weights[at[k, here]])
            left[here[seen]] = False
        return out + np.where(left, self.root[sym], 0.0)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text, its end included, as far as this part owns it."""
        out = np.zeros(len(texts))
        for part in _chunks(texts):
            syms, starts, ends = symbols([texts[i] for i in part])
            gram = packed(syms)
            mine = np.zeros(len(gram) + 1, np.int64)
            np.add.at(mine, starts - DEPTH, 1)
            np.add.at(mine, ends - DEPTH + 1, -1)
            mine = np.cumsum(mine[:-1]) > 0
            if self.owned is not None:
                mine &= self.owned[gram >> BITS & CELLS - 1]
            distinct, place = np.unique(gram[mine], return_inverse=True)
            p = np.zeros(len(gram))
            p[mine] = self.grams(distinct)[place]
            total = np.concatenate([[0.0], np.cumsum(p)])
            out[part] = total[ends - DEPTH + 1] - total[starts - DEPTH]
        return out


@dataclass
class Model:
    """entries: k, ctx, sym, log; contexts: k, ctx, weight; root: log10 probability of each symbol."""

    entries: DataFrame
    contexts: DataFrame
    root: np.ndarray
    words: DataFrame
    train_tokens: int
    vocabulary: int
    end_count: int


def _suffix(k: int) -> Column:
    return F.col("ctx").bitwiseAND(F.lit((1 << BITS * k) - 1))


def grow(grams: DataFrame, min_count: int, divergence: float) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(entries, contexts, root) of a Model from the counts of all (DEPTH + 1)-grams (gram, n)."""
    levels = {DEPTH: grams.select(F.shiftright("gram", BITS).alias("ctx"), F.col("gram").bitwiseAND(F.lit(LAST)).cast("int").alias("sym"), "n")}
    for k in range(DEPTH - 1, -1, -1):
        levels[k] = cut(levels[k + 1].groupBy(_suffix(k).alias("ctx"), "sym").agg(F.sum("n").alias("n")), "pst-level")
    share = np.full(LAST + 1, 0.1)
    for r in levels[0].collect():  # at most a row for each symbol
        share[r.sym] += r.n
    root = share / share.sum()
    above = grams.sparkSession.createDataFrame([(0, i, float(x)) for i, x in enumerate(root)], "ctx long, sym int, p double")

    probs = {}
    context = Window.partitionBy("ctx")  # at most as many rows as there are symbols
    for k in range(1, DEPTH + 1):
        told = levels[k].withColumns({"size": F.sum("n").over(context), "types": F.count("*").over(context)}).where(F.col("size") >= min_count)
        told = told.withColumn("up", _suffix(k - 1)).join(above.select(F.col("ctx").alias("up"), "sym", F.col("p").alias("before")), ["up", "sym"])
        term = F.col("n") / F.col("size") * F.log(F.col("n") / F.col("size") / F.col("before"))
        told = told.withColumns({"p": (F.col("n") + F.col("types") * F.col("before")) / (F.col("size") + F.col("types")), "gain": F.sum(term).over(context) - (F.col("types") - 1) / (2 * F.col("size"))})
        probs[k] = above = cut(told.select("ctx", "sym", "p", "size", "types", "gain"), "pst-probabilities")
    remove(*[levels[k] for k in range(DEPTH)])

    entries = contexts = longer = None
    for k in range(DEPTH, 0, -1):  # a suffix of a retained context is retained
        kept = probs[k].where(F.col("gain") >= divergence).select("ctx")
        kept = kept if longer is None else kept.unionByName(longer.select(_suffix(k).alias("ctx")))
        longer = cut(kept.distinct(), "pst-kept")
        rows = probs[k].join(longer, "ctx").withColumn("k", F.lit(k))
        one = rows.select("k", "ctx", "sym", F.log10("p").cast("float").alias("log"))
        two = rows.select("k", "ctx", F.log10(F.col("types") / (F.col("size") + F.col("types"))).cast("float").alias("weight")).distinct()
        entries = one if entries is None else entries.unionByName(one)
        contexts = two if contexts is None else contexts.unionByName(two)
    return cut(entries, "pst-entries"), cut(contexts, "pst-contexts"), np.log10(root)


def train(docs: DataFrame, text_col: str = "text", min_count: int = 4, divergence: float = 0.02) -> Model:
    """Counts over all rows of docs; see the module's text."""
    partial = cut(docs.select(F.col(text_col).alias("text")).mapInPandas(trimmed(_count), "word string, gram long, n long"), "pst-partial")
    words = cut(partial.where("word is not null").groupBy("word").agg(F.sum("n").alias("c")), "pst-words")
    n_words, vocabulary = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    end_count = partial.where("word is null and gram is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    grams = cut(partial.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")), "pst-grams")
    remove(partial)
    entries, contexts, root = grow(grams, min_count, divergence)
    return Model(entries, contexts, root, words, n_words + end_count, vocabulary + (end_count > 0), end_count)


def parts(model: Model, part_entries: int) -> list[np.ndarray | None]:
    """Which last two symbols each part of the tree owns, so that a part has at most part_entries entries (or one pair of symbols)."""
    cell = F.col("ctx").bitwiseAND(F.lit(CELLS - 1)).cast("int")
    cells = model.entries.where("k > 1").groupBy(cell.alias("cell")).count().collect()  # at most CELLS rows
    if sum(r["count"] for r in cells) <= part_entries:
        return [None]
    out, held = [], part_entries + 1
    for r in sorted(cells, key=lambda r: -r["count"]):
        if held + r["count"] > part_entries:
            out.append(np.zeros(CELLS, bool))
            held = 0
        out[-1][r["cell"]] = True
        held += r["count"]
    out[-1] |= ~np.any(out, axis=0)  # what follows two symbols that no context ends in
    return out


def gathered(model: Model, owned: np.ndarray | None) -> Tree:
    """A part of the tree in memory; contexts of one symbol belong to every part."""
    entries, contexts = model.entries, model.contexts
    if owned is not None:
        cells = model.entries.sparkSession.createDataFrame([(int(c),) for c in np.flatnonzero(owned)], "cell int")
        mine = lambda df: df.where("k = 1").unionByName(df.where("k > 1").withColumn("cell", F.col("ctx").bitwiseAND(F.lit(CELLS - 1)).cast("int")).join(F.broadcast(cells), "cell").drop("cell"))
        entries, contexts = mine(entries), mine(contexts)
    key = F.shiftleft("ctx", BITS).bitwiseOR(F.col("sym"))
    levels = []
    for k in range(1, DEPTH + 1):
        c = contexts.where(F.col("k") == k).select("ctx", "weight").toArrow()
        e = entries.where(F.col("k") == k).select(key.alias("key"), "log").toArrow()
        (ctx, weight), (keys, log) = ((t[0].to_numpy(), t[1].to_numpy()) for t in (c, e))
        by_ctx, by_key = np.argsort(ctx), np.argsort(keys)
        levels.append((ctx[by_ctx], weight[by_ctx], keys[by_key], log[by_key]))
    return Tree(model.root, levels, owned)


def head_floor(words: DataFrame, most: int) -> int:
    """The smallest count that at most ``most`` words reach, on a grid of 64 steps an octave: a histogram, no sort."""
    steps = words.groupBy(F.floor(F.log2("c") * 64).cast("int").alias("step")).count().collect()
    left, floor = most, 1 << 62
    for step, n in sorted(map(tuple, steps), reverse=True):
        left -= n
        if left < 0:
            return floor
        floor = int(np.ceil(2 ** (step / 64) * (1 - 1e-12)))
    return 0


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", head_words: int = 200_000, part_entries: int = 4_000_000) -> DataFrame:
    """id, n_tokens, n_known, base_score, score: a row for each row of docs."""
    spark = docs.sparkSession
    n, v = model.train_tokens, model.vocabulary
    head = model.words.where(F.col("c") >= head_floor(model.words, head_words)).toArrow()
    log = np.log10(head["c"].to_numpy().astype(np.float64) + 0.1)
    known = dict(zip((w.encode() for w in head["word"].to_pylist()), log.tolist()))
    norm, end = float(np.log10(n + 0.1 * (v + 1))), float(np.log10(model.end_count + 0.1))
    end_known = int(model.end_count > 0)

    def first(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, head = shared.value
            for batch in batches:
                texts, n_tokens, n_known, base, tails, times = [], [], [], [], [], []
                for t in batch.column("text").to_pylist():
                    w = blank_words(t)
                    texts.append(b" ".join(w))
                    logs = list(map(head.get, w, repeat(None)))
                    tail = Counter(x for x, y in zip(w, logs) if y is None)
                    hits = [x for x in logs if x is not None]
                    n_tokens.append(len(w) + 1)
                    n_known.append(len(hits) + end_known)
                    base.append(float(np.sum(hits)) + end - (len(w) + 1) * norm)
                    tails.append([x.decode("utf-8", "replace") for x in tail])
                    times.append(list(tail.values()))
                columns = {"row": batch.column("row"), "id": batch.column("id"), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64())}
                columns |= {"base": pa.array(base, pa.float64()), "score": pa.array(tree.score(texts), pa.float64()), "word": pa.array(tails, pa.list_(pa.string())), "times": pa.array(times, pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_pydict(columns)

        return trimmed(run)

    def further(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = shared.value
            for batch in batches:
                texts = [b" ".join(blank_words(t)) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "score": pa.array(tree.score(texts), pa.float64())})

        return trimmed(run)

    kind = docs.schema[id_col].dataType.simpleString()
    owned = parts(model, part_entries)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows if len(owned) == 1 else cut(rows, "pst-rows")  # read more than once: the numbers must stay
    shared = spark.sparkContext.broadcast((gathered(model, owned[0]), known))
    scored = cut(rows.mapInArrow(first(shared), f"row long, id {kind}, n_tokens long, n_known long, base double, score double, word array<string>, times array<long>"), "pst-scored")
    shared.unpersist()
    further_scores = None
    for part in owned[1:]:
        shared = spark.sparkContext.broadcast(gathered(model, part))
        more = cut(rows.mapInArrow(further(shared), "row long, score double"), "pst-part")
        shared.unpersist()
        further_scores = more if further_scores is None else further_scores.unionByName(more)
    if further_scores is not None:
        scored = scored.join(further_scores.groupBy("row").agg(F.sum("score").alias("s")), "row").withColumn("score", F.col("score") + F.col("s")).drop("s")
    tail = scored.select("row", F.explode(F.arrays_zip("word", "times")).alias("x")).select("row", "x.word", "x.times")
    tail = tail.join(model.words, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("part")
    )
    out = scored.join(tail, "row", "left")
    return out.select(
        F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), (F.col("base") + F.coalesce("part", F.lit(0.0))).alias("base_score"), "score"
    )
