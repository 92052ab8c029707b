"""Language identification with blended-spectrum string kernels.

Texts are lower-cased and folded to 64 symbols (a-z, 37 slots for all other letters, one for the rest). The kernel
counts the n-grams of 1 to 3 symbols that two whole texts share, presence only, and is normalised by both texts' own
counts. Nyström landmarks, some training texts of each language, give features K(x, L) K(L, L)^-1/2; one-versus-rest
kernel ridge regression is fitted on them. Prediction is two matrix products for a block of texts: presence rows by
landmark columns, then the kernel block by the coefficients.

The model is fitted on a bounded sample of labelled rows: ``per_lang`` a language, those with the smallest hash of
id and text, equal rows once, and ``max_langs`` languages (more labels than that are an error: no model of them fits into
a worker). Only n-gram sets of these rows reach the driver (at most 266,304 codes each). Prediction reads the whole text
and nothing else.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is every text if nothing could be
learned (no labelled row with a letter). Ties go to the language that sorts first. Repeated rows are predicted one by
one; null ids are kept (and count as training rows); empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm.text import release_memory

SYMBOLS, N_MAX = 64, 3
_OFFSET = [0, SYMBOLS, SYMBOLS + SYMBOLS**2]
SPACE = SYMBOLS + SYMBOLS**2 + SYMBOLS**3
UNDETERMINED = "und"


@cache
def _fold() -> np.ndarray:
    """Code point -> symbol; 0 is all that is no letter."""
    table = np.zeros(0x110000, np.uint8)
    letters = np.array([c for c in range(128, 0x110000) if chr(c).isalpha()])
    table[letters] = 27 + letters % 37
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return table


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text, repeats included."""
    s = _fold()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")].astype(np.int32)
    out = [s]
    for n in range(1, N_MAX):
        if len(s) > n:
            out.append(out[-1][:-1] * SYMBOLS + s[n:])
    return np.concatenate([g + o for g, o in zip(out, _OFFSET)])


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray
    landmarks: np.ndarray
    own: np.ndarray
    weights: np.ndarray
    mean: np.ndarray

    def kernel(self, rows: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Normalised kernel of texts (presence on self.codes, own n-gram count) with the landmarks."""
        return (rows @ self.landmarks) / np.sqrt(np.maximum(own, 1)[:, None] * self.own[None, :])

    def predict(self, texts: list[str | None], block: int = 64) -> tuple[list[str], np.ndarray]:
        langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        todo = [i for i, t in enumerate(texts) if self.langs and has_letter(t)]
        seen = np.zeros(SPACE, bool)
        for i in range(0, len(todo), block):
            part = todo[i : i + block]
            rows, own = np.empty((len(part), len(self.codes)), np.float32), np.empty(len(part), np.float32)
            for k, j in enumerate(part):
                g = grams(texts[j])
                seen[g] = True
                rows[k], own[k] = seen[self.codes], np.count_nonzero(seen)
                seen[g] = False
            s = self.kernel(rows, own) @ self.weights + self.mean
            best = s.argmax(1)
            scores[part] = np.clip(s[np.arange(len(part)), best], 0, 1)
            for j, b in zip(part, best):
                langs[j] = self.langs[b]
        return langs, scores


def fit(rows: list[tuple[str, np.ndarray]], landmarks: int = 128, ridge: float = 1e-3) -> Model:
    """rows: (language, distinct n-gram codes) of the training texts, in the order in which landmarks are drawn."""
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        none = np.empty(0, np.float32)
        return Model([], np.empty(0, np.int64), none, none, none, none)
    each = max(2, landmarks // len(langs))
    chosen = [i for lang in langs for i in [i for i, r in enumerate(rows) if r[0] == lang][:each]]
    codes = np.unique(np.concatenate([rows[i][1] for i in chosen]))
    own = np.array([len(g) for _, g in rows], np.float32)

    def presence(g: np.ndarray) -> np.ndarray:
        row = np.zeros(len(codes), np.float32)
        at = np.searchsorted(codes, g)
        at[at == len(codes)] = 0
        row[at[codes[at] == g]] = 1
        return row

    model = Model(langs, codes, np.stack([presence(rows[i][1]) for i in chosen], 1), own[chosen], np.empty(0), np.empty(0))
    k = np.concatenate([model.kernel(np.stack([presence(g) for _, g in rows[i : i + 256]]), own[i : i + 256]) for i in range(0, len(rows), 256)]).astype(np.float64)
    values, vectors = np.linalg.eigh(k[chosen])
    sound = values > values.max() * 1e-6
    root = vectors[:, sound] / np.sqrt(values[sound])
    x = k @ root
    y = np.array([[lang == other for other in langs] for lang, _ in rows], np.float64)
    model.mean = y.mean(0)
    w = np.linalg.solve(x.T @ x + ridge * len(rows) * np.eye(x.shape[1]), x.T @ (y - model.mean))
    model.weights = root @ w
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 200, landmarks: int = 128, ridge: float = 1e-3, seed: int = 4, max_langs: int = 1000) -> Model:
    """Fit on at most per_lang labelled rows of each language (see the module's text)."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit(seed), id_col, text_col).alias("h"))
    counts = labelled.groupBy("lang").count().limit(max_langs + 1).collect()
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    if not counts:
        return fit([])
    # about twice as many as wanted, by a hash threshold; the smallest hashes of them are taken
    rate = F.lit(0.0)
    for r in counts:
        rate = F.when(F.col("lang") == r.lang, F.lit(min(1.0, (2.0 * per_lang + 20) / r["count"]))).otherwise(rate)
    drawn = labelled.where(F.pmod("h", F.lit(1 << 30)) < rate * (1 << 30))
    found = drawn.dropDuplicates(["lang", "h"]).select("lang", F.pmod("h", F.lit(1 << 30)).alias("h"), _gram_sets(F.col("text")).alias("grams")).toArrow().sort_by([("h", "ascending")])
    taken: dict[str, int] = {}
    rows = []
    for lang, g in zip(found["lang"].to_pylist(), found["grams"]):
        if taken.get(lang, 0) < per_lang:
            taken[lang] = taken.get(lang, 0) + 1
            rows.append((lang, g.values.to_numpy()))
    return fit(rows, landmarks, ridge)


def _gram_sets(text: Column) -> Column:
    @F.pandas_udf("array<int>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(grams(t)) for t in texts], index=texts.index, dtype=object)

    return of(text)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """struct<lang string, score double> of the text column of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        langs, scores = shared.value.predict(texts.tolist())
        release_memory()
        return pd.DataFrame({"lang": langs, "score": scores}, index=texts.index)

    return of(F.col(text_col))
