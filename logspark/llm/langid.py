"""Operator 10: language identification by interpolated Kneser-Ney character models.

One model per language over lower-cased letters (other characters count as one blank), kept as sorted arrays of n-gram
hashes with log probabilities and back-off weights.  A text gets the language of lowest cross-entropy per character.
The score is a softmax over length-normalised cross-entropies at a fitted temperature; ``rejected`` marks texts without
a letter and texts whose cross-entropy is beyond what was seen of their language, by a limit fitted on the training
rows.  Fitting takes at most ``rows_per_language`` hashed rows of each language (a documented bound); predicting reads
whole texts in one pass without a shuffle.

Edge cases: null texts and texts without a letter give ``und`` with score 0 and are rejected; rows with null ``lang``
or id are never learned from; without any training row every text gives ``und``; repeated rows are predicted each.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm.labelled import bounded, fold, held_out
from logspark.llm.shared import lean, trim
from logspark.llm.text import chunks, mix

ORDER = 4
#: The most training rows of one language.
ROWS_PER_LANGUAGE = 2500
#: Texts with fewer letters are never rejected for their cross-entropy.
LEAST_LETTERS = 40


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Lower-case code point of every letter (16 bits), 32 for all else."""
    out = np.full(0x110000, 32, np.uint64)
    for cp in range(0x110000):
        if unicodedata.category(chr(cp))[0] == "L":
            low = chr(cp).lower()
            out[cp] = (ord(low[0]) & 0xFFFF) or 0xFFFF
    return out


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters with single blanks between words (one leads each text), the text of each symbol, letters per text."""
    cps = _folded()[np.frombuffer("".join(" " + t for t in texts).encode("utf-32-le"), np.uint32)]
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    blank = cps == 32
    keep = ~(blank & np.concatenate(([False], blank[:-1])))
    keep[bounds[:-1]] = True
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))[keep]
    cps = cps[keep]
    # a text's leading blank may be followed by another one, which the text starts with
    twice = (cps == 32) & np.concatenate(([False], (cps[:-1] == 32) & (owner[1:] == owner[:-1])))
    cps, owner = cps[~twice], owner[~twice]
    return cps, owner, np.bincount(owner[cps != 32], minlength=len(texts))


def grams(syms: np.ndarray, owner: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams that end at each symbol but a text's first one (16 bits a symbol; blanks before the text)."""
    key = syms.copy()
    for k in range(1, order):
        before = np.full_like(syms, 32)
        same = owner[k:] == owner[:-k]
        before[k:][same] = syms[:-k][same]
        key |= before << np.uint64(16 * k)
    at = np.flatnonzero(np.concatenate(([False], owner[1:] == owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
    return key[at], at


class Model:
    """Kneser-Ney models of all languages over common sorted hash arrays."""

    def __init__(self, counts: pd.DataFrame, order: int) -> None:
        self.order, self.langs = order, sorted(counts["lang"].unique())
        self.gram: list[tuple[np.ndarray, np.ndarray]] = []
        self.context: list[tuple[np.ndarray, np.ndarray]] = []
        self.temperature, self.limit = 1.0, np.full(len(self.langs), np.inf)
        symbols_ = np.unique(counts["key"].to_numpy(np.uint64) & np.uint64(0xFFFF))
        self.size = len(symbols_) + 1
        #: letters that no language shows share one place
        self.symbols, self.shared = symbols_, np.log(max(1, len(np.unique(_folded())) - len(symbols_)))
        per = [self._fit(g["key"].to_numpy(np.uint64), g["n"].to_numpy(np.float64)) for _, g in counts.groupby("lang", sort=True)]
        for k in range(order):
            for made, side in ((self.gram, 0), (self.context, 1)):
                keys = np.unique(np.concatenate([mix(p[k][side][0]) for p in per])) if per else np.zeros(0, np.uint64)
                table = np.full((len(keys), len(per)), np.nan, np.float32)
                for j, p in enumerate(per):
                    table[np.searchsorted(keys, mix(p[k][side][0])), j] = p[k][side][1]
                made.append((keys, table))

    def _fit(self, keys: np.ndarray, n: np.ndarray) -> list[tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]]:
        """For each order from 1: n-grams with log probabilities, contexts with log back-off weights."""
        levels = [(keys, n)]
        for k in range(self.order - 1, 0, -1):  # continuation counts: different symbols before
            shorter = levels[0][0] & np.uint64((1 << (16 * k)) - 1)
            u, c = np.unique(shorter, return_counts=True)
            levels.insert(0, (u, c.astype(np.float64)))
        out = []
        below: tuple[np.ndarray, np.ndarray] | None = None
        for k, (g, c) in enumerate(levels, 1):
            ones, twos = (c == 1).sum(), (c == 2).sum()
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            h, inverse = np.unique(g >> np.uint64(16), return_inverse=True)
            total, kinds = np.bincount(inverse, c), np.bincount(inverse)
            weight = d * kinds / total
            if below is None:
                lower = np.full(len(g), 1.0 / self.size)
            else:
                suffix = g & np.uint64((1 << (16 * (k - 1))) - 1)
                lower = below[1][np.searchsorted(below[0], suffix)]
            p = np.maximum(c - d, 0) / total[inverse] + weight[inverse] * lower
            out.append(((g, np.log(p)), (h, np.log(weight))))
            below = (g, p)
        return out

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """Row per key of the full order, column per language."""
        got = np.full((len(keys), len(self.langs)), -np.log(self.size), np.float32)
        for k in range(1, self.order + 1):
            key = keys & np.uint64((1 << (16 * k)) - 1) if k < 4 else keys
            (gh, gt), (ch, ct) = self.gram[k - 1], self.context[k - 1]
            c = self._find(ch, mix(key >> np.uint64(16)))
            back = np.where(c[:, None] >= 0, np.nan_to_num(ct[c], nan=0.0), 0.0)
            g = self._find(gh, mix(key))
            own = np.where(g[:, None] >= 0, gt[g], np.nan)
            got = np.where(np.isnan(own), got + back, own)
        got = got - np.where(self._find(self.symbols, keys & np.uint64(0xFFFF)) >= 0, 0, self.shared)[:, None]
        return got.astype(np.float32)

    @staticmethod
    def _find(sorted_: np.ndarray, want: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(sorted_, want), len(sorted_) - 1)
        return np.where(sorted_[at] == want, at, -1)

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per symbol in each language (row per text), and letters per text."""
        syms, owner, letters = symbols(texts)
        keys, at = grams(syms, owner, self.order)
        codes, unique = pd.factorize(keys)
        table = self.log_probabilities(unique.astype(np.uint64)) if len(unique) else np.zeros((0, len(self.langs)), np.float32)
        own = owner[at]
        n = np.maximum(np.bincount(own, minlength=len(texts)), 1)
        return np.stack([-np.bincount(own, table[codes, j], len(texts)) / n for j in range(len(self.langs))], axis=1) if self.langs else np.zeros((len(texts), 0)), letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        h, letters = self.cross_entropy(texts)
        best = h.argmin(axis=1)
        low = h[np.arange(len(texts)), best]
        score = 1 / np.exp((low[:, None] - h) * self.temperature).sum(axis=1)
        none = letters == 0
        rejected = none | ((letters >= LEAST_LETTERS) & (low > self.limit[best]))
        return ["und" if x else self.langs[j] for x, j in zip(none, best, strict=True)], np.where(none, 0.0, score), rejected

    def calibrate(self, texts: list[str], langs: list[str]) -> None:
        """Temperature of least log loss, and each language's limit of cross-entropy, from labelled texts."""
        some = [self.cross_entropy(texts[k : k + 40]) for k in range(0, len(texts), 40)]  # few at once: bounded memory
        h, letters = (np.concatenate(x) for x in zip(*some, strict=True))
        y = np.array([self.langs.index(x) for x in langs])
        ok = letters >= LEAST_LETTERS
        if not ok.any():
            return
        h, y = h[ok], y[ok]
        grid = [0.5, 1, 2, 4, 8, 16, 32]
        loss = [np.mean(t * h[np.arange(len(y)), y] + np.log(np.exp(-t * h).sum(axis=1))) for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        for j in range(len(self.langs)):
            own = h[y == j, j]
            if len(own):  # half way from the worst seen to a guess among all symbols
                self.limit[j] = (own.max() + np.log(self.size)) / 2


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Fit on a bounded sample of the labelled rows outside the held-out fold."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(id_col) != 2)).select(F.col(id_col).alias("i"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sample = bounded(rows, "lang", "i", rows_per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: pd.DataFrame | None = None
        for b in batches:
            for lo, hi in chunks(b.column(1)):
                langs = np.array(b.column(0).slice(lo, hi - lo).to_pylist(), object)
                syms, owner, _ = symbols(b.column(1).slice(lo, hi - lo).to_pylist())
                keys, at = grams(syms, owner, order)
                part = pd.DataFrame({"lang": langs[owner[at]], "key": keys}).value_counts(sort=False).rename("n").reset_index()
                total = part if total is None else pd.concat([total, part]).groupby(["lang", "key"], as_index=False)["n"].sum()
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(total["lang"]), pa.array(total["key"].to_numpy(np.uint64).view(np.int64)), pa.array(total["n"].to_numpy(np.int64))], ["lang", "key", "n"])

    counted = sample.select("lang", "text").mapInArrow(lean(count), "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    counted["key"] = counted["key"].to_numpy(np.int64).view(np.uint64)
    model = Model(counted, order)
    if model.langs:
        some = bounded(sample, "lang", "i", min(300, rows_per_language)).select("lang", "text").collect()
        model.calibrate([r[1] for r in some], [r[0] for r in some])
        del some
    del counted
    trim()
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, lang_pred, score, rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            for lo, hi in chunks(b.column(2)):
                lang, score, rejected = m.predict([t or "" for t in b.column(2).slice(lo, hi - lo).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], [id_col, "held_out", "lang_pred", "score", "rejected"])

    key = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, held_out(id_col).alias("held_out"), text_col).mapInArrow(lean(run), f"{id_col} {key}, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose language is not rejected."""
    held, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            for lo, hi in chunks(b.column(place)):
                part = b.slice(lo, hi - lo)
                yield part.filter(pa.array(~m.predict([t or "" for t in part.column(place).to_pylist()])[2]))

    return docs.mapInArrow(lean(run), docs.schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs))
