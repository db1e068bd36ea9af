"""Operator 8: toxicity by a learned lexicon, matched through Levenshtein automata.

The lexicon (words, and stems that many words share) is learned from labelled rows.  Its trie is intersected with the
Levenshtein automata of its words (one edit, for words of five letters or more; stems match exactly) and made into one
deterministic table, through which all words of many texts run at once, a letter a step; most leave it at once.  A
match counts by the evidence of its entry and kind (exact, edited), less where its context window shows quotation
(quote marks on both sides).  The score is the posterior probability of the toxic label given the matches.

Fitting takes at most ``rows_per_class`` hashed labelled rows of each class (a documented bound), never the held-out
fold; the candidate words that reach the driver are the ``MOST_WORDS`` of most toxic rows.  Scoring reads whole texts
in one pass without a shuffle.

Edge cases: null and empty texts get the score of a text without matches; without labelled rows of both classes the
score is the share of toxic rows (0 without any); rows with a null id are never learned from; a document with several
labels counts as toxic if one says so; repeated rows are scored each.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm.labelled import bounded, fold, held_out
from logspark.llm.shared import lean, trim
from logspark.llm.text import chunks

ROWS_PER_CLASS = 4000
MOST_WORDS = 20_000
#: Letters from which one edit is allowed.
FUZZY_FROM = 5
STEM_LENGTHS = range(4, 8)
#: Code points to either side in which quote marks make a match a quotation.
WINDOW = 60
QUOTES = "\"'`«»‘’“”„"
#: What a quoted match counts, of an unquoted one, before evidence.
QUOTED = 0.4
KINDS = ("exact", "edited", "exact quoted", "edited quoted")


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case code point of what words consist of (letters, digits, marks and signs put for letters), else 0."""
    out = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        if unicodedata.category(chr(cp))[0] in "LNM" or chr(cp) in "@$_":
            low = chr(cp).lower()
            out[cp] = ord(low[0])
    return out


def spans(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded code points of a text, and where its words start and end."""
    low = _letters()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    edge = np.diff(np.concatenate(([0], (low > 0).astype(np.int8), [0])))
    return low, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class Lexicon:
    """The deterministic table of a trie of stems and words within one edit."""

    def __init__(self, words: list[str], stems: list[str]) -> None:
        self.entries = [*words, *(s + "*" for s in stems)]
        letters = sorted({c for e in (*words, *stems) for c in e})
        self.symbol = {c: k + 1 for k, c in enumerate(letters)}  # 0: any other letter
        self.columns = len(letters) + 1
        next_: list[dict[str, int]] = [{}]
        ends: dict[int, int] = {}  # trie node: word
        stem: dict[int, int] = {}
        deep = [0]  # length of the longest fuzzy word below a node, 0 if none
        for k, e in enumerate((*words, *stems)):
            node, path = 0, [0]
            for c in e:
                if c not in next_[node]:
                    next_[node][c] = len(next_)
                    next_.append({})
                    deep.append(0)
                node = next_[node][c]
                path.append(node)
            if k < len(words):
                ends[node] = k
                if len(e) >= FUZZY_FROM:
                    for p in path:
                        deep[p] = 1
            else:
                stem[node] = k
        fuzzy_end = {n for n, k in ends.items() if len(words[k]) >= FUZZY_FROM}

        def close(states: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
            out = set(states)
            for node, edits in states:  # a letter of the word left out
                if edits == 0:
                    out |= {(n, 1) for n in next_[node].values() if deep[n]}
            return frozenset(s for s in out if s[1] == 0 or (s[0], 0) not in out)

        def step(state: frozenset[tuple[int, int]], c: str) -> frozenset[tuple[int, int]]:
            out: set[tuple[int, int]] = set()
            for node, edits in state:
                to = next_[node].get(c)
                if to is not None and (edits == 0 or deep[to]):
                    out.add((to, edits))
                if edits == 0:
                    if deep[node]:
                        out.add((node, 1))  # a letter put in
                    out |= {(n, 1) for n in next_[node].values() if deep[n]}  # a letter for another
            return close(out)

        start = close({(0, 0)})
        number, queue = {frozenset(): 0, start: 1}, [start]
        rows = [[0] * self.columns]
        accept: list[tuple[int, int]] = [(-1, 0), (-1, 0)]  # entry, kind at the end of a word
        hit = [-1, -1]  # stem just completed
        while queue:
            state = queue.pop(0)
            row = []
            for c in ["\0", *letters]:
                to = step(state, c)
                if to not in number:
                    number[to] = len(number)
                    queue.append(to)
                    exact = [ends[n] for n, e in to if e == 0 and n in ends]
                    near = sorted(ends[n] for n, e in to if e == 1 and n in fuzzy_end)
                    accept.append((exact[0], 0) if exact else (near[0], 1) if near else (-1, 0))
                    hit.append(min((stem[n] for n, e in to if e == 0 and n in stem), default=-1))
                row.append(number[to])
            rows.append(row)
        self.table = np.array(rows, np.int32)
        self.accept = np.array(accept, np.int32).reshape(-1, 2)
        self.hit = np.array(hit, np.int32)

    def matches(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word number, entry and kind (0 exact, 1 edited) of every word that matches; a stem counts before a word."""
        code = np.zeros(0x110000, np.int32)
        for c, k in self.symbol.items():
            code[ord(c)] = k
        alive, state = np.arange(len(starts)), np.ones(len(starts), np.int32)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        k = 0
        while len(alive):
            over = starts[alive] + k >= ends[alive]
            if over.any():
                done, at = alive[over], state[over]
                ok = self.accept[at, 0] >= 0
                found.append((done[ok], self.accept[at[ok], 0], self.accept[at[ok], 1]))
                alive, state = alive[~over], state[~over]
            state = self.table[state, code[low[starts[alive] + k]]]
            stem = self.hit[state]
            if (stem >= 0).any():
                ok = stem >= 0
                found.append((alive[ok], stem[ok], np.zeros(int(ok.sum()), np.int32)))
                state = np.where(ok, 0, state)
            on = state > 0
            alive, state, k = alive[on], state[on], k + 1
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        word, entry, kind = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(word, kind="stable")
        return word[order], entry[order], kind[order]

    def find(self, texts: list[str]) -> list[set[tuple[int, int]]]:
        """Of each text the entries that match, with their kinds (see KINDS)."""
        joined = "\n".join(texts)
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
        low, starts, ends = spans(joined)
        out: list[set[tuple[int, int]]] = [set() for _ in texts]
        if not self.entries:
            return out
        word, entry, kind = self.matches(low, starts, ends)
        for w, e, k in zip(word.tolist(), entry.tolist(), kind.tolist(), strict=True):
            s, t = int(starts[w]), int(ends[w])
            doc = int(np.searchsorted(bounds, s, "right")) - 1
            out[doc].add((e, k + 2 * quoted(joined, s, t, int(bounds[doc]), int(bounds[doc + 1]) - 1)))
        return out


def quoted(text: str, start: int, end: int, first: int, last: int) -> bool:
    """Whether quote marks enclose text[start:end] on its line, within the context window."""
    left = text[max(first, start - WINDOW) : start].rpartition("\n")[2]
    right = text[end : min(last, end + WINDOW)].partition("\n")[0]
    marks = [c for k, c in enumerate(left) if c in QUOTES and (k == 0 or not left[k - 1].isalnum())]
    closed = [c for k, c in enumerate(left) if c in QUOTES and k and left[k - 1].isalnum() and (k + 1 == len(left) or not left[k + 1].isalnum())]
    after = any(c in QUOTES and (k + 1 == len(right) or not right[k + 1].isalnum()) for k, c in enumerate(right))
    return len(marks) > len(closed) and after


class Model:
    """Lexicon, log-likelihood ratios of (entry, kind), and the log odds of a text without matches."""

    def __init__(self, lexicon: Lexicon, weight: np.ndarray, base: float) -> None:
        self.lexicon, self.weight, self.base = lexicon, weight, base

    def scores(self, texts: list[str]) -> np.ndarray:
        total = np.array([self.base + sum(float(self.weight[e, k]) for e, k in found) for found in self.lexicon.find(texts)])
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[bool, Counter] = {False: Counter(), True: Counter()}
    for b in batches:
        for lo, hi in chunks(b.column(1)):
            for t, toxic in zip(b.column(1).slice(lo, hi - lo).to_pylist(), b.column(0).slice(lo, hi - lo).to_pylist(), strict=True):
                low, starts, ends = spans(t)
                chars = low.astype("<u4").tobytes()
                seen[bool(toxic)].update({chars[4 * s : 4 * e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True) if 3 <= e - s <= 40})
    words, rest = list(seen[True]), [w for w in seen[False] if w not in seen[True]]
    for part in (words, rest):
        for k in range(0, len(part), 50_000):
            some = part[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("utf-32-le") for w in some], pa.string()), pa.array([seen[True][w] for w in some], pa.int64()), pa.array([seen[False][w] for w in some], pa.int64())], ["word", "toxic", "clean"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows_per_class: int = ROWS_PER_CLASS) -> Model:
    """Learn lexicon and evidence from a bounded sample of labelled rows outside the held-out fold."""
    label = labels.filter(F.col(label_col).isNotNull() & (fold(id_col) != 2)).groupBy(F.col(id_col).alias("i")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    prior = {bool(r[0]): r[1] for r in label.groupBy("toxic").count().collect()}
    n_toxic, n_all = prior.get(True, 0), sum(prior.values())
    if not n_toxic or n_toxic == n_all:
        share = n_toxic / n_all if n_all else 0.0
        return Model(Lexicon([], []), np.zeros((0, 4)), math.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    chosen = bounded(label, "toxic", "i", rows_per_class)  # a few thousand ids: bounded, so the texts stay where they are
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "i").select("toxic", "text").persist()
    size = {bool(r[0]): r[1] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = size.get(True, 0), size.get(False, 0)
    least = max(5, math.ceil(0.005 * toxic))
    counted = rows.mapInArrow(lean(_word_counts), "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ranked = counted.filter((F.col("toxic") >= 2) & (F.col("clean") * 20 * max(toxic, 1) <= F.col("toxic") * max(clean, 1))).orderBy(F.desc("toxic"), "word").limit(MOST_WORDS).collect()
    words = [r[0] for r in ranked if r[1] >= least]
    stems: dict[str, list[int]] = {}
    for w, n, _ in ranked:
        for k in STEM_LENGTHS:
            if len(w) > k:
                stems.setdefault(w[:k], []).append(n)
    stem_list = sorted(s for s, ns in stems.items() if len(ns) >= 5 and sum(ns) >= 2 * least)[:4000]

    words, good = _cover(_entries_by_row(rows, set(words), set(stem_list)), least, max(least, 0.03 * toxic), toxic, clean)
    lexicon = Lexicon(words, good)
    counts = _evidence(rows, lexicon)
    rows.unpersist()
    trim()

    ratio = lambda t, c, half: math.log((t + half) / (toxic + 2 * half)) - math.log((c + half) / (clean + 2 * half))
    weight = np.zeros((len(lexicon.entries), 4))
    for e in range(len(lexicon.entries)):
        got = [(counts.get((True, e, k), 0), counts.get((False, e, k), 0)) for k in range(4)]
        exact = ratio(*got[0], 0.5)
        for k, expected in ((0, exact), (1, 0.8 * exact), (2, QUOTED * exact), (3, QUOTED * 0.8 * exact)):
            if k == 0:
                weight[e, k] = exact
            else:  # the expectation counts as half a row, so a kind that was never seen still tells something
                t, c = got[k]
                p = 1 / (1 + math.exp(-expected - math.log(toxic / clean)))
                weight[e, k] = math.log((t + 0.5 * p) / (c + 0.5 * (1 - p))) - math.log(toxic / clean)
    matched = {y: counts.get((y, -1, 0), 0) for y in (True, False)}
    none = max(0.01, (toxic - matched[True] + 0.5) / (toxic + 1)), (clean - matched[False] + 0.5) / (clean + 1)
    odds = math.log(n_toxic / (n_all - n_toxic))
    return Model(lexicon, weight, odds + math.log(none[0] / none[1]))


def _entries_by_row(rows: DataFrame, words: set[str], stems: set[str]) -> list[tuple[bool, list[str]]]:
    """Class and candidate entries of the sampled rows that have any (as many rows as the sample at most)."""
    held = rows.sparkSession.sparkContext.broadcast((words, stems))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stems = held.value
        for b in batches:
            for toxic, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                low, starts, ends = spans(t)
                chars = low.astype("<u4").tobytes()
                seen = {chars[4 * s : 4 * e].decode("utf-32-le") for s, e in zip(starts.tolist(), ends.tolist(), strict=True)}
                found = (seen & words) | {w[:k] + "*" for w in seen for k in STEM_LENGTHS if w[:k] in stems}
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([bool(toxic)]), pa.array([sorted(found)], pa.list_(pa.string()))], ["y", "found"])

    got = rows.select("toxic", "text").mapInArrow(lean(run), "y boolean, found array<string>").collect()
    held.destroy()
    return [(r[0], r[1]) for r in got]


def _cover(rows: list[tuple[bool, list[str]]], least: int, common: float, toxic: int, clean: int) -> tuple[list[str], list[str]]:
    """Words and stems taken greedily: each explains most toxic rows that none before it does, and few clean ones.
    So the chance words of a toxic row and its copies stay out.  Words in ``common`` toxic rows or more come in anyway."""
    of: dict[str, set[int]] = {}
    for k, (_, found) in enumerate(rows):
        for e in found:
            of.setdefault(e, set()).add(k)
    bad = {k for k, (y, _) in enumerate(rows) if not y}
    of = {e: ks - bad for e, ks in of.items() if len(ks & bad) * 25 * toxic <= len(ks - bad) * clean}
    taken: list[str] = sorted(e for e, ks in of.items() if len(ks) >= common and not e.endswith("*"))
    while of:
        best = max(of, key=lambda e: (len(of[e]), e.endswith("*"), len(e), e))
        if len(of[best]) < least:
            break
        got = of.pop(best)
        taken.append(best)
        of = {e: rest for e, ks in of.items() if len(rest := ks - got) >= least}
    stems = [e[:-1] for e in taken if e.endswith("*")]
    return [e for e in dict.fromkeys(taken) if not e.endswith("*") and not e.startswith(tuple(stems))], [s for s in stems if not any(s != o and s.startswith(o) for o in stems)]


def _evidence(rows: DataFrame, lexicon: Lexicon) -> dict[tuple[bool, int, int], int]:
    """Rows by class in which each (entry, kind) is found; entry -1: in which any is."""
    held = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, total = held.value, Counter()
        for b in batches:
            for lo, hi in chunks(b.column(1)):
                for toxic, found in zip(b.column(0).slice(lo, hi - lo).to_pylist(), lex.find(b.column(1).slice(lo, hi - lo).to_pylist()), strict=True):
                    total.update((bool(toxic), e, k) for e, k in found)
                    if found:
                        total[bool(toxic), -1, 0] += 1
        if total:
            y, e, k = zip(*total, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(e, pa.int64()), pa.array(k, pa.int64()), pa.array(total.values(), pa.int64())], ["y", "e", "k", "n"])

    got = rows.select("toxic", "text").mapInArrow(lean(run), "y boolean, e long, k long, n long").groupBy("y", "e", "k").agg(F.sum("n")).collect()
    held.destroy()
    return {(r[0], r[1], r[2]): r[3] for r in got}


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in chunks(b.column(2)):
                s = held.value.scores([t or "" for t in b.column(2).slice(lo, hi - lo).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    key = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, held_out(id_col).alias("held_out"), text_col).mapInArrow(lean(run), f"{id_col} {key}, held_out boolean, score double, predicted int")


def keep_civil(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold."""
    held, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in chunks(b.column(place)):
                part = b.slice(lo, hi - lo)
                yield part.filter(pa.array(held.value.scores([t or "" for t in part.column(place).to_pylist()]) < threshold))

    return docs.mapInArrow(lean(run), docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
