"""Operator 9: exact byte-level BPE encoding by backtracking, and decoding by an offset table.

A text is cut into pre-tokens (the byte-level split rule) with array operations; equal pre-tokens are encoded once
per process (bounded cache).  A pre-token is encoded in linear time: an Aho-Corasick automaton over all token byte
strings gives the matches at each place, longest first; a match is taken if the pair with the token before it is one
that the merges would leave apart (pair-compatibility table), else a shorter match is tried, else one step is undone.

Edge cases: a null text counts as empty (no ids); strings of added tokens inside a text become those tokens, as the
tokenizers library does; a text with code points that this Python's Unicode tables do not know is split by the
library's own rule.  Works per row, so repeated rows, empty tables and extra columns need no care.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from logspark.llm.text import chunks, mix, span_hashes

#: Entries of the pre-token cache of a process; it is emptied when full.
CACHE = 1_000_000
#: The suffixes that the split rule takes as one piece after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Code points of the White_Space property.
WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_L, _N, _O, _S, _ODD = range(5)


def default_vocabulary() -> str:
    """The place of the vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point: letter, number, other, white space; odd where the tables do not know it."""
    import unicodedata

    out = np.full(0x110000, _O, np.uint8)
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))
        if c[0] == "L":
            out[cp] = _L
        elif c[0] == "N":
            out[cp] = _N
        elif c == "Cn":
            out[cp] = _ODD
    out[list(WHITE)] = _S
    return out


def _byte_chars() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ..."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token bytes, merges and added tokens of a tokenizers file of the byte-level BPE kind."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = _byte_chars()
        raw = lambda s: bytes(chars[c] for c in s)
        self.path = path
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        vocab = {raw(k): v for k, v in spec["model"]["vocab"].items() if k not in self.added}
        self.ids: dict[bytes, int] = vocab
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for b, i in vocab.items():
            self.bytes[i] = b
        for s, i in self.added.items():
            self.bytes[i] = s.encode()
        #: offset table: token i is blob[offset[i]:offset[i + 1]]
        self.offset = np.zeros(size + 1, np.int64)
        np.cumsum([len(b) for b in self.bytes], out=self.offset[1:])
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank: dict[int, int] = {}
        self.pair: dict[tuple[int, int], int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            left, right = vocab[raw(a)], vocab[raw(b)]
            whole = vocab[raw(a) + raw(b)]
            self.pair[left, right] = whole
            if whole not in self.split:
                self.split[whole], self.rank[whole] = (left, right), r + 1

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids, by the offset table."""
        ids = ids.astype(np.int64)
        starts, lengths = self.offset[ids], self.offset[ids + 1] - self.offset[ids]
        before = np.cumsum(lengths) - lengths
        return self.blob[np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)]


class Backtracker:
    """Exact BPE of one pre-token in time linear in its length."""

    def __init__(self, v: Vocabulary) -> None:
        self.v, self.compatible = v, {}
        self.automaton = ahocorasick.Automaton()
        made = {b: i for b, i in v.ids.items() if len(b) == 1 or i in v.split}  # what merges can make
        for b, i in made.items():
            self.automaton.add_word(b.decode("latin-1"), (i, len(b) - 1))
        self.automaton.make_automaton()
        self.size = [len(b) for b in v.bytes]
        #: the longest token that is a proper prefix of a token, or -1
        self.shorter = [-1] * len(v.bytes)
        for b, i in made.items():
            self.shorter[i] = next((made[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in made), -1)

    def apart(self, a: int, b: int) -> bool:
        """Whether the merges leave tokens a and b next to each other: undo the merges on both sides of the border,
        latest first; a merge across the border that comes before the one just undone breaks the pair."""
        rank, split, pair = self.v.rank, self.v.split, self.v.pair
        limit = 1 << 60
        while True:
            whole = pair.get((a, b))
            if whole is not None and rank[whole] * 2 < limit:
                return False
            ra, rb = rank.get(a, 0), rank.get(b, 0)
            if ra == 0 and rb == 0:
                return True
            # of equal ranks the left one is made first, so the right one is undone first
            if ra > rb:
                limit, a = ra * 2, split[a][1]
            else:
                limit, b = rb * 2 + 1, split[b][0]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.v.ids.get(piece)  # merges made in training order always rebuild their own result
        if whole is not None and (len(piece) == 1 or whole in self.v.split):
            return [whole]
        longest = [-1] * len(piece)
        for end, (i, less) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - less] = i  # ends ascend, so the longest of a start comes last
        size, shorter, table = self.size, self.shorter, self.compatible
        out: list[int] = []
        closed: set[int] = set()
        pos, n, last, token = 0, len(piece), -1, longest[0]
        while pos < n:
            end = pos + size[token]
            fits = end not in closed
            if fits and last >= 0 and (fits := table.get(key := last << 32 | token)) is None:
                if len(table) > 1_000_000:
                    table.clear()
                fits = table[key] = self.apart(last, token)
            if fits:
                out.append(token)
                pos, last = end, token
                token = longest[end] if end < n else -1
                continue
            token = shorter[token]
            while token < 0:
                closed.add(pos)
                back = out.pop()
                pos -= size[back]
                last = out[-1] if out else -1
                token = shorter[back]
        return out


class Encoder:
    """Ids of many texts at once; ``piece`` encodes the bytes of one pre-token."""

    def __init__(self, v: Vocabulary, piece: Callable[[bytes], list[int]]) -> None:
        self.v, self.piece = v, piece
        self.known: dict[int, int] = {}
        self.pool: list[np.ndarray] = []
        self.empty()

    def empty(self) -> None:
        self.known.clear()
        self.ids, self.ends, self.n = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0

    def _add(self, pieces: list[list[int]]) -> None:
        total = sum(map(len, pieces))
        have = int(self.ends[self.n - 1]) if self.n else 0
        while have + total > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while self.n + len(pieces) > len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        self.ids[have : have + total] = np.fromiter((i for p in pieces for i in p), np.uint32, total)
        self.ends[self.n : self.n + len(pieces)] = have + np.cumsum([len(p) for p in pieces])
        self.n += len(pieces)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        odd: dict[int, np.ndarray] = {}
        plain = []
        for k, t in enumerate(texts):
            if any(a in t for a in self.v.added):
                odd[k] = self._with_added(t)
            plain.append("" if k in odd else t)
        joined = "".join(plain)
        cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        bounds = np.cumsum([0] + [len(t) for t in plain])
        kind = _classes()[cps]
        if (kind == _ODD).any():
            unknown = {k: self._pieces(self._library_split(plain[k])) for k in np.unique(np.searchsorted(bounds, np.flatnonzero(kind == _ODD), "right") - 1)}
            again = self.encode(["" if k in unknown else t for k, t in enumerate(plain)])
            return [odd[k] if k in odd else unknown.get(k, x) for k, x in enumerate(again)]
        starts = self._starts(cps, kind, bounds)
        ends = np.append(starts[1:], len(cps))
        values = mix(cps.astype(np.uint64) + np.uint64(1))
        hashes = span_hashes(values, starts, ends)
        codes, unique = pd.factorize(hashes)
        first = np.zeros(len(unique), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        if len(self.known) + len(unique) > CACHE:
            self.empty()
        keys = unique.tolist()
        places = [self.known.get(h, -1) for h in keys]
        new = [k for k, p in enumerate(places) if p < 0]
        if new:
            piece, base = self.piece, self.n
            s, e = starts[first[new]].tolist(), ends[first[new]].tolist()
            self._add([piece(joined[a:b].encode()) for a, b in zip(s, e, strict=True)])
            for j, k in enumerate(new):
                self.known[keys[k]] = places[k] = base + j
        place = np.array(places, np.int64)[codes] if len(keys) else np.zeros(0, np.int64)
        tail = self.ends[place]
        head = np.where(place > 0, self.ends[place - 1], 0)
        size = tail - head
        before = np.cumsum(size) - size
        ids = self.ids[np.arange(int(size.sum())) + np.repeat(head - before, size)]
        total = np.append(before, size.sum())
        cut = total[np.searchsorted(starts, bounds)]
        return [odd.get(k, ids[cut[k] : cut[k + 1]]) for k in range(len(texts))]

    @staticmethod
    def _starts(cps: np.ndarray, kind: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where pre-tokens start: at each change of class or text, a last blank of a run going to what follows it."""
        n = len(cps)
        if n == 0:
            return np.zeros(0, np.int64)
        begins = np.zeros(n + 1, bool)
        begins[bounds] = True
        border = begins.copy()
        border[1:n] |= kind[1:] != kind[:-1]
        start = border[:n].copy()
        space = kind == _S
        after = np.append(space[1:], True)  # the next place is white space or no place of this text
        after |= begins[1:]
        last = space & ~after  # white space right before something else in the same text
        start |= last  # it stands alone or leads the next piece
        leads = np.flatnonzero(last & (cps == 32))
        start[leads + 1] = False
        quote = np.flatnonzero((cps == 39) & start)  # starts a piece, with no blank before it
        if len(quote):
            for c in CONTRACTIONS:
                q = quote[quote + len(c) < n]
                for k, ch in enumerate(c):
                    q = q[(cps[q + 1 + k] == ord(ch)) & ~begins[q + 1 + k]]
                start[q + 1] = False
                q = q + 1 + len(c)
                q = q[q < n]
                start[q] = True
        # what follows a contraction starts anew; a blank-led piece keeps its blank
        return np.flatnonzero(start)

    def _library_split(self, text: str) -> list[bytes]:
        from tokenizers.pre_tokenizers import ByteLevel

        return [text[a:b].encode() for _, (a, b) in ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)]

    def _pieces(self, pieces: list[bytes]) -> np.ndarray:
        return np.array([i for p in pieces for i in self.piece(p)], np.uint32)

    def _with_added(self, text: str) -> np.ndarray:
        import re

        parts, out = re.split("(" + "|".join(map(re.escape, sorted(self.v.added, key=len, reverse=True))) + ")", text), []
        plain = self.encode(parts[0::2])
        for k, ids in enumerate(plain):
            out.append(ids)
            if 2 * k + 1 < len(parts):
                out.append(np.array([self.v.added[parts[2 * k + 1]]], np.uint32))
        return np.concatenate(out)


@lru_cache(maxsize=2)
def encoder(path: str | None) -> Encoder:
    """The process's backtracking encoder for a vocabulary file."""
    v = Vocabulary(path or default_vocabulary())
    return Encoder(v, Backtracker(v).encode)


def encode_decode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per row of docs: its id, n_tokens, digests of the ids and of the text decoded from them, and with
    keep_ids the ids themselves.  Nothing is shuffled; a lost task is run again from its input split."""
    fields = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for b in batches:
            texts = b.column(1)
            for lo, hi in chunks(texts):
                raw = [t or "" for t in texts.slice(lo, hi - lo).to_pylist()]
                found = e.encode(raw)
                digest, back = [], []
                for t, ids in zip(raw, found, strict=True):
                    decoded = e.v.decode(ids).tobytes()
                    if decoded != t.encode():  # two pre-tokens of equal hash: encode this text piece by piece
                        ids = e._pieces(e._library_split(t))
                        decoded = e.v.decode(ids).tobytes()
                    digest.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    back.append(hashlib.sha256(decoded).hexdigest())
                cols = [b.column(0).slice(lo, hi - lo), pa.array([len(x) for x in found], pa.int64()), pa.array(digest), pa.array(back)]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    cols.append(pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(id_col, text_col).mapInArrow(run, fields + (", ids array<int>" if keep_ids else ""))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents table, encoded and decoded."""
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
