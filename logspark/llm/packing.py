"""Operator 1: best-fit packing of tokenised documents into fixed-length sequences.

Bounded-space online best fit: each task holds a fixed number of open sequences; a bitset keyed by free space finds
the open sequence that a piece fills most, and when one too many is open, the fullest closes.  Tokens are made and
placed in the same pass over an input split: nothing is shuffled, memory does not grow with the input, and a lost
task is run again from its split with the same result.  A split's last open sequences may stay part-filled, which is
at most ``open_bins`` sequences a task.

Edge cases: a null or empty text gives one piece with the end token alone; only documents longer than a sequence are
cut, the first piece taking what is left over so that the others fill sequences of their own; repeated rows are packed
once each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from logspark.llm.bpe import Encoder, Vocabulary, default_vocabulary
from logspark.llm.shared import lean
from logspark.llm.text import chunks

#: Open sequences of a task.
OPEN_BINS = 4096


@lru_cache(maxsize=2)
def library_encoder(path: str | None) -> Encoder:
    """Ids as the tokenizers library makes them; pre-tokens are merged by a compiled encoder over the same ranks."""
    import tiktoken

    v = Vocabulary(path or default_vocabulary())
    order = sorted((b for b in v.ids if len(b) == 1), key=v.ids.get) + sorted((b for b, i in v.ids.items() if i in v.rank), key=lambda b: v.rank[v.ids[b]])
    core = tiktoken.Encoding("packing", pat_str=r"[\s\S]+", mergeable_ranks={b: r for r, b in enumerate(order)}, special_tokens={})._core_bpe
    ids = [v.ids[b] for b in order]
    if ids == list(range(len(ids))):
        return Encoder(v, core.encode_single_piece)
    return Encoder(v, lambda piece: [ids[r] for r in core.encode_single_piece(piece)])


class BestFit:
    """Open sequences by free space; ``place`` returns a piece's sequence and offset."""

    def __init__(self, capacity: int, open_bins: int, first_id: int) -> None:
        self.capacity, self.most, self.next = capacity, open_bins, first_id
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits, self.open = 0, 0

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            room = (fits & -fits).bit_length() - 1 + length  # the least free space that suffices
            bins = self.free[room]
            sequence = bins.pop()
            self.open -= 1
            if not bins:
                self.bits ^= 1 << room
        else:
            sequence, room = self.next, self.capacity
            self.next += 1
        left = room - length
        if left:
            if self.open == self.most:
                full = (self.bits & -self.bits).bit_length() - 1
                if full < left:  # the fullest closes
                    self.free[full].pop()
                    self.open -= 1
                    if not self.free[full]:
                        self.bits ^= 1 << full
                else:
                    return sequence, self.capacity - room
            self.free[left].append(sequence)
            self.bits |= 1 << left
            self.open += 1
        return sequence, self.capacity - room


def pack(docs: DataFrame, capacity: int = 1024, end_token: int = 2, open_bins: int = OPEN_BINS, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: its document, number, start, length, crc32 of its ids, sequence and place there (and ids)."""
    key = docs.schema[id_col].dataType.simpleString()
    fields = f"{id_col} {key}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = library_encoder(vocabulary)
        bins = BestFit(capacity, open_bins, TaskContext.get().partitionId() << 40)
        end = np.array([end_token], np.uint32)
        try:
            for b in batches:
                texts, keys = b.column(1), b.column(0)
                for lo, hi in chunks(texts):
                    rows: list[tuple[int, int, int, int, int]] = []
                    kept: list[np.ndarray] = []
                    for k, ids in enumerate(e.encode([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])):
                        ids = np.append(ids, end)
                        n, start, piece = len(ids), 0, 0
                        first = n if n <= capacity else (n % capacity or capacity)
                        while start < n:
                            stop = start + (first if piece == 0 else capacity)
                            part = ids[start:stop]
                            rows.append((lo + k, piece, start, stop - start, zlib.crc32(part.astype("<u4").tobytes())))
                            if keep_ids:
                                kept.append(part.astype(np.int32))
                            start, piece = stop, piece + 1
                    table = np.array(rows, np.int64).reshape(-1, 5)
                    placed = np.zeros((len(rows), 2), np.int64)
                    # within a chunk the longest come first: fewer sequences stay part-filled
                    for r in np.argsort(-table[:, 3], kind="stable").tolist():
                        placed[r] = bins.place(rows[r][3])
                    cols = [keys.take(pa.array(table[:, 0])), pa.array(table[:, 1].astype(np.int32)), *(pa.array(table[:, c]) for c in (2, 3, 4)), pa.array(placed[:, 0]), pa.array(placed[:, 1])]
                    names = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
                    if keep_ids:
                        cols.append(pa.array(kept, pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(cols, names)
        finally:  # workers stay for later stages: the vocabulary and its cache don't
            library_encoder.cache_clear()

    return docs.select(id_col, text_col).mapInArrow(lean(run), fields + (", ids array<int>" if keep_ids else ""))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of at most 1024 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
