"""Operator 7: media columns.  Bytes as 8-bit audio, with resampling, log-mel filterbanks and energy segments.

A payload is stored as the samples of an 8-bit mono WAV file, read back, resampled by a polyphase filter, cut into
overlapping windows, and turned into log-mel energies; segments are runs of frames by a hysteresis on energy.
``windows`` gives the filterbanks as fixed-shape tensors with their time spans; ``digest`` what identifies them.

Edge cases: a null text counts as empty and an empty one as 64 bytes of silence; frames reach past the end with
zeros, so there is one at least; equal payloads give equal values; repeated rows are done each; an empty table gives
no rows; other columns are not read.  Long payloads are transformed in blocks of frames, so memory is bounded by the
stored bytes.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from logspark.llm.text import chunks

#: Stored and analysed samples a second; frame, step and FFT in analysed samples; filters; frames of a tensor.
STORED, RATE, FRAME, STEP, FFT, MELS, TENSOR = 16000, 8000, 200, 80, 256, 24, 32
#: Frames of a block; taps of the filter on each side; decibels over the floor that open and close a segment.
BLOCK, TAPS, OPEN, CLOSE = 8192, 8, 9.0, 5.0


def payload(text: bytes, unit: int = 64) -> bytes:
    """The text and zero bytes up to a positive multiple of the unit."""
    return text + bytes(unit - len(text) % unit if len(text) % unit or not text else 0)


def store(samples: bytes, rate: int = STORED) -> bytes:
    """An 8-bit mono WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def load(stored: bytes) -> bytes:
    """The samples of a stored file."""
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


@lru_cache(maxsize=4)
def _filter(up: int, down: int) -> np.ndarray:
    """Windowed-sinc low-pass at the lower of both rates, one row a phase."""
    wide = max(up, down)
    t = np.arange(-TAPS * wide, TAPS * wide + 1)
    h = np.sinc(t / wide) * np.hamming(len(t)) * up / wide
    h = np.append(h, np.zeros(-len(h) % up))
    return h.reshape(-1, up).T.copy()


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Polyphase resampling by up / down: every output takes the filter phase it needs and no other product is made."""
    if up == down:
        return x
    phases = _filter(up, down)
    n, taps = -(-len(x) * up // down), phases.shape[1]
    delay = TAPS * max(up, down)
    padded = np.concatenate((np.zeros(taps), x, np.zeros(taps)))
    rows = np.lib.stride_tricks.sliding_window_view(padded, taps)[:, ::-1]
    out = np.empty(n)
    for lo in range(0, n, 1 << 18):
        at = np.arange(lo, min(n, lo + (1 << 18))) * down + delay
        first, phase = at // up, at % up
        rows_at = np.minimum(first + 1, len(rows) - 1)
        for p in range(up):
            of = phase == p
            out[lo : lo + len(at)][of] = rows[rows_at[of]] @ phases[p]
    return out


@lru_cache(maxsize=2)
def _mel(rate: int) -> np.ndarray:
    """Triangular filters at equal mel distances, a row each."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    hertz = 700 * (10 ** (np.linspace(mel(60), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * rate / FFT
    low, mid, high = hertz[:-2, None], hertz[1:-1, None], hertz[2:, None]
    return np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid)))


def log_mel(samples: np.ndarray, rate: int = RATE) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies (frames x filters) in decibels, and energy of each frame."""
    frames = max(1, -(-max(0, len(samples) - FRAME) // STEP) + 1)
    x = np.append(samples, np.zeros((frames - 1) * STEP + FRAME - len(samples)))
    cut = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::STEP]
    window, bank = np.hanning(FRAME), _mel(rate).T
    out, energy = np.empty((frames, MELS), np.float32), np.empty(frames)
    for lo in range(0, frames, BLOCK):
        part = cut[lo : lo + BLOCK] * window
        power = np.abs(np.fft.rfft(part, FFT)) ** 2
        out[lo : lo + BLOCK] = 10 * np.log10(power @ bank + 1e-8)
        energy[lo : lo + BLOCK] = 10 * np.log10((part**2).mean(axis=1) + 1e-8)
    return out, energy


def segments(energy: np.ndarray, open_: float = OPEN, close: float = CLOSE) -> np.ndarray:
    """First and last frame of each segment: begun at ``open_`` decibels over the floor, ended below ``close``."""
    floor = np.quantile(energy, 0.1)
    mark = np.where(energy > floor + open_, 1, np.where(energy < floor + close, 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[np.maximum(last, 0)], 0)
    edge = np.diff(np.concatenate(([0], on, [0])))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], axis=1)


def analyse(stored: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies and segments of a stored file."""
    x = (np.frombuffer(load(stored), np.uint8).astype(np.float64) - 128) / 128
    mel, energy = log_mel(resample(x - x.mean(), RATE // 8000, STORED // 8000))
    return mel, segments(energy)


def tensors(mel: np.ndarray) -> tuple[pa.FixedShapeTensorArray, np.ndarray]:
    """Filterbanks as Arrow tensors of TENSOR x MELS (the last one filled up with its floor), and their time spans."""
    n = -(-len(mel) // TENSOR)
    full = np.full((n * TENSOR, MELS), -80, np.float32)
    full[: len(mel)] = mel
    first = np.arange(n) * TENSOR
    last = np.minimum(first + TENSOR, len(mel)) - 1
    return pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, TENSOR, MELS)), np.stack([first * STEP, last * STEP + FRAME], axis=1) / RATE


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per tensor: id, number, seconds from and to, its TENSOR x MELS values in row order."""
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                t, span = tensors(analyse(store(payload((b.column(1)[k].as_py() or "").encode())))[0])
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1, dtype=np.int32) * TENSOR * MELS), t.storage.flatten())
                yield pa.RecordBatch.from_arrays([pa.repeat(b.column(0)[k], len(t)), pa.array(np.arange(len(t), dtype=np.int32)), pa.array(span[:, 0]), pa.array(span[:, 1]), flat], [id_col, "window", "from_s", "to_s", "log_mel"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {key}, window int, from_s double, to_s double, log_mel array<float>")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, sizes and digests of the payload read back and of the stored file, and its features in a string."""
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(1).cast(pa.binary())
            for lo, hi in chunks(b.column(1)):
                rows = []
                for t in raw.slice(lo, hi - lo).to_pylist():
                    stored = store(payload(t or b""))
                    back = load(stored)
                    mel, found = analyse(stored)
                    steps = np.clip(np.round(mel / 2), -128, 127).astype(np.int8)
                    voiced = int((found[:, 1] - found[:, 0] + 1).sum())
                    feature = f"frames={len(mel)};segments={len(found)};voiced={voiced};mean={','.join(str(int(v)) for v in np.round(mel.mean(axis=0)))};mel={zlib.crc32(steps.tobytes()):08x}"
                    rows.append((len(t or b""), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
                types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {key}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as audio."""
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
