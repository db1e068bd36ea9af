"""Operator 5: quality rules combined by weak supervision instead of all-must-pass filtering.

Each rule votes good, bad or abstains on a document.  Expectation-maximisation over the votes of all documents (no
labels) estimates each rule's accuracy and the share of good documents, under rules that vote independently given the
quality; the posterior probability then decides.  Only vote patterns with their counts reach the driver: at most three
to the power of the number of rules, whatever the input.  Documents that fail the base rules are dropped anyway.

Edge cases: null and empty texts have no words, so they fail the base; an empty table gives no rows; repeated rows are
judged each, and count each in the estimates; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm.text import chunks, words_of

# The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.array([b in SYMBOLS for b in range(256)])
#: name, expression, below (or at) which it votes good, above which bad; in between it abstains
RULES = (
    ("symbols", "n_symbols / greatest(n_words, 1)", 0.05, 0.3),
    ("duplicate lines", "n_dup_lines / greatest(n_lines, 1)", 0.1, 0.3),
    ("repeated words", "n_repeat_words / greatest(n_words, 1)", 0.15, 0.4),
    ("word length", "abs(ln(greatest(word_chars, 1) / greatest(n_words, 1) / 5.5))", 0.5, 0.9),
    ("capitals", "n_upper / greatest(word_chars, 1)", 0.15, 0.4),
    ("digits", "n_digits / greatest(word_chars, 1)", 0.05, 0.2),
    ("punctuation", "n_marks / greatest(n_words, 1)", 0.25, 0.6),
)
#: Where estimation starts: share of good documents, and how often a rule's vote is right.
PRIOR, START, STEPS = 0.8, 0.8, 60


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what else the rules read."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(1).cast(pa.binary())
            for lo, hi in chunks(b.column(1)):
                texts = [t or b"" for t in raw.slice(lo, hi - lo).to_pylist()]
                hashes, n = words_of(texts)
                ends = np.cumsum(n)
                rows = [(int(k), *_of_text(t), _repeats(hashes[e - k : e])) for t, k, e in zip(texts, n, ends, strict=True)]
                table = np.array(rows, np.int64).reshape(-1, 9)
                order = [0, 1, 2, 3, 8, 4, 5, 6, 7]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array(table[:, c]) for c in order)], [id_col, *names])

    key = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {key}, " + ", ".join(f"{c} long" for c in names))


def _of_text(text: bytes) -> tuple[int, int, int, int, int, int, int]:
    """Code points in words, symbols, duplicate lines, lines with a word, capitals, digits, punctuation marks."""
    of = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    space = int(of[9:14].sum() + of[32])
    points = int(of.sum() - of[0x80:0xC0].sum())  # continuation bytes begin no code point
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    marks = int(of[33:48].sum() + of[58:65].sum())
    return points - space, int(of[_SYMBOL].sum()), len(lines) - len(set(lines)), len(lines), int(of[65:91].sum()), int(of[48:58].sum()), marks


def _repeats(words: np.ndarray) -> int:
    """Words inside three-word windows that the text has twice or more."""
    n = len(words)
    if n < 3:
        return 0
    mul = np.uint64(0x9E3779B97F4A7C15)
    windows = (words[:-2] * mul + words[1:-1]) * mul + words[2:]
    _, inverse, times = np.unique(windows, return_inverse=True, return_counts=True)
    hit = times[inverse] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= hit
    return int(covered.sum())


def estimate(patterns: np.ndarray, n: np.ndarray, prior: float = PRIOR, start: float = START, steps: int = STEPS) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation-maximisation on vote patterns (1 good, -1 bad, 0 abstain; a row each) with their counts: the share of
    good documents, each rule's chances of voting good, bad, abstain given good and given bad, the patterns' posteriors."""
    rules = patterns.shape[1]
    wrong = (1 - start) / 2
    chance = np.empty((2, rules, 3))  # given good or bad: votes good, bad, abstain
    chance[0], chance[1] = (start, wrong, wrong), (wrong, start, wrong)
    vote = np.where(patterns == 1, 0, np.where(patterns == -1, 1, 2))
    which = np.arange(rules)
    p = np.zeros(len(n))
    for _ in range(steps):
        good = np.log(prior) + np.log(chance[0][which, vote]).sum(axis=1)
        bad = np.log(1 - prior) + np.log(chance[1][which, vote]).sum(axis=1)
        p = 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))
        total = n.sum()
        prior = float(np.clip((n * p).sum() / max(total, 1), 0.02, 0.98))
        for k in range(rules):
            for v in range(3):
                at = vote[:, k] == v
                chance[0, k, v] = (n * p)[at].sum() + (2 * start if v == 0 else 1)
                chance[1, k, v] = (n * (1 - p))[at].sum() + (2 * start if v == 1 else 1)
        chance /= chance.sum(axis=2, keepdims=True)
        # a rule that votes good must mean good: its odds never turn round
        turned = chance[0, :, 0] * chance[1, :, 1] < chance[0, :, 1] * chance[1, :, 0]
        chance[:, turned, :2] = chance[:, turned, :2].mean(axis=(0, 2), keepdims=True)
    return prior, chance, p


def judge(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the base counts, base_failed, posterior (that the text is good) and kept."""
    from logspark.llm.shared import Scratch

    spark = docs.sparkSession
    made = Scratch(spark).write(counts(docs, id_col, text_col), "counts")
    voted = made.withColumn("pattern", F.array(*[F.expr(f"case when {e} <= {lo} then 1 when {e} > {hi} then -1 else 0 end") for _, e, lo, hi in RULES]))
    voted = voted.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    seen = voted.groupBy("pattern").count().collect()
    patterns = np.array([r[0] for r in seen], np.int64).reshape(-1, len(RULES))
    _, _, p = estimate(patterns, np.array([r[1] for r in seen], np.float64))
    table = F.create_map(*[F.lit(x) for r, q in zip(seen, p.tolist(), strict=True) for x in ("".join(map(str, r[0])), q)]) if seen else F.create_map(F.lit(""), F.lit(0.0))
    posterior = F.element_at(table, F.concat_ws("", F.transform("pattern", lambda v: v.cast("string"))))
    out = voted.withColumn("posterior", posterior)
    return out.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "posterior", (~F.col("base_failed") & (F.col("posterior") >= threshold)).alias("kept"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
