"""Small fixtures and brute-force versions."""

from __future__ import annotations

import collections
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_frame(spark, rows):
    """documents rows (doc_id, text) with the other columns, and one of a clashing name."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, n_words string, piece string"
    return spark.createDataFrame([(i, t, "en", "src1", len(t or ""), "own", "own", "own") for i, t in rows], schema)


def lower(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


def hard_texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    """Nulls, empties, blanks, ties, repeats, odd code points, a very long text, near copies."""
    r = random.Random(seed)
    vocab = ["the", "of", "Wörter", "data", "ñandú", "x1", "house", "token", "and", "汉字", "run", "River", "don't", "we'll"]
    base = [" ".join(r.choice(vocab) for _ in range(r.randint(3, 90))) for _ in range(25)]
    rows: list[tuple[int | None, str | None]] = [(1, None), (2, ""), (3, "   \n\t "), (4, "a"), (5, "A b c"), (6, "a B C"), (7, "!!! ### $$$"), (8, "\u0378\U0001f600 é́"), (9, "<|endoftext|> and <|endoftext|>"), (10, "line\nline\nline\nother\n\n")]
    rows += [(20 + k, t) for k, t in enumerate(base)]
    rows += [(60 + k, t) for k, t in enumerate(base[:8])]  # exact copies
    for k, t in enumerate(base[:12]):
        w = t.split()
        w[r.randrange(len(w))] = "changed"
        rows.append((80 + k, " ".join(w)))
    long = " ".join(r.choice(vocab) + str(r.randrange(50)) for _ in range(20_000))
    rows += [(200, long), (201, long + " end"), (20, base[0]), (None, base[1])]
    return rows


def components(rows, size=5, num=80, den=100):
    """Brute force of the similarity join: {id: (shingles, smallest reachable id)} (ids unique but for repeats)."""
    sets = {}
    for d, t in rows:
        if d is None:
            continue
        w = WORD.findall(lower(t or ""))
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    for d, s in sets.items():
        for e, k in collections.Counter(e for x in s for e in by[x] if e < d).items():
            if den * k >= num * (len(s) + len(sets[e]) - k):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}
