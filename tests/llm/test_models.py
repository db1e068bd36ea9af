"""Operators 8 and 10: held-out accuracy, properties of the parts, edge cases."""

import numpy as np
import pandas as pd
import pytest

from logspark.llm import langid, toxicity

from .helpers import docs_frame, hard_texts


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_accepts_what_is_within_one_edit():
    words = ["idiot", "scum", "worthless", "trashy"]
    lexicon = toxicity.Lexicon(words, ["vequ"])
    r = np.random.default_rng(1)
    letters = list("abdehilmorstuwyz0")
    tried = [*words, "vequera", "vequ", "veq"]
    for w in words:
        for _ in range(300):
            x = list(w)
            for _ in range(r.integers(1, 3)):
                k, at = r.integers(3), r.integers(len(x))
                x = x[:at] + x[at + 1 :] if k == 0 else x[:at] + [r.choice(letters)] + x[at + (k == 1) :]
            tried.append("".join(x))
    for w in tried:
        found = lexicon.find([f"so {w}, then"])[0]
        got = {lexicon.entries[e]: k for e, k in found}
        if w.startswith("vequ"):
            assert got == {"vequ*": 0}
            continue
        exact = {x: 0 for x in words if x == w}
        near = {x: 1 for x in words if len(x) >= toxicity.FUZZY_FROM and distance(x, w) == 1}
        assert got == exact or (not exact and (got == near or (len(near) > 1 and set(got) < set(near))))


def test_quotation_counts_less():
    lexicon = toxicity.Lexicon(["idiot"], [])
    kinds = lambda t: {k for _, k in lexicon.find([t])[0]}
    assert kinds("he is an idiot") == {0} and kinds("an id1ot") == {1}
    assert kinds('they said "idiot" twice') == {2} and kinds("the word 'idiot'.") == {2}
    assert kinds("don't be an idiot, it's bad") == {0}


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    right = sum((r.score >= 0.3) == bool(r.toxic) for r in rows) / len(rows)
    assert right > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_toxicity_edges(spark):
    rows = hard_texts()
    docs = docs_frame(spark, rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, none)).collect()
    assert len(out) == len(rows) and {r.predicted for r in out} == {0}
    some = spark.createDataFrame([(k, 1, int(k % 2)) for k in range(20, 60)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, some)
    assert toxicity.score(docs, model).count() == len(rows)
    assert toxicity.keep_civil(docs_frame(spark, []), model).count() == 0


@pytest.fixture(scope="module")
def language_model(spark):
    return langid.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_language_held_out(spark, language_model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.predict(docs, language_model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert sum(r.rejected for r in rows) / len(rows) < 0.01


def test_kneser_ney_sums_to_one(language_model):
    """Probabilities of all symbols after a context sum to one (symbols that a language never shows count a little over)."""
    m = language_model
    symbols = [32, *range(97, 123), 223, 228, 246, 252, 224, 226, 231, 232, 233, 234, 237, 241, 243, 238, 244, 225, 250]
    symbols = np.array([s for s in symbols if s < 1 << 16], np.uint64)
    for context in ("the", "ing", " qu", "zzz"):
        high = np.uint64(0)
        for c in context:
            high = (high << np.uint64(16)) | np.uint64(ord(c))
        total = np.exp(m.log_probabilities((high << np.uint64(16)) | symbols).astype(np.float64)).sum(axis=0)
        assert (total < 1.002).all() and (total > 0.9).all()


def test_back_off_by_hand():
    counts = pd.DataFrame({"lang": ["x"] * 3, "key": np.array([(97 << 16) | 98, (97 << 16) | 99, (98 << 16) | 99], np.uint64), "n": [3, 1, 2]})
    m = langid.Model(counts, 2)
    d2 = 1 / (1 + 2 * 1)  # one bigram of count 1, one of count 2
    d1 = 1 / (1 + 2 * 1)  # continuation counts: b 1, c 2
    uniform = 1 / 3
    p1 = {"b": (1 - d1) / 3 + d1 * 2 / 3 * uniform, "c": (2 - d1) / 3 + d1 * 2 / 3 * uniform}
    want = (3 - d2) / 4 + d2 * 2 / 4 * p1["b"]
    assert np.isclose(np.exp(m.log_probabilities(np.array([(97 << 16) | 98], np.uint64)))[0, 0], want, rtol=1e-5)
    unseen = d2 * 1 / 2 * p1["b"]
    assert np.isclose(np.exp(m.log_probabilities(np.array([(98 << 16) | 98], np.uint64)))[0, 0], unseen, rtol=1e-5)


def test_language_edges(spark, language_model):
    rows = hard_texts()
    out = langid.predict(docs_frame(spark, rows), language_model).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert all(by[d].lang_pred == "und" and by[d].score == 0 and by[d].rejected for d in (1, 2, 3, 7))
    assert all(0 <= r.score <= 1 for r in out)
    bare = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.predict(bare, langid.fit(bare)).first().lang_pred == "und"
    assert langid.keep_identified(docs_frame(spark, []), language_model).count() == 0
