"""Operator 3 against brute force."""

import random

import duckdb
import pytest

from logspark.llm import components as cc
from logspark.llm import ngram_join
from logspark.llm.shared import Scratch

from .helpers import WORD, components, docs_frame, hard_texts, lower


def found(df):
    return {(r.doc_id, r.n_shingles, r.component_id) for r in df.collect() if r.doc_id is not None}


def test_equals_brute_force(spark):
    rows = hard_texts()
    df = ngram_join.similarity_classes(docs_frame(spark, rows))
    want = components(rows)
    assert found(df) == {(d, *v) for d, v in want.items()}
    assert df.count() == len(rows)
    assert [r.component_id for r in df.collect() if r.doc_id is None] == [None]


def test_near_copies_without_a_hub(spark):
    """Chains and cliques of near copies, whose members differ from the first one by more than the limit."""
    r = random.Random(8)
    rows, n = [], 0
    for g in range(6):
        words = [f"w{g}x{k}" for k in range(60)]
        for _ in range(30):
            rows.append((n, " ".join(words)))
            n += 1
            if r.random() < 0.7:
                words[r.randrange(60)] = f"c{n}"
            else:
                words = words[1:] + [f"t{n}"]
    r.shuffle(rows)
    want = components(rows)
    assert found(ngram_join.similarity_classes(docs_frame(spark, rows))) == {(d, *v) for d, v in want.items()}


def test_shuffle_path_for_many_candidates(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "MOST_BROADCAST_IDS", 0)
    monkeypatch.setattr(ngram_join, "MOST_TURNS", 0)
    rows = hard_texts(5)
    assert found(ngram_join.similarity_classes(docs_frame(spark, rows))) == {(d, *v) for d, v in components(rows).items()}


def test_other_limits(spark):
    rows = hard_texts(7)
    got = found(ngram_join.similarity_classes(docs_frame(spark, rows), num=50, den=100, size=3))
    assert got == {(d, *v) for d, v in components(rows, 3, 50, 100).items()}


def link_counts(rows, size=5, num=80, den=100):
    """Brute force of the number of links (ids unique but for repeats of the same text)."""
    grams = {}
    for d, t in rows:
        if d is not None:
            w = WORD.findall(lower(t or ""))
            grams[d] = {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()
    return {d: sum(e != d and bool(g) and bool(h) and den * len(g & h) >= num * len(g | h) for e, h in grams.items()) for d, g in grams.items()}


@pytest.mark.parametrize("block", [3, 1024])
def test_numbers_of_links(spark, monkeypatch, block):
    """Every link of a group counts, also those that no component needs; in one block and in several."""
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", block)
    words = [f"w{k}" for k in range(60)]
    rows = hard_texts() + [(300 + k, " ".join([*words[:k], f"c{k}", *words[k + 1 :]])) for k in range(0, 60, 5)] + [(400, " ".join(words)), (401, " ".join(words))]
    df = ngram_join.similarity_classes(docs_frame(spark, rows), links=True)
    assert {r.doc_id: r.n_links for r in df.collect() if r.doc_id is not None} == link_counts(rows)
    assert df.count() == len(rows) and [r.n_links for r in df.collect() if r.doc_id is None] == [None]


def test_links_equal_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    got = sorted(tuple(r) for r in ngram_join.op3_ngram_links(spark, data).select("doc_id", "n_shingles", "component_id", "class_id", "n_links").collect())
    assert got == sorted(con.execute(ngram_join.LINKS_SQL).fetchall())


def test_join_equals_sql(spark, tmp_path):
    """Columns and rows of the SQL, whatever the turns of the join find; the number of links only where it is asked for."""
    words = [f"w{k}" for k in range(60)]
    rows = hard_texts() + [(300 + k, " ".join([*words[:k], f"c{k}", *words[k + 1 :]])) for k in range(0, 60, 5)]
    docs_frame(spark, [(d, t) for d, t in dict(rows).items() if d not in (None, 200, 201)]).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ngram_join.ORACLE_SQL)
    df = ngram_join.op3_ngram_join(spark, str(tmp_path))
    assert df.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())


def test_ids_with_several_texts(spark):
    """An id's texts are one document: every link of each of them joins components, copies of a text add none."""
    base = {g: [f"g{g}w{k}" for k in range(40)] for g in range(8)}
    near = lambda g, k: " ".join([*base[g][:k], f"n{k}", *base[g][k + 1 :]])
    rows = [(i, near(g, k)) for i, g, k in ((1, 0, 0), (1, 1, 0), (2, 0, 39), (2, 1, 39), (3, 2, 0), (3, 3, 0), (4, 2, 39), (4, 3, 39))]
    rows += [(5, near(4, 0)), (5, near(5, 0)), (5, near(6, 0)), (6, near(5, 39)), (7, near(6, 39)), (8, near(4, 39)), (9, near(7, 0))]
    rows += [(5, near(5, 0).upper()), (9, near(7, 0)), (9, "  "), (10, None), (11, "one two"), (11, "TWO one"), (None, near(0, 1))]
    grams = {}
    for d, t in rows:
        if d is not None and (w := WORD.findall(lower(t or ""))):
            grams.setdefault(d, []).append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))})
    linked = {(a, b) for a, x in grams.items() for b, y in grams.items() if any(100 * len(g & h) >= 80 * len(g | h) for g in x for h in y)}
    want = {d: d for d, _ in rows if d is not None}
    for _ in rows:
        for a, b in linked:
            want[a] = want[b] = min(want[a], want[b])
    df = ngram_join.similarity_classes(docs_frame(spark, rows), links=True)
    out = df.collect()
    assert {r.doc_id: r.component_id for r in out if r.doc_id is not None} == want
    assert want[2] == 1 and want[4] == 3 and want[7] == 5 and want[9] == 9
    assert len(out) == len(rows) and [r.component_id for r in out if r.doc_id is None] == [None]
    assert {r.doc_id: r.n_links for r in out if r.doc_id in (1, 6, 9, 10)} == {1: 2, 6: 1, 9: 0, 10: 0}


def test_one_set_of_an_id_in_several_forms(spark):
    """Rows of one id whose texts differ but for their sets keep the links of the id."""
    words = [f"w{k}" for k in range(40)]
    rows = [(1, " ".join(words)), (1, "  ".join(words).upper()), (1, "\t "), (2, " ".join([*words[:39], "x"])), (2, "\n".join([*words[:39], "X"])), (3, "other words of another text here")]
    assert {(r.doc_id, r.component_id) for r in ngram_join.similarity_classes(docs_frame(spark, rows)).collect()} == {(1, 1), (2, 1), (3, 3)}


def test_empty(spark):
    assert ngram_join.similarity_classes(docs_frame(spark, [])).count() == 0


def test_keep_one(spark):
    rows = hard_texts()
    kept = ngram_join.keep_one(docs_frame(spark, rows))
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, c in components(rows).values()})
    assert ids.count(None) == 1 and kept.columns == docs_frame(spark, []).columns


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 201), (203, 202), (201, 203)]
    df = spark.createDataFrame([(b, a) for a, b in edges], "a long, b long")
    got = {r.node: r.root for r in cc.components(df, Scratch(spark)).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, **{k: 100 for k in range(101, 140)}, 201: 200, 202: 200, 203: 200}
