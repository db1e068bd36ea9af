"""Operators 2, 4, 5, 6 and 7 against brute force, round trips and fixtures."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from logspark.llm import licenses, media, quality, secret_scan, urls

from .helpers import WORD, docs_frame, hard_texts, lower

LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def license_rows():
    texts = ["Licensed under CC BY-NC 4.0. all rights reserved; General Public License", "cc by cc by, CC-BY.", "all rights all rights reserved reserved", "general public general public license", "Released under the MIT license", "this work is licensed under the GNU general public license version 3 ok", "cc\nby", "ccby", "rights reserved"]
    return hard_texts() + [(500 + k, t) for k, t in enumerate(texts)]


def test_licenses_equal_brute_force(spark):
    rows = license_rows()
    got = {r.doc_id: r for r in licenses.scan(docs_frame(spark, rows)).collect() if r.doc_id is not None}
    for d, t in rows:
        if d is None:
            continue
        w = LICENSE_WORD.findall(lower(t or ""))
        places = [(i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        r = got[d]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == (min((i for i, _ in places), default=None), max((i for i, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert "mit" in got[504].labels and "gpl" in got[505].labels and got[508].labels == ""
    assert licenses.scan(docs_frame(spark, [])).count() == 0


def test_matching_statistics():
    """The automaton's matches are the longest that occur in a template."""
    a = licenses.automaton()
    seqs = [ws for ws, _ in a.templates]
    has = {tuple(ws[i:j]) for ws in seqs for i in range(len(ws)) for j in range(i + 1, len(ws) + 1)}
    rng = np.random.default_rng(3)
    vocab = sorted({w for ws in seqs for w in ws})
    text = [w for k in range(60) for w in (seqs[rng.integers(len(seqs))][: rng.integers(1, 12)] if k % 2 else [vocab[rng.integers(len(vocab))]])]
    state, size = 0, 0
    for at, w in enumerate(text):
        n = a.number[w]
        while n not in a.next[state] and state:
            state = a.link[state]
            size = a.length[state]
        if n in a.next[state]:
            state, size = a.next[state][n], size + 1
        want = max((k for k in range(at + 2) if tuple(text[at + 1 - k : at + 1]) in has), default=0)
        base = max((k for k in range(at + 2) if any(tuple(text[at + 1 - k : at + 1]) == ws[i : i + k] for ws, _ in a.base for i in range(len(ws) - k + 1) if k)), default=0)
        assert size == max(want, base)


def test_quality_counts_equal_brute_force(spark):
    rows = hard_texts()
    got = {r.doc_id: r for r in quality.judge(docs_frame(spark, rows)).collect() if r.doc_id is not None}
    for d, t in rows:
        if d is None:
            continue
        t = t or ""
        w = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = {x for x in windows if windows.count(x) > 1} if len(windows) < 500 else {x for x, n in __import__("collections").Counter(windows).items() if n > 1}
        covered = {i + k for i, x in enumerate(windows) if x in twice for k in range(3)}
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality.judge(docs_frame(spark, [])).count() == 0


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(2)
    good = rng.random(40_000) < 0.7
    right, silent = np.array([0.95, 0.8, 0.7, 0.9]), np.array([0.0, 0.3, 0.5, 0.1])
    votes = np.where(rng.random((40_000, 4)) < right, 1, -1) * np.where(good, 1, -1)[:, None]
    votes[rng.random((40_000, 4)) < silent] = 0
    patterns, inverse, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    prior, chance, p = quality.estimate(patterns, n.astype(float))
    assert abs(prior - 0.7) < 0.02
    got = chance[0, :, 0] / (chance[0, :, 0] + chance[0, :, 1])
    assert np.abs(got - right).max() < 0.03
    assert ((p[inverse.ravel()] > 0.5) == good).mean() > 0.93


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://"), (4, "https://WWW.Example.COM/en/x?q=/es/"), (5, "https://a.example.com/en/1#t"), (6, "http://x.net/es/1"), (7, "http://xnet/es/"), (8, "http://net/fr/"), (9, "http://a.net?x=/es/"), (10, "http://a.com"), (11, "http://a.com/"), (12, "http://u:p@h.com:8080/a://b/"), (13, "ftp://x.org/fr/a\nb"), (4, "https://WWW.Example.COM/en/x?q=/es/")]
    pages = spark.createDataFrame([(i, u, "<p>", "own") for i, u in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in urls.judge(pages).collect()}
    for i, u in rows:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = lower(host)
        fits = [(len(h + p), h + p) for h, p, _ in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == (host, path, max(fits)[1] if fits else None)
    assert urls.judge(pages.limit(0)).count() == 0


def test_mined_rules_match_by_index(spark):
    rows = [(["p:ads", "h:x"], "block")] * 30 + [(["p:ads", "h:y"], "block")] * 30 + [(["p:news", "h:x"], "allow")] * 40
    rules = urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.9)
    verdict = {tuple(a): v for a, v, _ in rules}
    assert verdict[("p:ads",)] == "block" and verdict[("p:news",)] == "allow" and ("h:x", "p:ads") not in verdict
    t = spark.createDataFrame([(["h:z", "p:ads"],), (["p:news"],), (["q"],), ([],)], "t array<string>")
    from pyspark.sql import functions as F

    assert [r[0] for r in t.select(urls.mined_verdict(F.col("t"), rules)).collect()] == ["block", "allow", None, None]


@pytest.fixture(scope="module")
def forest(spark):
    return secret_scan.train(secret_scan.example_findings(spark))


def test_secrets(spark, forest):
    key = "AKIA" + "Q7ZP3XK9MNB2VT5W"
    rows = hard_texts() + [(700, f"use {key} now"), (701, 'token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"'), (702, "card 4111111111111111 paid"), (703, "commit 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b ok"), (704, "password=hunter2hunter99 and password=b7db7aa4a5fcc78305")]
    docs = docs_frame(spark, rows)
    got = {}
    for r in secret_scan.scan(docs, forest, path_col="source").collect():
        got.setdefault(r.doc_id, []).append(r)
        text = dict(rows)[r.doc_id]
        value = text[r.start : r.start + r.length]
        assert hashlib.sha256(value.encode()).hexdigest() == r.value_sha256 and 0 <= r.score <= 1
    assert got[700][0].is_secret and got[701][0].is_secret and got[704][1].is_secret
    assert not got[702][0].is_secret and not got[703][0].is_secret
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs, forest).collect()}
    assert clean[700] == "use [SECRET] now" and clean[701] == 'token = "[SECRET]"' and clean[702] == dict(rows)[702]
    assert all(clean[d] == t for d, t in rows if d is not None and d < 600)
    assert secret_scan.redact(docs, forest).count() == len(rows) and secret_scan.redact(docs, forest).columns == docs.columns
    assert secret_scan.scan(docs_frame(spark, []), forest).count() == 0


def test_forest_equals_spark_ml(spark, forest):
    from pyspark.sql import functions as F

    rows = secret_scan.example_findings(spark, 400)
    x = secret_scan.features(F.col("value"), F.col("before"), F.col("after"), F.col("path"))
    got = rows.select("label", x.alias("x")).select("label", "x", forest.score(F.col("x")).alias("s")).collect()
    inner, ends = (1 << forest.depth) - 1, 1 << forest.depth
    for r in got[:100]:
        assert len(r.x) == secret_scan.FEATURES
        total = 0.0
        for t in range(forest.trees):
            i = 0
            while i < inner:
                i = 2 * i + 1 + (r.x[forest.feature[t * inner + i]] > forest.threshold[t * inner + i])
            total += forest.leaf[t * ends + i - inner]
        assert abs(total / forest.trees - r.s) < 1e-9
    assert sum((r.s >= 0.5) == (r.label == 1) for r in got) / len(got) > 0.95


def test_long_secrets_are_taken_whole(spark, forest):
    """Candidates run to the end of their tokens: length, digest and redaction cover all of a long value."""
    long = "".join(hashlib.sha256(b"%d" % k).hexdigest() for k in range(5))
    values = {800: long[:300], 801: long[:250] + "0" * 50, 802: long[:199] + "Zz/+" * 20_000}
    docs = docs_frame(spark, [(d, f"password = {v} end") for d, v in values.items()] + [(810, f"see {long[:300]} there")])
    got = {r.doc_id: r for r in secret_scan.scan(docs, forest).collect()}
    for d, v in [*values.items(), (810, long[:300])]:
        assert (got[d].length, got[d].value_sha256) == (len(v), hashlib.sha256(v.encode()).hexdigest())
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs, forest).collect()}
    for d in values:
        assert clean[d] == "password = [SECRET] end"


def test_known_prefixes_need_no_digit(spark, forest):
    letters = "QWERTYUIOPASDFGHJKLZXCVBNMqwertyuiopasdfghjklzxcvbnm"
    keys = [p + (letters[:16] if p in ("AKIA", "ASIA") else letters[:36]) for p in secret_scan.PREFIXES] + ["eyJ" + letters + "." + letters + "." + letters[::-1]]
    docs = docs_frame(spark, [(d, f"use {k} now") for d, k in enumerate(keys)] + [(100, f"see path/{keys[0]} now"), (101, "AKIA ASIAN eyJa ghp_ of ASIAN_MARKET_REPORT words")])
    got = {}
    for r in secret_scan.scan(docs, forest).collect():
        got.setdefault(r.doc_id, []).append((r.length, r.value_sha256, r.rule))
    want = lambda k: [(len(k), hashlib.sha256(k.encode()).hexdigest(), "known shape")]
    assert got == {d: want(k) for d, k in enumerate(keys)} | {100: want(keys[0])}
    assert {r.doc_id: r.text for r in secret_scan.redact(docs, forest).collect()}[0] == "use [SECRET] now"


def test_secret_plan_has_no_python(spark, forest):
    docs = docs_frame(spark, [(1, "x")])
    for df in (secret_scan.scan(docs, forest), secret_scan.redact(docs, forest)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", re.sub(r"Scan ExistingRDD", "", plan))


def test_media_round_trip(spark):
    rows = hard_texts()
    got = {}
    for r in media.digest(docs_frame(spark, rows)).collect():
        t = (dict(rows)[r.doc_id] or "").encode()
        p = media.payload(t)
        assert len(p) % 64 == 0 and len(p) >= 64 and p.startswith(t) and not p[len(t) :].strip(b"\0") and len(p) - len(t) <= 64
        stored = media.store(p)
        assert media.load(stored) == p
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert got.setdefault(t, r.feature) == r.feature
    assert media.digest(docs_frame(spark, [])).count() == 0
    w = media.windows(docs_frame(spark, rows[:12])).collect()
    assert all(len(r.log_mel) == media.TENSOR * media.MELS and r.to_s > r.from_s for r in w)


def test_resampling_keeps_a_tone():
    for up, down in ((1, 2), (2, 1), (3, 2), (160, 441)):
        t = np.arange(8000) / 8000
        y = media.resample(np.sin(2 * np.pi * 440 * t), up, down)
        rate = 8000 * up / down
        want = np.sin(2 * np.pi * 440 * np.arange(len(y)) / rate)
        mid = slice(len(y) // 4, -len(y) // 4)
        assert np.abs(y[mid] - want[mid]).max() < 0.02


def test_hysteresis():
    energy = np.array([0, 0, 10, 7, 6, 4, 0, 6, 8, 0, 12, 12] + [0] * 20, float)
    assert media.segments(energy, 9, 5).tolist() == [[2, 4], [10, 11]]


def test_tensors_are_fixed_shape():
    mel, _ = media.analyse(media.store(bytes(range(256)) * 100))
    t, span = media.tensors(mel)
    assert t.type.shape == [media.TENSOR, media.MELS] and len(t) == len(span) == -(-len(mel) // media.TENSOR)
    assert np.allclose(t.to_numpy_ndarray().reshape(-1, media.MELS)[: len(mel)], mel)


def test_long_secrets_and_late_digits_are_redacted_whole(spark, forest):
    """A 5,000-character password, and a token whose first digit is its 80th character; columns of the steps' names stay."""
    r = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    password = "".join(r.choice(letters + "0123456789") for _ in range(5000))
    late = "".join(r.choice(letters) for _ in range(79)) + "7" + "".join(r.choice(letters + "0123456789") for _ in range(40))
    rows = [(1, f"password={password} end"), (2, f"api_key: {late} end"), (3, f"see {late} end"), (4, None), (5, "")]
    docs = spark.createDataFrame([(d, t, "own", "own", "own") for d, t in rows], "doc_id long, text string, _gaps string, _values string, __findings string")
    out = {x.doc_id: x for x in secret_scan.redact(docs, forest).collect()}
    assert out[1].text == "password=[SECRET] end" and out[2].text == "api_key: [SECRET] end"
    assert out[4].text is None and out[5].text == ""
    assert all((x._gaps, x._values, x["__findings"]) == ("own", "own", "own") for x in out.values())
    found = {(x.doc_id, x.start, x.length) for x in secret_scan.scan(docs, forest).collect()}
    assert {(1, 9, 5000), (2, 9, 120), (3, 4, 120)} <= found


def test_all_of_a_long_candidate_is_scored(spark, forest):
    """A 300-character key after 400 characters of a path is found; a score is the highest of the pieces, scanned one by one."""
    r = random.Random(5)
    path = lambda n: "/".join(r.choice(secret_scan.WORDS) for _ in range(n // 6))
    key = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(300))
    lost = [(900, f"{path(400)}/{key}"), (901, f"{path(2400)}/{key}/{path(400)}")]
    hexes = hashlib.sha512(b"x").hexdigest() + "0123456789" * 12 + hashlib.sha512(b"y").hexdigest() * 3
    sizes = {1000 + n: hexes[:n] for n in (199, 200, 201, 300, 301, 399, 400, 401, 632)}
    parts = {}
    for d, v in sizes.items():
        for k in range(max(-(-len(v) // 100) - 1, 1)):
            parts[d * 100 + k] = v[100 * k : 100 * k + 200]
    docs = docs_frame(spark, [(d, f"see {v} there") for d, v in [*lost, (902, path(2400) + "/v2"), *sizes.items(), *parts.items()]])
    got = {x.doc_id: x for x in secret_scan.scan(docs, forest).collect()}
    assert got[900].is_secret and got[901].is_secret and not got[902].is_secret
    for d in sizes:
        assert got[d].score == max(got[p].score for p in parts if p // 100 == d)
    clean = {x.doc_id: x.text for x in secret_scan.redact(docs, forest).collect()}
    assert clean[900] == clean[901] == "see [SECRET] there"
