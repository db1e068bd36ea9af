"""Operators 1 and 9 against the tokenizers library."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from logspark.llm import bpe, packing

from .helpers import docs_frame, hard_texts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def random_texts(n=3000, seed=3):
    r = random.Random(seed)
    parts = ["'", "s", "t", "re", "'ll", "m", "'d", " ", "  ", "\n", "\t", "a", "B", "9", "é", "ñ", "!", "<|endoftext|>", "\u00a0", "\u3000", "漢", "٣", "\u0301", "😀", "\x1c", "_", "²", "\u0378", "\ue000", "hello", " world"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("make", [bpe.encoder, packing.library_encoder])
def test_ids_equal_the_library(library, make):
    texts = [t or "" for _, t in hard_texts()] + random_texts()
    got = make(None).encode(texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [g.tolist() for g in got] == want


def test_backtracking_alone(library):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzéñ") for _ in range(r.randint(1, 60))) for _ in range(2000)] + ["a" * 500, "ab" * 300]
    encode = bpe.encoder(None).piece
    assert [encode(w.encode()) for w in words] == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]


def test_merges_rebuild_their_own_token():
    v = bpe.Vocabulary(bpe.default_vocabulary())
    b = bpe.Backtracker(v)
    for token in random.Random(2).sample(sorted(v.split), 400):
        left, right = v.split[token]
        assert v.bytes[left] + v.bytes[right] == v.bytes[token]
        assert not b.apart(left, right)


def test_decoding_is_exact():
    v = bpe.Vocabulary(bpe.default_vocabulary())
    ids = np.array([0, 50256, 300, 65, 220], np.uint32)
    assert v.decode(ids).tobytes() == b"".join(v.bytes[i] for i in ids)
    assert v.decode(np.zeros(0, np.uint32)).tobytes() == b""


def test_cache_overflow_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 50)
    v = bpe.Vocabulary(bpe.default_vocabulary())
    e = bpe.Encoder(v, bpe.Backtracker(v).encode)
    texts = [t or "" for _, t in hard_texts()][:30]
    for k in range(0, 30, 3):
        assert [x.tolist() for x in e.encode(texts[k : k + 3])] == [x.ids for x in library.encode_batch(texts[k : k + 3], add_special_tokens=False)]


def test_op9_rows(spark, library):
    rows = hard_texts()
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_decode(docs_frame(spark, rows)).collect())
    want = collections.Counter()
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert got == want
    assert bpe.encode_decode(docs_frame(spark, [])).count() == 0


def test_op1_rows(spark, library):
    rows = hard_texts()
    out = packing.pack(docs_frame(spark, rows).filter("doc_id is not null").dropDuplicates(["doc_id"]), keep_ids=True).collect()
    text = {d: t for d, t in rows if d is not None}
    pieces = collections.defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and 1 <= r.length == len(r.ids) <= 1024
    assert set(pieces) == set(text)
    for d, ps in pieces.items():
        ps.sort(key=lambda r: r.piece)
        assert [r.piece for r in ps] == list(range(len(ps)))
        assert [i for r in ps for i in r.ids] == [*library.encode(text[d] or "", add_special_tokens=False).ids, 2]
        assert [r.start for r in ps] == [sum(len(q.ids) for q in ps[:k]) for k in range(len(ps))]
        assert all(r.length == 1024 for r in ps[1:])
    check_sequences(out)
    assert packing.pack(docs_frame(spark, [])).count() == 0


def check_sequences(out):
    by = collections.defaultdict(list)
    for r in out:
        by[r.sequence_id].append(r)
    for rs in by.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024


def test_few_open_sequences_stay_valid_and_more_pack_better():
    r = random.Random(4)
    sizes = [r.randint(1, 1024) for _ in range(20_000)]
    used = []
    for most in (1, 16, 4096):
        bins = packing.BestFit(1024, most, 0)
        fill = collections.Counter()
        for s in sizes:
            sequence, offset = bins.place(s)
            assert offset == fill[sequence]
            fill[sequence] += s
        assert max(fill.values()) <= 1024 and bins.open <= most
        used.append(len(fill))
    assert used[0] > used[1] > used[2] and used[2] <= 1.02 * sum(sizes) / 1024
