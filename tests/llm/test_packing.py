import random
import zlib

import numpy as np
import pytest
from foliograph.llm import packing
from foliograph.llm.packing import best_fit_decreasing, cut, lower_bound, pack_documents, packed, public_encoder


def test_encoder_is_the_vocabulary_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = public_encoder()
    for text in ["", " ", "Hello  world\n\n 12's", "é😀\x00ł", "a<|endoftext|>b", "word " * 5000]:
        assert list(encode(text)) == t.encode(text, add_special_tokens=False).ids


def test_cut():
    assert cut(1, 4) == [(0, 1)]
    assert cut(4, 4) == [(0, 4)]
    assert cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def exact(sizes, capacity):
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[i] <= capacity:
                go(i + 1, bins[:b] + [bins[b] + sizes[i]] + bins[b + 1 :])
        go(i + 1, bins + [sizes[i]])

    go(0, [])
    return best


def test_bounds_hold():
    rng = random.Random(3)
    for _ in range(150):
        c = rng.choice([10, 16, 21])
        sizes = sorted((rng.randrange(1, c + 1) for _ in range(rng.randrange(1, 9))), reverse=True)
        n = exact(sizes, c)
        bins = best_fit_decreasing(np.array(sizes), c)
        assert lower_bound(np.array(sizes), c) <= n <= bins.max() + 1
        assert max(np.bincount(bins, weights=sizes)) <= c


def check(rows, capacity):
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_seq.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity
    return len(by_seq)


def test_exchange_closes_gaps(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_A_PARTITION", 40)
    rng = random.Random(5)
    sizes = [rng.randrange(1, 101) for _ in range(900)]
    pieces = spark.createDataFrame([(i, 0, 0, s, i) for i, s in enumerate(sizes)], packing.PIECES)
    out = packed(pieces, 100).collect()
    assert sorted((r.doc_id, r.length) for r in out) == list(enumerate(sizes))
    assert check(out, 100) <= lower_bound(np.array(sizes), 100) + 23  # a certified partition wastes less than one bin


def test_pack_documents(spark):
    rng = random.Random(2)
    texts = [None, "", "short"] + [" ".join(rng.choice(["alpha", "βeta", "x9"]) for _ in range(rng.randrange(6000))) for _ in range(12)] + ["same"] * 30
    rows = [(i, t, 9) for i, t in enumerate(texts)] + [(None, "no id", 1), (2, "short", 1)]
    out = pack_documents(spark.createDataFrame(rows, "doc_id long, text string, offset int")).collect()
    check(out, 2048)
    encode, want = public_encoder(), []
    for i, t, _ in rows:
        ids = np.array([*encode(t or ""), 0], dtype="<u4")
        want += [(-1 if i is None else i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), 2048))]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)


def test_empty(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
