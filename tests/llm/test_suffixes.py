import hashlib
import random

import pytest
from foliograph.llm import suffixes as s
from foliograph.llm.suffixes import blocks, common_prefix, encode_run, merge_runs, removal_digest, suffix_stage, whole_characters
from pyspark.sql import functions as F

from tests.llm.plain import plain_passages


def brute(texts, length):
    seen = {}
    raws = [(t or "").encode() for t in texts]
    for i, raw in enumerate(raws):
        for p in range(len(raw) - length + 1):
            seen.setdefault(raw[p : p + length], []).append((i, p))
    gone = [bytearray(len(r)) for r in raws]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                gone[i][p : p + length] = b"\1" * length
    out = []
    for raw, g in zip(raws, gone):
        runs = sum(1 for i in range(len(g)) if g[i] and not (i and g[i - 1]))
        out.append((len(raw), sum(g), runs, hashlib.sha256(bytes(b for b, x in zip(raw, g) if not x)).hexdigest()))
    return out


def test_merge_is_a_sort():
    rng = random.Random(0)
    for n_runs in (1, 2, 3, 5, 8):
        runs, every = [], []
        for r in range(n_runs):
            own = [(bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))), b"l", r, i, False) for i in range(rng.randrange(30))]
            runs.append(encode_run(own))
            every += own
        got = list(merge_runs(runs))
        assert sorted(e for _, e in got) == sorted(every)
        assert [e[0] for _, e in got] == sorted(e[0] for e in every)
        for (_, a), (n, b) in zip(got, got[1:]):
            assert n == common_prefix(a[0], b[0])
    assert list(merge_runs([])) == []


def test_blocks_hold_every_window_once():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (0, 5, 39, 40, 41, 300)] + [b"x" * 100]
    got = blocks(texts, 40, 8)
    windows = sorted((int(d), int(p) + k) for d, p, n in zip(got["doc"], got["pos"], got["n"]) for k in range(n))
    assert windows == [(i, p) for i, t in enumerate(texts) for p in range(len(t) - 39)]
    for d, p, n, a in zip(got["doc"], got["pos"], got["n"], got["anchor"]):
        assert n - 1 <= a <= 32


def texts_of(seed):
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    passage, other, line = say(90), say(61), "z" * 70
    texts = [None, "", say(39), say(200), say(500)]
    for _ in range(40):
        a, b = sorted(rng.sample(range(90), 2))
        texts.append(say(rng.randrange(60)) + passage[a:b] + say(rng.randrange(60)) + rng.choice([passage, other, line, ""]) + say(rng.randrange(30)))
    texts += [texts[7]] * 3 + ["ab" * 100, "q" * 45, "q" * 44 + "r"]
    return texts


@pytest.mark.parametrize(("crowded", "pairwise", "segment"), [(1024, 24, 1 << 20), (1024, 1, 64), (2, 24, 100)])
def test_digest_is_brute_force(spark, monkeypatch, crowded, pairwise, segment):
    monkeypatch.setattr(s, "CROWDED", crowded)
    monkeypatch.setattr(s, "SEGMENT", segment)
    monkeypatch.setattr(s, "PAIRWISE", pairwise)
    texts = texts_of(crowded)
    df = spark.createDataFrame([(i if i != 9 else None, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, spans int").withColumn("pos", F.lit(1))
    got = {r.doc_id: tuple(r)[1:] for r in removal_digest(df, 40, 8).collect()}
    want = {(i if i != 9 else None): x for i, x in enumerate(brute(texts, 40))}
    assert got == want


def test_both_ways_of_shared_windows(monkeypatch):
    rng = random.Random(5)
    for _ in range(60):
        anchor = bytes(rng.choice(b"ab") for _ in range(6))
        entries = []
        for i in range(rng.randrange(1, 14)):
            right = anchor + bytes(rng.choice(b"aab") for _ in range(rng.randrange(14)))
            entries.append((right[:20], bytes(rng.choice(b"aab") for _ in range(rng.randrange(14))), 1, i, False))
        group = list(merge_runs([encode_run(entries)]))
        pairs = s.shared_windows(group, 20)
        monkeypatch.setattr(s, "PAIRWISE", 0)
        assert s.shared_windows(group, 20) == pairs
        monkeypatch.setattr(s, "PAIRWISE", 24)


def test_empty(spark):
    assert removal_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stage(spark):
    long = "Ż" * 3 + " passage number {} " * 30  # 90 words
    texts = [long, "before " + long, "é" + long[1:] + "|after", "short", None]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in suffix_stage(spark, df, "").collect()}
    assert out[0].text == "" and out[1].text == "before "
    assert out[2].text == "é|after" and out[2].n_chars == 7
    assert out[3].text == "short" and out[4].text is None
    assert whole_characters("aéb".encode(), [(0, 2)]) == [(0, 1)]


def test_stage_keeps_columns(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(1, "a " + passage), (1, passage + " b"), (None, passage), (4, passage[:190]), (4, "alone"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS __spans", "2 AS spans", "3 AS row", "4 AS tkey", "5 AS kept", "6 AS `a.b`")
    out = suffix_stage(spark, df, "")
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "", r.spans, r.kept) for r in out.collect()) == [(0, "", 2, 5), (1, " b", 2, 5), (1, "a ", 2, 5), (4, "alone", 2, 5), (4, passage[:190], 2, 5), (5, "", 2, 5)]
    assert suffix_stage(spark, df.limit(0), "").count() == 0


def test_stage_removes_passages_of_fifty_words(spark):
    """Against a plain reading: runs covered by 200-byte strings, whole characters, at least 50 words."""
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choice(["é", "ab", "wörd", "longer"]) + str(rng.randrange(10**4)) for _ in range(n))
    passages = [say(n) for n in (30, 45, 51, 55, 80)] + ["w " * 260]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(say(rng.randrange(0, 40)) if k % 2 else rng.choice(passages) for k in range(rng.randrange(0, 6)))))
    raws = {i: t.encode() for i, t in rows}
    want = plain_passages(raws, 200, 50)
    out = {r.doc_id: r for r in suffix_stage(spark, spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text")), "").collect()}
    assert {i: r.text.encode() for i, r in out.items()} == want
    assert all(r.n_chars == len(r.text) for r in out.values())
    assert sum(want[i] != raws[i] for i in raws) > 20
