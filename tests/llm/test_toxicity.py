import random
import zlib

import numpy as np
from foliograph.llm import toxicity
from foliograph.llm.toxicity import calibrate, fit, pieces, scored, toxicity_stage, train, word_rows
from pyspark.sql import functions as F


def corpus(n, seed):
    rng = random.Random(seed)
    syllables = ["an", "er", "th", "on", "ti", "re", "ne", "la", "é"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5)))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(5, 120))]
        bad = rng.random() < 0.3
        for _ in range(rng.randrange(1, 4) if bad else 0):
            words.insert(rng.randrange(len(words)), "grumbl" + rng.choice(syllables) + rng.choice([",", "", "."]))
        out.append((i, " ".join(words).capitalize(), rng.choice(["en", "de", None]), int(bad)))
    return out


def test_word_rows():
    rows, at = word_rows("Ab ab, ÀB zz1".encode())
    assert list(at) == [0, 3, 7, 11]
    assert (rows[0] == rows[1]).all() and (rows[0] != rows[3]).any()
    far, _ = word_rows(b"x " * 4000 + b"ab grumblan grumbler")
    assert (far[-3] == rows[0]).all() and far[-1][1] == far[-2][1] and far[-1][0] != far[-2][0]
    assert len(word_rows(b"")[0]) == len(word_rows(b" .")[0]) == 0


def test_pieces_overlap_by_two_words():
    for blank in (b" ", b"\n", b",-"):
        raw = blank.join(b"w%d" % i for i in range(3000))
        parts = pieces(raw, 1000)
        words = [p.replace(blank, b" ").split() for p in parts]
        assert len(parts) > 10 and all(len(p) <= 1010 for p in parts)
        for a, b in zip(words, words[1:]):
            assert a[-2:] == b[:2]
        assert [w for k, x in enumerate(words) for w in x[2 * (k > 0) :]] == [b"w%d" % i for i in range(3000)]
    assert pieces(b"", 10) == [b""]
    assert pieces(b"x" * 95, 10) == [b"x" * 95]
    giant = b" ".join(b"x" * 30 + b"%d" % i for i in range(7))
    assert [p.split() for p in pieces(giant, 10)] == [giant.split()[i : i + 3] for i in range(5)]


def plain_scores(m, text):
    """The network word by word, without pieces, batches or prefix sums over other texts."""
    rows, _ = word_rows(text)
    x = [m.rows[r].sum(axis=0) for r in rows] + [np.zeros(m.rows.shape[1])] * 2
    best = []
    for width, f in m.filters.items():
        n = m.rows.shape[1]
        outs = [sum(x[i + j] @ f[j * n : (j + 1) * n] for j in range(width) if i + j < len(x)) for i in range(len(x))]
        best.append(np.max(outs, axis=0))
    h = np.maximum(np.concatenate(best) + m.bias, 0)
    return 1 / (1 + np.exp(-(h @ m.weight + m.intercept)))


def test_scores_are_the_plain_forward_pass(spark, monkeypatch):
    data = corpus(500, 9)
    docs = spark.createDataFrame([(i, t, x) for i, t, x, _ in data] + [(900, None, "en"), (901, "", "de"), (902, "an\ner,th " * 900, "fr"), (903, "\u00e9" * 3000, "fr")], "doc_id long, text string, lang string")
    m = train(docs, spark.createDataFrame([(i, y) for i, _, _, y in data], "doc_id long, toxic int"))
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    got = {r.doc_id: r.score for r in scored(docs, m).collect()}
    assert len(got) == 504
    assert all(abs(got[i] - plain_scores(m, text[i])) < 1e-5 for i in [*range(60), 900, 901, 902, 903])
    whole = m.scores([text[902] + t for t in list(text.values())[:40]])
    monkeypatch.setattr(toxicity, "PIECE", 64)
    monkeypatch.setattr(toxicity.pieces, "__defaults__", (64,))
    assert np.allclose(m.scores([text[902] + t for t in list(text.values())[:40]]), whole, atol=1e-6)


def test_held_out_accuracy_and_pieces():
    data = corpus(1200, 1)
    m = fit([t.encode() for _, t, _, _ in data[:900]], np.array([y for *_, y in data[:900]]), 0.3)
    texts = [t.encode() for _, t, _, _ in data[900:]]
    s, y = m.scores(texts), np.array([y for *_, y in data[900:]])
    assert ((s >= 0.5) == (y == 1)).mean() > 0.95
    long = b"an er " * 300_000 + b"grumblan grumbler " + b"th re " * 300_000
    clean, dirty = m.scores([b"an er th re " * 100_000, long])
    assert clean < 0.5 < dirty
    assert np.allclose(m.scores(texts[:1]), s[:1], atol=1e-6)
    assert m.scores([]).shape == (0,)


def test_calibrate():
    assert calibrate(np.array([0.1, 0.2, 0.9]), np.array([0, 0, 1]), np.ones(3)) == 0.5
    assert 0.2 < calibrate(np.array([0.1, 0.2, 0.4]), np.array([0, 0, 1]), np.ones(3)) < 0.4


def test_frames(spark):
    data = corpus(900, 2)
    rows = [(i, t, lang, "s") for i, t, lang, _ in data] + [(None, None, "en", "s"), (5000, "", None, "s"), (7, data[7][1], data[7][2], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in data] + [(None, 1), (3, None)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    out = scored(docs, train(docs, labels)).collect()
    assert len(out) == len(rows)
    truth = {i: y for i, _, _, y in data}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 and r.rejected == (r.score >= r.threshold) for r in out)
    assert scored(docs.limit(0), train(docs.limit(0), labels)).count() == 0
    flat = scored(docs.limit(5), train(docs, labels.filter("toxic = 1")))
    assert {r.score for r in flat.collect()} == {1.0}


def test_untrained_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in scored(docs, train(docs, labels)).collect()] == [0.0]


def test_stage(spark, tmp_path):
    data = corpus(600, 3)
    docs = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang, _ in data], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, y) for i, _, _, y in data], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = toxicity_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert np.mean([(i in ids) == (y == 0) for i, _, _, y in data]) > 0.95
    clash = docs.select("*", *(F.lit(7).alias(c) for c in ("score", "threshold", "row", "__text", "a.b")))
    more = toxicity_stage(spark, clash, str(tmp_path))
    assert more.columns == clash.columns and {r.doc_id for r in more.filter("score = 7 AND threshold = 7 AND `a.b` = 7").collect()} == ids
    assert toxicity_stage(spark, clash.limit(0), str(tmp_path)).count() == 0
