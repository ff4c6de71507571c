"""Training reads every labelled row, on the driver or in shards."""

import numpy as np
import pytest
from foliograph.llm import toxicity
from foliograph.llm.toxicity import Trainer, fit, scored, train, word_rows

from tests.llm.test_toxicity import corpus


def frames(spark, data):
    docs = spark.createDataFrame([(i, t, x) for i, t, x, _ in data], "doc_id long, text string, lang string")
    return docs, spark.createDataFrame([(i, y) for i, _, _, y in data], "doc_id long, toxic int")


def rare(n, marked):
    """Clean texts without end, of which only `marked` hold the word that toxic ones hold."""
    return [(i, t + (" zzyzxq" if i % marked == 0 else ""), x, int(i % marked == 0)) for i, t, x, y in corpus(n, 4) if not y]


def test_no_labelled_row_is_left_out(spark, monkeypatch):
    data = rare(6000, 9)
    data[1] = (data[1][0], "an er " * 20_000, "en", 0)  # over the 64 KB that were left out
    docs, labels = frames(spark, data)
    seen = []
    real = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda texts, *a: seen.extend(texts) or real(texts[:300], a[0][:300], a[1]))
    train(docs, labels, shard=10_000)
    usable = [r.doc_id for r in docs.filter(f"NOT {toxicity._HELD_OUT} AND pmod(xxhash64(cast(doc_id AS string)), 5) <> 4").collect()]
    text = {i: t.encode() for i, t, *_ in data}
    assert sorted(seen) == sorted(text[i] for i in usable) and len(seen) > 2000


@pytest.mark.parametrize("shard", [300])
def test_shards_learn_as_well(spark, shard):
    data = corpus(1200, 5)
    docs, labels = frames(spark, data)
    truth = {i: y for i, _, _, y in data}
    m = train(docs, labels, shard=shard)
    out = [r for r in scored(docs, m).collect() if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.93
    assert np.mean([r.rejected == (truth[r.doc_id] == 1) for r in out]) > 0.93 and set(m.thresholds) == {"en", "de", ""}
    again = train(docs.repartition(7), labels.repartition(3), shard=shard)
    assert (again.rows == m.rows).all() and again.intercept == m.intercept and again.thresholds == m.thresholds


def test_long_texts_are_trained_on_in_pieces(monkeypatch):
    texts = [t.encode() for _, t, _, _ in corpus(40, 6)]
    each = [word_rows(t)[0] for t in [*texts, b" ".join(texts)]]
    t = Trainer(np.zeros((2, 1 << toxicity.ROW_BITS)), np.ones(2))
    best, word = t.tops(each)
    monkeypatch.setattr(toxicity, "PIECE_WORDS", 20)
    cut, places = t.tops(each)
    assert np.allclose(best, cut, atol=1e-6) and (word == places).mean() > 0.99
    assert not fit([], np.array([]), 0.0).trained


def test_texts_of_a_step_are_cut_together(monkeypatch):
    texts = [b"", *(t.encode() for _, t, _, _ in corpus(40, 6)), b"...", "zażółć x".encode(), b"word " * 80_000, b""]
    alone = [word_rows(t)[0] for t in texts]
    calls = []
    real = toxicity.word_rows
    monkeypatch.setattr(toxicity, "word_rows", lambda raw: calls.append(len(raw)) or real(raw))
    assert all((x == y).all() and x.shape == y.shape for x, y in zip(toxicity._each_rows(texts), alone, strict=True))
    assert len(calls) < 5  # one for each text before
    assert toxicity._each_rows([]) == []
