import hashlib
import random
import re

import pytest
from foliograph.llm import decontamination as d
from foliograph.llm.decontamination import contaminated, decontamination_stage, overlaps
from pyspark.sql import functions as F


def split(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items):
    w, hit, ids = split(text), set(), set()
    for i, t in items:
        v = split(t)
        for s in range(max(0, len(v) - 13) + 1 if v else 0):
            win = v[s : s + 13]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    ids.add("" if i is None else str(i))
    return len(w), len(hit), sorted(ids)


@pytest.mark.parametrize("literals", [50_000, 3])
def test_overlaps(spark, monkeypatch, literals):
    monkeypatch.setattr(d, "LITERALS", literals)
    rng = random.Random(7)
    vocab = ["the", "of", "Ça", "über", "x1", "zeta", "Kappa", "mu", "nu", "😀b"]
    say = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", "", ",", "\n"]) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([30, 13, 14, 5, 2, 1, 0, 60, 20])] + [(1, say(15)), (None, say(18)), (70, None)]
    docs = [None, "", "the", say(40), "THE OF " * 30]
    for i, t in items:
        docs += [say(9) + " " + (t or "").upper() + " " + say(400), (t or "")[:-3], t]
    rows = [(i, t, "en") for i, t in enumerate(docs)] + [(3, docs[3], "en"), (None, docs[5], "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, w string").withColumn("n", F.lit(0))
    out = overlaps(df, spark.createDataFrame(items, "item_id long, text string")).withColumn("c", contaminated()).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.item_ids, r.c) for r in out)
    want = []
    for i, t, _ in rows:
        n, h, ids = brute(t, items)
        want.append((-1 if i is None else i, n, h, ids, h > 0 and 20 * h >= n))
    assert got == sorted(want)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert overlaps(docs.limit(0), items).count() == 0
    assert [r.n_hit for r in overlaps(docs, items.limit(0)).collect()] == [0]
    assert hashlib.sha256(b"").hexdigest()


def test_stage_keeps_columns(spark, tmp_path):
    item = " ".join(f"word{i}" for i in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, item), (1, "clean"), (2, "before " + item), (None, None), (3, "clean"), (3, "clean")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS __text_id", "2 AS text_id", "3 AS row", "4 AS key", "5 AS `a.b`")
    out = decontamination_stage(spark, df, str(tmp_path))
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "", r.text_id) for r in out.collect()) == [(0, "", 2), (1, "clean", 2), (3, "clean", 2), (3, "clean", 2)]
    assert decontamination_stage(spark, df.limit(0), str(tmp_path)).count() == 0
