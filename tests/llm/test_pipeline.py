"""The pipeline on the smallest tables, each stage against a plain reading of its rule."""

import corpus_pipeline
import pytest
from foliograph.llm.packing import public_encoder
from foliograph.session import stored

from tests.llm.plain import plain_passages
from tests.llm.test_decontamination import brute as plain_overlap
from tests.llm.test_simhash import plain as plain_fingerprint
from tests.llm.test_simhash import union

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append((None, docs, docs.collect()))
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "test-stage")
        out.append((name, docs, docs.collect()))
    return out


def test_columns(stages):
    for _, df, _ in stages[:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxicity_keeps_whole_rows(stages):
    before, after = ({r.doc_id: r for r in rows} for _, _, rows in stages[0:2])
    assert len(after) == len(stages[1][2]) and set(after.items()) <= set(before.items())
    assert len(after) >= 0.7 * len(before)


def test_simhash_keeps_the_first_of_each_group(stages):
    rows = stages[1][2]
    fp = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    ids = sorted(fp)
    root = union(ids, [(a, b) for a in ids for b in ids if a < b and bin(fp[a] ^ fp[b]).count("1") <= 2])
    assert sorted(r.doc_id for r in stages[2][2]) == sorted(set(root.values()))


def test_suffixes(stages):
    raws = {r.doc_id: r.text.encode() for r in stages[2][2]}
    want = plain_passages(raws, 200, 50)
    assert {r.doc_id: r.text.encode() for r in stages[3][2]} == want
    assert all(r.n_chars == len(r.text) for r in stages[3][2])
    assert sum(want[i] != raws[i] for i in raws) >= 3


def test_decontamination(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = set()
    for r in stages[3][2]:
        n, hit, _ = plain_overlap(r.text, items)
        if hit and 20 * hit >= n:
            bad.add(r.doc_id)
    assert {r.doc_id for r in stages[4][2]} == {r.doc_id for r in stages[3][2]} - bad


def test_packing(stages):
    encode, lengths = public_encoder(), {}
    for r in stages[5][2]:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {r.doc_id: len(encode(r.text)) + 1 for r in stages[4][2]}
    loads = {}
    for r in stages[5][2]:
        loads[r.sequence_id] = loads.get(r.sequence_id, 0) + r.length
    assert max(loads.values()) <= 2048


def test_run(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect())) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in stages[5][2])
