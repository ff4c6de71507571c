import zlib

import pytest
from foliograph.llm.sharding import longest_first, shard_by_size
from pyspark.sql import functions as F


def test_longest_first_matches_plain_rule():
    sizes = [7, 3, 9, 9, 1, 4, 4]
    loads = [0, 0, 0]
    want = {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = loads.index(min(loads))
        want[i] = b
        loads[b] += sizes[i]
    assert list(longest_first(sizes, 3)) == [want[i] for i in range(len(sizes))]


def test_sharding(spark):
    texts = [None, "", "", "é" * 50] + ["hot copy " * 9] * 300 + [f"text number {i} " * (i % 37) for i in range(900)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(5, "hot copy " * 9, "x"), (None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string").withColumn("slot", F.lit(1))
    out = shard_by_size(df, 7).collect()
    assert len(out) == len(rows)
    by_text = {}
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r["size"], r.text_crc32) for r in out) == want
    loads = [0] * 7
    for r in out:
        assert by_text.setdefault((r["size"], r.text_crc32), r.shard) == r.shard
        loads[r.shard] += r["size"]
    for s in range(7):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    hot = 301 * (81 + 16)
    rest = sum(loads) - hot
    assert max(loads) <= max(hot, rest / 6 * 1.05)


def test_empty(spark):
    assert shard_by_size(spark.createDataFrame([], "doc_id long, text string"), 3).count() == 0


def test_same_result_again(spark):
    df = spark.createDataFrame([(i, f"t{i % 50}" * (i % 9)) for i in range(500)], "doc_id long, text string")
    first, second = ({(r.doc_id, r.shard, r.slot) for r in shard_by_size(df, 5).collect()} for _ in range(2))
    assert first == second
