import random
import re

import pytest
import xxhash
from foliograph.llm.simhash import components, fingerprint, links, near_duplicates, simhash_stage
from pyspark.sql import functions as F


def plain(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(nodes, pairs):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in nodes}


def test_fingerprint():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 5, 40, 300):
        text = " ".join(rng.choice(["The", "É", "ab", "x y", "\n", "\x1c"]) for _ in range(n))
        assert fingerprint(text) == plain(text)
    assert fingerprint(None) == 0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize(("crowded", "one_chain"), [(1, 1 << 24), (4, 1 << 24), (1000, 1 << 24), (2, 0), (1000, 0)])
def test_links_find_every_component(spark, crowded, one_chain):
    rng = random.Random(crowded)
    values = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 9)):
            values.add(x)
            for b in rng.sample(range(64), rng.randrange(0, 5)):
                x ^= 1 << b
    values = sorted(signed(x) for x in values)
    pairs = [(a, b) for a in values for b in values if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2]
    df = spark.createDataFrame([(x,) for x in values], "fp long")
    edges = links(df, crowded=crowded, one_chain=one_chain)
    found = {(r.a, r.b) for r in edges.collect()}
    assert found <= set(pairs)
    want = union(values, pairs)
    roots = {r.node: r.root for r in components(edges).collect()}
    assert {x: roots.get(x, x) for x in values} == want


def test_components_of_a_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    assert {r.root for r in components(edges).collect()} == {0}
    assert components(edges.limit(0)).count() == 0


def test_stage_decides_by_row(spark):
    a, b, c = "a b c d e", "other words stand here now", "something else is said in this"
    rows = [(1, a), (2, a), (2, b), (3, b), (5, c), (5, c), (None, c), (None, "alone in the dark"), (None, "alone in the dark"), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS __at", "2 AS row", "3 AS text_id", "4 AS n", "5 AS `a.b`")
    out = simhash_stage(spark, df, "")
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == sorted([(1, a), (2, b), (5, c), (0, "alone in the dark"), (7, "")])
    assert simhash_stage(spark, df.limit(0), "").count() == 0


def test_near_duplicates(spark):
    rows = [(3, "a b c d"), (1, "A b  c d"), (2, None), (9, ""), (4, "other words stand here"), (4, "other words stand here"), (None, "alone in the dark")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x"))
    out = {(r.doc_id, r.component_id) for r in near_duplicates(df).collect()}
    assert out == {(3, 1), (1, 1), (2, 2), (9, 2), (4, 4), (None, None)}
    assert near_duplicates(df).count() == len(rows)
    assert near_duplicates(df.limit(0)).count() == 0
