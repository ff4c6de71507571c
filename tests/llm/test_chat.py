import random

import pytest
from foliograph.llm.chat import chosen_paths, formatted, op4_chat, read_back, reply_chain
from pyspark.sql import functions as F

SCHEMA = "tree long, id long, parent long, role string, text string, score double"


def brute(messages, branches):
    out = {}
    for tree in {m[0] for m in messages}:
        own = {}
        for m in sorted((m for m in messages if m[0] == tree and m[1] is not None), key=lambda m: (m[3] or "", m[4] or "")):
            own.setdefault(m[1], m)
        leaves = []
        for i in own:
            if any(m[2] == i for m in own.values()):
                continue
            path, at = [], i
            while at in own and at not in path:
                path.append(at)
                at = own[at][2]
            if at in path:
                continue
            leaves.append((-sum(own[p][5] or 0 for p in path) / len(path), -len(path), i, path[::-1]))
        for rank, leaf in enumerate(sorted(leaves)[:branches], 1):
            out[tree, rank] = [(own[p][1], own[p][3] or "", own[p][4] or "") for p in leaf[3]]
    return out


def test_paths(spark):
    rng = random.Random(4)
    messages = []
    for tree in [1, 2, 3, None]:
        for i in range(60):
            messages.append((tree, i, rng.randrange(i) if i and rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", None, "</s>[x]\\"]), rng.choice([None, 0.5, 2.0, -1.25])))
    messages += [(5, i, i - 1 if i else 99, "user", str(i), 1.0) for i in range(70)]  # a long chain whose first parent is missing
    messages += [(6, 1, 2, "user", "x", 1.0), (6, 2, 1, "user", "x", 1.0), (7, 1, None, "b", "x", 1.0), (7, 1, None, "a", "y", 1.0), (7, None, 1, "a", "z", 1.0)]
    df = spark.createDataFrame(messages, SCHEMA).withColumn("depth", F.lit("x"))
    got = {}
    for r in chosen_paths(df, 3).orderBy("depth").collect():
        got.setdefault((r.tree, r.rank), []).append((r.id, r.role, r.text))
    assert got == brute(messages, 3)
    back = read_back(formatted(chosen_paths(df, 3))).collect()
    assert {(r.tree, r.rank): [(t.role, t.text) for t in r.turns] for r in back} == {k: [x[1:] for x in v] for k, v in got.items()}
    assert {(r.tree, r.rank): r.learnt for r in back} == {k: [x[2] for x in v if x[1] == "assistant"] for k, v in got.items()}


def test_chain_ties_and_nulls(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "assistant", None), (1, None, "system", "s"), (None, 3, None, "x"), (1, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r.tree: [(t.role, t.text) for t in r.turns] for r in read_back(formatted(chosen_paths(reply_chain(df)))).collect()}
    assert back == {1: [("system", "s"), ("user", "a"), ("user", "a"), ("user", "b"), ("assistant", "")], None: [("", "x")]}
    assert chosen_paths(reply_chain(df.limit(0))).count() == 0


def test_hostile_conversation(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    (r,) = op4_chat(spark, str(tmp_path)).collect()
    assert (r.conv_id, r.n_turns, r.loss_chars) == (-1, 2, 21)
