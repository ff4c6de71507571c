"""SimHash near-dedup: fingerprints, and links found by pigeonring filtering.

A fingerprint's ring of SEGMENTS equal segments has, for any partner at a distance of at most
max_distance, a segment from which every chain of l consecutive segments differs in at most
floor(l * max_distance / SEGMENTS) bits. The longest chain whose budget is zero must be equal,
so it is the key of an equi-join; the budgets of longer chains prune what the join finds before
the full Hamming check. Over ONE_CHAIN fingerprints the join is on two such chains at once, the
arcs between the segments that may differ (48 bits in 28 ways), so that keys stay selective at any
size; both ways find every link. Only distinct fingerprints are joined. Keys that more than CROWDED
fingerprints share take an exact linear way instead: two fingerprints within two bits have a
common neighbour within one bit each, so each fingerprint names its neighbours within
ceil(max_distance / 2) bits and those that name the same one are linked to the smallest of them
(a link of odd excess is checked first). Links are edges of a graph whose components come from
alternating large-star and small-star rounds.

Defined results: a null text is empty; a text without words has fingerprint zero, linked like
any other; one with fewer words than a shingle has one shingle; a null id is carried but is never
a component's name unless all ids of the component are null; repeated rows share a component.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliograph.llm.common import LOWER, UPPER, as_rows, lean, table, text_key, text_of, with_small_batches
from foliograph.session import discard, stored

SEED = 42
SEGMENTS = 8
CROWDED = 32
#: Up to so many distinct fingerprints one zero-budget chain of 24 bits is a key; beyond, chance alone would crowd it.
ONE_CHAIN = 1 << 24
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans(UPPER, LOWER)


def fingerprint(text: str | None, n_words: int = 3) -> int:
    """The 64-bit fingerprint: a bit is 1 if it is set in over half of the shingles' XXH64 hashes."""
    words = _WORDS.findall((text or "").translate(_LOWER))
    if not words:
        return 0
    if len(words) <= n_words:
        return xxhash.xxh64_intdigest(" ".join(words), SEED)
    digest = xxhash.xxh64_digest
    ones, n, step = np.zeros(64, dtype=np.int64), len(words) - n_words + 1, 65_536
    for at in range(0, n, step):
        part = words[at : at + step + n_words - 1]
        raw = b"".join([digest(" ".join(s), SEED) for s in zip(*(part[k:] for k in range(n_words)), strict=False)])
        ones += np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, n_words: int = 3, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """(doc_id, fp) for each row, and text_id if keyed; fp is the fingerprint as a signed long."""
    own = [("doc_id", pa.int64())] + [("text_id", pa.binary())] * keyed
    schema = pa.schema([*own, ("fp", pa.int64())])

    @lean
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, n_words) for t in b.column(len(own)).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([*b.columns[: len(own)], pa.array(fps)], schema=schema)

    columns = [F.col(id_col).cast("long").alias("doc_id"), *([text_key(text_of(text_col)).alias("text_id")] * keyed), F.col(text_col).alias("text")]
    return with_small_batches(docs).select(*columns).mapInArrow(score, "doc_id long, text_id binary, fp long" if keyed else "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _chain(start: int, length: int, segments: int) -> int:
    """The mask of `length` consecutive segments of the ring from segment `start`."""
    width = 64 // segments
    return _signed(functools.reduce(lambda m, s: m | ((1 << width) - 1) << (s % segments * width), range(start, start + length), 0))


def _zero_keys(max_distance: int, segments: int, two_chains: bool) -> list[tuple[int, int]]:
    """(start, mask) of the bits that some key of two fingerprints within max_distance shares.

    One chain: the longest one whose budget is zero. Two chains at once: what is left of the ring
    where max_distance segments may differ, which is all chains between them.
    """
    if two_chains:
        gone = itertools.combinations(range(segments), max_distance)
        return [(k, _signed(~functools.reduce(lambda m, s: m | _chain(s, 1, segments), out, 0) & (1 << 64) - 1)) for k, out in enumerate(gone)]
    zero = max(n for n in range(1, segments + 1) if n * max_distance // segments == 0)
    return [(s, _chain(s, zero, segments)) for s in range(segments)]


def links(fps: DataFrame, max_distance: int = 2, segments: int = SEGMENTS, crowded: int = CROWDED, one_chain: int = ONE_CHAIN) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp`, enough of them to connect all pairs within max_distance bits."""
    assert 64 % segments == 0 and segments > max_distance
    two = fps.count() > one_chain
    masks = F.array(*(F.struct(F.lit(s).alias("start"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for s, m in _zero_keys(max_distance, segments, two)))
    keys = fps.select("fp", F.explode(masks).alias("k")).select("fp", "k.start", "k.part")
    sizes = keys.groupBy("start", "part").count().filter("count > 1")
    shared = stored(keys.join(sizes, ["start", "part"]), "simhash-keys")

    few = shared.filter(F.col("count") <= crowded)
    diff = F.col("a").bitwiseXOR(F.col("b"))
    viable = F.bit_count(diff) <= max_distance
    for s in range(segments):
        for n in range(segments - 1, 0, -1):
            budget = F.bit_count(diff.bitwiseAND(F.lit(_chain(s, n, segments)))) <= n * max_distance // segments
            if not two and n * max_distance // segments:
                viable &= (F.col("start") != s) | budget
    pairs = few.select("start", "part", F.col("fp").alias("a")).join(few.select("start", "part", F.col("fp").alias("b")), ["start", "part"])
    pairs = pairs.filter((F.col("a") < F.col("b")) & viable).select("a", "b")

    many = shared.filter(F.col("count") > crowded).select("fp").distinct()
    return pairs.unionByName(_ball_links(many, max_distance)).distinct()


def _ball_links(fps: DataFrame, max_distance: int) -> DataFrame:
    """The same edges without pairs of candidates: those that name a common neighbour. Exact for a distance of up to 2."""
    assert max_distance <= 2
    flips = [0] + [_signed(1 << i) for i in range(64)] if max_distance else [0]
    near = fps.select("fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(f)) for f in flips))).alias("at"))
    star = near.groupBy("at").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).filter("a < top")
    edges = near.join(star, "at").filter("a < fp").select("a", F.col("fp").alias("b"))
    if max_distance == 1:  # two that name a third may be two bits apart: keep those that one names as itself
        own = near.join(fps.select(F.col("fp").alias("at")), "at").filter("fp != at")
        edges = own.select(F.least("fp", "at").alias("a"), F.greatest("fp", "at").alias("b"))
    return edges


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each connected component, for nodes that have edges (a, b)."""
    now, before = stored(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), "cc"), None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        now, old = stored(small, "cc"), now
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(old)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, n_words: int = 3, max_distance: int = 2, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """(doc_id, fp, component_id) for each row, the smallest id that links reach; if keyed, (doc_id, text_id, fp, root), one root a component."""
    fps = stored(fingerprints(docs, n_words, id_col, text_col, keyed), "simhash-fps")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    root = components(links(distinct.select("fp"), max_distance))
    named = distinct.join(root, distinct.fp == root.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    if keyed:
        return fps.join(named.select("fp", "root"), "fp").select("doc_id", "text_id", "fp", "root")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(names, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """All documents with their fingerprints and components of links of at most two bits."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component of near-duplicates, with all its columns, whatever their names.

    That is a row of the smallest id; of several texts with that id in the component, the one of
    the smallest text key; of rows that repeat both, one. Rows without an id stay only where no
    row of their component has one. Links are those of op8: at most two bits.
    """
    who = F.struct(F.col("doc_id").isNull().alias("without"), F.col("doc_id").alias("doc_id"), F.col("text_id").alias("text_id"))
    first = near_duplicates(docs, keyed=True).groupBy("root").agg(F.min(who).alias("w"), F.count(F.lit(1)).alias("n")).select(F.col("w.doc_id").alias("kept_id"), F.col("w.text_id").alias("kept_text"), "n")
    row = F.col("row")
    rows = as_rows(docs).select("row", row.getField("doc_id").cast("long").alias("doc_id"), text_key(text_of(row.getField("text"))).alias("text_id"))
    kept = rows.join(first, rows.doc_id.eqNullSafe(first.kept_id) & (rows.text_id == first.kept_text))
    again = Window.partitionBy("doc_id", "text_id").orderBy(F.xxhash64("row"))
    several = kept.filter("n > 1").withColumn("at", F.row_number().over(again)).filter("at = 1")  # a component of one row repeats nothing
    return kept.filter("n = 1").select("row").unionByName(several.select("row")).select("row.*")
