"""Best-fit packing of token sequences, certified by dual-feasible-function lower bounds.

Documents become pieces of at most `capacity` tokens (only the first piece of a longer one may
be shorter). Each hash partition of pieces is packed by best-fit decreasing, and dual feasible
functions give a lower bound of the bins that its sizes need. A partition that meets its bound
and the bound of its volume is certified and done. The others have gaps and exchange their
pieces: up to POOL neighbouring partitions become one, which packs them again; a repacking that
needs no fewer bins is not taken. (A partition that meets a bound over its volume has the fewest bins for its own
pieces, yet others may hold what fills them.) A partition too large to be pooled whole keeps its
full bins and exchanges the pieces of its other bins. Rounds end when the bins meet the bound of
all sizes together, when one partition is left, or when two as large as the largest do not fit
into MAX_POOLED. The driver sees one row a round.

Defined results: null and empty texts have only the end token; a null id is carried; repeated
rows are packed each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import lean, table, with_small_batches
from foliograph.session import stored

PIECES_A_PARTITION, POOL, MAX_POOLED = 60_000, 8, 500_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


@functools.cache
def _encoder(json_path: str, ranks_path: str | None, pattern: str | None):
    """Text -> ids of the vocabulary file. With its ranks, tiktoken gives the same ids about four times as fast; texts that name a special token go to tokenizers."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(json_path)
    plain = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    if not ranks_path:
        return plain
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return lambda text: plain(text) if any(s in text for s in special) else fast(text)


def public_encoder(vocabulary: str = "byte_bpe_50k"):
    import public_tokenizers

    return _encoder(public_tokenizers.path(f"{vocabulary}.json"), public_tokenizers.path(f"{vocabulary}.tiktoken"), public_tokenizers.PATTERN)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all but the first are full."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(s, capacity) for s in range(first, n, capacity)]


def tokenized(docs: DataFrame, capacity: int = 2048, end_id: int = 0, encoder=public_encoder, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all rows; encoder is called once on each executor's worker and gives text -> ids."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                rows += [(doc_id, k, s, n, zlib.crc32(ids[s : s + n])) for k, (s, n) in enumerate(cut(len(ids), capacity))]
            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES) if rows else pa.record_batch([[]] * 5, schema=_PIECES)

    return with_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing of the sizes needs."""
    return lower_bound_of_counts(np.bincount(sizes, minlength=capacity + 1), capacity)


def lower_bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """The same of the number of pieces of each size, by the dual feasible functions of Martello and Toth and of Fekete and Schepers."""
    x = np.arange(capacity + 1)
    best = -(-int((count * x).sum()) // capacity)
    below, weight = np.cumsum(count), np.cumsum(count * x)
    eps = np.arange(1, capacity // 2 + 1)  # sizes over capacity - eps need a bin each, sizes under eps are left out
    best = max(best, int((below[-1] - below[capacity - eps] - (-(weight[capacity - eps] - weight[eps - 1]) // capacity)).max()))
    for k in range(1, 41):
        whole = x * (k + 1) % capacity == 0
        scaled = np.where(whole, x * k, x * (k + 1) // capacity * capacity)  # k * capacity times the function's value
        best = max(best, -(-int((count * scaled).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size: by falling size, into the fullest bin that has room, else a new one."""
    bins = np.empty(len(sizes), dtype=np.int64)
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n_bins = 0, 0  # rooms: bit r is set if some bin has room r
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, n_bins
            n_bins += 1
        bins[i] = b
        if room > size:
            open_by_room[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins


def _packer(capacity: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        sizes = pdf.length.to_numpy()
        bins = best_fit_decreasing(sizes, capacity)
        before = pdf.sequence_id[pdf.sequence_id >= 0].nunique() if (pdf.sequence_id >= 0).all() else None
        bound = max(lower_bound(sizes, capacity), 1)
        if before is None or bins.max() + 1 < before:
            pdf["sequence_id"] = bins + (pdf.part.to_numpy() + 1) * (1 << 32)
        n = pdf.sequence_id.nunique()
        certified = n == bound == -(-int(sizes.sum()) // capacity)
        full = pdf.groupby("sequence_id").length.transform("sum").to_numpy() == capacity
        pdf["done"] = certified | (full & (len(pdf) * POOL > MAX_POOLED))
        pdf["open_bins"] = pdf.sequence_id[~pdf.done].nunique()
        pdf["done_bins"] = n - pdf.open_bins
        return pdf

    return pack


def packed(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """The columns of pieces with sequence_id and offset: few sequences of at most `capacity` tokens."""
    schema = f"{PIECES}, part long, sequence_id long, done boolean, open_bins long, done_bins long"
    n = pieces.count()
    n_parts = max(1, math.ceil(n / PIECES_A_PARTITION))
    now = pieces.select("*", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(n_parts)).alias("part"), F.lit(-1).cast("long").alias("sequence_id"))
    sizes = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, dtype=np.int64)
    counts[[r.length for r in sizes]] = [r["count"] for r in sizes]
    bound = lower_bound_of_counts(counts, capacity)
    first_part, finished, done_bins = 0, [], 0
    while True:
        out = stored(now.groupBy("part").applyInPandas(_packer(capacity), schema), "packed")
        finished.append(out.filter("done"))
        left = out.filter(~F.col("done"))
        parts = out.groupBy("part").agg(F.count_if(~F.col("done")).alias("left"), F.max("open_bins").alias("open"), F.max("done_bins").alias("closed"))
        state = parts.agg(F.count_if(F.col("left") > 0).alias("parts"), F.max("left").alias("largest"), F.sum("open").alias("open"), F.sum("closed").alias("closed")).first()
        done_bins += state.closed or 0
        if (state.parts or 0) <= 1 or done_bins + state.open == bound:
            break
        pool = min(POOL, MAX_POOLED // state.largest)  # by arithmetic on part numbers: no list of parts is gathered
        if pool < 2:
            break  # no two of the largest fit into one pool
        now = left.withColumn("part", F.lit(first_part + n_parts) + F.floor((F.col("part") - first_part) / pool)).select(*(f.name for f in pieces.schema), "part", "sequence_id")
        first_part, n_parts = first_part + n_parts, math.ceil(n_parts / pool)
    finished.append(left)
    every = functools.reduce(DataFrame.unionByName, finished).select(*(f.name for f in pieces.schema), "sequence_id")
    return every.groupBy(F.pmod(F.xxhash64("sequence_id"), F.lit(max(8, n // 100_000))).alias("deal")).applyInPandas(_placed, f"{PIECES}, sequence_id long, offset long")


def _placed(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["sequence_id", "length", "doc_id", "piece", "ids_crc32"], ascending=[True, False, True, True, True], kind="stable")
    pdf["offset"] = pdf.groupby("sequence_id").length.cumsum() - pdf.length
    return pdf[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]


def pack_documents(docs: DataFrame, capacity: int = 2048) -> DataFrame:
    return packed(stored(tokenized(docs, capacity), "pieces"), capacity)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that the stages before kept, with their sequences."""
    return pack_documents(docs)
