"""Sharding: longest-processing-time scheduling of groups that must stay together.

Rows with equal texts form a group. Groups, sorted by size, go to the least-loaded bin
through a heap, in two levels: within each hash bucket of groups, a task fills n_shards
bins; then the bins of all buckets, and the few groups that are heavy by themselves, go to
the shards by the same rule on the driver. No task sees all groups and the driver sees
n_buckets * n_shards loads (MAX_BUCKETS bounds them) and at most 2 * HEAVY heavy groups.

Defined results: a null text counts no bytes and groups with the empty text; a null id is
carried; repeated rows are separate members of one group; an empty table gives no rows;
further columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliograph.llm.common import text_key, text_of
from foliograph.session import stored

#: A group with a larger share of all bytes or of all rows than 1 / HEAVY is scheduled by itself.
HEAVY = 10_000
GROUPS_A_BUCKET, MIN_BUCKETS, MAX_BUCKETS = 20_000, 12, 65_536
ROWS_A_CHUNK, MAX_CHUNKS = 100_000, 65_536


def longest_first(sizes: Iterable[int], n_bins: int) -> np.ndarray:
    """The bin of each size: in order of falling size (ties: by position), always the least-loaded bin (ties: the lowest)."""
    sizes = np.asarray(sizes, dtype=np.int64)
    bins = np.empty(len(sizes), dtype=np.int32)
    heap = [(0, b) for b in range(n_bins)]
    for i in np.argsort(-sizes, kind="stable"):
        load, b = heap[0]
        bins[i] = b
        heapq.heapreplace(heap, (load + int(sizes[i]), b))
    return bins


def _fill(n_bins: int):
    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["gsize", "g"], ascending=[False, True], kind="stable")
        return pdf.assign(bin=longest_first(pdf.gsize, n_bins))[["g", "bucket", "bin", "gsize"]]

    return fill


def shard_by_size(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """Per row: id, size (UTF-8 bytes plus overhead), text_crc32, shard and slot (gapless from 0 within the shard)."""
    spark = docs.sparkSession
    text = text_of(text_col)
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text).cast("long") + overhead).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            text_key(text).alias("g"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("g").agg(F.sum("size").alias("gsize"), F.count(F.lit(1)).alias("n"))
    groups = stored(groups, "shard-groups")
    n_groups, n_rows, total = groups.agg(F.count(F.lit(1)), F.sum("n"), F.sum("gsize")).first()
    n_rows, total = n_rows or 0, total or 0
    n_buckets = min(MAX_BUCKETS, max(MIN_BUCKETS, math.ceil(n_groups / GROUPS_A_BUCKET)))

    is_heavy = (F.col("gsize") * HEAVY > total) | (F.col("n") * HEAVY > n_rows)
    heavy = sorted(((r.gsize, bytes(r.g)) for r in groups.filter(is_heavy).collect()), key=lambda x: (-x[0], x[1]))
    filled = stored(
        groups.filter(~is_heavy)
        .select("g", "gsize", F.pmod(F.xxhash64("g"), F.lit(n_buckets)).cast("int").alias("bucket"))
        .groupBy("bucket")
        .applyInPandas(_fill(n_shards), "g binary, bucket int, bin int, gsize long"),
        "shard-bins",
    )
    loads = sorted(((r.load, r.bucket, r.bin) for r in filled.groupBy("bucket", "bin").agg(F.sum("gsize").alias("load")).collect()), key=lambda x: (-x[0], x[1], x[2]))
    placed = longest_first([x[0] for x in heavy] + [x[0] for x in loads], n_shards)

    # Both maps are bounded: HEAVY and MAX_BUCKETS above.
    heavy_map = spark.createDataFrame(pd.DataFrame({"g": [x[1] for x in heavy], "heavy_shard": placed[: len(heavy)].astype(np.int32)}), "g binary, heavy_shard int")
    bin_map = spark.createDataFrame(pd.DataFrame({"bucket": [x[1] for x in loads], "bin": [x[2] for x in loads], "shard": placed[len(heavy) :].astype(np.int32)}), "bucket int, bin int, shard int")
    light_map = filled.join(F.broadcast(bin_map), ["bucket", "bin"]).select("g", "shard")

    marked = rows.join(F.broadcast(heavy_map), "g", "left")
    sharded = marked.filter(F.col("heavy_shard").isNotNull()).select("doc_id", "size", "text_crc32", "g", F.col("heavy_shard").alias("shard"))
    sharded = sharded.unionByName(marked.filter(F.col("heavy_shard").isNull()).select("doc_id", "size", "text_crc32", "g").join(light_map, "g"))
    return _numbered(sharded, n_rows, n_shards)


def _numbered(sharded: DataFrame, n_rows: int, n_shards: int) -> DataFrame:
    """Add slot: rows are numbered within (shard, chunk), and chunks start where those before end, so that no task holds a shard."""
    n_chunks = min(MAX_CHUNKS, max(8, math.ceil(n_rows / n_shards / ROWS_A_CHUNK)))
    sharded = stored(sharded.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "g"), F.lit(n_chunks)).cast("int")), "shard-map")
    counts = sharded.groupBy("shard", "chunk").count()
    start = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "chunk", start.alias("start"))  # at most n_shards * MAX_CHUNKS rows
    within = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "g")) - 1
    return sharded.withColumn("within", within).join(starts, ["shard", "chunk"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("within")).alias("slot"))


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents on shards 0 to 39 under the law `bytes`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_by_size(docs, 40).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
