"""The exclusion mask: ranges of a document that analyses leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliograph.functions import lexicon
from foliograph.functions.text import overlaps

FLAG = "excluded_from_analysis"


def candidate_ranges(assigned: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, start, end, reason) from the kinds of sections and from the blocks themselves."""
    reasons = sections.select("doc_id", "section_no", lexicon.mapped(lexicon.SECTION_REASON, F.col("kind")).alias("reason")).filter("reason IS NOT NULL")
    by_section = assigned.join(reasons, ["doc_id", "section_no"]).select("doc_id", "start", "end", "reason")
    own = F.coalesce(lexicon.mapped(lexicon.BLOCK_REASON, F.col("type")), F.when(F.array_contains("flags", "toc"), "toc"))
    by_block = assigned.select("doc_id", "start", "end", own.alias("reason")).filter("reason IS NOT NULL")
    return by_section.unionByName(by_block)


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges of one reason that touch or overlap, and follow each other in order of (start, end, reason), joined."""
    order = Window.partitionBy("doc_id").orderBy("start", "end", "reason")
    real = ranges.filter("end > start")
    changed = F.coalesce(F.lag("reason").over(order) != F.col("reason"), F.lit(True))
    runs = real.withColumn("run", F.sum(changed.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("doc_id", "run").orderBy("start", "end")
    apart = F.coalesce(F.col("start") > F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True))
    islands = runs.withColumn("island", F.sum(apart.cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("doc_id", "run", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("reason").alias("reason")).drop("run", "island")


def excluded_blocks(blocks: DataFrame, mask: DataFrame) -> DataFrame:
    """The blocks that the mask overlaps: an equi-join on the document with the overlap as residual."""
    m = mask.select(F.col("doc_id").alias("m_doc"), F.col("start").alias("m_start"), F.col("end").alias("m_end"))
    return blocks.join(m, (F.col("doc_id") == F.col("m_doc")) & overlaps(F.col("start"), F.col("end"), F.col("m_start"), F.col("m_end")), "left_semi")


def analysable_blocks(blocks: DataFrame, mask: DataFrame) -> DataFrame:
    m = mask.select(F.col("doc_id").alias("m_doc"), F.col("start").alias("m_start"), F.col("end").alias("m_end"))
    return blocks.join(m, (F.col("doc_id") == F.col("m_doc")) & overlaps(F.col("start"), F.col("end"), F.col("m_start"), F.col("m_end")), "left_anti")


def mark_excluded(blocks: DataFrame, mask: DataFrame) -> DataFrame:
    """Blocks with the flag on those that the mask overlaps, once however often this runs."""
    hit = excluded_blocks(blocks, mask).select("doc_id", "block_id", F.lit(True).alias("hit"))
    flagged = F.when(F.col("hit"), F.array_union("flags", F.array(F.lit(FLAG)))).otherwise(F.col("flags"))
    return blocks.join(hit, ["doc_id", "block_id"], "left").withColumn("flags", flagged).drop("hit")
