"""Sections: the block stream cut at the shallowest heading level present."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliograph.functions.lexicon import FRONT_MATTER, section_kind
from foliograph.operators.blocks import in_document


def assign_sections(blocks: DataFrame) -> DataFrame:
    """Blocks with section_no (0: before the first cut), is_cut and has_headings."""
    level = F.when(F.col("type") == "heading", F.coalesce("level", F.lit(1)))
    whole = Window.partitionBy("doc_id")
    cut = F.coalesce(level <= F.min(level).over(whole), F.lit(False))
    marked = blocks.withColumn("is_cut", cut).withColumn("has_headings", F.max(level).over(whole).isNotNull())
    return marked.withColumn("section_no", F.sum(F.col("is_cut").cast("int")).over(in_document().rowsBetween(Window.unboundedPreceding, 0)).cast("int"))


def build_sections(assigned: DataFrame, fold_l: bool = False) -> DataFrame:
    """(doc_id, section_no, ordinal, section_id, kind, title, block_ids, page_range) from assign_sections.

    Leading blocks are a section of their own and no part of the next one.
    """
    head = F.col("is_cut")
    members = F.array_sort(F.collect_list(F.struct("ordinal", "block_id")))
    page = F.when(~head, F.col("page"))
    title = F.max(F.when(head, F.trim("text")))
    raw = assigned.groupBy("doc_id", "section_no").agg(
        title.alias("heading"), F.max("has_headings").alias("has_headings"), F.coalesce(F.max(F.when(head, F.array_contains("flags", "title"))), F.lit(False)).alias("titled"),
        F.transform(members, lambda m: m.block_id).alias("block_ids"), F.min(page).alias("first_page"), F.max(page).alias("last_page"),
    )
    front = F.col("section_no") == 0
    kind = F.when(front & F.col("has_headings"), "title_page").when(front, "other").otherwise(F.coalesce(section_kind("heading", fold_l), F.lit("other")))
    name = F.when(front & F.col("has_headings"), "(front matter)").when(front, "(no headings detected)").otherwise(F.col("heading"))
    order = in_document("section_no")
    found = raw.withColumn("kind", kind).withColumn("title", name).withColumn("ordinal", F.row_number().over(order))
    later = F.max(F.col("kind").isin(*FRONT_MATTER)).over(order.rowsBetween(1, Window.unboundedFollowing))
    promote = F.col("has_headings") & (F.col("ordinal") == 1) & (F.col("kind") == "other") & (F.col("titled") | F.coalesce(later, F.lit(False)))
    promoted = found.withColumn("kind", F.when(promote, "title_page").otherwise(F.col("kind")))
    introduced = F.max(F.col("kind") == "introduction").over(Window.partitionBy("doc_id"))
    fallback = F.col("has_headings") & (F.col("ordinal") == 1) & (F.col("kind") == "other") & ~introduced
    return promoted.withColumn("kind", F.when(fallback, "introduction").otherwise(F.col("kind"))).select(
        "doc_id", "section_no", "ordinal", F.format_string("s%04d", "ordinal").alias("section_id"), "kind", "title", "block_ids",
        F.when(F.col("first_page").isNotNull(), F.struct(F.col("first_page").alias("min"), F.col("last_page").alias("max"))).alias("page_range"),
    )
