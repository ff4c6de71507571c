"""Blocks and their offsets: block texts joined by one line feed are the document's plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliograph.functions import text as t
from foliograph.functions.lexicon import first_case


def in_document(*order: str) -> Window:
    return Window.partitionBy("doc_id").orderBy(*(order or ("ordinal",)))


def with_offsets(blocks: DataFrame) -> DataFrame:
    """Add block_id, start and end from the texts in order of `ordinal`."""
    before = F.sum(F.length("text") + 1).over(in_document().rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)).cast("int")
    return blocks.withColumn("block_id", F.format_string("b%04d", F.row_number().over(in_document()))).withColumn("start", start).withColumn("end", (F.col("start") + F.length("text")).cast("int"))


def plain_text(blocks: DataFrame) -> DataFrame:
    """(doc_id, plain_text) of each document."""
    rows = F.array_sort(F.collect_list(F.struct("ordinal", "text")))
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r.text), "\n").alias("plain_text"))


def offset_violations(blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """Blocks whose span does not slice their text out of plain_text."""
    joined = blocks.join(texts.select("doc_id", "plain_text"), "doc_id")
    return joined.filter(t.span_text(F.col("plain_text"), F.col("start"), F.col("end")) != F.col("text")).drop("plain_text")


def line_type(text: Column) -> Column:
    """The type that the shape of a line gives it."""
    return F.coalesce(first_case([(t.caption_kind(text).isNotNull(), "caption"), (text.rlike(t.BULLET), "list_item")]), F.lit("paragraph"))


def from_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Blocks of plain-text documents: non-blank lines, with type, flags and offsets."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.col(text_col), "\n")).alias("ordinal", "text")).filter(F.trim("text") != "")
    typed = lines.withColumn("type", line_type(F.col("text"))).withColumn("level", F.lit(None).cast("int")).withColumn("page", F.lit(None).cast("int"))
    flags = F.when(t.looks_like_toc("text"), F.array(F.lit("toc"))).otherwise(F.array().cast("array<string>"))
    return with_offsets(typed.withColumn("flags", flags))
