"""Figures, tables and equations: their register, captions and mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliograph.functions import text as t
from foliograph.functions.lexicon import FLOAT_SCAN_TYPES
from foliograph.operators.blocks import in_document

# The words that announce a float in running text.
_WORDS = r"(?:rys\.?|rysunku|rysunek|rysunek|fig\.?|figure|wykres|tab\.?|tabeli|tabela|tabl\.?|table)"
_NUMBER = r"[0-9IVXLivxl]+(?:[.\-][0-9IVXLivxl]+)*"
MENTION = rf"(?iU){_WORDS}\s*(?:nr\.?\s*)?({_NUMBER})\b"


def nearest_caption(blocks: DataFrame, reach: int = 2) -> DataFrame:
    """Tables and figures with caption_ordinal and caption_text: of the captions within `reach` blocks, the nearest, above before below."""
    own = F.when((F.col("type") == "caption") & t.caption_number("text").isNotNull(), F.struct("ordinal", "text"))
    order = in_document()
    marked = blocks.withColumn("cap", own)
    near = [f("cap", n).over(order) for n in range(1, reach + 1) for f in (F.lag, F.lead)]
    return marked.withColumn("near", F.coalesce(*near)).filter(F.col("type").isin("table", "figure")).select("*", F.col("near.ordinal").alias("caption_ordinal"), F.col("near.text").alias("caption_text")).drop("cap", "near")


def register(blocks: DataFrame, images: DataFrame | None = None, reach: int = 2) -> DataFrame:
    """(doc_id, kind, float_id, number, caption, page).

    Captions come first; a table or figure block counts only without a caption near it; an image
    (doc_id, page) counts on pages without a captioned figure.
    """
    captioned = blocks.filter("type = 'caption'").withColumn("kind", t.caption_kind("text")).filter("kind IS NOT NULL")
    rows = captioned.select("doc_id", "kind", F.lit(0).alias("pass"), "ordinal", t.caption_number("text").alias("number"), F.col("text").alias("caption"), "page")
    bare = nearest_caption(blocks, reach).filter("caption_ordinal IS NULL")
    rows = rows.unionByName(bare.select("doc_id", F.col("type").alias("kind"), F.lit(1).alias("pass"), "ordinal", F.lit(None).cast("string").alias("number"), F.lit(None).cast("string").alias("caption"), "page"))
    if images is not None:
        shown = rows.filter("kind = 'figure' AND caption IS NOT NULL").select("doc_id", "page").distinct()
        loose = images.join(shown, ["doc_id", "page"], "left_anti").withColumn("ordinal", F.row_number().over(in_document("page")))
        rows = rows.unionByName(loose.select("doc_id", F.lit("figure").alias("kind"), F.lit(2).alias("pass"), "ordinal", F.lit(None).cast("string").alias("number"), F.lit(None).cast("string").alias("caption"), "page"))
    equations = blocks.filter("type = 'equation'").select("doc_id", F.lit("equation").alias("kind"), F.lit(0).alias("pass"), "ordinal", t.equation_number("text").alias("number"), F.lit(None).cast("string").alias("caption"), "page")
    every = rows.unionByName(equations)
    at = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("pass", "ordinal"))
    return every.select("doc_id", "kind", F.format_string("%s%03d", F.substring("kind", 1, 1), at).alias("float_id"), "number", "caption", "page")


def prefixes(number: Column) -> Column:
    """A number and what a word boundary lets it be cut to: 1.1.2 also mentions 1.1 and 1."""
    parts = F.regexp_extract_all(number, F.lit(r"[.\-]?[0-9IVXLivxl]+"), F.lit(0))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.lower(F.array_join(F.slice(parts, 1, n), "")))


def mentions(blocks: DataFrame, floats: DataFrame, exclude_own_caption: bool = False) -> DataFrame:
    """(doc_id, kind, float_id, block_id): the blocks that mention each numbered figure or table.

    Numbers are taken from the text once and joined, instead of trying each float's pattern on each block.
    """
    scanned = blocks.filter(F.col("type").isin(*FLOAT_SCAN_TYPES))
    own = F.when(F.col("type") == "caption", F.xxhash64("text")) if exclude_own_caption else F.lit(None).cast("long")
    numbers = F.array_distinct(F.flatten(F.transform(F.regexp_extract_all("text", F.lit(MENTION), F.lit(1)), prefixes)))
    said = scanned.select("doc_id", "block_id", own.alias("own"), F.explode(numbers).alias("number"))  # hashes stand for texts, which stay behind
    named = floats.filter("kind IN ('figure', 'table') AND number IS NOT NULL").select("doc_id", "kind", "float_id", F.xxhash64("caption").alias("caption"), F.lower("number").alias("number"))
    found = named.join(said, ["doc_id", "number"]).filter(~F.col("own").eqNullSafe(F.col("caption")))
    return found.select("doc_id", "kind", "float_id", "block_id").distinct()


def with_mentions(floats: DataFrame, found: DataFrame) -> DataFrame:
    """floats with referenced_by."""
    by = found.groupBy("doc_id", "kind", "float_id").agg(F.array_sort(F.collect_set("block_id")).alias("referenced_by"))
    return floats.join(by, ["doc_id", "kind", "float_id"], "left").withColumn("referenced_by", F.coalesce("referenced_by", F.array().cast("array<string>")))
