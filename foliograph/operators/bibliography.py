"""Bibliography: which blocks are entries, and their fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliograph.functions import references as r
from foliograph.functions.lexicon import ENTRY_TYPES, section_kind
from foliograph.operators.blocks import in_document

MIN_CHARS = 12


def retype_entries(assigned: DataFrame, sections: DataFrame) -> DataFrame:
    """Paragraphs and list items of bibliography sections become bibitem."""
    inside = sections.filter("kind = 'bibliography'").select("doc_id", "section_no", F.lit(True).alias("in_bib"))
    joined = assigned.join(inside, ["doc_id", "section_no"], "left")
    return joined.withColumn("type", F.when(F.col("in_bib") & F.col("type").isin("paragraph", "list_item"), "bibitem").otherwise(F.col("type"))).drop("in_bib")


def bibliography_blocks(assigned: DataFrame, sections: DataFrame, fold_l: bool = False) -> DataFrame:
    """Blocks of bibliography sections; in documents without one, all from the first heading on that names one."""
    named = sections.groupBy("doc_id").agg(F.max(F.col("kind") == "bibliography").alias("has_section"))
    kinds = sections.select("doc_id", "section_no", "kind")
    first = F.min(F.when((F.col("type") == "heading") & (section_kind("text", fold_l) == "bibliography"), F.col("ordinal"))).over(Window.partitionBy("doc_id"))
    marked = assigned.withColumn("from_heading", first).join(kinds, ["doc_id", "section_no"]).join(named, "doc_id")
    return marked.filter(F.when(F.col("has_section"), F.col("kind") == "bibliography").otherwise(F.col("ordinal") >= F.col("from_heading"))).drop("from_heading", "kind", "has_section")


def harvest(entries: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """References from the blocks of bibliographies; documents that `known` references cover keep those."""
    raw = F.trim("text")
    rows = entries.filter(F.col("type").isin(*ENTRY_TYPES) & (F.length(raw) >= MIN_CHARS)).withColumn("raw", raw)
    if known is not None:
        rows = rows.join(known.select("doc_id").distinct(), "doc_id", "left_anti")
    at = F.row_number().over(in_document())
    found = rows.select("doc_id", at.alias("ordinal"), F.format_string("r%03d", at).alias("ref_id"), "raw")
    found = r.with_fields(found)
    return found if known is None else known.select(*found.columns).unionByName(found)
