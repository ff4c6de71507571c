"""The enrichment chain: from blocks to all tables of the model, in a fixed order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.operators import bibliography, citations, exclusions, floats, languages, sections
from foliograph.session import stored


@dataclass
class Enriched:
    blocks: DataFrame
    sections: DataFrame
    refs: DataFrame
    citations: DataFrame
    floats: DataFrame
    exclusions: DataFrame
    languages: DataFrame


def enrich(blocks: DataFrame, known_refs: DataFrame | None = None, known_citations: DataFrame | None = None, images: DataFrame | None = None, fold_l: bool = False) -> Enriched:
    """All tables of the documents of `blocks` (doc_id, ordinal, block_id, type, level, text, start, end, page, flags).

    Tables that several later steps read are written once to the shared folder, so no step is
    planned or run again for each of its readers.
    """
    assigned = stored(sections.assign_sections(blocks), "blocks")
    cut = stored(sections.build_sections(assigned, fold_l), "sections")
    assigned = bibliography.retype_entries(assigned, cut)
    refs = stored(bibliography.harvest(bibliography.bibliography_blocks(assigned, cut, fold_l), known_refs), "refs")
    primary = stored(languages.primary_language(assigned), "languages")
    cut = stored(languages.correct_abstracts(cut, languages.section_language(assigned, primary)), "sections")
    mask = stored(exclusions.merge_ranges(exclusions.candidate_ranges(assigned, cut)), "exclusions")
    marked = stored(exclusions.mark_excluded(assigned, mask), "blocks")
    cites = stored(citations.attach(marked, refs, mask, known_citations), "citations")
    register = stored(floats.register(marked, images), "floats")
    return Enriched(marked, cut, refs, cites, floats.with_mentions(register, floats.mentions(marked, register)), mask, primary)


def summary(e: Enriched) -> DataFrame:
    """(doc_id, blocks, headings, sections, citations, references, figures, tables, equations, excluded_blocks, analysed_char_ratio)."""
    out = F.array_contains("flags", exclusions.FLAG)
    per = e.blocks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("type") == "heading").alias("headings"), F.count_if(out).alias("excluded_blocks"),
        F.sum(F.when(~out, F.length("text")).otherwise(0)).alias("analysed"), (F.sum(F.length("text") + 1) - 1).alias("total"),
    )
    for name, df in (("sections", e.sections), ("citations", e.citations), ("references", e.refs)):
        per = per.join(df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name)), "doc_id", "left")
    kinds = e.floats.groupBy("doc_id").agg(*(F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("figure", "table", "equation")))
    names = ["sections", "citations", "references", "figures", "tables", "equations"]
    per = per.join(kinds, "doc_id", "left").fillna(0, names)
    return per.select("doc_id", "blocks", "headings", *names, "excluded_blocks", F.round(F.col("analysed") / F.greatest("total", F.lit(1)), 3).alias("analysed_char_ratio"))
