"""The tables of the document model, schema version 1.0. Every table is keyed by doc_id first."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "1.0"

# The vocabularies of the model.
SOURCE_FORMATS = ("docx", "latex", "pdf")
BLOCK_TYPES = ("heading", "paragraph", "list_item", "table", "figure", "caption", "equation", "code", "quote", "footnote", "bibitem")
SECTION_KINDS = ("title_page", "statement", "abstract_pl", "abstract_en", "toc", "introduction", "literature_review", "methodology", "results", "summary", "bibliography", "appendix", "other")
EXCLUDE_REASONS = ("front_matter", "toc", "bibliography", "code", "quote", "appendix", "boilerplate")
SEVERITIES = ("info", "minor", "major", "critical")


STYLE = "struct<font:string,size_pt:double,bold:boolean,italic:boolean,line_spacing:double,align:string,indent_cm:double,space_before_pt:double>"
#: Column names and types of each table.
TABLES: dict[str, str] = {
    "documents": "doc_id string, source_format string, filename string, sha256 string, pages int, words int, language_primary string, margins_cm map<string,double>, page_size string, extra string",
    "blocks": f"doc_id string, ordinal int, block_id string, type string, level int, text string, start int, end int, page int, bbox array<double>, xml_path string, line int, style {STYLE}, flags array<string>",
    "sections": "doc_id string, ordinal int, section_id string, kind string, title string, block_ids array<string>, page_range struct<min:int,max:int>, lang string",
    "citations": "doc_id string, citation_id string, raw string, style string, keys array<string>, block_id string, start int, end int, ref_id string",
    "refs": "doc_id string, ordinal int, ref_id string, raw string, authors array<string>, title string, year int, venue string, doi string, url string, confidence double",
    "floats": "doc_id string, kind string, float_id string, number string, caption string, page int, referenced_by array<string>",
    "exclusions": "doc_id string, start int, end int, reason string",
    "segments": "doc_id string, block_id string, start int, end int, text string, word_count int",
    "findings": (
        "doc_id string, finding_id string, module string, rule_id string, severity string, confidence double, title_pl string, title_en string, detail_pl string, detail_en string,"
        " locations array<struct<block_id:string,start:int,end:int>>, evidence string, suggested_fix struct<text_pl:string,text_en:string>, docs_url string"
    ),
}


def struct(table: str) -> T.StructType:
    """A table's schema; needs a running session."""
    return T.StructType.fromDDL(TABLES[table])


def export_schema() -> str:
    """All tables as JSON."""
    return json.dumps({"schema_version": VERSION, "tables": {k: json.loads(struct(k).json()) for k in TABLES}}, indent=2)


def violations(blocks_or_sections: str) -> Column:
    """A predicate that is true for rows outside the vocabularies or ranges of their table."""
    return {
        "blocks": ~F.col("type").isin(*BLOCK_TYPES) | ((F.col("type") == "heading") & ~F.col("level").between(1, 6)) | (F.col("start") < 0) | (F.col("end") < F.col("start")),
        "sections": ~F.col("kind").isin(*SECTION_KINDS),
        "exclusions": ~F.col("reason").isin(*EXCLUDE_REASONS) | (F.col("end") <= F.col("start")),
        "documents": ~F.col("source_format").isin(*SOURCE_FORMATS) | ~F.col("sha256").rlike("^[0-9a-f]{64}$") | ~F.col("language_primary").rlike("^[a-z]{2}$"),
    }[blocks_or_sections]
