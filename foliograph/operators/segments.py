"""Sentence segments anchored in the plain text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.functions.lexicon import SEGMENT_TYPES
from foliograph.functions.sentences import split_sentences
from foliograph.functions.text import count_words
from foliograph.operators.exclusions import FLAG, analysable_blocks


def segment(blocks: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """The segments table of all analysable blocks."""
    prose = blocks.filter(F.col("type").isin(*SEGMENT_TYPES) & ~F.array_contains("flags", FLAG))
    if mask is not None:
        prose = analysable_blocks(prose, mask)
    each = prose.select("doc_id", "block_id", F.col("start").alias("at"), F.explode(split_sentences("text")).alias("s"))
    return each.select("doc_id", "block_id", (F.col("at") + F.col("s.start")).alias("start"), (F.col("at") + F.col("s.end")).alias("end"), F.col("s.text").alias("text"), count_words("s.text").alias("word_count"))
