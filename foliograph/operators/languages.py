"""Languages of documents and sections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliograph.functions.language import MIN_CHARS, detect
from foliograph.functions.lexicon import LANGUAGE_TYPES


def primary_language(blocks: DataFrame, default: str = "pl", detector: Callable[[str], Column] = detect) -> DataFrame:
    """(doc_id, language_primary): the language with the most characters of prose, a tie is pl. detector: any function of a column's name."""
    prose = F.col("type").isin(*LANGUAGE_TYPES) & (F.length("text") >= MIN_CHARS)
    weighed = blocks.select("doc_id", F.when(prose, detector("text")).alias("lang"), F.length("text").alias("chars")).groupBy("doc_id", "lang").agg(F.sum("chars").alias("chars"))
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("lang").isNull(), F.col("chars").desc(), (F.col("lang") != "pl")))
    return weighed.withColumn("at", best).filter("at = 1").select("doc_id", F.coalesce("lang", F.lit(default)).alias("language_primary"))


def section_language(assigned: DataFrame, primary: DataFrame, detector: Callable[[str], Column] = detect) -> DataFrame:
    """(doc_id, section_no, lang): detected on the section's whole text, else the document's."""
    rows = F.array_sort(F.collect_list(F.struct("ordinal", "text")))
    text = assigned.groupBy("doc_id", "section_no").agg(F.array_join(F.transform(rows, lambda r: r.text), " ").alias("text"))
    found = F.when(F.length("text") >= MIN_CHARS, detector("text"))
    return text.join(primary, "doc_id").select("doc_id", "section_no", F.coalesce(found, F.col("language_primary")).alias("lang"))


def correct_abstracts(sections: DataFrame, languages: DataFrame) -> DataFrame:
    """Sections with lang; an abstract's kind follows the language of its text."""
    abstract = F.col("kind").isin("abstract_pl", "abstract_en") & F.col("lang").isin("pl", "en")
    return sections.join(languages, ["doc_id", "section_no"], "left").withColumn("kind", F.when(abstract, F.concat(F.lit("abstract_"), F.col("lang"))).otherwise(F.col("kind")))
