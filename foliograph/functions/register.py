"""SQL names of the functions that need Python: scalar ones on Arrow batches, and table functions for LATERAL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from foliograph.functions import citations, sentences


def register(spark: SparkSession) -> None:
    """citation_shapes, split_sentences, decode_text and zip_entries; as table functions citations_of, sentences_of and bib_entries_of."""
    from foliograph.sources import bibtex, files

    for name, f in (("citation_shapes", citations.shape_spans), ("split_sentences", sentences.split_sentences), ("decode_text", files.decoded), ("zip_entries", files.zip_entries)):
        spark.udf.register(name, f)

    class Sentences:
        def eval(self, text: str) -> Iterator[tuple]:
            for a, b in sentences.split(text or ""):
                yield a, b, text[a:b]

    class Entries:
        def eval(self, text: str) -> Iterator[tuple]:
            for e in bibtex.entries(text or ""):
                yield e["key"], e["kind"], e["fields"]

    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION citations_of(text STRING) RETURNS TABLE(raw STRING, style STRING, keys ARRAY<STRING>, start INT, `end` INT) RETURN {citations.SQL_CITATIONS}")
    spark.udtf.register("sentences_of", udtf(Sentences, returnType="start int, end int, text string"))
    spark.udtf.register("bib_entries_of", udtf(Entries, returnType="key string, kind string, fields map<string,string>"))
