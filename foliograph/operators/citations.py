"""Citations: found in blocks, numbered, and linked to references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliograph.functions.citations import find_citations
from foliograph.functions.lexicon import CITATION_TYPES
from foliograph.operators.exclusions import analysable_blocks


def hits(blocks: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """(doc_id, block_id, ordinal, raw, style, keys, authors, year, start, end) with offsets in the document."""
    prose = blocks.filter(F.col("type").isin(*CITATION_TYPES))
    if mask is not None:
        prose = analysable_blocks(prose, mask)
    found = prose.select("doc_id", "block_id", "ordinal", F.col("start").alias("at"), F.explode(find_citations("text")).alias("h"))
    return found.select("doc_id", "block_id", "ordinal", "h.raw", "h.style", "h.keys", "h.authors", "h.year", (F.col("at") + F.col("h.start")).alias("start"), (F.col("at") + F.col("h.end")).alias("end"))


def surname(author: Column) -> Column:
    """The last word before an author's first comma, letters only, in lower case."""
    words = F.filter(F.split(F.trim(F.substring_index(author, ",", 1)), r"(?U)\s+"), lambda w: w != "")
    return F.lower(F.regexp_replace(F.try_element_at(words, F.lit(-1)), r"(?U)[^\w]", ""))


def first_author(authors: Column) -> Column:
    return F.trim(F.get(F.split(authors, r"(?U),|\s+(?:i|and|&|et al)\b"), 0))


def surname_years(refs: DataFrame) -> DataFrame:
    """(doc_id, surname, year, ref_id): of references that share both, the first."""
    named = refs.filter("year IS NOT NULL").select("doc_id", "ordinal", "ref_id", F.col("year").alias("ref_year"), F.explode("authors").alias("author"))
    keyed = named.withColumn("surname", surname(F.col("author"))).filter("surname <> ''")
    return keyed.groupBy("doc_id", "surname", "ref_year").agg(F.min_by("ref_id", "ordinal").alias("by_name"))


def resolve(found: DataFrame, refs: DataFrame) -> DataFrame:
    """Add ref_id: a number links by the order of references, a name by surname and year; a citation of several by its first."""
    numbers = refs.select("doc_id", F.col("ordinal").cast("string").alias("number"), F.col("ref_id").alias("by_number"))
    names = surname_years(refs)
    numeric = F.col("style") == "numeric"
    keyed = found.withColumn("number", F.when(numeric, F.get("keys", 0))).withColumn("surname", F.when(~numeric, surname(first_author(F.col("authors")))))
    keyed = keyed.withColumn("ref_year", F.when(~numeric, F.col("year").try_cast("int")))
    joined = keyed.join(numbers, ["doc_id", "number"], "left").join(names, ["doc_id", "surname", "ref_year"], "left")
    return joined.withColumn("ref_id", F.coalesce("by_number", "by_name")).drop("number", "by_number", "surname", "ref_year", "by_name")


def attach(blocks: DataFrame, refs: DataFrame, mask: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The citations table. Existing ones stay as they are and keep their spans, so attaching again changes nothing."""
    new = resolve(hits(blocks, mask), refs)
    if existing is not None:
        new = new.join(existing.select("doc_id", "block_id", "start", "end"), ["doc_id", "block_id", "start", "end"], "left_anti")
        new = new.join(existing.groupBy("doc_id").agg(F.count(F.lit(1)).alias("taken")), "doc_id", "left")
    else:
        new = new.withColumn("taken", F.lit(0))
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end")) + F.coalesce("taken", F.lit(0))
    out = new.select("doc_id", F.format_string("c%04d", at.cast("int")).alias("citation_id"), "raw", "style", "keys", "block_id", "start", "end", "ref_id")
    return out if existing is None else existing.select(*out.columns).unionByName(out)


def orphans(citations: DataFrame) -> DataFrame:
    """Citations without a reference."""
    return citations.filter("ref_id IS NULL")


def uncited(refs: DataFrame, citations: DataFrame) -> DataFrame:
    """References that no citation links to."""
    return refs.join(citations.filter("ref_id IS NOT NULL").select("doc_id", "ref_id"), ["doc_id", "ref_id"], "left_anti")


def duplicate_references(refs: DataFrame) -> DataFrame:
    """(doc_id, key, ref_ids): references of one document that share a DOI, or else title and year (a null year is one too); without a DOI a title is needed."""
    titled = F.when(F.trim("title") != "", F.concat_ws("|", F.lower(F.trim("title")), F.col("year").cast("string")))
    key = F.coalesce(F.when(F.col("doi") != "", F.lower("doi")), titled)
    return refs.withColumn("key", key).filter("key IS NOT NULL").groupBy("doc_id", "key").agg(F.array_sort(F.collect_list("ref_id")).alias("ref_ids")).filter(F.size("ref_ids") > 1)
