"""Evaluation: multisets of predicted and expected keys, rolled up by document and format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions.text import metric_key


def ratio(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole > 0, F.round(part / whole, 3)).otherwise(F.lit(empty))


def prf(true_positives: Column, false_positives: Column, false_negatives: Column) -> dict[str, Column]:
    """Precision, recall and F1, each rounded to three places, F1 from the rounded others."""
    p = ratio(true_positives, true_positives + false_positives, 0.0)
    r = ratio(true_positives, true_positives + false_negatives, 0.0)
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, F.round(2 * p * r / (p + r), 3)).otherwise(0.0)}


def multiset_prf(predicted: DataFrame, expected: DataFrame, by: list[str], key: str = "key") -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of multisets of `key` for each group of `by`."""
    n = lambda df, name: df.groupBy(*by, key).agg(F.count(F.lit(1)).alias(name))
    joined = n(predicted, "p").join(n(expected, "e"), [*by, key], "full").fillna(0, ["p", "e"])
    both = F.least("p", "e")
    sums = joined.groupBy(*by).agg(F.sum(both).alias("tp"), F.sum(F.col("p") - both).alias("fp"), F.sum(F.col("e") - both).alias("fn"))
    return sums.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn")))


def heading_keys(blocks: DataFrame) -> DataFrame:
    return blocks.filter((F.col("type") == "heading") & (F.trim("text") != "")).select("doc_id", F.concat_ws("@", metric_key("text"), F.coalesce("level", F.lit(0)).cast("string")).alias("key"))


def citation_keys(citations: DataFrame) -> DataFrame:
    """BibTeX citations by each of their keys, others by their raw form without blanks."""
    keys = F.filter(F.regexp_extract_all("raw", F.lit(r"(?U)\w[\w:-]*"), F.lit(0)), lambda k: k != "cite")
    each = F.when(F.col("style") == "bibtex_key", F.transform(keys, lambda k: metric_key(k))).otherwise(F.array(F.lower(F.regexp_replace("raw", r"(?U)\s+", ""))))
    return citations.select("doc_id", F.explode(each).alias("key"))


def matched_references(expected: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, expected, matched, accuracy); expected has expectation_id and year, doi, first_author, each null where not asked for."""
    e = expected.select("doc_id", "expectation_id", F.col("year").alias("x_year"), F.col("doi").alias("x_doi"), F.lower("first_author").alias("x_author"))
    names = F.lower(F.array_join("authors", " "))
    fits = (F.col("x_year").isNull() | F.col("x_year").eqNullSafe(F.col("year"))) & (F.col("x_doi").isNull() | F.col("x_doi").eqNullSafe(F.col("doi"))) & (F.col("x_author").isNull() | names.contains(F.col("x_author")))
    hit = e.join(refs.select(F.col("doc_id").alias("r_doc"), "year", "doi", "authors"), (F.col("doc_id") == F.col("r_doc")) & fits, "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("matched"))
    total = e.groupBy("doc_id").agg(F.count(F.lit(1)).alias("expected"))
    return total.join(hit, "doc_id", "left").fillna(0, ["matched"]).withColumn("accuracy", ratio(F.col("matched"), F.col("expected"), 1.0))


def summarise(reports: DataFrame) -> DataFrame:
    """Means by source_format of a report table: heading_*, section_f1, citation_f1, reference_accuracy, language_correct, runtime_s, figures_* and tables_*."""
    mean = lambda c: F.round(F.avg(c), 3)
    recall = lambda k: F.when(F.col(f"{k}_expected") > 0, F.col(f"{k}_found") / F.col(f"{k}_expected")).otherwise(1.0)
    return reports.groupBy("source_format").agg(
        F.count(F.lit(1)).alias("documents"), *(mean(c).alias(c) for c in ("heading_f1", "heading_precision", "heading_recall", "section_f1", "citation_f1", "reference_accuracy")),
        mean(F.col("language_correct").cast("double")).alias("language_accuracy"), mean("runtime_s").alias("mean_runtime_s"), mean(recall("figures")).alias("figure_recall"), mean(recall("tables")).alias("table_recall"),
    ).orderBy("source_format")
