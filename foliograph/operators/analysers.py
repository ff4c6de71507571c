"""Deterministic analysers beyond the enrichment chain: rules, integrity, style features, and the handling of findings.

These extend the engine; rules and weights are parameters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliograph.functions.text import overlaps
from foliograph.operators.blocks import in_document
from foliograph.session import stored

# Polish first-person endings of verbs that impersonal style avoids, and single-letter words that do not end a line.
FIRST_PERSON = r"(?iU)\b\p{L}+(?:łem|łam|liśmy|łyśmy)\b"
ORPHAN = r"(?U)(?:^|\s)[aiouwzAIOUWZ]\s*$"
SEVERITY_WEIGHT = {"info": 0.0, "minor": 1.0, "major": 3.0, "critical": 10.0}


@dataclass(frozen=True)
class Rule:
    """A rule on blocks: `applies` selects them, `holds` must be true of them."""

    rule_id: str
    severity: str
    title_pl: str
    title_en: str
    applies: Callable[[], Column]
    holds: Callable[[], Column]


def near(value: Column, wanted: float, tolerance: float) -> Column:
    return F.abs(value - wanted) <= tolerance


RULES = (
    Rule("heading-dot", "minor", "Kropka na końcu nagłówka", "Heading ends with a period", lambda: F.col("type") == "heading", lambda: ~F.col("text").rlike(r"\.\s*$")),
    Rule("orphan-letter", "info", "Pojedyncza litera na końcu wiersza", "Single letter at a line's end", lambda: F.col("type").isin("paragraph", "list_item"), lambda: ~F.col("text").rlike(ORPHAN)),
    Rule("straight-quotes", "info", "Cudzysłów prosty", "Straight quotation marks", lambda: F.col("type").isin("paragraph", "quote"), lambda: ~F.contains("text", F.lit('"'))),
    Rule("spaced-hyphen", "info", "Łącznik zamiast myślnika", "Hyphen used as a dash", lambda: F.col("type").isin("paragraph", "list_item"), lambda: ~F.contains("text", F.lit(" - "))),
    Rule("decimal-point", "info", "Kropka dziesiętna", "Decimal point instead of a comma", lambda: F.col("type") == "paragraph", lambda: ~F.col("text").rlike(r"(?:^|[^\d.])\d+\.\d+(?:[^\d.]|$)")),
    Rule("first-person", "minor", "Pierwsza osoba", "First person", lambda: F.col("type") == "paragraph", lambda: ~F.col("text").rlike(FIRST_PERSON)),
)


def check_blocks(blocks: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of block rules: all rules in one pass over the blocks."""
    broken = [F.when(r.applies() & ~r.holds(), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.title_pl).alias("title_pl"), F.lit(r.title_en).alias("title_en"))) for r in rules]
    each = blocks.select("doc_id", "block_id", "start", "end", F.explode(F.array_compact(F.array(*broken))).alias("f"))
    return each.select("doc_id", "f.*", "block_id", "start", "end")


def missing_sections(sections: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """(doc_id, kind): the required kinds that a document lacks."""
    wanted = sections.select("doc_id").distinct().select("doc_id", F.explode(F.array(*(F.lit(k) for k in required))).alias("kind"))
    return wanted.join(sections.select("doc_id", "kind"), ["doc_id", "kind"], "left_anti")


def unmentioned(floats: DataFrame) -> DataFrame:
    return floats.filter(F.col("kind").isin("figure", "table") & (F.size("referenced_by") == 0))


def numbering_gaps(floats: DataFrame) -> DataFrame:
    """Floats whose whole number does not follow the one before it in its kind."""
    n = F.col("number").try_cast("int")
    order = Window.partitionBy("doc_id", "kind").orderBy("float_id")
    return floats.withColumn("n", n).filter("n IS NOT NULL").withColumn("before", F.lag("n").over(order)).filter("before IS NOT NULL AND n <> before + 1").select("doc_id", "kind", "float_id", "n", "before")


def numbering_order(citations: DataFrame) -> DataFrame:
    """Numeric citations whose first number is more than one above all before it in the document."""
    n = citations.filter("style = 'numeric'").withColumn("n", F.get("keys", 0).try_cast("int"))
    top = F.max("n").over(in_document("start").rowsBetween(Window.unboundedPreceding, -1))
    return n.withColumn("top", F.coalesce(top, F.lit(0))).filter("n > top + 1").select("doc_id", "citation_id", "n", "top")


def metadata_diff(left: DataFrame, right: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """(key, field, left_value, right_value) of the fields that differ; a row that one side lacks differs in each field that the other has."""
    a = left.select(*key, *(F.col(f).cast("string").alias(f"l_{f}") for f in fields))
    b = right.select(*key, *(F.col(f).cast("string").alias(f"r_{f}") for f in fields))
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"l_{f}").alias("left_value"), F.col(f"r_{f}").alias("right_value")) for f in fields))
    return a.join(b, key, "full").select(*key, F.explode(pairs).alias("d")).select(*key, "d.*").filter(~F.col("left_value").eqNullSafe(F.col("right_value")))


def source_profile(refs: DataFrame, this_year: int) -> DataFrame:
    """(doc_id, references, mean_age, doi_share, newest) of each bibliography."""
    return refs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("references"), F.round(F.avg(this_year - F.col("year")), 2).alias("mean_age"), F.round(F.avg(F.col("doi").isNotNull().cast("double")), 3).alias("doi_share"), F.max("year").alias("newest"))


def stylometry(texts: DataFrame, min_words: int = 150, function_words: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, words, type_token_ratio, function_share, burstiness, enough): burstiness is the deviation of sentence lengths over their mean."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))
    sentences = F.filter(F.transform(F.split("text", r"[.!?]+"), lambda s: F.size(F.regexp_extract_all(s, F.lit(r"(\p{L}+)"), F.lit(1)))), lambda n: n > 0)
    row = texts.select("doc_id", words.alias("w"), sentences.alias("s"))
    n, count = F.size("w"), F.size("s")
    mean = F.aggregate("s", F.lit(0.0), lambda t, x: t + x) / count
    spread = F.sqrt(F.aggregate("s", F.lit(0.0), lambda t, x: t + (x - mean) * (x - mean)) / count)
    share = F.size(F.filter("w", lambda x: x.isin(*function_words))) / n if function_words else F.lit(0.0)
    return row.select(
        "doc_id", n.alias("words"), F.when(n > 0, F.round(F.size(F.array_distinct("w")) / n, 4)).alias("type_token_ratio"), F.when(n > 0, F.round(share, 4)).alias("function_share"),
        F.when(count > 0, F.round(spread / mean, 4)).alias("burstiness"), (n >= min_words).alias("enough"),
    )


def _by_score(scored: DataFrame) -> DataFrame:
    """(score, p, n, below_p, below_n): labels of each score, and of all lower ones.

    Ranges of scores are summed apart; only one row a range is ordered in one task.
    """
    by = scored.groupBy("score").agg(F.sum("label").cast("double").alias("p"), F.sum(1 - F.col("label")).cast("double").alias("n"))
    ranged = stored(by.repartitionByRange("score").withColumn("part", F.spark_partition_id()), "score-ranges")
    sums = ranged.groupBy("part").agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    sums = sums.select("part", F.coalesce(F.sum("all_p").over(over), zero).alias("part_p"), F.coalesce(F.sum("all_n").over(over), zero).alias("part_n"))
    inside = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = lambda c: F.col(f"part_{c}") + F.coalesce(F.sum(c).over(inside), zero)
    return ranged.join(sums, "part").select("score", "p", "n", below("p").alias("below_p"), below("n").alias("below_n"))


def auroc(scored: DataFrame) -> DataFrame:
    """(positives, negatives, auroc) of (score, label): from counts by score, so equal scores share their rank and no row is sorted twice."""
    wins = _by_score(scored)
    return wins.agg(F.sum("p").cast("long").alias("positives"), F.sum("n").cast("long").alias("negatives"), F.round(F.sum(F.col("p") * (F.col("below_n") + F.col("n") / 2)) / (F.sum("p") * F.sum("n")), 6).alias("auroc"))


def tpr_at_fpr(scored: DataFrame, fpr: float = 0.01) -> DataFrame:
    """(threshold, tpr): the lowest threshold whose share of false positives is at most fpr."""
    curve = _by_score(scored)
    total = scored.agg(F.sum("label").cast("double").alias("all_p"), F.sum(1 - F.col("label")).cast("double").alias("all_n"))  # one row
    kept = curve.join(total).filter(F.col("all_n") - F.col("below_n") <= fpr * F.col("all_n"))
    return kept.agg(F.min("score").alias("threshold"), F.round(F.max((F.col("all_p") - F.col("below_p")) / F.col("all_p")), 6).alias("tpr"))


def calibration_error(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(ece): the mean gap of score and label over equal bins of score, weighted by rows."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    per = scored.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg("score") - F.avg("label")).alias("gap"))
    return per.agg(F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece"))


def merge_findings(findings: DataFrame) -> DataFrame:
    """Findings of one rule family (rule_id up to its first dot) whose spans overlap become one of the highest severity."""
    rank = F.element_at(F.create_map(*(x for i, s in enumerate(SEVERITY_WEIGHT) for x in (F.lit(s), F.lit(i)))), F.col("severity"))
    base = findings.withColumn("family", F.substring_index("rule_id", ".", 1)).withColumn("rank", rank)
    order = Window.partitionBy("doc_id", "family").orderBy("start", "end", "rule_id")
    apart = ~overlaps(F.col("start"), F.col("end"), F.lit(-1), F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    island = F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return base.withColumn("island", island).groupBy("doc_id", "family", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max_by("severity", "rank").alias("severity"), F.count(F.lit(1)).alias("merged")).drop("island")


def scores(findings: DataFrame, weights: dict[str, float] = SEVERITY_WEIGHT, left_out: tuple[str, ...] = ("aigt",)) -> DataFrame:
    """(doc_id, module, penalty) by module; modules left out never count."""
    w = F.element_at(F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(v)))), F.col("severity"))
    return findings.filter(~F.col("module").isin(*left_out)).groupBy("doc_id", "module").agg(F.sum(w).alias("penalty"))


def to_recheck(segments: DataFrame, cache: DataFrame, module: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(segments to analyse, cached results) by the hash of text, module and version."""
    keyed = segments.withColumn("cache_key", F.sha2(F.concat_ws("\0", "text", F.lit(module), F.lit(version)), 256))
    return keyed.join(cache.select("cache_key"), "cache_key", "left_anti"), keyed.join(cache, "cache_key")
