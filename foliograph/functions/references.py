"""Bibliography entries as fields, in Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions.text import clean, strip_quotes

# The shapes of identifiers and names in entries.
YEAR = r"1[6-9]\d{2}|20\d{2}"
DOI = r"(?U)\b(10\.\d{4,9}/[^\s,;„”\"'\)\]]+)"
URL = r"(?U)\b(https?://[^\s,;„”\"'\)\]>]+)"
ARXIV = r"(?iU)\barXiv:\s*(\d{4}\.\d{4,5})"
PAGES = r"(?U)\b(?:s\.?|pp?\.?|str\.?)\s*([\dIVXLC]+)\s*[-–—]\s*([\dIVXLC]+)"
LEADING_INDEX = r"^\s*[\[\(]?\d{1,3}[\]\).,]\s*"
NOISE = r"(?iU)^\b(?:ISBN|ISSN|vol\.?|nr\.?|no\.?|tom|wyd\.?|ed\.?|s\.?|pp?\.?)\b$"
NAME_SHAPE = r"(?U)^[A-ZĄĆĘŁŃÓŚŹŻ][\w'’\-]*(\s+[A-ZĄĆĘŁŃÓŚŹŻ]\.?)"
BRACKETED_YEAR = r"[\(\[]\s*((?:1[6-9]|20)\d{2})[a-z]?\s*[\)\]]"
MAX_AUTHORS, MAX_VENUE = 6, 160

FIELDS = ("authors", "title", "year", "venue", "doi", "url")


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _stripped(text: Column, chars: str) -> Column:
    return F.regexp_replace(text, f"^[{chars}]+|[{chars}]+$", "")


def body(raw: Column) -> Column:
    return F.regexp_replace(clean(raw), LEADING_INDEX, "")


def doi(text: Column) -> Column:
    return F.regexp_replace(_found(text, DOI), r"\.+$", "")


def url(text: Column) -> Column:
    arxiv = _found(text, ARXIV)
    return F.coalesce(F.regexp_replace(_found(text, URL), r"[.,;]+$", ""), F.concat(F.lit("https://arxiv.org/abs/"), arxiv))


def year(text: Column) -> Column:
    """A bracketed year, else the first one."""
    return F.coalesce(_found(text, BRACKETED_YEAR), _found(text, rf"(?U)\b({YEAR})\b")).cast("int")


def pages(raw: Column) -> Column:
    return F.when(F.regexp_like(raw, F.lit(PAGES)), F.struct(F.regexp_extract(raw, PAGES, 1).alias("first"), F.regexp_extract(raw, PAGES, 2).alias("last")))


def split_authors(whole: Column, anded: Column) -> Column:
    """At semicolons, else at and/or/i/&, else at commas between names; otherwise one name. whole: the clean list; anded: with semicolons for these words."""
    parts = lambda t: F.filter(F.transform(F.split(t, ";"), lambda p: _stripped(p, " .,")), lambda p: p != "")
    chunks = F.transform(F.split(anded, ","), lambda p: _stripped(p, " ."))
    named = lambda cs: F.when((F.size(cs) > 1) & F.forall(cs, lambda p: (p == "") | p.rlike(NAME_SHAPE)), F.filter(cs, lambda p: p != "")).otherwise(F.array(anded))
    several = lambda first, second: F.when(whole.contains(";") & (F.size(first) > 1), first).when(anded.contains(";") & (F.size(second) > 1), second)
    return F.when(whole == "", F.array().cast("array<string>")).otherwise(F.coalesce(several(parts(whole), parts(anded)), named(chunks)))


def _anded(whole: Column) -> Column:
    return F.regexp_replace(whole, r"(?i)\s+(?:and|or|i|&)\s+", "; ")


def with_fields(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """df with the fields of the entries in raw_col and their confidence.

    A title is what stands between the first colon and the year, or the second sentence. The steps
    are projections of their own, so no expression is copied into all that use it.
    """
    c, none, empty = F.col, F.lit(None).cast("string"), F.array().cast("array<string>")
    kept = df.columns
    step = df.withColumn("__t", body(F.coalesce(c(raw_col), F.lit(""))))
    step = step.withColumns({"__y": _found(c("__t"), BRACKETED_YEAR), "__p": _found(c("__t"), rf"(?U)\b({YEAR})\b"), "doi": doi(c("__t")), "url": url(c("__t"))})
    head = F.when(c("__y").isNotNull(), F.regexp_extract("__t", rf"(?s)^(.*?){BRACKETED_YEAR}", 1)).when(c("__p").isNotNull(), F.regexp_extract("__t", rf"(?sU)^(.*?)\b({YEAR})\b", 1)).otherwise(c("__t"))
    step = step.withColumns({"year": F.coalesce("__y", "__p").cast("int"), "__head": head})
    step = step.withColumns({"__tail": F.substring(c("__t"), F.length("__head") + 1, F.length("__t")), "__blob": F.substring_index("__head", ":", 1)})
    chunks = F.filter(F.transform(F.split("__head", r"\."), lambda x: F.trim(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))), lambda x: x != "")
    step = step.withColumns({
        "__rest": F.when(F.contains("__head", F.lit(":")), F.substring(c("__head"), F.length("__blob") + 2, F.length("__head"))).otherwise(""), "__whole": clean("__blob"), "__chunks": chunks,
        "__after": _stripped(F.regexp_replace("__tail", r"^[\(\[]?\s*\d{4}[a-z]?\s*[\)\]]?", ""), r" .,;:"),
    })
    step = step.withColumns({"__anded": _anded(c("__whole")), "__w0": clean(F.coalesce(F.get("__chunks", 0), F.lit("")))})
    step = step.withColumns({"__names": split_authors(c("__whole"), c("__anded")), "__anded0": _anded(c("__w0"))})
    many = F.size("__names") > MAX_AUTHORS
    rest = F.when(many, clean(F.when(c("__rest") != "", F.concat("__blob", F.lit(": "), "__rest")).otherwise(c("__blob")))).otherwise(c("__rest"))
    step = step.withColumns({"__title": strip_quotes(clean(rest)), "__authors": F.when(many, empty).otherwise(c("__names")), "__venue": clean(F.get(F.split("__after", "[.;]"), 0))})
    sentences = (c("__title") == "") & (F.size("__chunks") >= 2)
    third = F.nullif(clean(F.array_join(F.slice("__chunks", F.lit(3), F.greatest(F.size("__chunks") - 2, F.lit(0))), ".")), F.lit(""))
    named = F.when(sentences & (F.size("__authors") == 0), split_authors(c("__w0"), c("__anded0"))).otherwise(c("__authors"))
    title = F.when(c("__title") != "", c("__title")).otherwise(strip_quotes(F.coalesce(F.get("__chunks", F.when(F.size("__chunks") >= 2, 1).otherwise(0)), F.lit(""))))
    venue = F.coalesce(F.when(sentences, third), F.when((c("__venue") != "") & (F.length("__venue") < MAX_VENUE), c("__venue")))
    step = step.withColumns({"authors": named, "title": F.nullif(title, F.lit("")), "__v": venue})
    repeats = F.coalesce(F.lower("title").contains(F.lower("__v")) & (F.size(F.split("__v", r"\s+")) <= 2), F.lit(False))
    step = step.withColumn("venue", F.when(~repeats & ~c("__v").rlike(NOISE), c("__v")).otherwise(none))
    return step.withColumn("confidence", confidence(c("authors"), c("title"), c("year"), c("venue"), c("doi"))).select(*kept, *FIELDS, "confidence")


def confidence(authors: Column, title: Column, year_: Column, venue: Column, doi_: Column) -> Column:
    """The share of the fields that a resolver needs."""
    has = lambda c, w: F.when(c, F.lit(w)).otherwise(0.0)
    return F.round(has(title.isNotNull(), 0.35) + has(F.size(authors) > 0, 0.25) + has(year_.isNotNull(), 0.2) + has(doi_.isNotNull(), 0.15) + has(venue.isNotNull(), 0.05), 2)
