"""Text functions as Column expressions. All positions count code points."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Latin letters. Each maps to the letter it decomposes to; the letter l with
# stroke has no decomposition, and `fold_l` maps it too.
ACCENTED = "ąćęńóśźżàáâãäåçèéêëìíîïñòôõöùúûüýÿčďěňřšťůžőűșțāēīōūğş"
PLAIN = "".join(unicodedata.normalize("NFKD", c)[0] for c in ACCENTED)
LIGATURES = (("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb03", "ffi"), ("\ufb04", "ffl"), ("\ufb05", "st"), ("\ufb06", "st"))
QUOTE_PAIRS = (("„", "”"), ("“", "”"), ('"', '"'), ("'", "'"), ("«", "»"))
CAPTION = r"(?iu)^\s*(?:(Rys\.|Rysunek|Figure|Fig\.|Wykres|Schemat|Fot\.|Fotografia)|(Tab\.|Tabela|Table|Tablica))\s*\.?\s*([\dIVXL]+(?:[.\-][\dIVXL]+)*)"
BULLET = r"^\s*([•·◦‣⁃–—-]|\d{1,3}[.)]|[a-zA-Z][.)])\s+"
PDF_BULLET = r"^\s*([•·◦‣⁃▪–—-]|\d{1,3}[.)]|[a-zA-Z][.)])\s+"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_ws(text: str | Column) -> Column:
    """White space of any script collapsed to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(_col(text), r"(?U)\s+", " "))


def count_words(text: str | Column) -> Column:
    return F.size(F.filter(F.split(_col(text), r"(?U)\s+"), lambda w: w != ""))


def strip_accents(text: str | Column, fold_l: bool = False) -> Column:
    """Lower-case accented letters without their marks; combining marks dropped."""
    folded = F.translate(_col(text), ACCENTED + ("ł" if fold_l else ""), PLAIN + ("l" if fold_l else ""))
    return F.regexp_replace(folded, r"\p{Mn}+", "")


def heading_key(title: str | Column, fold_l: bool = False) -> Column:
    """A heading for the lexicon: lower case, no accents, punctuation or numbering."""
    text = F.regexp_replace(strip_accents(F.lower(F.trim(_col(title))), fold_l), r"(?U)[^\w\s%-]", " ")
    return F.trim(F.regexp_replace(normalise_ws(text), r"^[\d.)\s]*(rozdzial|chapter|czesc|part)?[\s\d.)]*", ""))


def metric_key(text: str | Column) -> Column:
    """A heading for comparison with annotations: numbering goes before punctuation does."""
    bare = F.regexp_replace(strip_accents(F.lower(F.trim(_col(text)))), r"^[\d.)\s]*(rozdzial|chapter)?[\s\d.)]*", "")
    return normalise_ws(F.regexp_replace(bare, r"(?U)[^\w\s%.-]", " "))


def clean(text: str | Column) -> Column:
    """White space collapsed, and blanks and `,;:.` stripped from both ends."""
    return F.regexp_replace(F.regexp_replace(_col(text), r"(?U)\s+", " "), r"^[ \t\n,;:.]+|[ \t\n,;:.]+$", "")


def strip_quotes(text: str | Column) -> Column:
    """One pair of enclosing quotation marks removed."""
    t = F.trim(_col(text))
    out = t
    for left, right in reversed(QUOTE_PAIRS):
        out = F.when(t.startswith(left) & t.endswith(right) & (F.length(t) > 2), F.trim(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(out)
    return out


def expand_ligatures(text: str | Column) -> Column:
    out = _col(text)
    for ligature, letters in LIGATURES:
        out = F.replace(out, F.lit(ligature), F.lit(letters))
    return out


def join_lines(lines: Column) -> Column:
    """An array of lines as one paragraph: soft hyphens dropped, a word broken at a hyphen before a lower-case letter rejoined."""
    shy = F.filter(F.transform(lines, lambda x: F.replace(x, F.lit("\u00ad"), F.lit(""))), lambda x: x != "")
    glue = lambda done, line: (
        F.when(done == "", line)
        .when(done.endswith("-") & line.rlike(r"^\p{Ll}"), F.concat(F.substring(done, F.lit(1), F.length(done) - 1), line))
        .otherwise(F.concat(done, F.lit(" "), line))
    )
    return normalise_ws(expand_ligatures(F.aggregate(shy, F.lit(""), glue)))


def prefix_score(needle: Column, hay: Column) -> Column:
    """The share of needle's words, from the first on, whose first four letters start hay's word at the same place."""
    words, found = F.split(needle, " "), F.split(hay, " ")
    same = F.zip_with(words, F.slice(found, F.lit(1), F.size(words)), lambda w, h: F.coalesce(h.startswith(F.substring(w, 1, 4)), F.lit(False)))
    leading = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, m: F.struct((s.n + (s.on & m).cast("int")).alias("n"), (s.on & m).alias("on")))
    return leading.n / F.size(words)


def looks_like_toc(text: str | Column) -> Column:
    """A line of a table of contents: dot leaders, or a page number after a tab or a wide gap."""
    t = F.trim(_col(text))
    return ~t.rlike(r"[.,;:]$") & (t != "") & (t.rlike(r"\.{4,}") | t.rlike(r"(\t| {2,})\d{1,4}$"))


def caption_kind(text: str | Column) -> Column:
    """figure, table or null."""
    t = _col(text)
    return F.when(F.regexp_extract(t, CAPTION, 1) != "", "figure").when(F.regexp_extract(t, CAPTION, 2) != "", "table")


def caption_number(text: str | Column) -> Column:
    return F.nullif(F.regexp_extract(_col(text), CAPTION, 3), F.lit(""))


def equation_number(text: str | Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(_col(text)), r"[(\[]\s*(\d+(?:\.\d+)*)\s*[)\]]\s*$", 1), F.lit(""))


def strip_macros(text: str | Column) -> Column:
    """LaTeX markup of a reference reduced to its words."""
    t = F.regexp_replace(_col(text), r"\\newblock\b", ". ")
    t = F.regexp_replace(t, r"\\[a-zA-Z]+\*?\s*\{([^{}]*)\}", "$1")
    return normalise_ws(F.regexp_replace(F.regexp_replace(t, r"\\[a-zA-Z]+\*?", " "), r"[{}]", ""))


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Half-open intervals that share a position."""
    return (other_start < end) & (start < other_end)


def span_text(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)
