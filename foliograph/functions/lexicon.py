"""Classification lexicons."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliograph.functions.text import heading_key

# Section kinds in order of precedence, with the words that name them.
SECTION_LEXICON = {
    "title_page": ("politechnika", "uniwersytet", "university of technology", "wydzial", "faculty of", "praca dyplomowa", "praca magisterska", "praca inzynierska", "kierunek studiow", "thesis title"),
    "statement": ("oswiadczenie", "declaration of authorship", "authors declaration", "swiadectwo oryginalnosci", "statement of originality"),
    "abstract_pl": ("streszczenie", "streszczenie pracy", "slowa kluczowe"),
    "abstract_en": ("abstract", "summary of the thesis", "keywords"),
    "toc": ("spis tresci", "spis zawartosci", "table of contents", "contents", "spis rysunkow", "list of figures", "spis tabel", "list of tables", "spis skrotow", "list of abbreviations", "wykaz skrotow"),
    "bibliography": ("bibliografia", "literatura", "spis literatury", "references", "bibliography", "works cited", "zrodla"),
    "appendix": ("dodatek", "dodatki", "zalacznik", "zalaczniki", "appendix", "appendices", "supplementary"),
    "introduction": ("wstep", "wprowadzenie", "introduction", "cel i zakres pracy", "cel pracy", "scope of the thesis", "problem statement"),
    "literature_review": ("przeglad literatury", "stan wiedzy", "stan techniki", "literature review", "related work", "background", "podstawy teoretyczne", "teoria", "czesc teoretyczna", "theoretical"),
    "methodology": ("metodyka", "metodologia", "methodology", "methods", "materialy i metody", "materials and methods", "projekt", "design", "implementacja", "implementation", "narzedzia", "tools", "srodowisko"),
    "results": ("wyniki", "results", "eksperymenty", "experiments", "ewaluacja", "evaluation", "badania", "analiza wynikow", "discussion", "dyskusja", "testy", "testing", "veryfikacja", "verification"),
    "summary": ("podsumowanie", "zakonczenie", "wnioski", "conclusion", "conclusions", "summary and conclusions", "concluding remarks", "future work", "kierunki dalszych prac"),
}
SECTION_REASON = {"title_page": "front_matter", "statement": "front_matter", "abstract_pl": "front_matter", "abstract_en": "front_matter", "toc": "toc", "bibliography": "bibliography", "appendix": "appendix"}
BLOCK_REASON = {"code": "code", "quote": "quote"}
FRONT_MATTER = ("statement", "abstract_pl", "abstract_en", "toc", "introduction", "bibliography")
CITATION_TYPES = ("paragraph", "list_item", "quote", "caption", "bibitem")
SEGMENT_TYPES = ("paragraph", "list_item", "caption", "bibitem", "quote")
FLOAT_SCAN_TYPES = ("paragraph", "list_item", "quote", "caption", "heading")
ENTRY_TYPES = ("bibitem", "paragraph", "list_item")
LANGUAGE_TYPES = ("paragraph", "list_item", "quote")
# Names of styles and fonts in word-processor files, in Polish and English.
CAPTION_STYLES = ("caption", "caption text", "legenda", "tekst legendy", "napis", "podpis")
QUOTE_STYLES = ("quote", "cytat", "intense quote", "cytat intensywny", "block text", "blok tekstowy", "block quote", "block quotation")
LIST_STYLES = ("list paragraph", "akapit listy", "list bullet", "list number", "lista punktowana", "lista numerowana", "list continue")
CODE_HINTS = ("code", "kod", "listing", "verbatim", "preformatted", "html")
TOC_HINTS = ("toc", "spis treści", "spis tresci", "table of contents", "contents")
TITLE_STYLES = ("title", "tytuł", "tytul")
SUBTITLE_STYLES = ("subtitle", "podtytuł", "podtytul")
MONOSPACE = ("courier", "courier new", "consolas", "menlo", "monaco", "lucida console", "dejavu sans mono", "liberation mono", "andale mono", "inconsolata", "fira code", "source code pro")
MATH_FONTS = ("math", "cmmi", "cmsy", "cmex", "msam", "msbm", "rsfs", "euscript", "symbol")
# Page sizes in cm.
PAGE_SIZES = (("A4", 21.0, 29.7), ("A5", 14.8, 21.0), ("Letter", 21.59, 27.94), ("B5", 17.6, 25.0))


def first_case(cases: list[tuple[Column, str]]) -> Column:
    """The value of the first condition that holds, else null."""
    return functools.reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), F.lit(None).cast("string"))


def section_kind(title: str | Column, fold_l: bool = False) -> Column:
    """The kind that a heading names: as its first words, else anywhere; null if none. The lexicon is one literal, so no join is needed."""
    lex = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("needle")) for kind, needles in SECTION_LEXICON.items() for n in needles))

    def of(key: Column) -> Column:
        start = F.filter(lex, lambda x: (key == x.needle) | key.startswith(F.concat(x.needle, F.lit(" "))) | key.startswith(F.concat(x.needle, F.lit(","))))
        inside = F.filter(lex, lambda x: key.contains(x.needle))
        return F.when(key != "", F.coalesce(F.get(start, 0).kind, F.get(inside, 0).kind))

    return F.get(F.transform(F.array(heading_key(title, fold_l)), of), 0)  # binds the key once


def mapped(values: dict[str, str], of: Column) -> Column:
    return first_case([(of == k, v) for k, v in values.items()])


def page_size(width: Column, height: Column, tolerance: float = 0.4) -> Column:
    """The name of a page size in cm, or WxHcm."""
    near = [((F.abs(width - w) <= tolerance) & (F.abs(height - h) <= tolerance), name) for name, w, h in PAGE_SIZES]
    return F.coalesce(first_case(near), F.format_string("%.1fx%.1fcm", width, height))
