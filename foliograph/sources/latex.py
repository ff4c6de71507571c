"""LaTeX projects: a tokenizer and renderer for a fixed set of macros; levels, labels and citations are linked in SQL."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from foliograph.config import Settings
from foliograph.functions import references
from foliograph.functions.text import strip_macros
from foliograph.operators.blocks import with_offsets
from foliograph.sources import bibtex

# Macros and environments by what they do.
CITE = set("cite citep citet citealp citealt citeauthor citeyear autocite parencite textcite footcite smartcite supercite nocite Citep Citet Autocite Parencite Textcite Cite".split())
REF = set("ref eqref pageref cref Cref autoref labelcref vref".split())
SKIP = set(
    "label index includegraphics bibliographystyle bibliography addbibresource printbibliography addcontentsline setcounter newpage clearpage pagebreak linebreak hspace vspace smallskip medskip bigskip noindent centering raggedright raggedleft maketitle"
    " titlepage input include subfile includeonly graphicspath tableofcontents listoffigures listoftables appendix markboth markright thispagestyle pagestyle phantom".split()
)
FOOTNOTE = {"footnote", "footnotetext"}
LITERAL = {
    "LaTeX": "LaTeX", "TeX": "TeX", "LaTeXe": "LaTeX2e", "S": "§", "P": "¶", "dots": "…", "ldots": "…", "cdots": "…", "textellipsis": "…", "textbackslash": "\\", "textendash": "–", "textemdash": "—", "textquotesingle": "'",
    "textquotedblleft": "„", "textquotedblright": "”", "textquoteleft": "‚", "textquoteright": "’", "textdegree": "°", "texttimes": "×", "textpm": "±", "textapprox": "≈", "texteuro": "€",
    "%": "%", "&": "&", "#": "#", "$": "$", "_": "_", "{": "{", "}": "}", " ": " ", ",": " ", ";": " ", ":": " ", "!": "", "\\": " ", "AA": "Å", "aa": "å", "AE": "Æ", "ae": "æ", "OE": "Œ", "oe": "œ", "ss": "ß", "l": "ł", "L": "Ł", "o": "ø", "O": "Ø",
}
LEVELS = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "subparagraph": 6}
FIGURES = {"figure", "figure*", "wrapfigure", "subfigure"}
TABLES = {"table", "table*", "wraptable", "longtable", "tabular", "tabularx"}
CODE = {"lstlisting", "verbatim", "Verbatim", "minted", "lstlisting*", "alltt", "spverbatim"}
QUOTES = {"quote", "quotation", "verse", "csquote", "displayquote"}
LISTS = {"itemize", "enumerate", "description", "compactitem", "compactenum"}
MATH = set("equation equation* align align* gather gather* multline multline* eqnarray eqnarray* displaymath math flalign flalign* alignat alignat* subequations IEEEeqnarray".split())
TOC = {"tableofcontents", "listoffigures", "listoftables"}

_TOKEN = re.compile(r"\\begin\s*\{([^}]*)\}|\\end\s*\{([^}]*)\}|\\([a-zA-Z@]+)(\*?)|\\(.)|(\$\$?)|([{}])|(%[^\n]*\n?)|(\n\s*\n)", re.DOTALL)
_INCLUDE = re.compile(r"\\(?:input|include|subfile)\s*\{([^}]+)\}")
RAW = (
    "doc_id string, ordinal int, type string, base_level int, text string, line int, file string, flags array<string>, number string, caption string, labels array<string>, refs array<string>,"
    " cites array<struct<raw:string,keys:array<string>,start:int,end:int>>, bib_key string, is_chapter boolean, meta string, warning string, error string"
)


@dataclass
class Rendered:
    text: str = ""
    cites: list[dict] = field(default_factory=list)
    refs: list[str] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)


def without_comments(text: str) -> str:
    return re.sub(r"(?<!\\)%[^\n]*", "", text)


def group_end(text: str, at: int, pair: str = "{}") -> int:
    """The place after the group that opens at `at`, or the text's end."""
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 1
        elif c == pair[0]:
            depth += 1
        elif c == pair[1]:
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return len(text)


def arguments(text: str, at: int) -> tuple[list[str], list[str], int]:
    """(optional, braced) arguments from `at` on, and where they end."""
    optional, braced = [], []
    while True:
        m = re.compile(r"[ \t]*\n?[ \t]*").match(text, at)
        nxt = m.end() if m else at
        if nxt < len(text) and text[nxt] == "{":
            end = group_end(text, nxt)
            braced.append(text[nxt + 1 : end - 1])
        elif nxt < len(text) and text[nxt] == "[" and nxt == at and not braced:
            end = group_end(text, nxt, "[]")
            optional.append(text[nxt + 1 : end - 1])
        else:
            return optional, braced, at
        at = end


class Renderer:
    """LaTeX as running text: blanks collapse while it is written, so the places of citations hold."""

    def __init__(self):
        self.out = Rendered()

    def write(self, text: str) -> None:
        for c in re.split(r"(\s+)", text):
            if not c.isspace():
                self.out.text += c
            elif self.out.text and not self.out.text.endswith(" "):
                self.out.text += " "

    def render(self, text: str) -> Rendered:
        self.walk(text)
        self.out.text = self.out.text.rstrip()
        return self.out

    def walk(self, text: str) -> None:
        at = 0
        while m := _TOKEN.search(text, at):
            self.plain(text[at : m.start()])
            at = m.end()
            if m[8]:
                continue
            if m[3]:
                at = self.macro(m[3], text, at)
            elif m[5]:
                self.write(LITERAL.get(m[5], ""))
            elif m[6]:
                end = text.find(m[6], at)
                end = len(text) if end < 0 else end
                self.write(text[at:end])
                at = end + len(m[6])
            elif m[9]:
                self.write(" ")
        self.plain(text[at:])

    def plain(self, text: str) -> None:
        self.write(text.replace("~", " ").replace("---", "—").replace("--", "–").replace("``", "„").replace("''", "”").replace(",,", "„"))

    def macro(self, name: str, text: str, at: int) -> int:
        if name in LITERAL:
            self.write(LITERAL[name])
            return at + (text[at : at + 2] == "{}") * 2
        _, braced, end = arguments(text, at)
        if name in CITE:
            keys = [k.strip() for k in (braced[-1] if braced else "").split(",") if k.strip()]
            if name != "nocite" and keys:
                start = len(self.out.text)
                self.write(f"[{', '.join(keys)}]")
                self.out.cites.append({"raw": f"\\{name}{{{', '.join(keys)}}}", "keys": keys, "start": start, "end": len(self.out.text)})
            return end
        if name in REF:
            for label in (braced[0] if braced else "").split(","):
                self.out.refs.append(label.strip())
            self.write(braced[0] if braced else "")
            return end
        if name == "label":
            self.out.labels += braced[:1]
            return end
        if name in FOOTNOTE:
            self.out.notes += braced[:1]
            return end
        if name not in SKIP and braced:  # known text macros and unknown ones alike keep their last argument
            self.walk(braced[-1])
        elif not braced:
            return at
        return end


def _labels(text: str) -> list[str]:
    return re.findall(r"\\label\s*\{([^}]*)\}", text)


class Parser:
    """Blocks of one project."""

    def __init__(self):
        self.rows: list[dict] = []
        self.warnings: list[str] = []

    def add(self, kind: str, text: str, unit: str, line: int, r: Rendered | None = None, **more) -> None:
        r = r or Rendered()
        self.rows.append({"type": kind, "text": text, "file": unit, "line": line, "labels": r.labels, "refs": r.refs, "cites": r.cites} | more)
        for note in r.notes:
            n = Renderer().render(note)
            if n.text:
                self.add("footnote", n.text, unit, line, n)

    def unit(self, path: str, source: str) -> None:
        text = re.sub(r"(?<!\\)%[^\n]*", lambda m: " " * len(m[0]), source)  # places stay those of the file
        start = text.find("\\begin{document}")
        stop = text.find("\\end{document}")
        a = start + len("\\begin{document}") if start >= 0 else 0
        self.body(text[a : stop if stop >= 0 else len(text)], path, source, a)

    def body(self, text: str, path: str, whole: str, offset: int) -> None:
        line = lambda at: whole.count("\n", 0, offset + at) + 1
        at = begun = 0

        def flush(end: int) -> None:
            for part in re.finditer(r"(?:(?!\n[ \t]*\n).)+", text[begun:end], re.DOTALL):
                r = Renderer().render(part[0])
                if r.text:
                    lead = len(part[0]) - len(part[0].lstrip())
                    self.add("paragraph", r.text, path, line(begun + part.start() + lead), r)

        while m := _TOKEN.search(text, at):
            at = m.end()
            if m[3] in LEVELS:
                flush(m.start())
                optional, braced, at = arguments(text, at)
                r = Renderer().render(braced[-1] if braced else "")
                if r.text:
                    follow = re.compile(r"\s*\\label\s*\{([^}]*)\}").match(text, at)
                    r.labels += [follow[1]] if follow else []
                    self.add("heading", r.text, path, line(m.start()), r, base_level=LEVELS[m[3]], is_chapter=m[3] in ("chapter", "part"), flags=["starred"] if m[4] else [])
                else:
                    self.warnings.append(f"empty heading at {path}:{line(m.start())}")
                begun = at
            elif m[3] in TOC:
                self.warnings.append(f"\\{m[3]} has no text of its own")
            elif m[1] is not None:
                name = m[1]
                end, stop = self.environment_end(text, m.end(), name)
                if name in CODE | QUOTES | LISTS | MATH | FIGURES | TABLES | {"abstract", "thebibliography"}:
                    flush(m.start())
                    self.environment(name, text[m.end() : end], path, line(m.start()), whole, offset + m.end())
                    begun = at = stop
            elif m[2] is not None or m[8]:
                continue
        flush(len(text))

    @staticmethod
    def environment_end(text: str, at: int, name: str) -> tuple[int, int]:
        depth = 1
        for m in re.compile(rf"\\(begin|end)\s*\{{{re.escape(name)}\}}").finditer(text, at):
            depth += 1 if m[1] == "begin" else -1
            if not depth or (name in CODE and m[1] == "end"):
                return m.start(), m.end()
        return len(text), len(text)

    def environment(self, name: str, body: str, path: str, line: int, whole: str, offset: int) -> None:
        if name in CODE:
            code = re.sub(r"^\s*(?:\[[^\]]*\])?(?:\{[^}]*\})?[ \t]*\n", "", whole[offset : offset + len(body)] if len(whole) >= offset + len(body) else body)
            self.add("code", code.strip("\n"), path, line)
        elif name in QUOTES:
            r = Renderer().render(body)
            self.add("quote", r.text, path, line, r)
        elif name in LISTS:
            for item in re.split(r"\\item\b", body)[1:]:
                r = Renderer().render(re.sub(r"^\s*\[([^\]]*)\]", r"\1 ", item))
                if r.text:
                    self.add("list_item", r.text, path, line, r)
        elif name in MATH:
            tag = re.search(r"\\tag\*?\s*\{([^}]*)\}", body)
            text = " ".join(re.sub(r"\\(?:label|tag\*?)\s*\{[^}]*\}", "", body).split())
            self.add("equation", text, path, line, Rendered(labels=_labels(body)), number=tag[1] if tag else None)
        elif name in FIGURES | TABLES:
            caption = re.search(r"\\caption(?:of\s*\{[^}]*\})?\s*(?:\[[^\]]*\])?\s*\{", body)
            kind = "table" if name in TABLES else "figure"
            labels, r = _labels(body), None
            if caption:
                end = group_end(body, caption.end() - 1)
                r = Renderer().render(body[caption.end() : end - 1])
                body = body[: caption.start()] + body[end:]
            if kind == "table":
                rows = re.sub(r"\\(?:begin|end)\s*\{[^}]*\}(?:\[[^\]]*\])?(?:\{[^}]*\})?|\\(?:hline|toprule|midrule|bottomrule)", "", body)
                cells = [[Renderer().render(c).text for c in re.split(r"(?<!\\)&", row)] for row in re.split(r"\\\\", rows)]
                text = "\n".join(x for row in cells if (x := "\t".join(row).strip()))
                if text:
                    self.add("table", text, path, line)
            self.add("caption" if r else kind, r.text if r else "", path, line, Rendered(r.text, r.cites, r.refs, labels, r.notes) if r else Rendered(labels=labels), caption=r.text if r else None, flags=[kind])
        elif name == "abstract":
            self.add("heading", "Abstract", path, line, base_level=2, is_chapter=False, flags=["synthetic"])
            self.body(body, path, whole, offset)
        else:
            for m in re.finditer(r"\\bibitem\s*(?:\[[^\]]*\])?\s*\{([^}]*)\}((?:(?!\\bibitem).)*)", body, re.DOTALL):
                self.add("bibitem", " ".join(m[2].split()), path, line, bib_key=m[1].strip())


def resolve(name: str, files: set[str], extensions: tuple[str, ...] = (".tex",)) -> str | None:
    """An included file's path within the project; null for absolute paths, those that leave it, and missing files."""
    name = name.strip()
    if not name or name.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", name):
        return None
    path = posixpath.normpath(name)
    return next((p for p in (path, *(path + e for e in extensions)) if p in files and p.endswith(extensions)), None)


def collect(files: dict[str, str], main: str, settings: Settings) -> tuple[list[str], list[str]]:
    """(files to read, warnings): the main file and what it includes, breadth first, each once, down to the depth limit."""
    order, warnings, queue = [], [], [(main, 0)]
    while queue:
        path, depth = queue.pop(0)
        if path in order:
            warnings.append(f"included again: {path}")
            continue
        if len(order) >= settings.max_tex_files or depth > settings.max_include_depth:
            warnings.append(f"include limit reached at {path}")
            continue
        order.append(path)
        for name in _INCLUDE.findall(without_comments(files[path])):
            found = resolve(name, set(files))
            if found:
                queue.append((found, depth + 1))
            else:
                warnings.append(f"include refused or missing: {name.strip()}")
    return order, warnings


def preamble(text: str) -> dict:
    """Class, options, packages, title and author of a main file."""
    head = without_comments(text.split("\\begin{document}")[0])
    cls = re.search(r"\\documentclass\s*(?:\[([^\]]*)\])?\s*\{([^}]*)\}", head)
    packages = [p.strip() for m in re.findall(r"\\usepackage\s*(?:\[[^\]]*\])?\s*\{([^}]*)\}", head) for p in m.split(",")]
    one = lambda n: (lambda m: Renderer().render(head[m.end() - 1 : group_end(head, m.end() - 1)]).text if m else None)(re.search(rf"\\{n}\s*\{{", head))
    return {"documentclass": cls[2] if cls else None, "options": [o.strip() for o in (cls[1] or "").split(",") if o.strip()] if cls else [], "packages": packages, "title": one("title"), "author": one("author")}


def bibliographies(files: dict[str, str], main_text: str, settings: Settings) -> list[str]:
    """The .bib files that the main file names, else the first few at the root."""
    named = [n for m in re.findall(r"\\(?:bibliography|addbibresource)\s*\{([^}]*)\}", without_comments(main_text)) for n in m.split(",")]
    found = [p for n in named if (p := resolve(n, set(files), (".bib",)))]
    return found or sorted(p for p in files if p.endswith(".bib") and "/" not in p)[: settings.max_bib_files]


def read(files: dict[str, str], main: str, settings: Settings) -> list[dict]:
    """Raw rows of one project: blocks, then bib entries, the preamble and warnings as rows of their own."""
    if sum(p.endswith(".tex") for p in files) > settings.max_tex_files:
        return [{"error": "resource_limit"}]
    parser = Parser()
    order, warnings = collect(files, main, settings)
    for path in order:
        parser.unit(path, files[path])
    rows = [r | {"ordinal": i} for i, r in enumerate(parser.rows)]
    for path in bibliographies(files, files[main], settings):
        rows += [{"type": "bibentry", "text": json.dumps(bibtex.parsed(e)), "bib_key": e["key"], "file": path, "ordinal": len(rows) + i} for i, e in enumerate(bibtex.entries(files[path]))]
    rows.append({"type": "meta", "meta": json.dumps(preamble(files[main]))})
    return rows + [{"type": "warning", "warning": w} for w in warnings + parser.warnings]


MAINS = ("main.tex", "master.tex", "thesis.tex", "praca.tex")


def raw_rows(files: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Raw rows of projects. files: doc_id, path (within the project), content (text). The limits bound what one project holds."""
    s = settings or Settings()
    schema = to_arrow_schema(T.StructType.fromDDL(RAW))
    capped = files.filter(F.length("content") <= s.max_upload_mb * 1024 * 1024)
    projects = capped.groupBy("doc_id").agg(F.collect_list(F.struct("path", "content")).alias("files"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, own in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                texts = {f["path"]: f["content"] or "" for f in own.as_py()}
                tex = sorted(p for p in texts if p.endswith(".tex"))
                main = next((m for m in MAINS if m in texts), next((p for p in tex if "\\documentclass" in texts[p]), tex[0] if tex else None))
                found = read(texts, main, s) if main else [{"error": "parse_error"}]
                rows += [{"doc_id": doc_id} | r for r in found]
            yield from pa.Table.from_pylist(rows, schema).to_batches()

    return projects.select("doc_id", "files").mapInArrow(run, RAW)


_BLOCKS = ("heading", "paragraph", "list_item", "table", "figure", "caption", "equation", "code", "quote", "footnote", "bibitem")


def blocks(raw: DataFrame) -> DataFrame:
    """The blocks table, with what links need: headings move up a level in documents without chapters."""
    rows = raw.filter(F.col("type").isin(*_BLOCKS))
    chapters = F.coalesce(F.max("is_chapter").over(Window.partitionBy("doc_id")), F.lit(False))
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.col("base_level") - F.when(chapters, 0).otherwise(1)))
    typed = rows.withColumn("level", F.when(F.col("type") == "heading", level)).withColumn("page", F.lit(None).cast("int")).withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))
    return with_offsets(typed.drop("base_level", "is_chapter", "meta", "warning", "error"))


def refs(raw: DataFrame) -> DataFrame:
    """References: entries of .bib files first, then bibitems; a key counts once."""
    entry = F.from_json("text", "authors array<string>, title string, year int, venue string, doi string, url string, raw string, confidence double")
    known = raw.filter("type = 'bibentry'").select("doc_id", "ordinal", "bib_key", F.lit(0).alias("pass"), entry.alias("e")).select("doc_id", "ordinal", "bib_key", "pass", "e.raw", "e.authors", "e.title", "e.year", "e.venue", "e.doi", "e.url", "e.confidence")
    items = references.with_fields(raw.filter("type = 'bibitem'").select("doc_id", "ordinal", "bib_key", F.lit(1).alias("pass"), strip_macros("text").alias("raw")))
    both = known.unionByName(items.select(*known.columns))
    once = both.withColumn("seen", F.row_number().over(Window.partitionBy("doc_id", "bib_key").orderBy("pass", "ordinal"))).filter("seen = 1")
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("pass", "ordinal"))
    return once.select("doc_id", at.alias("ordinal"), F.col("bib_key").alias("ref_id"), "raw", *references.FIELDS, "confidence")


def citations(found: DataFrame, references_: DataFrame) -> DataFrame:
    """The citations of blocks(), each linked by its first key."""
    each = found.select("doc_id", "block_id", F.col("start").alias("at"), F.explode("cites").alias("c")).select("doc_id", "block_id", "c.raw", "c.keys", (F.col("at") + F.col("c.start")).alias("start"), (F.col("at") + F.col("c.end")).alias("end"))
    keys = references_.select("doc_id", F.col("ref_id").alias("key"), "ref_id")
    linked = each.withColumn("key", F.get("keys", 0)).join(keys, ["doc_id", "key"], "left")
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("start"))
    return linked.select("doc_id", F.format_string("c%04d", at).alias("citation_id"), "raw", F.lit("bibtex_key").alias("style"), "keys", "block_id", "start", "end", "ref_id")


def label_links(found: DataFrame) -> DataFrame:
    """(doc_id, label, block_id): the blocks that refer to the label of a figure or table."""
    labels = found.filter(F.col("type").isin("figure", "table", "caption")).select("doc_id", F.explode("labels").alias("label"))
    said = found.select("doc_id", "block_id", F.explode("refs").alias("label"))
    return labels.join(said, ["doc_id", "label"]).dropDuplicates(["doc_id", "label", "block_id"])
