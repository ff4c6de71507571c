"""Word-processor files: raw paragraph rows from the XML, classification in SQL."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from foliograph.functions import lexicon
from foliograph.functions import text as t
from foliograph.operators.blocks import in_document, with_offsets

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
RAW = (
    "doc_id string, ordinal int, kind string, text string, style_id string, style_name string, outline int, listed boolean, has_image boolean, has_math boolean, font string, size_pt double, bold boolean, italic boolean,"
    " line_spacing double, align string, indent_cm double, space_before_pt double, body_index int, pages int, margins_cm map<string,double>, page_size string, error string"
)
# Conversions of OOXML units.
TWIPS_PER_CM, ALIGN = 567.0, {"both": "justify", "start": "left", "end": "right"}
HEADING_STYLE = r"(?iu)^(?:heading|nag[łl][óo]wek)\s*([1-9])$"


class UnsafeXml(ValueError):
    pass


def _xml(raw: bytes | None) -> ET.Element | None:
    """Parse a part; a document type or entity declaration is refused before any parsing."""
    if raw is None:
        return None
    if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
        raise UnsafeXml("document type declaration")
    return ET.fromstring(raw)


def _value(el: ET.Element | None, path: str, attr: str = "val") -> str | None:
    found = el.find(path) if el is not None else None
    return None if found is None else found.get(W + attr)


def _number(text: str | None) -> float | None:
    try:
        return float(text) if text is not None else None
    except ValueError:
        return None


def _switch(el: ET.Element | None, tag: str) -> bool | None:
    found = el.find(W + tag) if el is not None else None
    return None if found is None else (found.get(W + "val") or "true").lower() not in ("0", "false", "none", "off")


def _run_properties(rpr: ET.Element | None, theme: dict[str, str]) -> dict:
    out: dict = {}
    if rpr is None:
        return out
    fonts = rpr.find(W + "rFonts")
    if fonts is not None:
        named = next((fonts.get(W + a) for a in ("ascii", "hAnsi", "cs") if fonts.get(W + a)), None)
        slot = next((fonts.get(W + a) for a in ("asciiTheme", "hAnsiTheme", "cstheme") if fonts.get(W + a)), "")
        out["font"] = named or theme.get(slot[:5])
    out["size_pt"] = None if (half := _number(_value(rpr, W + "sz"))) is None else half / 2
    out["bold"], out["italic"] = _switch(rpr, "b"), _switch(rpr, "i")
    return {k: v for k, v in out.items() if v is not None}


def _paragraph_properties(ppr: ET.Element | None) -> dict:
    out: dict = {}
    if ppr is None:
        return out
    align = _value(ppr, W + "jc")
    out["align"] = ALIGN.get(align, align) if align else None
    before = _number(_value(ppr, W + "spacing", "before"))
    out["space_before_pt"] = None if before is None else round(before / 20, 2)
    line, rule = _number(_value(ppr, W + "spacing", "line")), _value(ppr, W + "spacing", "lineRule")
    out["line_spacing"] = round(line / 240, 2) if line is not None and rule in (None, "auto", "multiple") else None
    first, chars = _number(_value(ppr, W + "ind", "firstLine")), _number(_value(ppr, W + "ind", "firstLineChars"))
    twips = int(chars * 5.67) if chars is not None and first is None else first
    out["indent_cm"] = None if twips is None else round(twips / TWIPS_PER_CM, 2)
    level = _number(_value(ppr, W + "outlineLvl"))
    out["outline"] = int(level) + 1 if level is not None and 0 <= level <= 5 else None
    return {k: v for k, v in out.items() if v is not None}


class Styles:
    """Styles with what they inherit: defaults, then the chain of basedOn from its root, which a cycle ends."""

    def __init__(self, root: ET.Element | None, theme: dict[str, str]):
        self.theme, self.by_id, self.default, self.base = theme, {}, None, {}
        if root is None:
            return
        self.base = _run_properties(root.find(f"{W}docDefaults/{W}rPrDefault/{W}rPr"), theme) | _paragraph_properties(root.find(f"{W}docDefaults/{W}pPrDefault/{W}pPr"))
        for s in root.findall(W + "style"):
            key = s.get(W + "styleId") or ""
            own = _run_properties(s.find(W + "rPr"), theme) | _paragraph_properties(s.find(W + "pPr"))
            self.by_id[key] = ((_value(s, W + "name") or key).strip().lower(), _value(s, W + "basedOn"), own)
            if s.get(W + "type") == "paragraph" and s.get(W + "default") in ("1", "true"):
                self.default = key

    def name(self, key: str | None) -> str:
        return self.by_id.get(key or self.default, ((key or "").lower(), None, {}))[0]

    def resolve(self, key: str | None) -> dict:
        chain, at = [], key or self.default
        while at in self.by_id and at not in chain:
            chain.append(at)
            at = self.by_id[at][1]
        out = dict(self.base)
        for k in reversed(chain):
            out |= self.by_id[k][2]
        return out


def _text(paragraph: ET.Element) -> str:
    out = []
    for el in paragraph.iter():
        if el.tag == W + "t":
            out.append(el.text or "")
        elif el.tag in (W + "tab", W + "br", W + "cr"):
            out.append(" ")
        elif el.tag == W + "noBreakHyphen":
            out.append("-")
    return " ".join("".join(out).split())


def _paragraph(p: ET.Element, styles: Styles) -> dict:
    ppr = p.find(W + "pPr")
    key = _value(ppr, W + "pStyle")
    props = styles.resolve(key) | _paragraph_properties(ppr)
    run = next((r for r in p.iter(W + "r") if any((x.text or "").strip() for x in r.iter(W + "t"))), None)
    props |= _run_properties(run.find(W + "rPr"), styles.theme) if run is not None else {}
    math = any(e.tag in (M + "oMath", M + "oMathPara") for e in p.iter())
    text = _text(p)
    if math and not text:
        text = " ".join("".join(e.text or "" for e in p.iter(M + "t")).split())
    image = any(e.tag in (W + "drawing", W + "pict", W + "object") for e in p.iter())
    listed = ppr is not None and ppr.find(W + "numPr") is not None
    return props | {"kind": "paragraph", "text": text, "style_id": key, "style_name": styles.name(key), "listed": listed, "has_image": image, "has_math": math}


def _layout(body: ET.Element) -> dict:
    sect = body.find(W + "sectPr")
    if sect is None:
        inner = body.findall(f"{W}p/{W}pPr/{W}sectPr")
        sect = inner[-1] if inner else None
    if sect is None:
        return {}
    sides = (("top", "top"), ("bottom", "bottom"), ("inner", "left"), ("outer", "right"), ("gutter", "gutter"))
    margins = {k: round(v / TWIPS_PER_CM, 2) for k, a in sides if (v := _number(_value(sect, W + "pgMar", a))) is not None}
    w, h = _number(_value(sect, W + "pgSz", "w")), _number(_value(sect, W + "pgSz", "h"))
    size = None
    if w and h:
        w, h = w / TWIPS_PER_CM, h / TWIPS_PER_CM
        size = next((n for n, x, y in lexicon.PAGE_SIZES if n != "B5" and abs(w - x) <= 0.35 and abs(h - y) <= 0.35), f"{w:.1f}x{h:.1f}cm")
    return {"margins_cm": list(margins.items()), "page_size": size}


def read(content: bytes) -> list[dict]:
    """The raw rows of a file: body paragraphs and tables in order, then footnotes."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        part = lambda n: _xml(z.read(n)) if n in names else None
        document, theme_root = part("word/document.xml"), part("word/theme/theme1.xml")
        theme = {}
        if theme_root is not None:
            for slot in ("major", "minor"):
                latin = theme_root.find(f".//{A}{slot}Font/{A}latin")
                if latin is not None:
                    theme[slot] = latin.get("typeface")
        styles, notes, app = Styles(part("word/styles.xml"), theme), part("word/footnotes.xml"), part("docProps/app.xml")
    body = document.find(W + "body") if document is not None else None
    if body is None:
        raise ValueError("no body")
    pages = next((int(e.text) for e in (app.iter() if app is not None else ()) if e.tag.endswith("}Pages") and (e.text or "").isdigit()), 0)
    rows = []
    for index, el in enumerate(body, 1):
        if el.tag == W + "p":
            rows.append(_paragraph(el, styles) | {"body_index": index})
        elif el.tag == W + "tbl":
            cells = [["\u0020".join(filter(None, (_text(p) for p in c.iter(W + "p")))) for c in r.findall(W + "tc")] for r in el.findall(W + "tr")]
            text = "\n".join(line for r in cells if (line := "\t".join(r).strip()))
            if text:
                rows.append({"kind": "table", "text": text, "body_index": index})
    for note in notes.findall(W + "footnote") if notes is not None else ():
        if (_number(note.get(W + "id")) or 0) > 0 and (text := " ".join(filter(None, (_text(p) for p in note.iter(W + "p"))))):
            rows.append({"kind": "footnote", "text": text})
    whole = {"pages": pages} | _layout(body)  # once: it looks through all of the body
    return [r | whole | {"ordinal": i} for i, r in enumerate(rows)]


def raw_rows(files: DataFrame) -> DataFrame:
    """Raw rows of files (doc_id, content); a file that cannot be read gives one row with `error`."""

    schema = to_arrow_schema(T.StructType.fromDDL(RAW))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    rows += [{"doc_id": doc_id} | r for r in read(content.as_py())]
                except UnsafeXml:
                    rows.append({"doc_id": doc_id, "error": "suspicious_archive"})
                except (zipfile.BadZipFile, ET.ParseError, ValueError, KeyError, EOFError, OSError):
                    rows.append({"doc_id": doc_id, "error": "parse_error"})
            yield from pa.Table.from_pylist(rows, schema).to_batches()

    return files.select("doc_id", "content").mapInArrow(run, RAW)


def classified(raw: DataFrame) -> DataFrame:
    """The blocks table of raw rows: one CASE in order of precedence, then levels of inferred headings by size."""
    c = F.col
    rows = raw.filter("error IS NULL").fillna(False, ["listed", "has_image", "has_math"]).fillna("", ["style_name", "text"])
    sized = rows.filter((c("kind") == "paragraph") & (c("size_pt") > 0) & (c("text") != "")).groupBy("doc_id", "size_pt").agg(F.sum(F.length("text")).alias("chars"), F.min("ordinal").alias("first"))
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy(c("chars").desc(), "first"))
    body = sized.withColumn("at", at).filter("at = 1").select("doc_id", c("size_pt").alias("body_size"))
    rows = rows.join(body, "doc_id", "left").fillna(0.0, ["body_size"])
    name, style_key = c("style_name"), F.replace(F.coalesce("style_id", F.lit("")), F.lit(" "), F.lit(""))
    level_of = lambda x: F.regexp_extract(x, HEADING_STYLE, 1).try_cast("int")
    heading = name.isin(*lexicon.TITLE_STYLES) | level_of(name).isNotNull() | level_of(style_key).isNotNull() | c("outline").isNotNull()
    hinted = lambda hints: F.exists(F.array(*(F.lit(h) for h in hints)), lambda h: name.contains(h))
    p = c("kind") == "paragraph"
    kind = F.coalesce(
        lexicon.first_case([
            (c("kind") == "table", "table"), (c("kind") == "footnote", "footnote"), (c("has_math"), "equation"), ((c("text") == "") & c("has_image"), "figure"), (heading, "heading"),
            (name.isin(*lexicon.CAPTION_STYLES) | t.caption_kind("text").isNotNull(), "caption"), (hinted(lexicon.TOC_HINTS), "paragraph"), (name.isin(*lexicon.QUOTE_STYLES), "quote"),
            (c("listed") | name.isin(*lexicon.LIST_STYLES) | c("text").rlike(t.BULLET), "list_item"), (hinted(lexicon.CODE_HINTS) | F.lower("font").isin(*lexicon.MONOSPACE), "code"), (name.isin(*lexicon.SUBTITLE_STYLES), "heading"),
        ]), F.lit("paragraph"),
    )
    size, short = F.coalesce("size_pt", F.lit(0.0)), F.length("text")
    manual = (kind == "paragraph") & p & (c("body_size") > 0) & short.between(1, 100) & ~c("text").rlike(r"[.,;:]$") & ((size >= c("body_size") * 1.15) | (F.coalesce("bold", F.lit(False)) & (size >= c("body_size")) & (short <= 60)))
    toc = p & ~heading & ~c("has_math") & ~name.isin(*lexicon.CAPTION_STYLES) & t.caption_kind("text").isNull() & hinted(lexicon.TOC_HINTS)
    flags = F.array_compact(F.array(
        F.when((kind == "figure"), "image_only"), F.when((kind == "heading") & name.isin(*lexicon.TITLE_STYLES), "title"), F.when(toc, "toc"),
        F.when(c("has_image") & (kind != "figure"), "contains_image"), F.when(manual, "heading_inferred"),
    ))
    styled = F.least(F.coalesce(level_of(name), level_of(style_key), c("outline"), F.when(name.isin(*lexicon.SUBTITLE_STYLES), 2), F.lit(1)), F.lit(6))
    typed = rows.withColumn("type", F.when(manual, "heading").otherwise(kind)).withColumn("flags", flags).withColumn("level", F.when((kind == "heading"), styled))
    kept = typed.filter((c("text") != "") | c("type").isin("figure", "table") | c("has_image") | c("has_math"))
    inferred = F.array_contains("flags", "heading_inferred")
    rank = F.least(F.dense_rank().over(Window.partitionBy("doc_id", inferred).orderBy(c("size_pt").desc())), F.lit(6))
    kept = kept.withColumn("level", F.when(inferred, F.when(c("size_pt") > 0, rank).otherwise(1)).otherwise(c("level")))
    style = F.struct("font", "size_pt", "bold", "italic", "line_spacing", "align", "indent_cm", "space_before_pt")
    numbered = kept.withColumn("ordinal", F.row_number().over(in_document()))
    out = numbered.select("doc_id", "ordinal", "type", "level", "text", F.lit(None).cast("int").alias("page"), F.concat(F.lit("body/"), c("body_index").cast("string")).alias("xml_path"), style.alias("style"), "flags")
    return with_offsets(out)


def documents(raw: DataFrame) -> DataFrame:
    """(doc_id, pages, margins_cm, page_size) of raw rows."""
    return raw.filter("error IS NULL").groupBy("doc_id").agg(F.max("pages").alias("pages"), F.any_value("margins_cm").alias("margins_cm"), F.max("page_size").alias("page_size"))
