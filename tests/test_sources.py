import io
import json
import zipfile
import zlib

import pytest
from foliograph import cli, schema
from foliograph.config import Settings
from foliograph.functions import register
from foliograph.sources import bibtex, docx, files, latex, registry
from foliograph.sources import pdf as pdf_source
from foliograph.streaming import ingest

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
STYLES = f"""<w:styles {NS}><w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:ascii="Times"/><w:sz w:val="24"/></w:rPr></w:rPrDefault></w:docDefaults>
<w:style w:type="paragraph" w:styleId="Normal" w:default="1"><w:name w:val="Normal"/></w:style>
<w:style w:type="paragraph" w:styleId="Nagwek1"><w:name w:val="Nagłówek 1"/><w:basedOn w:val="Normal"/><w:rPr><w:b/><w:sz w:val="32"/></w:rPr></w:style>
<w:style w:type="paragraph" w:styleId="Loop"><w:name w:val="loop"/><w:basedOn w:val="Loop"/></w:style>
<w:style w:type="paragraph" w:styleId="Title"><w:name w:val="Title"/></w:style></w:styles>"""


def para(text, style=None, run="", ppr=""):
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + ppr
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:rPr>{run}</w:rPr><w:t>{text}</w:t></w:r></w:p>"


def build(body, extra=None, drop=()):
    parts = {"[Content_Types].xml": "<Types/>", "word/document.xml": f"<w:document {NS}><w:body>{body}</w:body></w:document>", "word/styles.xml": STYLES} | (extra or {})
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            if name not in drop:
                z.writestr(name, text)
    return out.getvalue()


BODY = (
    para("Tytuł pracy", "Title") + para("Wstęp", "Nagwek1") + para("W pracy opisano metody, które są dla nas ważne oraz przydatne [1].") + para("Większy tytuł", run='<w:b/><w:sz w:val="30"/>') + para("Rys. 1 Schemat") + para("x", "Loop")
    + "<w:p><m:oMath><m:r><m:t>a=b</m:t></m:r></m:oMath></w:p>" + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>" + para("kod", run='<w:rFonts w:ascii="Consolas"/>')
    + para("Bibliografia", "Nagwek1") + para("[1] Kowalski J.: Metody analizy. Wydawnictwo PG 2020.") + '<w:sectPr><w:pgSz w:w="11906" w:h="16838"/><w:pgMar w:top="1418" w:left="1418"/></w:sectPr>'
)
NOTES = {"word/footnotes.xml": f'<w:footnotes {NS}><w:footnote w:id="-1"><w:p><w:r><w:t>sep</w:t></w:r></w:p></w:footnote><w:footnote w:id="2"><w:p><w:r><w:t>Przypis</w:t></w:r></w:p></w:footnote></w:footnotes>'}

MAIN = r"""\documentclass[12pt,a4paper]{article} % comment
\usepackage[utf8]{inputenc}\usepackage{amsmath, graphicx}
\title{A \emph{short} title}\author{Jan Lis}
\begin{document}
\maketitle
\tableofcontents
\begin{abstract}
This is an abstract.
\end{abstract}
\section{Introduction}\label{sec:in}
First text~\cite{kow20, xx} of \textbf{bold} words\footnote{A note.} and Fig.~\ref{fig:a}.

Second paragraph with $a+b$ and \unknown{kept words}.
\begin{itemize}\item one \item two\end{itemize}
\begin{lstlisting}
x = 1 % kept
\end{lstlisting}
\begin{figure}\includegraphics{a.png}\caption{A picture}\label{fig:a}\end{figure}
\begin{equation}\label{eq:a} a = b \tag{2.1} \end{equation}
\begin{table}\caption{Data}\begin{tabular}{ll}a & b \\ c & d\end{tabular}\end{table}
\input{chapter}
\input{../secret}
\input{main}
\begin{thebibliography}{9}\bibitem{nowak} Nowak A.: \emph{Prace} o tekstach. Wydawnictwo PG 2019.\end{thebibliography}
\bibliography{refs}
\end{document}
"""
BIB = r"""@string{pg = "Wydawnictwo PG"}
@comment{nothing}
@article{kow20, author = {Kowalski, Jan and Anna Lis}, title = {{Methods} of text}, journal = pg, year = 2020, doi = "10.1/x"}
@misc{arx, title={An {\'o} eprint}, eprint={2101.1}, year={2021}}"""


def test_docx(spark):
    df = spark.createDataFrame([("a", build(BODY, NOTES)), ("bad", b"PK\x03\x04junk"), ("dtd", build("", {"word/document.xml": "<!DOCTYPE x><x/>"}))], "doc_id string, content binary")
    raw = docx.raw_rows(df).cache()
    assert {(r.doc_id, r.error) for r in raw.filter("error IS NOT NULL").collect()} == {("bad", "parse_error"), ("dtd", "suspicious_archive")}
    got = docx.classified(raw).orderBy("ordinal").collect()
    assert [(r.type, r.level, r.text) for r in got] == [
        ("heading", 1, "Tytuł pracy"), ("heading", 1, "Wstęp"), ("paragraph", None, "W pracy opisano metody, które są dla nas ważne oraz przydatne [1]."), ("heading", 1, "Większy tytuł"), ("caption", None, "Rys. 1 Schemat"),
        ("paragraph", None, "x"), ("equation", None, "a=b"), ("table", None, "a\tb"), ("code", None, "kod"), ("heading", 1, "Bibliografia"), ("paragraph", None, "[1] Kowalski J.: Metody analizy. Wydawnictwo PG 2020."), ("footnote", None, "Przypis"),
    ]
    assert got[0].flags == ["title"] and got[3].flags == ["heading_inferred"]
    assert (got[1]["style"].size_pt, got[1]["style"].bold, got[1]["style"].font) == (16.0, True, "Times")
    d = docx.documents(raw).first()
    assert d.page_size == "A4" and d.margins_cm["top"] == 2.5


def test_latex(spark):
    rows = [("p", "main.tex", MAIN), ("p", "chapter.tex", "\\subsection{Details}\nMore text \\citep[see][]{nowak}."), ("p", "refs.bib", BIB), ("q", "notes.bib", BIB)]
    raw = latex.raw_rows(spark.createDataFrame(rows, "doc_id string, path string, content string")).cache()
    assert {r.doc_id for r in raw.filter("error IS NOT NULL").collect()} == {"q"}
    b = latex.blocks(raw).orderBy("ordinal").cache()
    got = [(r.type, r.level, r.text) for r in b.collect()]
    assert got[:5] == [("heading", 1, "Abstract"), ("paragraph", None, "This is an abstract."), ("heading", 1, "Introduction"), ("paragraph", None, "First text [kow20, xx] of bold words and Fig. fig:a."), ("footnote", None, "A note.")]
    assert ("paragraph", None, "Second paragraph with a+b and kept words.") in got
    assert ("list_item", None, "one") in got and ("code", None, "x = 1 % kept") in got and ("equation", None, "a = b") in got and ("table", None, "a\tb\nc\td") in got
    assert ("caption", None, "A picture") in got and ("heading", 2, "Details") in got
    refs = {r.ref_id: r for r in latex.refs(raw).collect()}
    assert refs["kow20"].authors == ["Jan Kowalski", "Anna Lis"] and refs["kow20"].venue == "Wydawnictwo PG" and refs["kow20"].title == "Methods of text" and refs["kow20"].doi == "10.1/x"
    assert refs["arx"].url == "https://arxiv.org/abs/2101.1" and refs["nowak"].year == 2019
    cites = {(r.raw, r.ref_id) for r in latex.citations(b, latex.refs(raw)).collect()}
    assert cites == {("\\cite{kow20, xx}", "kow20"), ("\\citep{nowak}", "nowak")}
    assert [(r.label) for r in latex.label_links(b).collect()] == ["fig:a"]
    warned = " ".join(r.warning for r in raw.filter("type = 'warning'").collect())
    assert "refused or missing: ../secret" in warned and "included again: main.tex" in warned and "tableofcontents" in warned
    meta = json.loads(raw.filter("type = 'meta'").first().meta)
    assert meta == {"documentclass": "article", "options": ["12pt", "a4paper"], "packages": ["inputenc", "amsmath", "graphicx"], "title": "A short title", "author": "Jan Lis"}
    line = {r.text: r.line for r in b.collect()}
    assert line["Introduction"] == MAIN[: MAIN.index("\\section")].count("\n") + 1


def test_latex_guards():
    many = {f"f{i}.tex": "x" for i in range(5)}
    assert latex.read(many, "f0.tex", Settings(max_tex_files=4)) == [{"error": "resource_limit"}]
    deep = {f"f{i}.tex": f"\\input{{f{i + 1}}}" for i in range(20)} | {"f20.tex": "end"}
    order, warnings = latex.collect(deep, "f0.tex", Settings())
    assert len(order) == 9 and any("limit" in w for w in warnings)
    assert latex.resolve("/etc/passwd", {"a.tex"}) is None and latex.resolve("a", {"a.tex"}) == "a.tex"


def test_bibtex_braces():
    (e,) = bibtex.entries("@book{k, title = {A {nested {deep}} one}, year = {1999}, note = \"x {\\\"o} y\"}")
    assert e["fields"]["title"] == "A {nested {deep}} one" and e["fields"]["year"] == "1999"


def test_guards_and_sniffing(spark, tmp_path):
    put = lambda n, b: (tmp_path / n).write_bytes(b)
    put("ok.docx", build(BODY)), put("x.tex", "\\section{ż}".encode("cp1250")), put("p.pdf", b"%PDF-1.7"), put("b.tex", b"a\0b"), put("wrong.pdf", b"text")
    put("missing.docx", build("", drop=("word/document.xml",)))
    put("escape.docx", build("", {"../evil": "x"}))
    put("bomb.docx", build("", {"big": "0" * 3_000_000}))
    put("big.tex", b"x" * 2_000_000)
    accepted, refused = files.guarded(files.scan(spark, str(tmp_path)), Settings(max_upload_mb=1))
    assert {(r.filename, r.source_format) for r in accepted.collect()} == {("ok.docx", "docx"), ("x.tex", "latex"), ("p.pdf", "pdf")}
    assert {(r.filename, r.error_kind) for r in refused.collect()} == {
        ("b.tex", "unsupported_format"), ("wrong.pdf", "unsupported_format"), ("missing.docx", "unsupported_format"), ("escape.docx", "suspicious_archive"), ("bomb.docx", "suspicious_archive"), ("big.tex", "resource_limit"),
    }
    text = files.scan(spark, str(tmp_path), "x.tex").select(files.decoded("content").alias("t")).first().t
    assert text == "\\section{ż}"


def test_parse_and_evaluate(spark, tmp_path):
    (tmp_path / "one.docx").write_bytes(build(BODY, NOTES))
    (tmp_path / "one.expected.json").write_text(json.dumps({"source_format": "docx", "language": "pl", "headings": [["Wstęp", 1], ["Bibliografia", 1]], "sections": ["introduction", "bibliography"], "citations": ["[1]"], "references": [{"year": 2020}], "figures": 1, "tables": 0}))
    (tmp_path / "lost.expected.json").write_text("{}")
    entries = files.corpus(spark, str(tmp_path))
    assert [r.name for r in entries.collect()] == ["one"]
    out = tmp_path / "report.json"
    assert cli.main(["evaluate-ingestion", str(tmp_path), "--out", str(out)]) == 0
    report = json.loads(out.read_text())
    (doc,) = report["documents"]
    assert doc["citation_recall"] == 1.0 and doc["reference_accuracy"] == 1.0 and doc["heading_recall"] == 1.0 and doc["language_correct"]
    assert report["summary"][0]["documents"] == 1
    assert cli.main(["export-schema", "--out", str(tmp_path / "s.json")]) == 0
    assert set(json.loads((tmp_path / "s.json").read_text())["tables"]) == set(schema.TABLES)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.docx").write_bytes(build(BODY))
    (tmp_path / "in/b.docx").write_bytes((tmp_path / "in/a.docx").read_bytes())
    seen = []
    q = ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "cp"), lambda a, r, n: seen.extend(x.filename for x in a.collect()))
    q.awaitTermination(120)
    assert len(seen) == 1


def test_pdf_is_a_plug_in(spark):
    with pytest.raises(NotImplementedError):
        pdf_source.tables(spark.range(1))


def test_registry(spark):
    df = spark.createDataFrame([("a", "one.docx", "docx", build(BODY)), ("b", "two.tex", "latex", b"\\section{One}\nText.")], "doc_id string, filename string, source_format string, content binary")
    got = {(r.doc_id, r.type, r.text) for r in registry.parse(df).collect()}
    assert ("b", "heading", "One") in got and ("b", "paragraph", "Text.") in got and ("a", "heading", "Bibliografia") in got


def test_sql_functions(spark):
    register.register(spark)
    assert [tuple(r) for r in spark.sql("SELECT c.raw, c.start FROM VALUES ('ab [1] c [2-3]') AS t(x), LATERAL citations_of(x) c").collect()] == [("[1]", 3), ("[2-3]", 9)]
    assert spark.sql("SELECT size(split_sentences('Raz. Dwa.')) AS n").first().n == 2
    assert spark.sql("SELECT s.text FROM LATERAL sentences_of('Raz. Dwa.') s").count() == 2
    assert spark.sql("SELECT fields['title'] AS t FROM bib_entries_of('@misc{k, title={T}}')").first().t == "T"


def test_pdf_guards(spark):
    tree = lambda n: b"%%PDF-1.7\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R] /Count %d >>\nendobj\n" % n
    packed = b"%PDF-1.7\n5 0 obj\n<< /Type /ObjStm /N 1 /First 4 /Filter /FlateDecode >>\nstream\n" + zlib.compress(b"2 0 << /Count 7 /Kids [3 0 R] /Type /Pages >>") + b"\nendstream\n"
    made = {"few": tree(2), "many": tree(4), "none": tree(0), "locked": tree(1) + b"trailer << /Root 1 0 R /Encrypt 9 0 R >>", "packed": packed, "bare": b"%PDF-1.7"}
    assert [pdf_source.facts(made[k])["pages"] for k in ("few", "many", "none", "packed", "bare")] == [2, 4, 0, 7, None]
    df = spark.createDataFrame([(k, f"/{k}.pdf", f"{k}.pdf", len(v), bytearray(v)) for k, v in made.items()], "doc_id string, path string, filename string, length long, content binary")
    good, bad = files.guarded(df, Settings(max_pages=3))
    assert {r.doc_id for r in good.collect()} == {"few", "bare"}
    assert {(r.doc_id, r.error_kind) for r in bad.collect()} == {("many", "resource_limit"), ("packed", "resource_limit"), ("none", "parse_error"), ("locked", "encrypted")}
