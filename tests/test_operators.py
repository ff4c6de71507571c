import random

from foliograph.operators import analysers, bibliography, blocks, citations, enrich, exclusions, floats, languages, metrics, pdf, sections, segments
from foliograph.plans import stages
from pyspark.sql import functions as F
import pytest

BLOCK = "doc_id long, ordinal int, type string, level int, text string, page int, flags array<string>"


def frame(spark, rows, schema=BLOCK):
    return blocks.with_offsets(spark.createDataFrame(rows, schema))


def thesis(spark):
    rows = [
        ("paragraph", None, "Imię i nazwisko autora pracy"),
        ("heading", 1, "Streszczenie"),
        ("paragraph", None, "This is the text of an abstract that is written in English for all of the readers."),
        ("heading", 1, "Spis treści"),
        ("paragraph", None, "1. Wstęp ........ 5"),
        ("heading", 1, "1. Wstęp"),
        ("paragraph", None, "W pracy opisano metody, które są dla nas ważne oraz przydatne [1]. Por. rys. 1.1 oraz (Kowalski, 2020)."),
        ("quote", None, "Cytat z pracy [2]."),
        ("heading", 2, "1.1 Szczegóły"),
        ("caption", None, "Rys. 1.1 Schemat"),
        ("table", None, "a\tb"),
        ("heading", 1, "Bibliografia"),
        ("paragraph", None, "[1] Jan Kowalski: Metody analizy. Wydawnictwo PG, Gdańsk 2020."),
        ("paragraph", None, "krótkie"),
        ("paragraph", None, "[2] Nowak A.: Inne metody. Wydawnictwo PG 2019."),
    ]
    return frame(spark, [(1, i, k, lvl, txt, i // 5 + 1, []) for i, (k, lvl, txt) in enumerate(rows)] + [(2, 0, "paragraph", None, "Bez nagłówków.", 1, [])])


def test_offsets(spark):
    b = thesis(spark)
    assert blocks.offset_violations(b, blocks.plain_text(b)).count() == 0
    assert b.filter("block_id = 'b0001' AND start = 0").count() == 2


def test_enrichment(spark):
    e = enrich.enrich(thesis(spark))
    kinds = [(r.section_id, r.kind) for r in e.sections.filter("doc_id = 1").orderBy("ordinal").collect()]
    assert kinds == [("s0001", "title_page"), ("s0002", "abstract_en"), ("s0003", "toc"), ("s0004", "introduction"), ("s0005", "bibliography")]
    assert e.sections.filter("doc_id = 2").first().title == "(no headings detected)"
    assert [(r.ref_id, r.year) for r in e.refs.orderBy("ordinal").collect()] == [("r001", 2020), ("r002", 2019)]
    cites = {(r.raw, r.ref_id) for r in e.citations.collect()}
    assert cites == {("[1]", "r001"), ("(Kowalski, 2020)", "r001")}
    text = blocks.plain_text(e.blocks).filter("doc_id = 1").first().plain_text
    assert all(text[r.start : r.end] == r.raw for r in e.citations.collect())
    assert {r.reason for r in e.exclusions.collect()} == {"front_matter", "toc", "bibliography", "quote"}
    got = {(r.kind, r.float_id): r.referenced_by for r in e.floats.collect()}
    assert got["figure", "f001"] == ["b0007", "b0010"]
    s = enrich.summary(e).filter("doc_id = 1").first()
    assert (s.headings, s.sections, s.citations, s.references, s.figures, s.tables) == (5, 5, 2, 2, 1, 0)
    assert 0 < s.analysed_char_ratio < 1
    again = enrich.enrich(thesis(spark), known_citations=e.citations)
    assert again.citations.count() == e.citations.count()
    segs = segments.segment(e.blocks, e.exclusions).collect()
    plain = {r.doc_id: r.plain_text for r in blocks.plain_text(e.blocks).collect()}
    assert segs and all(plain[r.doc_id][r.start : r.end] == r.text for r in segs)


def test_no_bibliography_means_no_references(spark):
    b = frame(spark, [(1, 0, "paragraph", None, "Pierwszy akapit pracy.", 1, []), (1, 1, "paragraph", None, "Drugi akapit pracy.", 1, [])])
    a = sections.assign_sections(b)
    assert bibliography.harvest(bibliography.bibliography_blocks(a, sections.build_sections(a))).count() == 0


def test_bibliography_heading_at_any_level(spark):
    b = frame(spark, [(1, 0, "heading", 1, "Coś", 1, []), (1, 1, "heading", 2, "Bibliografia", 1, []), (1, 2, "paragraph", None, "Kowalski J.: Metody analizy 2020.", 1, [])])
    a = sections.assign_sections(b)
    assert bibliography.harvest(bibliography.bibliography_blocks(a, sections.build_sections(a))).count() == 1


def test_merge_ranges_is_the_plain_fold(spark):
    rng = random.Random(1)
    rows, want = [], []
    for d in range(60):
        own = sorted((s := rng.randrange(60), s + rng.randrange(-1, 15), rng.choice("abc")) for _ in range(rng.randrange(1, 12)))
        rows += [(d, *r) for r in own]
        out = []
        for s, e, r in own:
            if e > s:
                if out and out[-1][2] == r and s <= out[-1][1] + 1:
                    out[-1][1] = max(out[-1][1], e)
                else:
                    out.append([s, e, r])
        want += [(d, *r) for r in out]
    got = exclusions.merge_ranges(spark.createDataFrame(rows, "doc_id long, start int, end int, reason string"))
    assert sorted((r.doc_id, r.start, r.end, r.reason) for r in got.collect()) == sorted(want)


def test_mask_join_is_no_cartesian_product(spark):
    b = thesis(spark)
    mask = spark.createDataFrame([(1, 0, 5, "toc")], "doc_id long, start int, end int, reason string")
    plan = exclusions.analysable_blocks(b, mask)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    marked = exclusions.mark_excluded(exclusions.mark_excluded(b, mask), mask)
    assert marked.filter(F.array_contains("flags", exclusions.FLAG)).first().flags == [exclusions.FLAG]


def test_languages(spark):
    pl = "W pracy opisano metody, które są dla nas ważne oraz przydatne przy analizie."
    b = frame(spark, [(1, 0, "paragraph", None, pl, 1, []), (1, 1, "paragraph", None, "x", 1, []), (2, 0, "paragraph", None, "za mało", 1, [])])
    assert {r.doc_id: r.language_primary for r in languages.primary_language(b, "en").collect()} == {1: "pl", 2: "en"}


def test_float_register(spark):
    rows = [("caption", "Tab. 2 Dane"), ("table", "a\tb"), ("paragraph", "x"), ("paragraph", "x"), ("paragraph", "x"), ("table", "c\td"), ("equation", "a=b (2.1)"), ("figure", "")]
    b = frame(spark, [(1, i, k, None, txt, 1, []) for i, (k, txt) in enumerate(rows)])
    images = spark.createDataFrame([(1, 3)], "doc_id long, page int")
    got = [(r.float_id, r.number, r.caption) for r in floats.register(b, images).orderBy("float_id").collect()]
    assert got == [("e001", "2.1", None), ("f001", None, None), ("f002", None, None), ("t001", "2", "Tab. 2 Dane"), ("t002", None, None)]


def test_metrics(spark):
    p = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "doc_id long, key string")
    x = spark.createDataFrame([(1, "a"), (1, "c")], "doc_id long, key string")
    r = metrics.multiset_prf(p, x, ["doc_id"]).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) == (1, 2, 1, 0.333, 0.5, 0.4)
    refs = spark.createDataFrame([(1, 2020, "10.1/x", ["Kowalski J"])], "doc_id long, year int, doi string, authors array<string>")
    asked = spark.createDataFrame([(1, 0, 2020, None, "kowalski"), (1, 1, 2021, None, None)], "doc_id long, expectation_id int, year int, doi string, first_author string")
    assert metrics.matched_references(asked, refs).first().accuracy == 0.5


def test_layout_induction(spark):
    rows = []

    def put(page, block, text, size, bold=False, y=0.0, font="Serif"):
        rows.append((1, page, block, 0, 0, text, font, size, 16 if bold else 0, 50.0, float(y), 300.0, y + 12.0))

    put(1, 0, "Thesis title", 20.0, y=10)
    put(1, 1, "Introduction", 14.0, y=60)
    put(1, 2, "Running text of the first page that is long enough to be the body.", 10.0, y=90)
    put(1, 3, "inside a table", 10.0, y=200)
    put(2, 0, "Methods", 14.0, y=10)
    put(2, 1, "x = y", 10.0, y=40, font="CMMI10")
    put(2, 2, "Fig. 1 A picture", 10.0, y=80)
    put(2, 3, "- a list item", 10.0, y=99)
    spans = spark.createDataFrame(rows, "doc_id long, page int, block int, line int, span int, text string, font string, size double, flags int, x0 double, y0 double, x1 double, y1 double")
    toc = spark.createDataFrame([(1, 0, 1, "Introduction", 1)], "doc_id long, ordinal int, level int, title string, page int")
    regions = spark.createDataFrame([(1, 1, 40.0, 190.0, 400.0, 260.0, "a\tb")], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, text string")
    got = [(r.type, r.level, r.text) for r in pdf.induce(spans, toc, regions).orderBy("ordinal").collect()]
    assert got == [
        ("heading", 1, "Thesis title"), ("heading", 1, "Introduction"), ("paragraph", None, "Running text of the first page that is long enough to be the body."), ("table", None, "a\tb"),
        ("heading", 1, "Methods"), ("equation", None, "x = y"), ("caption", None, "Fig. 1 A picture"), ("list_item", None, "- a list item"),
    ]


def test_stages():
    assert stages.groups() == [["parse"], ["enrich"], ["aigt", "citations", "embed", "format", "grammar"], ["similarity"], ["aggregate"], ["report"]]
    with pytest.raises(ValueError):
        stages.groups((stages.Stage("a", ("b",)), stages.Stage("b", ("a",))))
    work = {"parse": lambda r: 1, "enrich": lambda r: r["parse"] + 1, "format": lambda r: 1 / 0, "aggregate": lambda r: "sum"}
    results, log = stages.run(work)
    status = {n: s for n, s, _ in log}
    assert results["enrich"] == 2 and results["aggregate"] == "sum" and status["format"] == "failed" and status["similarity"] == "skipped"
    results, log = stages.run({"parse": lambda r: 1 / 0})
    assert [x[1] for x in log] == ["failed"]


def test_findings(spark):
    rows = [(1, "style.a", "minor", 0, 5, "format"), (1, "style.b", "major", 4, 9, "format"), (1, "style.a", "minor", 9, 12, "format"), (1, "aigt.x", "critical", 0, 5, "aigt")]
    f = spark.createDataFrame(rows, "doc_id long, rule_id string, severity string, start int, end int, module string")
    got = sorted((r.family, r.start, r.end, r.severity, r.merged) for r in analysers.merge_findings(f).collect())
    assert got == [("aigt", 0, 5, "critical", 1), ("style", 0, 9, "major", 2), ("style", 9, 12, "minor", 1)]
    assert [(r.module, r.penalty) for r in analysers.scores(f).collect()] == [("format", 5.0)]


def test_rules_and_numbering(spark):
    b = frame(spark, [(1, 0, "heading", 1, "Wstęp.", 1, []), (1, 1, "paragraph", None, "Zrobiłem to w", 1, []), (1, 2, "paragraph", None, "Bez błędów", 1, [])])
    assert {(r.rule_id, r.block_id) for r in analysers.check_blocks(b).collect()} == {("heading-dot", "b0001"), ("orphan-letter", "b0002"), ("first-person", "b0002")}
    fl = spark.createDataFrame([(1, "figure", "f001", "1", []), (1, "figure", "f002", "3", ["b1"])], "doc_id long, kind string, float_id string, number string, referenced_by array<string>")
    assert [(r.float_id, r.before) for r in analysers.numbering_gaps(fl).collect()] == [("f002", 1)]
    assert [r.float_id for r in analysers.unmentioned(fl).collect()] == ["f001"]
    c = spark.createDataFrame([(1, "c1", "numeric", ["1"], 0), (1, "c2", "numeric", ["4"], 5), (1, "c3", "numeric", ["2"], 9)], "doc_id long, citation_id string, style string, keys array<string>, start int")
    assert [r.citation_id for r in analysers.numbering_order(c).collect()] == ["c2"]
    r = spark.createDataFrame([(1, "r1", "T", 2000, None), (1, "r2", "t", 2000, None), (1, "r3", "u", None, "10.1/a")], "doc_id long, ref_id string, title string, year int, doi string")
    assert [x.ref_ids for x in citations.duplicate_references(r).collect()] == [["r1", "r2"]]


def test_other_detector(spark):
    b = frame(spark, [(1, 0, "paragraph", None, "x" * 50, 1, [])])
    assert languages.primary_language(b, detector=lambda c: F.when(F.length(c) > 3, "en")).first().language_primary == "en"
