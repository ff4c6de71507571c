import pytest
from foliograph.functions import citations, language, lexicon, references, register, sentences
from foliograph.functions import text as t
from pyspark.sql import functions as F


def values(spark, rows, *columns):
    """Evaluate columns over a one-column table `x` in order."""
    df = spark.createDataFrame(list(enumerate(rows)), "i int, x string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_text(spark):
    got = values(spark, ["  a\u00a0 b\n", "2.1. Żółta Łąka!", "; x ,", "„cytat”", "ﬁnał"], t.normalise_ws("x"), t.count_words("x"), t.heading_key("x"), t.clean("x"), t.strip_quotes("x"), t.expand_ligatures("x"))
    assert got[0][:2] == ("a b", 2)
    assert got[1][2] == "zołta łaka"
    assert got[2][3] == "x"
    assert got[3][4] == "cytat"
    assert got[4][5] == "finał"
    assert values(spark, ["Łąka"], t.heading_key("x", True)) == [("laka",)]


def test_lines_join(spark):
    df = spark.createDataFrame([(["ana-", "lityczna", "", "Nowa-", "Huta\u00ad x"],)], "l array<string>")
    assert df.select(t.join_lines(F.col("l"))).first()[0] == "analityczna Nowa- Huta x"


def test_prefix_score(spark):
    df = spark.createDataFrame([("one twofold three", "one twofer four")], "a string, b string")
    assert round(df.select(t.prefix_score(F.col("a"), F.col("b"))).first()[0], 3) == 0.667


def test_captions_and_toc(spark):
    got = values(spark, ["Rys. 3.2 Schemat", "TABELA IV-2 x", "Rysować", "1. Wstęp ..... 5", "2. Metodyka\t9", "Zwykłe zdanie.", "wzór (2.1)"], t.caption_kind("x"), t.caption_number("x"), t.looks_like_toc("x"), t.equation_number("x"))
    assert got[0][:2] == ("figure", "3.2")
    assert got[1][:2] == ("table", "IV-2")
    assert got[2][0] is None
    assert [g[2] for g in got[3:6]] == [True, True, False]
    assert got[6][3] == "2.1"


HEADINGS = {
    "Wstęp": "introduction", "1. Wprowadzenie": "introduction", "3.2 Metodyka pomiarów": "methodology", "Przegląd literatury": "literature_review", "Stan wiedzy": "literature_review", "Wyniki pomiarów": "results",
    "Podsumowanie": "summary", "Bibliografia": "bibliography", "Spis treści": "toc", "Dodatek B": "appendix", "Oświadczenie": "statement", "Abstract": "abstract_en", "Streszczenie": "abstract_pl", "Politechnika Warszawska": "title_page",
    "Zupełnie inne": None, "Summary": None, "": None, "Słowa kluczowe": None,
}


def test_section_kinds(spark):
    assert [v for v, in values(spark, list(HEADINGS), lexicon.section_kind("x"))] == list(HEADINGS.values())
    assert values(spark, ["Słowa kluczowe"], lexicon.section_kind("x", True)) == [("abstract_pl",)]


def test_language(spark):
    texts = ["W tej pracy opisano metody, które są przydatne dla analizy tekstu oraz jego oceny.", "This work describes the methods that are useful for the analysis of texts.", "za mało słów", "uno dos tres cuatro cinco seis siete ocho nueve"]
    assert [v for v, in values(spark, texts, language.detect("x"))] == ["pl", "en", None, None]


CITED = [
    ("Opisano to w [1].", ["[1]"]),
    ("Por. [2, 3] i [4-6].", ["[2, 3]", "[4-6]"]),
    ("Wynika to z (Kowalski, 2020).", ["(Kowalski, 2020)"]),
    ("Później Jones (2019) to potwierdził; por. [Nowak i Lis, 2001].", ["Jones (2019)", "[Nowak i Lis, 2001]"]),
    ("Bez cytatu (12) tutaj.", []),
    ("Na rysunku 3 (a) nic.", []),
]


def test_citations(spark):
    register.register(spark)
    more = ["Lis [0, 2] i [3-40], [7; 8–10] (Kowalski  i\nNowak, 2001a) Li (2000) Lis (2001), [Lis (2000), 2001]", "😀 [1]", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*(t for t, _ in CITED), *more])], "i int, x string")
    got = {r.i: r.h for r in df.select("i", citations.find_citations("x").alias("h")).collect()}
    for i, (text, want) in enumerate(CITED):
        assert [h.raw for h in got[i]] == want
        assert all(text[h.start : h.end] == h.raw for h in got[i])
    n = len(CITED)
    assert [(h.raw, h["keys"], h.authors) for h in got[n]] == [("[0, 2]", ["0", "2"], None), ("[7; 8–10]", ["7", "8", "9", "10"], None), ("(Kowalski  i\nNowak, 2001a)", ["Kowalski i Nowak, 2001a"], "Kowalski i Nowak"), ("Lis (2001)", ["Lis, 2001"], "Lis"), ("Lis (2000)", ["Lis, 2000"], "Lis")]
    assert [(h.start, h.end) for h in got[n + 1]] == [(2, 5)] and got[n + 2] == []
    df.createOrReplaceTempView("cited_texts")
    by_sql = spark.sql("SELECT i, c.* FROM cited_texts, LATERAL citations_of(x) c").collect()
    assert sorted((r.i, r.start, r.end, r.raw, r.style, r["keys"]) for r in by_sql) == sorted((i, h.start, h.end, h.raw, h["style"], h["keys"]) for i, hits in got.items() for h in hits)


def test_numeric_keys(spark):
    inside = ["4-6", "1, 9", "3-40", "7;8-9"]
    want = [["4", "5", "6"], ["1", "9"], [], ["7", "8", "9"]]
    assert [v for v, in values(spark, inside, citations.numeric_keys(F.col("x")))] == want


def test_references(spark):
    raws = [
        "[1] Kowalski J.: Analiza tekstu. Wydawnictwo PW, Warszawa 2020.",
        "Smith J., Jones A.: Detection of text. Journal of X, vol. 12, 2019, s. 3-15. doi:10.1000/xyz123",
        "Nowak, A. (2021). Wykrywanie zapożyczeń. Zeszyty Naukowe.",
        "Tytuł pracy.",
        "Lee K. and Park S.: Things (arXiv: 2101.00001), 2021",
        "",
    ]
    df = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    got = references.with_fields(df).orderBy("i").collect()
    assert [g.year for g in got] == [2020, 2019, 2021, None, 2021, None]
    assert got[0].authors == ["Kowalski J"] and got[1].authors == ["Smith J", "Jones A"] and got[4].authors == ["Lee K", "Park S"]
    assert got[1].doi == "10.1000/xyz123" and got[0].doi is None
    assert got[4].url == "https://arxiv.org/abs/2101.00001"
    assert all(0 < g.confidence <= 1 for g in got[:5]) and got[5].confidence == 0
    assert got[1].confidence > got[3].confidence
    assert got[3].title == "Tytuł pracy"
    pages = df.select(references.pages(F.col("raw")).alias("p")).collect()
    assert (pages[1].p.first, pages[1].p.last) == ("3", "15") and pages[0].p is None


SENTENCES = [
    ("Opis metod. Wyniki są dobre.", 2), ("Prof. Nowak to opisał. Potem inni.", 2), ("Por. rys. 3.2 na s. 12.", 1), ("To 3.14 oraz 1,5 metra.", 1), ("Jest tzn. przykład. Następne zdanie.", 2),
    ("Tak jest (Kowalski, 2020). Następne zdanie.", 2), ("Raz! Dwa? Trzy.", 3), ("Zob. https://example.com/a.b. Dalej.", 2), ("DOI 10.1000/xyz.123 jest. Dalej.", 2), ("„Koniec cytatu.” Dalej inne.", 2),
    ("J. Lis i A. Kot opisali. Zgodnie.", 2), ("Autorzy (m.in. Nowak) piszą. Potem inni.", 2), ("", 0), ("   ", 0),
]


@pytest.mark.parametrize(("text", "n"), SENTENCES)
def test_sentences(text, n):
    spans = sentences.split(text)
    assert len(spans) == n
    assert all(text[a:b] == text[a:b].strip() != "" for a, b in spans)


def test_sentences_on_frames(spark):
    assert values(spark, ["łó. Ala.", ""], F.size(sentences.split_sentences("x"))) == [(2,), (0,)]
