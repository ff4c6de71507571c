import html as charrefs
import random
import re

from foliograph.llm.html import extracted, hosts, main_text, templates, valid_template
from pyspark.sql import functions as F


def test_article_and_surroundings():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body class="menu">
    <header><h2>Site</h2></header><nav><ul><li><a href="/a>b">Menu</a><li>Two</ul></nav><!-- <p>no</p> --><div class="ad">Buy</div>
    <div id="cookie-notice">We use</div><article><h1>Head &amp; &eacute;</h1><p><b>First<br>line.<br><p>Second &lt;b&gt;  one\n two</p>
    <aside>Side</aside><form><p>Name</p></form><ul><li>a<li>b</ul><p>a < b</p><div class="comments"><p>Nice!</p></div></article>
    <section>Outside</section><footer>&copy; x</footer>"""
    assert main_text(page, []) == "Head & é\nFirst line.\nSecond <b> one two\na\nb\na < b"
    assert main_text(None, []) == main_text("", []) == ""
    assert main_text("<p>open <b>end", []) == "open end"
    assert main_text("just text", []) == "just text"
    assert main_text("<div>" * 20_000 + "deep", []) == "deep"
    assert main_text("<a <a <", []) in ("", "<")


def test_names():
    page = """<div class="no-sidebar layout"><article><div class="article-header"><h1>T</h1></div><p>a</p><div class="search-results"><p>kept</p></div>
    <div class="header"><p>own</p></div><div class="comments-area"><p>Nice!</p></div><div class="x ad"><p>Buy</p></div><div role="complementary"><p>Side</p></div></article></div>
    <div class="legal-notice"><p>We use</p></div>"""
    assert main_text(page, []) == "T\na\nkept\nown"
    assert main_text('<div class="legal-notice"><p>We use</p></div><div class="notice-board"><p>body</p></div>', []) == "body"
    cards = "<article><h2>Tease</h2></article>" * 3
    assert main_text(f"<div><p>{'long text ' * 9}</p></div>{cards}", []) == ("long text " * 9).strip()
    assert main_text(f"<p>short</p>{cards}", []) == "Tease\nTease\nTease"
    assert main_text(f"<main><p>a</p>{cards}</main><p>{'long text ' * 9}</p>", []) == "a\nTease\nTease\nTease"


def test_template_decides(spark):
    """Notices of any length under neutral names, inside and outside the article, at one place of each page; a line that recurs anywhere in articles stays."""
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(999)) for _ in range(n))
    notice, line, within = say(90), say(9), say(12)
    rows, want, plain = [], {}, {}
    for i in range(60):
        paras = [say(rng.randrange(5, 40)) for _ in range(rng.randrange(3, 7))]
        if i % 4:
            paras.insert(rng.randrange(len(paras) + 1), line)
        body = "".join(f"<p>{p}</p>" for p in paras)
        host, lead = i % 3, f"<div class=a><p>{notice}</p></div>"
        if host == 0:  # no article: the notice is all text of the page's that the host repeats
            html = f"<body>{lead}<div class=text>{body}</div></body>"
        elif host == 1:
            html = f"<body>{lead}<article><h1>{say(4)}</h1>{body}<p>{within}</p></article></body>"
        else:
            html = f"<body><article>{body}<div class=q>{within}</div></article><p>{notice}</p></body>"
        title = [html.split("<h1>")[1].split("</h1>")[0]] if host == 1 else []
        want[i] = "\n".join(title + paras)
        plain[i] = main_text(html, [])
        rows.append((i, f"https://host{host}.example/{i}", html))
    rows += [(100 + i, f"https://copies.example/{i}", f"<article><h1>Same</h1><p>{line}</p></article>") for i in range(9)]
    got = {r.page_id: r.text for r in extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want | {100 + i: f"Same\n{line}" for i in range(9)}
    assert all(plain[i] != want[i] for i in range(60))  # without the deduction each page is wrong


def test_valid_classes():
    page = [1, 2, 5, 6, 5, 6, 3]
    assert valid_template(page, [[1, 2, 3], [5, 6], [9]]) == {1, 2, 3, 5, 6}
    assert valid_template(page, [[2, 1]]) == set()
    assert valid_template(page, [[5, 6, 3]]) == set()


def test_template_without_landmarks(spark):
    rng = random.Random(1)
    say = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(99)) for _ in range(n))
    rows, want = [], {}
    for i in range(40):
        paras = [say(rng.randrange(5, 40)) for _ in range(rng.randrange(1, 5))]
        body = "".join(f"<p>{p}</p>" for p in paras)
        rows.append((i, f"https://Host{i % 2}.example/{i}", f"<html><body><div class=top><p>Welcome to host</p><p><a href=x>{say(3)}</a></p></div><div class=text>{body}</div><div class=end><p>All rights kept</p></div></body></html>", 1))
        want[i] = "\n".join(paras)
    rows += [(100, None, "<p>alone</p>", 1), (101, "::", None, 1), (None, "https://host0.example/n", "<article><p>Welcome to host</p></article>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int").withColumn("text", F.lit("x"))
    got = {r.page_id: r.text for r in extracted(df).collect()}
    assert got == want | {100: "alone", 101: "", None: "Welcome to host"}
    assert extracted(df.limit(0)).count() == 0
    assert {r.host for r in templates(hosts(df)).collect()} == {"host0.example", "host1.example"}


def test_synthetic_pages_by_plain_rule(spark):
    """The pages of the tables have one article each; a plain reading of it must agree."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in extracted(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", r.html, re.S).group(1)
        parts = re.split(r"</?(?:p|h1|ul|li|div)\b[^>]*>", inner)
        texts = [" ".join(charrefs.unescape(re.sub(r"<[^>]+>", " " if "br" in p else "", p)).split()) for p in parts]
        assert got[r.page_id] == "\n".join(t for t in texts if t)
