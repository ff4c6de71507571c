"""HTML extraction by equivalence-class template deduction.

A page is a sequence of tokens: opening tags, named by their path of tags (with class or id), and
text blocks, named by path and text. Over the pages of one host each token has an occurrence
vector, its count on each page. Tokens with one vector form a class; sums of hashes of (page,
count) stand for vectors, so hosts of any size are grouped by partial sums and no task sees a
whole host. Classes that cover at least SUPPORT of a host's pages (and MIN_PAGES) are its
candidates. On each page, from the most frequent class on, a class is valid if its tokens come in
its order, round after round, and each round lies within one slot of the classes before; valid
classes nest into the page's template. Text that is a token of a valid class belongs to the
template; all other text lies in slots.

Text is a candidate only if it stands at one place on all pages that have it: among the blocks of
its path, counted from the first or from the last. A line that merely recurs between others is
no template. Inside `article` or `main` it must also be on at least ARTICLE_SUPPORT of the host's
pages (and ARTICLE_PAGES). An article of which the template
would take over half stays whole, so a host of copies keeps its text; so does other text if
nothing else of the page were left.

Of the slots, those under menus, headers, footers, sidebars, notices, adverts, forms and comments
are dropped. These are known by tag, role, or a whole class or id, by the first word of a compound
one if that says what it holds (`comments-area`), and outside the article by its last word
(`legal-notice`). An article's own header stays. If the page marks
its article, only slots inside it are taken, unless its articles are several cards with less text
than the slots outside; without one, slots whose text is all links are dropped too.

Defined results: a null or empty page gives no text; a null or unreadable url makes a page a host
of its own; a null id is carried; repeated rows each give their text and count as pages; unclosed
tags end with the page; an empty table gives no rows; other columns, whatever their names, are
not read.
"""

from __future__ import annotations

import bisect
import html as charrefs
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import lean, table, text_key, with_small_batches
from foliograph.session import stored

SUPPORT, MIN_PAGES = 0.5, 3
ARTICLE_SUPPORT, ARTICLE_PAGES = 0.9, 8

# Kinds of HTML elements, and names that mark what is not the article.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "template", "svg", "math", "object", "canvas", "select"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
CLOSES_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
ASIDE_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "head"}
ASIDE_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe",
    "subscription", "signup", "login", "sidebar", "side", "aside", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "foot", "comment", "comments", "reply", "replies", "discussion", "disqus", "related", "recommended",
    "share", "sharing", "social", "widget", "toolbar", "pagination", "pager", "legal", "copyright", "complementary", "contentinfo", "search", "form",
}
#: Names that inside an article are parts of it.
OF_ARTICLES = {"header", "masthead"}
#: First words of compound names that say what the element holds.
HOLDS = {"ad", "ads", "advert", "advertisement", "comment", "comments", "cookie", "newsletter", "sidebar", "sponsored"}
ARTICLE_TAGS = {"article", "main"}
#: First words of compound names that tell what a page has, not what an element is.
TELLS = {"has", "is", "no", "with", "without"}
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAME = re.compile(r"[a-z]+")


@dataclass
class Block:
    path: int
    text: str
    aside: bool
    article: int  # the outermost article or main element around it, by number from 1
    linked: bool


def _tags(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", name, attributes) and ("close", name, "") in page order; raw elements and comments are left out."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        after = page[lt + 1 : lt + 2]
        if not (after.isascii() and (after.isalpha() or after in "/!?")) or after == "":
            yield "text", page[at : lt + 1], ""
            at = lt + 1
            continue
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        gt = page.find(">", lt)
        if gt < 0:
            return
        body = page[lt + 1 : gt]
        if after in "!?":
            at = gt + 1
            continue
        for quote in ('"', "'"):
            if f"={quote}" in body and body.count(quote) % 2:  # the tag's end lies behind the quoted value
                close = page.find(quote, gt)
                far = page.find(">", close) if close >= 0 else -1
                if far >= 0:
                    gt, body = far, page[lt + 1 : far]
        at = gt + 1
        if after == "/":
            yield "close", body[1:].split(None, 1)[0].lower() if body[1:].strip() else "", ""
            continue
        name = re.split(r"[\s/]", body, maxsplit=1)[0].lower()
        yield "open", name, body[len(name) :]
        if name in RAW and not body.endswith("/"):
            found = re.compile(f"</{re.escape(name)}\\s*>", re.IGNORECASE).search(page, at)
            at = found.end() if found else n
            yield "close", name, ""


def _hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token) - (1 << 63)


#: name, hash of the path down to it, whether it or one above is an aside, the outermost article, whether it or one above is a link
Element = tuple[str, int, bool, int, bool]
ROOT: Element = ("", 0, False, 0, False)


def _is_aside(name: str, found: dict[str, str], in_article: bool) -> bool:
    """Whether a tag with these attributes holds no part of the article."""
    if name in ("html", "body"):
        return False
    if name in ASIDE_TAGS or (name == "header" and not in_article):
        return True
    marks = {w for a in ("id", "class", "role") for w in found.get(a, "").lower().split()}
    parts = [p for p in map(_NAME.findall, marks) if p and p[0] not in TELLS]
    if in_article:
        return any(p[0] in HOLDS or (len(p) == 1 and p[0] in ASIDE_NAMES - OF_ARTICLES) for p in parts)
    return any(p[0] in HOLDS or p[-1] in ASIDE_NAMES for p in parts)


def parse(page: str) -> list[int | Block]:
    """Tokens of a page in order: the hash of the path of each opening tag, and each text block."""
    out: list[int | Block] = []
    stack: list[Element] = [ROOT]
    part: list[str] = []
    linked, articles = True, 0

    def block() -> None:
        nonlocal linked
        text = " ".join(charrefs.unescape("".join(part)).split())
        part.clear()
        if text:
            _, path, aside, article, _ = stack[-1]
            out.append(Block(path, text, aside, article, linked))
        linked = True

    def close(names: set[str], stop: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in stop:
                return

    for kind, name, attrs in _tags(page):
        if kind == "text":
            if name.strip():
                linked &= stack[-1][4]
            part.append(name)
            continue
        if name == "br":
            part.append(" ")
        if name not in INLINE:
            block()
        if kind == "close":
            close({name}, set())
            continue
        if name in CLOSES_P:
            close({"p"}, {"div", "td", "li", "article", "section", "body", "blockquote"})
        if name in CLOSES_SAME:
            close(CLOSES_SAME[name], {"ul", "ol", "dl", "table", "menu"})
        if name not in INLINE:
            while stack[-1][0] in INLINE:  # formatting left open does not hold blocks
                stack.pop()
        found = {a.lower(): b or c or d for a, b, c, d in _ATTR.findall(attrs)} if attrs else {}
        mark = "".join(f"{s}{found[a]}" for a, s in (("id", "#"), ("class", ".")) if a in found)
        step = name + (mark if name not in ("a", "img") else "")
        _, path, in_aside, article, in_link = stack[-1]
        aside = _is_aside(name, found, article > 0)
        path = _hash(f"{path}>{step}")
        if name in ARTICLE_TAGS and not article:
            articles += 1
            article = articles
        if name not in INLINE or name == "a":
            out.append(path)
        if name not in VOID:
            stack.append((name, path, in_aside or aside, article, in_link or name == "a"))
    block()
    return out


def tokens(parsed: list[int | Block]) -> list[tuple[int, Block | None]]:
    """Hashes of the template's candidate tokens in order, and the block of those that are text."""
    return [(t, None) if isinstance(t, int) else (_hash(f"{t.path}\0{t.text}"), t) for t in parsed]


def valid_template(page: list[int], classes: list[list[int]]) -> set[int]:
    """The tokens of the classes that are ordered on this page and nest."""
    where: dict[int, list[int]] = {}
    for i, t in enumerate(page):
        where.setdefault(t, []).append(i)
    template: set[int] = set()
    cuts: list[int] = []  # places of the template so far
    for members in classes:
        places = [where.get(t, []) for t in members]
        if not places[0] or len({len(p) for p in places}) > 1:
            continue
        rounds = sorted(zip(*places, strict=True))
        flat = [i for r in rounds for i in r]
        if flat != sorted(flat):
            continue
        if len(members) > 1 and cuts and any(_between(cuts, r[0], r[-1]) for r in rounds) and len(rounds) > 1:
            continue
        template.update(members)
        cuts = sorted([*cuts, *flat])
    return template


def _between(cuts: list[int], a: int, b: int) -> bool:
    return bisect.bisect_left(cuts, a) != bisect.bisect_right(cuts, b)


def _size(blocks: list[Block]) -> int:
    return sum(len(b.text) for b in blocks)


def main_text(page: str | None, classes: list[list[int]]) -> str:
    """The article of a page, given its host's classes from the most frequent on."""
    named = tokens(parse(page or ""))
    template = valid_template([h for h, _ in named], classes)
    free = [(b, h not in template) for h, b in named if b is not None and not b.aside]
    inside = [b for b, _ in free if b.article]
    slots = [b for b, in_slot in free if b.article and in_slot]
    if 2 * _size(slots) < _size(inside):
        slots = inside
    outside = [b for b, in_slot in free if not b.article and in_slot and not b.linked]
    if not slots and not outside:
        outside = [b for b, _ in free if not b.linked]
    cards = len({b.article for b in slots}) > 1 and _size(outside) > _size(slots)
    return "\n".join(b.text for b in (outside if cards or not slots else slots))


def hosts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, html, host): the host of a page without one is the page itself."""
    host = F.lower(F.try_parse_url(F.col(url_col), F.lit("HOST")))
    own = F.concat(F.lit("?"), F.hex(text_key(F.concat_ws("\0", F.col(id_col).cast("string"), F.col(url_col), F.col(html_col)))))
    return with_small_batches(pages).select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), F.coalesce(host, own).alias("host"))


def templates(paged: DataFrame) -> DataFrame:
    """(host, classes): the candidate classes of each host with at least MIN_PAGES pages, from the most frequent on, each in the order of its tokens' mean places."""
    schema = pa.schema([("host", pa.string()), ("page", pa.int64()), ("token", pa.int64()), ("times", pa.int64()), ("place", pa.int64()), ("ahead", pa.int64()), ("behind", pa.int64()), ("inside", pa.bool_())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for host, page, key in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                named = tokens(parse(page.as_py()))
                left = Counter(t.path for _, t in named if t is not None)
                done: Counter[int] = Counter()
                seen: dict[int, list] = {}  # times, place, blocks of its path before the first and behind the last, whether in an article
                for i, (h, t) in enumerate(named):
                    own = seen.setdefault(h, [0, i, 0 if t is None else done[t.path], 0, t is not None and t.article > 0])
                    own[0] += 1
                    if t is not None:
                        done[t.path] += 1
                        own[3] = left[t.path] - done[t.path]
                rows += [(host, key, h, *own) for h, own in seen.items()]
            cols = list(zip(*rows, strict=True)) or [[]] * len(schema)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    sizes = paged.groupBy("host").count().withColumnRenamed("count", "pages").filter(F.col("pages") >= MIN_PAGES)
    rows = paged.select("host", "html", F.xxhash64("page_id", "url", "html").alias("page")).mapInArrow(run, "host string, page long, token long, times long, place long, ahead long, behind long, inside boolean")
    h = F.xxhash64("page", "times")
    vectors = rows.groupBy("host", "token").agg(
        F.sum(h.bitwiseAND((1 << 31) - 1)).alias("low"), F.sum(F.shiftrightunsigned(h, 33)).alias("high"), F.count(F.lit(1)).alias("support"), F.avg("place").alias("place"),
        F.max("inside").alias("inside"), ((F.min("ahead") == F.max("ahead")) | (F.min("behind") == F.max("behind"))).alias("at_one_place"),
    )
    support, pages = F.col("support"), F.col("pages")
    steady = (support >= ARTICLE_PAGES) & (support >= ARTICLE_SUPPORT * pages)
    often = vectors.filter((support >= MIN_PAGES) & F.col("at_one_place")).join(sizes, "host").filter((support >= SUPPORT * pages) & (~F.col("inside") | steady))
    classes = often.groupBy("host", "support", "low", "high").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda t: t.token).alias("members"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("support")).alias("s"), (-F.size("members")).alias("n"), F.col("members"))))
    return classes.groupBy("host").agg(F.transform(ranked, lambda c: c.members).alias("classes"))


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) for each row."""
    paged = hosts(pages, id_col, url_col, html_col)
    known = stored(templates(paged), "html-templates")
    id_type = paged.schema["page_id"].dataType

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(page.as_py(), classes.as_py() or []) for page, classes in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    joined = paged.join(known, "host", "left").select("page_id", "url", "html", "classes")
    return joined.mapInArrow(run, f"page_id {id_type.simpleString()}, url string, text string")


def op5_html(spark, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extracted(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
