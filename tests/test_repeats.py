"""Large documents of few different texts: no work grows with the square of a page or a file."""

import time

from foliograph.operators import pdf
from foliograph.plans.catalogue import _docx_bytes
from foliograph.sources import docx
from pyspark.sql import functions as F

NAMES = ["large ring", "ring", "hot bolt", "Hot  bolt", "blue ring"]


def pages(spark, n):
    """n blocks on three pages, and every fourth as an entry."""
    k = F.col("id")
    name = F.element_at(F.array(*(F.lit(x) for x in NAMES)), ((k * 7 + F.floor(k / 11)) % len(NAMES) + 1).cast("int"))
    found = spark.range(1, n + 1).select(F.lit("d").alias("doc_id"), k.cast("int").alias("ordinal"), (k % 3 + 1).cast("int").alias("page"), name.alias("text"), (8.0 + k % 4).alias("size"))
    return found, found.filter("ordinal % 4 = 0").select("doc_id", "ordinal", (F.col("ordinal") % 3 + 1).alias("level"), F.col("text").alias("title"), "page")


def plain_matches(found, toc):
    """Every entry against every block of its pages."""
    best = {}
    for e in sorted(toc.collect(), key=lambda e: e.ordinal):
        needle = " ".join(e.title.lower().split())
        near = [b for b in found.collect() if b.page in (e.page, e.page + 1) and needle in b.text.lower()]
        if near:
            best[min(near, key=lambda b: (-len(needle) / len(b.text), b.page, b.ordinal)).ordinal] = e.level
    return best


def test_toc_match_of_equal_texts(spark):
    found, toc = pages(spark, 90)
    assert {r.ordinal: r.toc_level for r in pdf.match_toc(found, toc).collect()} == plain_matches(found.cache(), toc.cache())


def test_toc_match_is_linear_in_equal_texts(spark):
    found, toc = pages(spark, 120_000)
    began = time.time()
    assert pdf.match_toc(found, toc).count() > 3
    assert time.time() - began < 30


def test_level_votes_of_equal_texts(spark):
    """The level that most matched blocks of a size have; at this size no pair of equal texts may be built."""
    small, toc = pages(spark, 90)
    levels, sizes, body = plain_matches(small, toc), {r.ordinal: r["size"] for r in small.collect()}, pdf.size_hierarchy(small)
    votes = {}
    for o, level in sorted(levels.items()):
        votes.setdefault(sizes[o], []).append(level)
    own = {r["size"]: r.size_level for r in body.collect()}
    wanted = {s: max(votes[s], key=lambda v: (votes[s].count(v), -votes[s].index(v))) if s in votes else own[s] for s in own}
    assert {r["size"]: r.size_level for r in pdf.calibrate(body, small, pdf.match_toc(small, toc)).collect()} == wanted
    found, toc = pages(spark, 120_000)
    began = time.time()
    assert pdf.calibrate(pdf.size_hierarchy(found), found, pdf.match_toc(found, toc)).count() == 4
    assert time.time() - began < 30


def test_docx_is_read_in_linear_time():
    """The last section's layout stands in every row, and is looked for once."""
    body = "<w:p><w:r><w:t>large ring</w:t></w:r></w:p>" * 6000 + '<w:sectPr><w:pgMar w:top="567"/></w:sectPr>'
    content = _docx_bytes(body)
    began = time.time()
    rows = docx.read(content)
    assert time.time() - began < 10
    assert len(rows) == 6000 and [r["ordinal"] for r in rows] == list(range(6000)) and all(r["margins_cm"] == [("top", 1.0)] for r in rows)
