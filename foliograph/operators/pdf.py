"""Structure induction on span tables of page layouts.

raw_spans: doc_id, page, block, line, span, text, font, size, flags (2 italic, 16 bold), x0, y0, x1, y1
toc: doc_id, ordinal, level, title, page; regions: doc_id, page, x0, y0, x1, y1, text; images: doc_id, page
No PDF library is needed here; a reader that fills these tables is a plug-in (sources.pdf).
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliograph.functions import lexicon
from foliograph.functions import text as t
from foliograph.operators.blocks import with_offsets

POINTS_PER_CM = 28.3465
HEADING_CHARS = 140
CHARS_A_PAGE = 1500
BOX = ("x0", "y0", "x1", "y1")


def text_blocks(spans: DataFrame) -> DataFrame:
    """Spans as blocks: lines joined, font and size those of most characters, bold and italic those of over half."""
    line = spans.groupBy("doc_id", "page", "block", "line").agg(F.array_sort(F.collect_list(F.struct("span", "text"))).alias("s"))
    line = line.select("doc_id", "page", "block", "line", F.array_join(F.transform("s", lambda x: x.text), "").alias("text"))
    texts = line.groupBy("doc_id", "page", "block").agg(t.join_lines(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x.text)).alias("text"))
    chars = F.length("text")
    math = functools.reduce(lambda a, b: a | b, [F.lower("font").contains(h) for h in lexicon.MATH_FONTS])
    weight = lambda c: F.sum(F.when(c, chars).otherwise(0))
    by = ["doc_id", "page", "block"]
    shape = spans.groupBy(*by).agg(
        F.sum(chars).alias("chars"), weight(F.col("flags").bitwiseAND(16) != 0).alias("bold_chars"), weight(F.col("flags").bitwiseAND(2) != 0).alias("italic_chars"), weight(math).alias("math_chars"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )

    def most(value, name: str) -> DataFrame:
        sums = spans.filter(chars > 0).groupBy(*by, value.alias(name)).agg(F.sum(chars).alias("n"), F.min(F.struct("line", "span")).alias("first"))
        at = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("n").desc(), "first"))
        return sums.withColumn("at", at).filter("at = 1").select(*by, name)

    out = texts.join(shape, by).join(most(F.col("font"), "font"), by, "left").join(most(F.round("size", 1), "size"), by, "left")
    half = lambda c: F.coalesce(F.col(c) / F.nullif(F.col("chars"), F.lit(0)) > 0.5, F.lit(False))
    return out.select(*by, "text", "font", F.coalesce("size", F.lit(0.0)).alias("size"), half("bold_chars").alias("bold"), half("italic_chars").alias("italic"), F.coalesce(F.col("math_chars") / F.nullif(F.col("chars"), F.lit(0)), F.lit(0.0)).alias("math_ratio"), *BOX)


def outside_regions(blocks: DataFrame, regions: DataFrame, share: float = 0.5) -> DataFrame:
    """Blocks of which less than `share` of the area lies in any one table region of their page."""
    r = regions.select(F.col("doc_id").alias("r_doc"), F.col("page").alias("r_page"), *(F.col(c).alias(f"r_{c}") for c in BOX))
    wide = F.greatest(F.least("x1", "r_x1") - F.greatest("x0", "r_x0"), F.lit(0.0))
    high = F.greatest(F.least("y1", "r_y1") - F.greatest("y0", "r_y0"), F.lit(0.0))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    inside = (F.col("doc_id") == F.col("r_doc")) & (F.col("page") == F.col("r_page")) & (area > 0) & (wide * high >= share * area)
    return blocks.join(r, inside, "left_anti")


def in_reading_order(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "y0", "x0", "block")))


def size_hierarchy(blocks: DataFrame) -> DataFrame:
    """(doc_id, size, body_size, size_level): the body size has most characters (first seen of equals); larger ones rank from level 1 to 6."""
    weights = blocks.filter("size > 0").groupBy("doc_id", F.round("size", 1).alias("size")).agg(F.sum(F.length("text")).alias("chars"), F.min("ordinal").alias("first"))
    body = F.first("size").over(Window.partitionBy("doc_id").orderBy(F.col("chars").desc(), "first"))
    sized = weights.withColumn("body_size", body)
    larger = F.col("size") > F.col("body_size") * 1.05
    rank = F.dense_rank().over(Window.partitionBy("doc_id", larger).orderBy(F.col("size").desc()))
    return sized.select("doc_id", "size", "body_size", F.when(larger, F.least(rank, F.lit(6))).alias("size_level"))


def match_toc(blocks: DataFrame, toc: DataFrame) -> DataFrame:
    """(doc_id, ordinal, toc_level): each entry's best block on its page or the next; of entries for one block, the last.

    A score depends on texts only, so each pair of different texts of a page is compared once: of
    equal blocks the first stands for all, of equal entries the last.
    """
    needle = t.normalise_ws(F.lower("title"))
    entries = toc.select("doc_id", "page", F.col("ordinal").alias("entry"), "level", needle.alias("needle")).filter("needle <> ''")
    entries = entries.groupBy("doc_id", F.col("page").alias("toc_page"), "needle").agg(F.max_by("level", "entry").alias("level"), F.max("entry").alias("entry"))
    hays = blocks.groupBy("doc_id", "page", F.lower("text").alias("hay")).agg(F.min("ordinal").alias("ordinal"))
    hay, prefix = F.col("hay"), t.prefix_score(F.col("needle"), t.normalise_ws(F.col("hay")))
    score = F.when(F.contains(hay, F.col("needle")), F.length("needle") / F.greatest(F.length(hay), F.lit(1))).when(prefix > 0.8, prefix * 0.9)
    e = entries.select("*", F.explode(F.array(F.col("toc_page"), F.col("toc_page") + 1)).alias("page"))
    found = e.join(hays, ["doc_id", "page"]).withColumn("score", score).filter("score > 0")
    best = F.row_number().over(Window.partitionBy("doc_id", "toc_page", "needle").orderBy(F.col("score").desc(), "page", "ordinal"))
    return found.withColumn("at", best).filter("at = 1").groupBy("doc_id", "ordinal").agg(F.greatest(F.lit(1), F.least(F.lit(6), F.max_by("level", "entry"))).alias("toc_level"))


def calibrate(sizes: DataFrame, blocks: DataFrame, matches: DataFrame) -> DataFrame:
    """size_hierarchy with the level that most matched blocks of a size have in the table of contents."""
    votes = blocks.join(matches, ["doc_id", "ordinal"]).filter("size > 0").groupBy("doc_id", F.round("size", 1).alias("size"), "toc_level").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first"))
    won = votes.withColumn("at", F.row_number().over(Window.partitionBy("doc_id", "size").orderBy(F.col("n").desc(), "first"))).filter("at = 1").select("doc_id", "size", F.col("toc_level").alias("voted"))
    return sizes.join(won, ["doc_id", "size"], "left").select("doc_id", "size", "body_size", F.coalesce("voted", "size_level").alias("size_level"))


def classify(blocks: DataFrame, sizes: DataFrame, matches: DataFrame) -> DataFrame:
    """blocks with type, level, flags and offsets."""
    joined = blocks.join(sizes.withColumnRenamed("size", "size_key"), (blocks.doc_id == sizes.doc_id) & (F.round(blocks["size"], 1) == F.col("size_key")), "left").drop(sizes.doc_id)
    joined = joined.join(matches, ["doc_id", "ordinal"], "left")
    body = F.coalesce("body_size", F.lit(0.0))
    large = (F.col("size") >= body * 1.05) | (F.col("bold") & (F.col("size") >= body * 0.95))
    headed = F.col("size_level").isNotNull() & (F.length("text") <= HEADING_CHARS) & ~F.col("text").rlike(r"[.,;:]$") & large
    listed = F.col("toc_level").isNotNull()
    kind = F.coalesce(
        lexicon.first_case([
            (t.caption_kind("text").isNotNull(), "caption"), ((F.col("math_ratio") > 0.5) & (F.length("text") < 200), "equation"), (headed | listed, "heading"),
            (F.col("text").rlike(t.PDF_BULLET), "list_item"), (F.contains("text", F.lit("\t")) & F.col("font").isNull(), "table"),
        ]), F.lit("paragraph"),
    )
    flag = F.when(kind == "equation", "math_fonts").when((kind == "heading") & ~listed, "heading_inferred").when(kind == "table", "table_detected")
    typed = joined.withColumn("type", kind).withColumn("level", F.when(kind == "heading", F.coalesce("toc_level", "size_level"))).withColumn("flags", F.array_compact(F.array(flag)))
    return with_offsets(typed.drop("size_key", "body_size", "size_level", "toc_level"))


def heading_source(matches: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc_id, heading_source): toc+font-size, toc, font-size clustering or none."""
    s = sizes.groupBy("doc_id").agg(F.max(F.col("size_level").isNotNull()).alias("sized"))
    m = matches.select("doc_id").distinct().withColumn("listed", F.lit(True))
    both = s.join(m, "doc_id", "full").fillna(False, ["sized", "listed"])
    return both.select("doc_id", F.when(F.col("listed") & F.col("sized"), "toc+font-size").when(F.col("listed"), "toc").when(F.col("sized"), "font-size clustering").otherwise("none").alias("heading_source"))


def margins(blocks: DataFrame, page_dims: DataFrame) -> DataFrame:
    """(doc_id, margins_cm, page_size): the distances of the text's ink from the page's edges. page_dims: doc_id, width, height in points."""
    ink = blocks.groupBy("doc_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).join(page_dims, "doc_id")
    cm = lambda c: F.round(F.greatest(c, F.lit(0.0)) / POINTS_PER_CM, 2)
    sides = F.create_map(F.lit("top"), cm(F.col("y0")), F.lit("bottom"), cm(F.col("height") - F.col("y1")), F.lit("inner"), cm(F.col("x0")), F.lit("outer"), cm(F.col("width") - F.col("x1")))
    return ink.select("doc_id", sides.alias("margins_cm"), lexicon.page_size(F.col("width") / POINTS_PER_CM, F.col("height") / POINTS_PER_CM).alias("page_size"))


def coverage(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, coverage): characters against CHARS_A_PAGE a page, 1 at most. pages: doc_id, pages."""
    n = blocks.groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars"))
    return pages.join(n, "doc_id", "left").select("doc_id", F.when(F.col("pages") > 0, F.least(F.lit(1.0), F.coalesce("chars", F.lit(0)) / (F.col("pages") * CHARS_A_PAGE))).otherwise(0.0).alias("coverage"))


def induce(spans: DataFrame, toc: DataFrame, regions: DataFrame) -> DataFrame:
    """The blocks table of page layouts; table regions become blocks without a font."""
    texts = outside_regions(text_blocks(spans), regions)
    tables = regions.select("doc_id", "page", F.lit(-1).alias("block"), "text", F.lit(None).cast("string").alias("font"), F.lit(0.0).alias("size"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.lit(0.0).alias("math_ratio"), *BOX)
    blocks = in_reading_order(texts.unionByName(tables).filter("text <> ''"))
    matches = match_toc(blocks, toc)
    return classify(blocks, calibrate(size_hierarchy(blocks), blocks, matches), matches)
