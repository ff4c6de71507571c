"""Registered queries of the document engine and their DuckDB counterparts.

The tables hold prose without markup, so queries on structure derive headings, citations,
captions and the like from ids and texts, by one rule in both engines.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from foliograph.functions import citations as cite
from foliograph.functions import language, lexicon, references
from foliograph.functions import text as t
from foliograph.operators import analysers, bibliography, blocks, citations, enrich, exclusions, floats, languages, metrics, pdf, sections, segments
from foliograph.plans import stages
from foliograph.session import stored
from foliograph.sources import docx, latex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Blocks of lines.

LINES = """lines AS (
  SELECT doc_id, i - 1 AS ordinal, l[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i) WHERE trim(l[i]) <> ''
), blocks AS (
  SELECT *, 'b' || lpad((row_number() OVER w)::VARCHAR, 4, '0') AS block_id,
    coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)
)"""
SQL_CAPTION = r"(?i)^\s*(?:(?:Rys\.|Rysunek|Figure|Fig\.|Wykres|Schemat|Fot\.|Fotografia)|(?:Tab\.|Tabela|Table|Tablica))\s*\.?\s*([\dIVXL]+(?:[.\-][\dIVXL]+)*)"
SQL_BULLET = r"^\s*([•·◦‣⁃–—-]|\d{1,3}[.)]|[a-zA-Z][.)])\s+"
SQL_TYPE = f"CASE WHEN regexp_matches(text, '{SQL_CAPTION}') THEN 'caption' WHEN regexp_matches(text, '{SQL_BULLET}') THEN 'list_item' ELSE 'paragraph' END"


@query(f"WITH {LINES} SELECT doc_id, ordinal::INT AS ordinal, block_id, start, (start + length(text))::INT AS \"end\", md5(text) AS text_md5 FROM blocks")
def block_offsets(spark, sf_dir):
    found = blocks.from_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "ordinal", "block_id", "start", "end", F.md5("text").alias("text_md5"))


@query(f"WITH {LINES} SELECT count(*) AS blocks, 0::BIGINT AS violations FROM blocks")
def offset_violations(spark, sf_dir):
    found = blocks.from_lines(table(spark, sf_dir, "documents"))
    bad = blocks.offset_violations(found, blocks.plain_text(found)).agg(F.count(F.lit(1)).alias("violations"))
    return found.agg(F.count(F.lit(1)).alias("blocks")).join(bad)  # one row each


SQL_WORDS = r"len(list_filter(regexp_split_to_array({0}, '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+'), lambda w: w <> ''))"


@query(f"SELECT 'documents' AS origin, doc_id AS id, {SQL_WORDS.format('text')}::INT AS words, length(text)::INT AS chars FROM documents UNION ALL SELECT 'pages', page_id, {SQL_WORDS.format('html')}::INT, length(html)::INT FROM pages")
def word_char_counts(spark, sf_dir):
    count = lambda df, origin, key, text: df.select(F.lit(origin).alias("origin"), F.col(key).alias("id"), t.count_words(text).alias("words"), F.length(text).alias("chars"))
    return count(table(spark, sf_dir, "documents"), "documents", "doc_id", "text").unionByName(count(table(spark, sf_dir, "pages"), "pages", "page_id", "html"))


@query("SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text))::INT AS n_bytes FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("n_bytes"))


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def sql_detect(text: str) -> str:
    w = f"regexp_extract_all(lower({text}), '\\p{{L}}+')"
    pl, en = (f"len(list_filter({w}, lambda x: list_contains({sql_list(s)}, x)))" for s in (language.POLISH, language.ENGLISH))
    return f"CASE WHEN len({w}) < 8 OR ({pl} = 0 AND {en} = 0) THEN NULL WHEN {pl} >= {en} THEN 'pl' ELSE 'en' END"


BLOCK_LANG = f"WITH {LINES}, typed AS (SELECT *, {SQL_TYPE} AS type FROM blocks), tagged AS (SELECT doc_id, ordinal, text, CASE WHEN type IN ('paragraph', 'list_item') AND length(text) >= 40 THEN {sql_detect('text')} END AS lang FROM typed)"


@query(f"{BLOCK_LANG} SELECT doc_id, ordinal::INT AS ordinal, lang FROM tagged")
def block_language(spark, sf_dir):
    found = blocks.from_lines(table(spark, sf_dir, "documents"))
    prose = F.col("type").isin(*lexicon.LANGUAGE_TYPES) & (F.length("text") >= language.MIN_CHARS)
    return found.select("doc_id", "ordinal", F.when(prose, language.detect("text")).alias("lang"))


DOC_LANG = BLOCK_LANG + """, weighed AS (SELECT doc_id, lang, sum(length(text)) AS chars FROM tagged GROUP BY 1, 2), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY lang IS NULL, chars DESC, lang <> 'pl') AS at FROM weighed), doc_lang AS (SELECT doc_id, coalesce(lang, 'pl') AS language_primary FROM ranked WHERE at = 1)"""


@query(f"{DOC_LANG} SELECT * FROM doc_lang".replace("AS at ", "AS pos ").replace("WHERE at =", "WHERE pos ="))
def doc_language(spark, sf_dir):
    return languages.primary_language(blocks.from_lines(table(spark, sf_dir, "documents")))


@query(f"WITH {LINES} SELECT doc_id, {SQL_TYPE} AS type, count(*) AS n, sum(length(text))::BIGINT AS chars FROM blocks GROUP BY 1, 2")
def block_types(spark, sf_dir):
    found = blocks.from_lines(table(spark, sf_dir, "documents"))
    return found.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


# Sections of derived headings.

HEADINGS = ("Wstęp", "2.1. Metodyka badań", "Wyniki eksperymentów", "Bibliografia", "Zupełnie inny tytuł", "Streszczenie", "Spis treści", "Dodatek A", "Oświadczenie autora", "Chapter 3 Conclusions", "Przegląd literatury", "Abstract", "Słowa kluczowe")
KINDS = "\n".join(f"({i}, '{k}', {j}, '{n}')," for i, (k, ns) in enumerate(lexicon.SECTION_LEXICON.items()) for j, n in enumerate(ns)).rstrip(",")
SQL_KEY = r"trim(regexp_replace(trim(regexp_replace(regexp_replace(strip_accents(lower(trim({0}))), '[^\p{{L}}\p{{N}}_\s%-]', ' ', 'g'), '\s+', ' ', 'g')), '^[\d.)\s]*(rozdzial|chapter|czesc|part)?[\s\d.)]*', ''))"


def sql_kinds(source: str, column: str) -> str:
    """CTE named_kinds(title, kind) of the distinct titles of a CTE."""
    return f"""lexicon(kind_rank, kind, needle_rank, needle) AS (VALUES {KINDS}), titles AS (SELECT DISTINCT {column} AS title, {SQL_KEY.format(column)} AS key FROM {source}),
    tried AS (SELECT title, kind, row_number() OVER (PARTITION BY title ORDER BY NOT (key = needle OR starts_with(key, needle || ' ') OR starts_with(key, needle || ',')), kind_rank, needle_rank) AS pos FROM titles JOIN lexicon ON contains(key, needle)),
    named_kinds AS (SELECT title, tried.kind AS kind FROM titles LEFT JOIN (SELECT * FROM tried WHERE pos = 1) tried USING (title))"""


H1 = "heads AS (SELECT page_id, unnest(regexp_extract_all(html, '<h1>([^<]*)', 1)) AS title FROM pages UNION ALL SELECT -i, v[i] FROM (SELECT {0} AS v), unnest(range(1, {1})) AS u(i))".format(sql_list(HEADINGS), len(HEADINGS) + 1)


@query(f"WITH {H1}, {sql_kinds('heads', 'title')} SELECT page_id, title, kind FROM heads LEFT JOIN named_kinds USING (title)")
def heading_kinds(spark, sf_dir):
    own = spark.createDataFrame([(-i, h) for i, h in enumerate(HEADINGS, 1)], "page_id long, title string")
    heads = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<h1>([^<]*)"), F.lit(1))).alias("title")).unionByName(own)
    return heads.select("page_id", "title", lexicon.section_kind("title").alias("kind"))


def derived_blocks(docs: DataFrame) -> DataFrame:
    """Lines as blocks of a thesis: every ninth a heading, others quotes, code, captions and paragraphs that cite."""
    line = blocks.from_lines(docs)
    at, doc = F.col("ordinal"), F.col("doc_id")
    step = at % 9
    kind = lexicon.first_case([(step == 0, "heading"), (step == 4, "quote"), (step == 5, "code"), (step == 6, "caption"), (step == 7, "table")])
    title = F.element_at(F.array(*(F.lit(h) for h in HEADINGS)), ((doc * 7 + at) % len(HEADINGS) + 1).cast("int"))
    number = ((doc + at) % 4 + 1).cast("string")
    text = F.when(step == 0, title).when(step == 6, F.concat(F.when(doc % 2 == 0, "Rys. ").otherwise("Table "), number, F.lit(" "), "text"))
    text = text.otherwise(F.concat("text", F.lit(" ["), ((doc + at) % 5 + 1).cast("string"), F.lit(", "), ((doc + at) % 3 + 6).cast("string"), F.lit("], rys. "), number))
    base = line.select("doc_id", "ordinal", F.coalesce(kind, F.lit("paragraph")).alias("type"), F.when(step == 0, (1 + (doc + at) % 2).cast("int")).alias("level"), text.alias("text"), F.floor(at / 10).cast("int").alias("p"))
    return blocks.with_offsets(base.select("*", (F.col("p") + 1).alias("page")).drop("p").withColumn("flags", F.array().cast("array<string>")))


THESIS = f"""{LINES}, derived AS (
  SELECT doc_id, ordinal, CASE ordinal % 9 WHEN 0 THEN 'heading' WHEN 4 THEN 'quote' WHEN 5 THEN 'code' WHEN 6 THEN 'caption' WHEN 7 THEN 'table' ELSE 'paragraph' END AS type,
    CASE WHEN ordinal % 9 = 0 THEN 1 + (doc_id + ordinal) % 2 END AS level, ordinal // 10 + 1 AS page,
    CASE ordinal % 9 WHEN 0 THEN {sql_list(HEADINGS)}[(doc_id * 7 + ordinal) % {len(HEADINGS)} + 1]
      WHEN 6 THEN CASE WHEN doc_id % 2 = 0 THEN 'Rys. ' ELSE 'Table ' END || ((doc_id + ordinal) % 4 + 1) || ' ' || text
      ELSE text || ' [' || ((doc_id + ordinal) % 5 + 1) || ', ' || ((doc_id + ordinal) % 3 + 6) || '], rys. ' || ((doc_id + ordinal) % 4 + 1) END AS text
  FROM lines
), thesis AS (
  SELECT *, 'b' || lpad((row_number() OVER (PARTITION BY doc_id ORDER BY ordinal))::VARCHAR, 4, '0') AS block_id,
    coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM derived
), spanned AS (SELECT *, start + length(text) AS stop FROM thesis
), topped AS (SELECT *, min(level) OVER (PARTITION BY doc_id) AS top FROM spanned
), assigned AS (SELECT *, coalesce(level <= top, false) AS cut, sum(coalesce(level <= top, false)::INT) OVER (PARTITION BY doc_id ORDER BY ordinal) AS section_no FROM topped)"""
SECTIONS = f"""{THESIS}, {sql_kinds("(SELECT text FROM thesis WHERE type = 'heading')", 'text')},
grouped AS (SELECT doc_id, section_no, max(text) FILTER (WHERE cut) AS heading, bool_or(top IS NOT NULL) AS headed, count(*) AS n_blocks, min(page) FILTER (WHERE NOT cut) AS first_page, max(page) FILTER (WHERE NOT cut) AS last_page FROM assigned GROUP BY 1, 2),
named AS (SELECT g.*, CASE WHEN section_no = 0 AND headed THEN 'title_page' WHEN section_no = 0 THEN 'other' ELSE coalesce(k.kind, 'other') END AS kind0,
  CASE WHEN section_no = 0 AND headed THEN '(front matter)' WHEN section_no = 0 THEN '(no headings detected)' ELSE heading END AS title, row_number() OVER (PARTITION BY doc_id ORDER BY section_no) AS ordinal FROM grouped g LEFT JOIN named_kinds k ON k.title = g.heading),
promoted AS (SELECT *, CASE WHEN headed AND ordinal = 1 AND kind0 = 'other' AND bool_or(kind0 IN ('statement', 'abstract_pl', 'abstract_en', 'toc', 'introduction', 'bibliography')) OVER (PARTITION BY doc_id ORDER BY section_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) THEN 'title_page' ELSE kind0 END AS kind1 FROM named),
sections AS (SELECT *, CASE WHEN headed AND ordinal = 1 AND kind1 = 'other' AND NOT bool_or(kind1 = 'introduction') OVER (PARTITION BY doc_id) THEN 'introduction' ELSE kind1 END AS kind FROM promoted)"""


@query(f"WITH {SECTIONS} SELECT doc_id, 's' || lpad(ordinal::VARCHAR, 4, '0') AS section_id, kind, title, n_blocks::INT AS n_blocks, first_page::INT AS first_page, last_page::INT AS last_page FROM sections")
def sectionise(spark, sf_dir):
    found = sections.build_sections(sections.assign_sections(derived_blocks(table(spark, sf_dir, "documents"))))
    return found.select("doc_id", "section_id", "kind", "title", F.size("block_ids").alias("n_blocks"), F.col("page_range.min").alias("first_page"), F.col("page_range.max").alias("last_page"))


@query(f"WITH {SECTIONS} SELECT kind0 AS lexical_kind, kind, count(*) AS n FROM sections WHERE ordinal = 1 GROUP BY 1, 2")
def front_matter_promotion(spark, sf_dir):
    found = sections.build_sections(sections.assign_sections(derived_blocks(table(spark, sf_dir, "documents")))).filter("ordinal = 1")
    plain = F.when(F.col("title") == "(front matter)", "title_page").when(F.col("title") == "(no headings detected)", "other").otherwise(F.coalesce(lexicon.section_kind("title"), F.lit("other")))
    return found.groupBy(plain.alias("lexical_kind"), "kind").agg(F.count(F.lit(1)).alias("n"))


# The exclusion mask on derived ranges.

RANGES = "ranges AS (SELECT l_orderkey AS doc_id, (l_partkey % 400)::INT AS start, (l_partkey % 400 + l_quantity * 3 - 3)::INT AS stop, ['toc', 'quote', 'code'][(l_suppkey % 3)::INT + 1] AS reason FROM lineitem)"
MERGED = f"""{RANGES}, runs AS (
  SELECT *, sum(changed) OVER (PARTITION BY doc_id ORDER BY start, stop, reason ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT *, CASE WHEN lag(reason) OVER (PARTITION BY doc_id ORDER BY start, stop, reason) = reason THEN 0 ELSE 1 END AS changed FROM ranges WHERE stop > start)
), apart AS (
  SELECT *, CASE WHEN start > max(stop) OVER (PARTITION BY doc_id, run ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS gap FROM runs
), islands AS (SELECT *, sum(gap) OVER (PARTITION BY doc_id, run ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM apart
), merged AS (SELECT doc_id, min(start) AS start, max(stop) AS stop, any_value(reason) AS reason FROM islands GROUP BY doc_id, run, island)"""


def derived_ranges(spark, sf_dir) -> DataFrame:
    start = (F.col("l_partkey") % 400).cast("int")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), start.alias("start"), (start + F.col("l_quantity") * 3 - 3).cast("int").alias("end"), F.element_at(F.array(F.lit("toc"), F.lit("quote"), F.lit("code")), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("reason"))


@query(f'WITH {MERGED} SELECT doc_id, start, stop AS "end", reason FROM merged')
def exclusion_merge(spark, sf_dir):
    return exclusions.merge_ranges(derived_ranges(spark, sf_dir))


@query(f"WITH {LINES}, {MERGED} SELECT doc_id, block_id FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.doc_id = b.doc_id AND m.start < b.start + length(b.text) AND b.start < m.stop)")
def analysable_blocks(spark, sf_dir):
    mask = exclusions.merge_ranges(derived_ranges(spark, sf_dir))
    return exclusions.analysable_blocks(blocks.from_lines(table(spark, sf_dir, "documents")), mask).select("doc_id", "block_id")


# Citations and references.


@query(
    f"WITH {THESIS} SELECT doc_id, block_id, b[i] AS inside, [((doc_id + ordinal) % 5 + 1)::VARCHAR, ((doc_id + ordinal) % 3 + 6)::VARCHAR]::VARCHAR[] AS keys FROM (SELECT *, regexp_extract_all(text, '\\[(\\d{{1,3}}(?:\\s*[,;]\\s*\\d{{1,3}}|\\s*[-–—]\\s*\\d{{1,3}})*)\\]', 1) AS b FROM thesis), unnest(range(1, len(b) + 1)) AS u(i)".replace(
        "[((doc_id + ordinal) % 5 + 1)::VARCHAR, ((doc_id + ordinal) % 3 + 6)::VARCHAR]::VARCHAR[] AS keys", "((doc_id + ordinal) % 5 + 1) || ',' || ((doc_id + ordinal) % 3 + 6) AS keys"
    )
)
def numeric_citations(spark, sf_dir):
    found = derived_blocks(table(spark, sf_dir, "documents")).select("doc_id", "block_id", F.explode(cite.numeric_brackets(F.col("text"))).alias("inside"))
    return found.select("doc_id", "block_id", "inside", F.array_join(cite.numeric_keys(F.col("inside")), ",").alias("keys"))


CITED = ", cited AS (SELECT *, start + length(text) - length(regexp_extract(text, '\\[\\d, \\d\\], rys\\. \\d$')) AS c_start FROM thesis WHERE type IN ('paragraph', 'quote'))"


@query(f"WITH {THESIS} {CITED} SELECT doc_id, block_id, regexp_extract(text, '(\\[\\d, \\d\\]), rys\\. \\d$', 1) AS raw, 'numeric' AS style, c_start::INT AS start, (c_start + 6)::INT AS \"end\" FROM cited")
def citation_spans(spark, sf_dir):
    return citations.hits(derived_blocks(table(spark, sf_dir, "documents"))).select("doc_id", "block_id", "raw", "style", "start", "end")


REF_LINE = "'[' || (p_partkey % 40 + 1) || '] Kowalski J., Nowak A.: Prace ' || replace(p_name, ':', ' ') || '. Wydawnictwo ' || replace(p_brand, '#', ' ') || ' ' || (1990 + p_size % 30) || '. doi:10.1000/x' || p_partkey"


def derived_references(spark, sf_dir) -> DataFrame:
    """Bibliography entries of 50 documents, made of parts."""
    part = table(spark, sf_dir, "part")
    raw = F.concat(
        F.lit("["), (F.col("p_partkey") % 40 + 1).cast("string"), F.lit("] Kowalski J., Nowak A.: Prace "), F.replace("p_name", F.lit(":"), F.lit(" ")), F.lit(". Wydawnictwo "), F.replace("p_brand", F.lit("#"), F.lit(" ")),
        F.lit(" "), (F.col("p_size") % 30 + 1990).cast("string"), F.lit(". doi:10.1000/x"), F.col("p_partkey").cast("string"),
    )
    return part.select((F.col("p_partkey") % 50).alias("doc_id"), F.col("p_partkey").alias("ordinal"), raw.alias("text"), F.lit("bibitem").alias("type"))


@query(f"""SELECT p_partkey AS ordinal, {REF_LINE} AS raw, 'Kowalski J;Nowak A' AS authors, regexp_replace('Prace ' || replace(p_name, ':', ' ') || '. Wydawnictwo ' || replace(p_brand, '#', ' '), '\\s+', ' ', 'g') AS title,
  (1990 + p_size % 30)::INT AS year, 'doi:10' AS venue, '10.1000/x' || p_partkey AS doi, NULL::VARCHAR AS url, 1.0::DOUBLE AS confidence FROM part""")
def reference_fields(spark, sf_dir):
    lines = derived_references(spark, sf_dir)
    found = references.with_fields(lines.select("ordinal", F.col("text").alias("raw")))
    return found.withColumn("authors", F.array_join("authors", ";"))


@query(f"""SELECT p_partkey % 50 AS doc_id, 'r' || lpad((row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY p_partkey))::VARCHAR, 3, '0') AS ref_id, {REF_LINE} AS raw, (1990 + p_size % 30)::INT AS year FROM part""")
def bibliography_harvest(spark, sf_dir):
    return bibliography.harvest(derived_references(spark, sf_dir)).select("doc_id", "ref_id", "raw", "year")


RESOLVED = f"""WITH {THESIS} {CITED}, refs AS (SELECT p_partkey % 50 AS doc_id, (row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY p_partkey)) AS n, row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY p_partkey) % 2 AS odd FROM part),
listed AS (SELECT doc_id, n, 'r' || lpad(n::VARCHAR, 3, '0') AS ref_id FROM refs),
linked AS (SELECT c.doc_id, block_id, 'c' || lpad((row_number() OVER (PARTITION BY c.doc_id ORDER BY c.c_start))::VARCHAR, 4, '0') AS citation_id, ref_id FROM cited c LEFT JOIN listed f ON f.doc_id = c.doc_id AND f.n = (c.doc_id + ordinal) % 5 + 1)"""


def linked_citations(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    refs = stored(bibliography.harvest(derived_references(spark, sf_dir)), "refs")
    found = derived_blocks(table(spark, sf_dir, "documents"))
    none = found.limit(0).select("doc_id", "start", "end", F.lit("toc").alias("reason"))
    return citations.attach(found, refs, none), refs


@query(f"{RESOLVED} SELECT doc_id, citation_id, block_id, ref_id FROM linked")
def citation_resolution(spark, sf_dir):
    return linked_citations(spark, sf_dir)[0].select("doc_id", "citation_id", "block_id", "ref_id")


@query(f"{RESOLVED} SELECT doc_id, count(*) AS orphans FROM linked WHERE ref_id IS NULL GROUP BY 1")
def orphan_citations(spark, sf_dir):
    return citations.orphans(linked_citations(spark, sf_dir)[0]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("orphans"))


@query(f"{RESOLVED} SELECT doc_id, ref_id FROM listed f WHERE NOT EXISTS (SELECT 1 FROM linked l WHERE l.doc_id = f.doc_id AND l.ref_id = f.ref_id)")
def uncited_references(spark, sf_dir):
    cites, refs = linked_citations(spark, sf_dir)
    return citations.uncited(refs, cites).select("doc_id", "ref_id")


AUTHOR_REFS = "refs AS (SELECT c_nationkey AS doc_id, c_custkey AS ordinal, 'Jan K' || chr((97 + c_custkey % 26)::INT) || 'wal, X.' AS author, (1980 + c_custkey % 11)::INT AS year FROM customer)"


@query(f"WITH {AUTHOR_REFS}, first AS (SELECT doc_id, lower(regexp_replace(split_part(author, ',', 1), '^Jan ', '')) AS surname, year AS ref_year, 'r' || min(ordinal) AS by_name FROM refs GROUP BY 1, 2, 3) SELECT * FROM first")
def surname_year_index(spark, sf_dir):
    return citations.surname_years(derived_author_refs(spark, sf_dir))


AUTHOR_TEXT = "texts AS (SELECT c_nationkey AS doc_id, c_custkey AS ordinal, 'K' || chr((97 + (c_custkey * 7) % 26)::INT) || 'wal' AS name, (1978 + c_custkey % 15)::INT AS year, c_custkey % 4 AS shape FROM customer)"


def derived_author_refs(spark, sf_dir) -> DataFrame:
    """References of each nation's customers: one author and a year."""
    c = table(spark, sf_dir, "customer")
    name = F.concat(F.lit("Jan K"), F.char((F.lit(97) + F.col("c_custkey") % 26)), F.lit("wal, X."))
    return c.select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("ordinal"), F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("ref_id"), F.array(name).alias("authors"), (1980 + F.col("c_custkey") % 11).cast("int").alias("year"))


@query(
    f"""WITH {AUTHOR_REFS}, {AUTHOR_TEXT}, first AS (SELECT doc_id, lower(regexp_replace(split_part(author, ',', 1), '^Jan ', '')) AS surname, year, 'r' || min(ordinal) AS ref_id FROM refs GROUP BY 1, 2, 3),
 said AS (SELECT *, CASE shape WHEN 0 THEN '(' || name || ', ' || year || ')' WHEN 1 THEN '[' || name || ' i Nowak, ' || year || ']' WHEN 2 THEN name || ' (' || year || ')' ELSE '(' || name || ' ' || year || ')' END AS raw,
  row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS n FROM texts)
 SELECT s.doc_id, 'c' || lpad(s.n::VARCHAR, 4, '0') AS citation_id, raw, 'author_year' AS style, name || CASE WHEN shape = 1 THEN ' i Nowak' ELSE '' END || ', ' || s.year AS "key", f.ref_id FROM said s LEFT JOIN first f ON f.doc_id = s.doc_id AND f.surname = lower(s.name) AND f.year = s.year"""
)
def author_year_links(spark, sf_dir):
    k = F.col("c_custkey")
    name, year = F.concat(F.lit("K"), F.char(F.lit(97) + k * 7 % 26), F.lit("wal")), (1978 + k % 15).cast("string")
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    shape = F.when(k % 4 == 0, say("(", name, ", ", year, ")")).when(k % 4 == 1, say("[", name, " i Nowak, ", year, "]")).when(k % 4 == 2, say(name, " (", year, ")")).otherwise(say("(", name, " ", year, ")"))
    lines = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc_id"), k.alias("ordinal"), F.concat(F.lit("Opisano to w pracy "), shape, F.lit(" 12 (a) szerzej.")).alias("text"), F.lit("paragraph").alias("type"))
    found = blocks.with_offsets(lines)
    none = found.limit(0).select("doc_id", "start", "end", F.lit("toc").alias("reason"))
    linked = citations.attach(found, derived_author_refs(spark, sf_dir), none)
    return linked.select("doc_id", "citation_id", "raw", "style", F.array_join("keys", ";").alias("key"), "ref_id")


@query(
    """WITH refs AS (SELECT o_custkey AS doc_id, o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE lower(o_orderpriority) END AS title, CASE WHEN o_orderkey % 5 <> 0 THEN year(o_orderdate)::INT END AS year, CASE WHEN o_orderkey % 11 = 0 THEN '10.1/' || o_orderpriority END AS doi FROM orders),
 keyed AS (SELECT doc_id, 'r' || o_orderkey AS ref_id, coalesce(lower(doi), lower(title) || CASE WHEN year IS NULL THEN '' ELSE '|' || year END) AS key FROM refs)
 SELECT doc_id, key, count(*) AS n, min(ref_id) AS first_ref FROM keyed WHERE key IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1"""
)
def duplicate_references(spark, sf_dir):
    k = F.col("o_orderkey")
    title = F.when(k % 7 == 0, None).when(k % 3 == 0, F.col("o_orderstatus")).otherwise(F.initcap(F.lower("o_orderpriority")))
    refs = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.concat(F.lit("r"), k.cast("string")).alias("ref_id"), title.alias("title"), F.when(k % 5 != 0, F.year("o_orderdate")).alias("year"), F.when(k % 11 == 0, F.concat(F.lit("10.1/"), "o_orderpriority")).alias("doi")
    )
    found = citations.duplicate_references(refs)
    return found.select("doc_id", "key", F.size("ref_ids").cast("long").alias("n"), F.array_min("ref_ids").alias("first_ref"))


# Formats: files written from the tables, and the blocks that their readers find.


def _docx_bytes(document: str) -> bytes:
    """A DOCX container of a document.xml body, with the styles that the queries name."""
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
    style = lambda i, name, more="": f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{name}"/><w:basedOn w:val="Normal"/>{more}</w:style>'
    defaults = '<w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:ascii="Times New Roman"/><w:sz w:val="24"/></w:rPr></w:rPrDefault></w:docDefaults><w:style w:type="paragraph" w:styleId="Normal" w:default="1"><w:name w:val="Normal"/></w:style>'
    styles = defaults + style("H1", "heading 1") + style("H2", "Nagłówek 2") + style("Q", "Quote") + style("C", "caption") + style("L", "List Paragraph") + style("T", "toc 1") + style("Big", "Big", '<w:rPr><w:b/><w:sz w:val="32"/></w:rPr>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f"<w:document {space}><w:body>{document}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {space}>{styles}</w:styles>")
    return out.getvalue()


@F.pandas_udf(BinaryType())
def docx_file(bodies: pd.Series) -> pd.Series:
    return bodies.map(_docx_bytes)


#: What each part of a supplier's file is, by part number: heading, second heading, quote, caption, list item, toc line, inferred heading, formula, table, code and text.
DOCX_PARTS = ("H1", "H2", "Q", "C", "L", "T", "Big", "math", "table", "code", "", "")


def _escaped(text) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


@query(
    f"""WITH parts AS (SELECT p_brand AS doc_id, p_partkey, {sql_list(DOCX_PARTS)}[p_partkey % {len(DOCX_PARTS)} + 1] AS part, CASE WHEN p_partkey % {len(DOCX_PARTS)} = 3 THEN 'Rys. ' || p_size || ' ' ELSE '' END || p_name || CASE WHEN p_partkey % 24 = 10 THEN ' & < >' WHEN p_partkey % {len(DOCX_PARTS)} = 8 THEN chr(9) || p_type ELSE '' END AS text FROM part),
 rows AS (SELECT doc_id, p_partkey, text, CASE part WHEN 'H1' THEN 'heading' WHEN 'H2' THEN 'heading' WHEN 'Q' THEN 'quote' WHEN 'C' THEN 'caption' WHEN 'L' THEN 'list_item' WHEN 'Big' THEN 'heading' WHEN 'math' THEN 'equation' WHEN 'table' THEN 'table' WHEN 'code' THEN 'code' ELSE 'paragraph' END AS type,
  CASE part WHEN 'H1' THEN 1 WHEN 'H2' THEN 2 WHEN 'Big' THEN 1 END AS level, CASE part WHEN 'T' THEN 'toc' WHEN 'Big' THEN 'heading_inferred' ELSE '' END AS flags,
  row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM (SELECT *, doc_id AS p_brand FROM parts))
 SELECT doc_id, 'b' || lpad(n::VARCHAR, 4, '0') AS block_id, type, level::INT AS level, text, flags, start, (start + length(text))::INT AS "end" FROM rows"""
)
def docx_blocks(spark, sf_dir):
    k, part = F.col("p_partkey"), F.element_at(F.array(*(F.lit(p) for p in DOCX_PARTS)), (F.col("p_partkey") % len(DOCX_PARTS) + 1).cast("int"))
    run = lambda text, props="": F.concat(F.lit(f"<w:r><w:rPr>{props}</w:rPr><w:t>"), text, F.lit("</w:t></w:r>"))
    name = F.concat(F.when(part == "C", F.concat(F.lit("Rys. "), F.col("p_size").cast("string"), F.lit(" "))).otherwise(""), _escaped(F.col("p_name")), F.when(k % 24 == 10, " &amp; &lt; &gt;").otherwise(""))
    cells = F.concat(*(F.concat(F.lit("<w:tc><w:p>"), run(_escaped(F.col(c))), F.lit("</w:p></w:tc>")) for c in ("p_name", "p_type")))
    body = (
        F.when(part == "table", F.concat(F.lit("<w:tbl><w:tr>"), cells, F.lit("</w:tr></w:tbl>")))
        .when(part == "math", F.concat(F.lit("<w:p><m:oMath><m:r><m:t>"), name, F.lit("</m:t></m:r></m:oMath></w:p>")))
        .when(part == "code", F.concat(F.lit("<w:p>"), run(name, '<w:rFonts w:ascii="Consolas"/>'), F.lit("</w:p>")))
        .otherwise(F.concat(F.lit('<w:p><w:pPr><w:pStyle w:val="'), F.when(part == "", "Normal").otherwise(part), F.lit('"/></w:pPr>'), run(name), F.lit("</w:p>")))
    )
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), k.alias("k"), body.alias("body"))
    rows = rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "doc_id")  # by count, as reading costs more than the bytes suggest
    made = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "body"))).alias("parts"))
    found = docx.classified(docx.raw_rows(made.select("doc_id", docx_file(F.array_join(F.transform("parts", lambda p: p.body), "")).alias("content"))))
    return found.select("doc_id", "block_id", "type", "level", "text", F.array_join("flags", ";").alias("flags"), "start", "end")


#: What each part of a project's main file is, by part number.
TEX_PARTS = ("chapter", "section", "subsection", "text", "quote", "item", "caption", "equation", "code", "cite", "footnote", "text")


@query(
    f"""WITH parts AS (SELECT p_brand AS doc_id, p_partkey, {sql_list(TEX_PARTS)}[p_partkey % {len(TEX_PARTS)} + 1] AS part, replace(replace(p_name, '#', ' '), ':', ' ') AS name FROM part),
 rows AS (SELECT doc_id, p_partkey, 0 AS sub, CASE part WHEN 'chapter' THEN 'heading' WHEN 'section' THEN 'heading' WHEN 'subsection' THEN 'heading' WHEN 'quote' THEN 'quote' WHEN 'item' THEN 'list_item' WHEN 'caption' THEN 'caption' WHEN 'equation' THEN 'equation' WHEN 'code' THEN 'code' ELSE 'paragraph' END AS type,
   CASE part WHEN 'chapter' THEN 1 WHEN 'section' THEN 2 WHEN 'subsection' THEN 3 END - CASE WHEN bool_or(part = 'chapter') OVER (PARTITION BY doc_id) THEN 0 ELSE 1 END AS level, CASE WHEN part = 'cite' THEN 'Zob. [k' || p_partkey || '] ' || name WHEN part = 'text' THEN name || ' plain' ELSE name END AS text FROM parts
  UNION ALL SELECT doc_id, p_partkey, 1, 'footnote', NULL, 'Note ' || p_partkey || '.' FROM parts WHERE part = 'footnote')
 SELECT doc_id, type, level::INT AS level, text, count(*) AS n FROM rows GROUP BY ALL"""
)
def latex_blocks(spark, sf_dir):
    k, name = F.col("p_partkey"), F.replace(F.replace("p_name", F.lit("#"), F.lit(" ")), F.lit(":"), F.lit(" "))
    part, key = F.element_at(F.array(*(F.lit(p) for p in TEX_PARTS)), (k % len(TEX_PARTS) + 1).cast("int")), k.cast("string")
    inside = lambda before, after, text=name: F.concat(F.lit(before), text, F.lit(after))
    tex = (
        F.when(part.isin("chapter", "section", "subsection"), F.concat(F.lit("\\"), part, inside("{", "}")))
        .when(part == "quote", inside("\\begin{quote}\n", "\n\\end{quote}"))
        .when(part == "item", inside("\\begin{itemize}\\item ", "\\end{itemize}"))
        .when(part == "caption", inside("\\begin{figure}\\includegraphics{a.png}\\caption{", "}\\end{figure}"))
        .when(part == "equation", inside("\\begin{equation}", "\\end{equation}"))
        .when(part == "code", inside("\\begin{verbatim}\n", "\n\\end{verbatim}"))
        .when(part == "cite", F.concat(F.lit("Zob.~\\cite{k"), key, F.lit("} % a comment\n"), name))
        .when(part == "footnote", F.concat(name, F.lit("\\footnote{Note "), key, F.lit(".}")))
        .otherwise(inside("", " \\emph{plain}"))
    )
    made = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), k.alias("k"), tex.alias("tex")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "tex"))).alias("parts"))
    main = F.concat(F.lit("\\documentclass{report}\n\\begin{document}\n"), F.array_join(F.transform("parts", lambda p: p.tex), "\n\n"), F.lit("\n\\end{document}\n"))
    found = latex.blocks(latex.raw_rows(made.select("doc_id", F.lit("main.tex").alias("path"), main.alias("content"))))
    return found.groupBy("doc_id", "type", "level", "text").agg(F.count(F.lit(1)).alias("n"))


# Floats.

CAPTIONS = f"WITH {THESIS}, caps AS (SELECT *, CASE WHEN text LIKE 'Rys.%' THEN 'figure' ELSE 'table' END AS kind, (doc_id + ordinal) % 4 + 1 AS number, row_number() OVER (PARTITION BY doc_id, text LIKE 'Rys.%' ORDER BY ordinal) AS n FROM thesis WHERE type = 'caption')"


@query(
    CAPTIONS + " SELECT DISTINCT c.doc_id, c.kind, left(c.kind, 1) || lpad(c.n::VARCHAR, 3, '0') AS float_id, t.block_id FROM caps c JOIN thesis t ON t.doc_id = c.doc_id AND t.type IN ('paragraph', 'quote', 'caption', 'heading')"
    " AND regexp_matches(t.text, '(?i)(?:rys\\.?|rysunku|rysunek|rysunek|fig\\.?|figure|wykres|tab\\.?|tabeli|tabela|tabl\\.?|table)\\s*(?:nr\\.?\\s*)?' || c.number || '\\b')"
)
def float_mentions(spark, sf_dir):
    found = derived_blocks(table(spark, sf_dir, "documents"))
    captions = found.filter("type = 'caption'")
    return floats.mentions(found, floats.register(captions))


@query(f"""WITH {THESIS}, placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS n FROM thesis), caps AS (SELECT doc_id, n, ordinal FROM placed WHERE type = 'caption'),
 near AS (SELECT p.doc_id, p.ordinal, c.ordinal AS caption_ordinal, row_number() OVER (PARTITION BY p.doc_id, p.ordinal ORDER BY abs(c.n - p.n), c.n) AS pos FROM placed p LEFT JOIN caps c ON c.doc_id = p.doc_id AND abs(c.n - p.n) BETWEEN 1 AND 2 WHERE p.type = 'table')
 SELECT doc_id, ordinal::INT AS ordinal, caption_ordinal::INT AS caption_ordinal FROM near WHERE pos = 1""")
def nearest_caption(spark, sf_dir):
    return floats.nearest_caption(derived_blocks(table(spark, sf_dir, "documents"))).select("doc_id", "ordinal", "caption_ordinal")


# Layout induction, with parts as text blocks of pages.

PSEUDO = "spans AS (SELECT p_brand AS doc_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS ordinal, p_size % 7 + 8.0 AS size, p_name AS text, (p_partkey % 5 + 1)::INT AS page, p_partkey FROM part)"


def pseudo_blocks(spark, sf_dir) -> DataFrame:
    at = F.row_number().over(blocks.in_document("p_partkey"))
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), "p_partkey", (F.col("p_size") % 7 + 8.0).alias("size"), F.col("p_name").alias("text"), (F.col("p_partkey") % 5 + 1).cast("int").alias("page"))
    return part.withColumn("ordinal", at)


SIZES = f"""WITH {PSEUDO}, weights AS (SELECT doc_id, round(size, 1) AS size, sum(length(text)) AS chars, min(ordinal) AS seen FROM spans GROUP BY 1, 2),
 bodies AS (SELECT *, first_value(size) OVER (PARTITION BY doc_id ORDER BY chars DESC, seen) AS body_size FROM weights),
 sizes AS (SELECT doc_id, size, body_size, CASE WHEN size > body_size * 1.05 THEN least(dense_rank() OVER (PARTITION BY doc_id, size > body_size * 1.05 ORDER BY size DESC), 6) END AS size_level FROM bodies)"""


@query(f"{SIZES} SELECT doc_id, size::DOUBLE AS size, body_size::DOUBLE AS body_size, size_level::INT AS size_level FROM sizes")
def size_hierarchy(spark, sf_dir):
    return pdf.size_hierarchy(pseudo_blocks(spark, sf_dir))


TOC = """toc AS (SELECT doc_id, ordinal AS entry, ordinal % 3 + 1 AS level, lower(text) AS needle, page FROM spans WHERE ordinal % 4 = 0),
 tried AS (SELECT t.doc_id, entry, t.level, s.ordinal, s.page, CASE WHEN contains(lower(s.text), needle) THEN length(needle) / length(s.text) END AS score FROM toc t JOIN spans s ON s.doc_id = t.doc_id AND s.page IN (t.page, t.page + 1)),
 best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, entry ORDER BY score DESC, page, ordinal) AS pos FROM tried WHERE score > 0),
 matched AS (SELECT doc_id, ordinal, max_by(level, entry) AS toc_level FROM best WHERE pos = 1 GROUP BY 1, 2)"""


def pseudo_toc(found: DataFrame) -> DataFrame:
    return found.filter("ordinal % 4 = 0").select("doc_id", "ordinal", (F.col("ordinal") % 3 + 1).alias("level"), F.col("text").alias("title"), "page")


@query(f"WITH {PSEUDO}, {TOC} SELECT doc_id, ordinal::INT AS ordinal, toc_level::INT AS toc_level FROM matched")
def toc_match(spark, sf_dir):
    found = pseudo_blocks(spark, sf_dir)
    return pdf.match_toc(found, pseudo_toc(found))


@query(f"""{SIZES}, {TOC}, votes AS (SELECT s.doc_id, round(s.size, 1) AS size, toc_level, count(*) AS n, min(s.ordinal) AS seen FROM spans s JOIN matched USING (doc_id, ordinal) GROUP BY 1, 2, 3),
 won AS (SELECT *, row_number() OVER (PARTITION BY doc_id, size ORDER BY n DESC, seen) AS pos FROM votes)
 SELECT z.doc_id, z.size::DOUBLE AS size, body_size::DOUBLE AS body_size, coalesce(toc_level, size_level)::INT AS size_level FROM sizes z LEFT JOIN (SELECT * FROM won WHERE pos = 1) w USING (doc_id, size)""")
def level_votes(spark, sf_dir):
    found = pseudo_blocks(spark, sf_dir)
    return pdf.calibrate(pdf.size_hierarchy(found), found, pdf.match_toc(found, pseudo_toc(found)))


BOXES = "boxes AS (SELECT p_brand AS doc_id, p_partkey, (p_partkey % 5 + 1)::INT AS page, (p_partkey * 37 % 400)::DOUBLE AS x0, (p_partkey * 53 % 700)::DOUBLE AS y0 FROM part), regions AS (SELECT * FROM boxes WHERE p_partkey % 11 = 0)"


def pseudo_boxes(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), "p_partkey", (k % 5 + 1).cast("int").alias("page"), (k * 37 % 400).cast("double").alias("x0"), (k * 53 % 700).cast("double").alias("y0")).withColumns({"x1": F.col("x0") + 120, "y1": F.col("y0") + 30})


@query(f"WITH {BOXES} SELECT doc_id, p_partkey FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE r.doc_id = b.doc_id AND r.page = b.page AND greatest(least(b.x0 + 120, r.x0 + 150) - greatest(b.x0, r.x0), 0) * greatest(least(b.y0 + 30, r.y0 + 60) - greatest(b.y0, r.y0), 0) >= 0.5 * 120 * 30)")
def table_region_anti(spark, sf_dir):
    found = pseudo_boxes(spark, sf_dir)
    regions = found.filter("p_partkey % 11 = 0").withColumns({"x1": F.col("x0") + 150, "y1": F.col("y0") + 60})
    return pdf.outside_regions(found, regions).select("doc_id", "p_partkey")


@query(f"WITH {BOXES} SELECT doc_id, round(greatest(min(y0), 0) / 28.3465, 2) AS top, round(greatest(842 - max(y0 + 30), 0) / 28.3465, 2) AS bottom, round(greatest(min(x0), 0) / 28.3465, 2) AS \"inner\", round(greatest(595 - max(x0 + 120), 0) / 28.3465, 2) AS \"outer\", 'A4' AS page_size FROM boxes GROUP BY 1")
def ink_margins(spark, sf_dir):
    found = pseudo_boxes(spark, sf_dir)
    dims = found.select("doc_id").distinct().withColumns({"width": F.lit(595.0), "height": F.lit(842.0)})
    return pdf.margins(found, dims).select("doc_id", *(F.col("margins_cm")[k].alias(k) for k in ("top", "bottom", "inner", "outer")), "page_size")


# Evaluation: detected against declared languages.

EVALUATED = """, pairs AS (SELECT source, lang AS e, language_primary AS p FROM documents JOIN doc_lang USING (doc_id)),
 counts AS (SELECT source, key, sum(p) AS p, sum(e) AS e FROM (SELECT source, p AS key, 1 AS p, 0 AS e FROM pairs UNION ALL SELECT source, e, 0, 1 FROM pairs) GROUP BY 1, 2),
 sums AS (SELECT source, sum(least(p, e))::BIGINT AS tp, sum(p - least(p, e))::BIGINT AS fp, sum(e - least(p, e))::BIGINT AS fn FROM counts GROUP BY 1),
 rates AS (SELECT *, round(tp / (tp + fp), 3) AS "precision", round(tp / (tp + fn), 3) AS recall FROM sums),
 scored AS (SELECT *, CASE WHEN "precision" + recall > 0 THEN round(2 * "precision" * recall / ("precision" + recall), 3) ELSE 0.0 END AS f1 FROM rates)"""


def language_scores(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.join(languages.primary_language(blocks.from_lines(docs)), "doc_id")
    return metrics.multiset_prf(found.select("source", F.col("language_primary").alias("key")), found.select("source", F.col("lang").alias("key")), ["source"])


@query(f"{DOC_LANG}{EVALUATED} SELECT * FROM scored".replace("AS at ", "AS pos ").replace("WHERE at =", "WHERE pos ="))
def multiset_prf(spark, sf_dir):
    return language_scores(spark, sf_dir)


@query(f"{DOC_LANG}{EVALUATED} SELECT count(*) AS groups, round(avg(\"precision\"), 3) AS \"precision\", round(avg(recall), 3) AS recall, round(avg(f1), 3) AS f1 FROM scored".replace("AS at ", "AS pos ").replace("WHERE at =", "WHERE pos ="))
def macro_average(spark, sf_dir):
    return language_scores(spark, sf_dir).agg(F.count(F.lit(1)).alias("groups"), *(F.round(F.avg(c), 3).alias(c) for c in ("precision", "recall", "f1")))


@query("""WITH sizes AS (SELECT 'documents' AS origin, source AS container, octet_length(encode(text)) AS n FROM documents UNION ALL SELECT 'pages', regexp_extract(url, '//([^/]+)', 1), octet_length(encode(html)) FROM pages)
 SELECT origin, container, count(*) AS members, sum(n)::BIGINT AS bytes, max(n)::BIGINT AS largest, CASE WHEN max(n) > 20000 THEN 'resource_limit' WHEN count(*) > 40 THEN 'suspicious_archive' WHEN sum(n) > 100 * max(n) THEN 'suspicious_archive' END AS error_kind FROM sizes GROUP BY 1, 2""")
def guard_quarantine(spark, sf_dir):
    n = lambda c: F.octet_length(c).alias("n")
    rows = table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("source").alias("container"), n("text"))
    rows = rows.unionByName(table(spark, sf_dir, "pages").select(F.lit("pages").alias("origin"), F.regexp_extract("url", "//([^/]+)", 1).alias("container"), n("html")))
    per = rows.groupBy("origin", "container").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("bytes"), F.max("n").cast("long").alias("largest"))
    bad = F.when(F.col("largest") > 20_000, "resource_limit").when(F.col("members") > 40, "suspicious_archive").when(F.col("bytes") > 100 * F.col("largest"), "suspicious_archive")
    return per.withColumn("error_kind", bad)


@query(
    "WITH RECURSIVE stage(name, needs) AS (VALUES {0}), edges AS (SELECT name, unnest(needs) AS needed FROM stage), depths AS (SELECT name, 0 AS depth FROM stage WHERE len(needs) = 0 UNION ALL SELECT e.name, d.depth + 1 FROM edges e JOIN depths d ON d.name = e.needed)"
    " SELECT name, max(depth)::INT AS depth FROM depths GROUP BY 1".format(", ".join(f"('{s.name}', {sql_list(s.depends_on)}::VARCHAR[])" for s in stages.PIPELINE))
)
def stage_groups(spark, sf_dir):
    return stages.groups_table(spark).select("name", "depth")


@query()
def sentence_segments(spark, sf_dir):
    return segments.segment(blocks.from_lines(table(spark, sf_dir, "documents"))).withColumn("text", F.md5("text"))


@query(f"""WITH {LINES}, typed AS (SELECT *, {SQL_TYPE} AS type, (regexp_matches(trim(text), '\\.{{4,}}') OR regexp_matches(trim(text), '(\\t| {{2,}})\\d{{1,4}}$')) AND NOT regexp_matches(trim(text), '[.,;:]$') AS toc FROM blocks)
 SELECT doc_id, count(*) AS blocks, 0::BIGINT AS headings, 1::BIGINT AS sections, 0::BIGINT AS citations, 0::BIGINT AS "references", 0::BIGINT AS figures, 0::BIGINT AS tables, 0::BIGINT AS equations,
  count(*) FILTER (WHERE toc) AS excluded_blocks, round(sum(CASE WHEN toc THEN 0 ELSE length(text) END) / greatest(sum(length(text) + 1) - 1, 1), 3) AS analysed_char_ratio FROM typed GROUP BY 1""")
def enrichment_summary(spark, sf_dir):
    return enrich.summary(enrich.enrich(blocks.from_lines(table(spark, sf_dir, "documents"))))


@query()
def enriched_theses(spark, sf_dir):
    return enrich.summary(enrich.enrich(derived_blocks(table(spark, sf_dir, "documents"))))


# Deterministic analysers.


@query(f"""WITH {THESIS}, broken AS (
 SELECT doc_id, block_id, start, stop, unnest(list_filter([
  CASE WHEN type = 'heading' AND regexp_matches(text, '\\.\\s*$') THEN 'heading-dot' END,
  CASE WHEN type IN ('paragraph', 'list_item') AND regexp_matches(text, '(?:^|\\s)[aiouwzAIOUWZ]\\s*$') THEN 'orphan-letter' END,
  CASE WHEN type IN ('paragraph', 'quote') AND contains(text, '"') THEN 'straight-quotes' END,
  CASE WHEN type IN ('paragraph', 'list_item') AND contains(text, ' - ') THEN 'spaced-hyphen' END,
  CASE WHEN type = 'paragraph' AND regexp_matches(text, '(?:^|[^\\d.])\\d+\\.\\d+(?:[^\\d.]|$)') THEN 'decimal-point' END,
  CASE WHEN type = 'paragraph' AND regexp_matches(text, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])\\p{{L}}+(?:łem|łam|liśmy|łyśmy)(?:[^\\p{{L}}\\p{{N}}_]|$)') THEN 'first-person' END], lambda x: x IS NOT NULL)) AS rule_id FROM spanned)
 SELECT doc_id, rule_id, count(*) AS findings FROM broken GROUP BY 1, 2""")
def rule_findings(spark, sf_dir):
    return analysers.check_blocks(derived_blocks(table(spark, sf_dir, "documents"))).groupBy("doc_id", "rule_id").agg(F.count(F.lit(1)).alias("findings"))


@query(f"WITH {SECTIONS}, wanted AS (SELECT DISTINCT doc_id, k AS kind FROM sections, unnest(['introduction', 'bibliography', 'summary']) AS u(k)) SELECT doc_id, kind FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM sections s WHERE s.doc_id = w.doc_id AND s.kind = w.kind)")
def missing_sections(spark, sf_dir):
    found = sections.build_sections(sections.assign_sections(derived_blocks(table(spark, sf_dir, "documents"))))
    return analysers.missing_sections(found, ("introduction", "bibliography", "summary"))


@query(r"""WITH row AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS w, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: len(regexp_extract_all(s, '\p{L}+'))), lambda n: n > 0) AS s FROM documents)
 SELECT doc_id, len(w)::INT AS words, round(len(list_distinct(w)) / len(w), 4) AS type_token_ratio, 0.0::DOUBLE AS function_share, round(list_aggregate(s, 'stddev_pop') / list_aggregate(s, 'avg'), 4) AS burstiness, len(w) >= 150 AS enough FROM row""")
def stylometry(spark, sf_dir):
    return analysers.stylometry(table(spark, sf_dir, "documents"))


SCORED = "scored AS (SELECT least(n_chars, 20000) / 20000 AS score, quality AS label FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"


def scored_labels(spark, sf_dir) -> DataFrame:
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").filter("quality IS NOT NULL"), "doc_id")
    return joined.select((F.least("n_chars", F.lit(20000)) / 20000).alias("score"), F.col("quality").alias("label"))


@query(f"WITH {SCORED} SELECT (SELECT count(*) FROM scored WHERE label = 1) AS positives, (SELECT count(*) FROM scored WHERE label = 0) AS negatives, round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END), 6) AS auroc FROM scored p, scored n WHERE p.label = 1 AND n.label = 0")
def auroc(spark, sf_dir):
    return analysers.auroc(scored_labels(spark, sf_dir))


@query(f"""WITH {SCORED}, cuts AS (SELECT DISTINCT score AS t FROM scored), curve AS (SELECT t, avg((score >= t)::INT) FILTER (WHERE label = 1) AS tpr, avg((score >= t)::INT) FILTER (WHERE label = 0) AS fpr FROM cuts, scored GROUP BY 1)
 SELECT min(t) AS threshold, round(max(tpr), 6) AS tpr FROM curve WHERE fpr <= 0.1""")
def tpr_at_fpr(spark, sf_dir):
    return analysers.tpr_at_fpr(scored_labels(spark, sf_dir), 0.1)


@query(f"WITH {SCORED}, bins AS (SELECT least(floor(score * 10), 9) AS b, count(*) AS n, abs(avg(score) - avg(label)) AS gap FROM scored GROUP BY 1) SELECT round(sum(n * gap) / sum(n), 6) AS ece FROM bins")
def calibration_error(spark, sf_dir):
    return analysers.calibration_error(scored_labels(spark, sf_dir))


@query(f"""WITH {RANGES}, f AS (SELECT doc_id, start, stop, reason AS rule_id, row_number() OVER (PARTITION BY doc_id, reason ORDER BY start, stop) AS n FROM ranges),
 apart AS (SELECT *, CASE WHEN start < max(stop) OVER (PARTITION BY doc_id, rule_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS gap FROM f),
 islands AS (SELECT *, sum(gap) OVER (PARTITION BY doc_id, rule_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM apart)
 SELECT doc_id, rule_id AS family, min(start) AS start, max(stop) AS "end", count(*) AS merged FROM islands GROUP BY doc_id, rule_id, island""")
def finding_dedup(spark, sf_dir):
    findings = derived_ranges(spark, sf_dir).withColumnRenamed("reason", "rule_id").withColumn("severity", F.lit("minor"))
    return analysers.merge_findings(findings).drop("severity")


@query("""SELECT * FROM (SELECT o_orderkey AS k, unnest(['status', 'priority']) AS field, unnest([o_orderstatus, o_orderpriority]) AS left_value, unnest([CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END]) AS right_value FROM orders)
 WHERE left_value IS DISTINCT FROM right_value""")
def metadata_diff(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    right = left.select("k", F.when(F.col("k") % 3 == 0, "X").otherwise(F.col("status")).alias("status"), F.when(F.col("k") % 5 != 0, F.col("priority")).alias("priority"))
    return analysers.metadata_diff(left, right, ["k"], ["status", "priority"])


@query(f"WITH {LINES}, cache AS (SELECT DISTINCT sha256(text || chr(0) || 'grammar' || chr(0) || '1') AS cache_key FROM blocks WHERE doc_id % 2 = 0) SELECT doc_id, block_id FROM blocks WHERE sha256(text || chr(0) || 'grammar' || chr(0) || '1') NOT IN (SELECT cache_key FROM cache)")
def incremental_recheck(spark, sf_dir):
    found = blocks.from_lines(table(spark, sf_dir, "documents")).select("doc_id", "block_id", "text")
    cache = analysers.to_recheck(found.filter("doc_id % 2 = 0"), found.limit(0).select(F.lit("").alias("cache_key")), "grammar", "1")[0].select("cache_key").distinct()
    return analysers.to_recheck(found, cache, "grammar", "1")[0].select("doc_id", "block_id")


@query("SELECT p_partkey % 50 AS doc_id, count(*) AS \"references\", round(avg(2026 - (1990 + p_size % 30)), 2) AS mean_age, 1.0::DOUBLE AS doi_share, max(1990 + p_size % 30)::INT AS newest FROM part GROUP BY 1")
def source_profile(spark, sf_dir):
    return analysers.source_profile(bibliography.harvest(derived_references(spark, sf_dir)), 2026)
