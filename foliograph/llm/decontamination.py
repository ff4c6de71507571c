"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

An item's window is `window` consecutive words of it (an item of fewer is one window). The
shingles of a window (SHINGLE words, or the whole of a shorter window) are ordered by their
number of occurrences in all documents. Exact containment needs every shingle, so the rarest
one alone is a sufficient prefix; documents are joined on it. Of each candidate the length
bound (the window must fit in the document), the positional bound (the shingle's place in the
window fixes where it would start) and then the words themselves are checked.

Only DataFrame functions run here. The benchmark's shingles prune positions inside each row
while they are at most LITERALS; beyond that the join alone selects them. The planner chooses
broadcast or shuffle joins by the tables' sizes.

Defined results: null and empty texts have no words and no hits; an item without words has no
windows; items that share an id count once; a null item id counts as an empty one; a null
document id is carried; repeated rows each get their result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliograph.llm.common import LOWER, UPPER, as_rows, ascii_lower, table, text_key, text_of
from foliograph.session import stored

SHINGLE = 3
LITERALS = 50_000
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), _BETWEEN), lambda w: w != "")


def _hash_at(arr: Column, i: Column, n: int) -> Column:
    return F.xxhash64(*(F.get(arr, i + k) for k in range(n)))


def _places(arr: Column, n: int) -> Column:
    """The positions at which a shingle of n words starts."""
    return F.when(F.size(arr) >= n, F.sequence(F.lit(0), F.size(arr) - n)).otherwise(F.array().cast("array<int>"))


def _found(arr: Column, wanted: dict[int, list[int]] | None, lengths: list[int], context: int) -> Column:
    """Structs (n, h, pos, from, near) of the shingles of arr that are wanted; near: the words from `from`, `context` to either side of pos."""

    def of(n: int) -> Column:
        places = _places(arr, n)
        if wanted is not None:
            places = F.filter(places, lambda i: _hash_at(arr, i, n).isin(wanted[n]))
        first = lambda i: F.greatest(i - context, F.lit(0))
        return F.transform(
            places,
            lambda i: F.struct(
                F.lit(n).alias("n"), _hash_at(arr, i, n).alias("h"), i.alias("pos"), first(i).alias("from"),
                (F.slice(arr, first(i) + 1, i - first(i) + context + n) if context else F.array().cast("array<string>")).alias("near"),
            ),
        )

    return F.concat(*(of(n) for n in lengths))


def _windows(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct windows: win (words), ids (items that have them), shingles (n, h, offset)."""
    w = F.col("w")
    per_item = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), words(text_of(text_col)).alias("w")).filter(F.size(w) > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - window, F.lit(0)))
    wins = per_item.select("id", F.explode(F.transform(starts, lambda s: F.slice(w, s + 1, window))).alias("win"))
    wins = wins.groupBy("win").agg(F.collect_set("id").alias("ids"))
    win = F.col("win")

    def of(n: int) -> Column:
        return F.transform(_places(win, n), lambda i: F.struct(F.lit(n).alias("n"), _hash_at(win, i, n).alias("h"), i.alias("offset")))

    shingles = of(SHINGLE)
    for n in range(1, SHINGLE):
        shingles = F.when(F.size(win) == n, of(n)).otherwise(shingles)
    return wins.withColumn("shingles", shingles)


def overlaps(docs: DataFrame, items: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, text_id, n_words, n_hit, item_ids (sorted as strings)."""
    wins = stored(_windows(items, window, item_id_col, item_text_col), "decon-windows")
    vocabulary = wins.select(F.explode("shingles").alias("s")).select("s.n", "s.h").distinct()
    lengths = sorted(r.n for r in vocabulary.select("n").distinct().collect()) or [SHINGLE]
    few = vocabulary.limit(LITERALS + 1).count() <= LITERALS

    def literals(df: DataFrame) -> dict[int, list[int]] | None:
        if not few:
            return None
        pairs = [(r.n, r.h) for r in df.collect()]  # LITERALS at most
        return {n: sorted({h for m, h in pairs if m == n}) for n in lengths}

    text = text_of(text_col)
    split = docs.select(F.col(id_col).alias("doc_id"), text_key(text).alias("text_id"), words(text).alias("w"))
    seen = split.select(F.explode(F.transform(_found(F.col("w"), literals(vocabulary), lengths, 0), lambda s: F.struct(s.n.alias("n"), s.h.alias("h")))).alias("s")).groupBy("s.n", "s.h").count()
    freq = stored(vocabulary.join(seen, ["n", "h"], "left").select("n", "h", F.coalesce("count", F.lit(0)).alias("freq")), "decon-frequencies")

    each = wins.select("win", "ids", F.explode("shingles").alias("s")).select("win", "ids", "s.*").join(freq, ["n", "h"])
    rarest = each.withColumn("at", F.row_number().over(Window.partitionBy("win").orderBy("freq", "h", "offset"))).filter("at = 1 and freq > 0").drop("at", "freq")
    rarest = stored(rarest, "decon-prefixes")

    rows = stored(
        split.select("doc_id", "text_id", F.size("w").alias("n_words"), _found(F.col("w"), literals(rarest.select("n", "h").distinct()), lengths, window - 1).alias("found")),
        "decon-candidates",
    )
    start = F.col("pos") - F.col("offset")
    hits = rows.select("text_id", "n_words", F.explode("found").alias("f")).select("text_id", "n_words", "f.*").join(rarest, ["n", "h"])
    hits = hits.filter((start >= 0) & (start + F.size("win") <= F.col("n_words")))
    hits = hits.filter(F.slice("near", start - F.col("from") + 1, F.size("win")) == F.col("win"))
    hits = hits.select("text_id", start.alias("start"), F.size("win").alias("len"), "ids").groupBy("text_id", "start", "len").agg(F.first("ids").alias("ids"))
    spans = F.collect_list(F.sequence("start", F.col("start") + F.col("len") - 1))
    per_text = hits.groupBy("text_id").agg(F.size(F.array_distinct(F.flatten(spans))).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("item_ids"))
    per_text = stored(per_text, "decon-texts")  # apart from the join, which can then split the copies of one text
    return rows.select("doc_id", "text_id", "n_words").join(per_text, "text_id", "left").select(
        "doc_id", "text_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids")
    )


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit").cast("long") >= F.col("n_words"))


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


ORACLE = f"""
WITH item AS (
  SELECT coalesce(item_id::VARCHAR, '') AS id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT id, list_slice(w, s + 1, s + 13) AS win FROM item, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS t(s) WHERE len(w) > 0
), doc AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), lens AS (SELECT DISTINCT len(win) AS n FROM win
), spot AS (
  SELECT rid, s, n, list_slice(w, s + 1, s + n) AS win FROM doc, lens, unnest(range(0, len(w) - n + 1)) AS t(s) WHERE len(w) >= n
), hit AS (SELECT rid, s, n, id FROM spot JOIN win USING (win)
), pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM hit, unnest(range(s, s + n)) AS t(p) GROUP BY rid
), ids AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS items FROM (SELECT DISTINCT rid, id FROM hit) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN pos USING (rid) LEFT JOIN ids USING (rid)
"""


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows whose texts are contaminated; all others stay as they are, with all columns, whatever their names."""
    bad = overlaps(docs, table(spark, sf_dir, "benchmark")).filter(contaminated()).select("text_id").distinct()
    rows = as_rows(docs).withColumn("key", text_key(text_of(F.col("row").getField("text"))))
    return rows.join(bad, rows.key == bad.text_id, "left_anti").select("row.*")
