"""Polish or English by stopwords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stopwords ("to" is in both).
POLISH = ("i w na z do jest to się nie że oraz dla od po przez który która które jak ich jego jej być był była były zostały został można tym tego tej bardziej bardzo także czyli aby żeby przy ze nad pod między gdzie gdy ponieważ jednak").split()
ENGLISH = ("the and of to in is for with that this are was were be been being have has had it its as at by from an or which their there they we you your can will would should could these those than then such").split()
MIN_WORDS, MIN_CHARS = 8, 40


def words(text: Column) -> Column:
    """Runs of letters in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


def detect(text: str | Column) -> Column:
    """pl or en by the more frequent stopwords (a tie is pl); null under eight words or without stopwords."""
    w = words(F.col(text) if isinstance(text, str) else text)
    pl, en = F.size(F.filter(w, lambda x: x.isin(POLISH))), F.size(F.filter(w, lambda x: x.isin(ENGLISH)))
    return F.when((F.size(w) < MIN_WORDS) | ((pl == 0) & (en == 0)), None).when(pl >= en, "pl").otherwise("en")
