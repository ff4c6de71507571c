"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The blanks that separate words in the word-shingle contracts: space and U+0009 to U+000D.
BLANKS = "\\x20\\x09-\\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column) -> Column:
    """The text, a null one as the empty string."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def as_rows(df: DataFrame) -> DataFrame:
    """(row): each row as one struct, so that no helper column can clash with one of its own."""
    return df.select(F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns)).alias("row"))


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text: equal texts share them, and no two of 10^12 texts are likely to."""
    return F.unhex(F.md5(text))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else changed, whatever the locale or script."""
    return F.translate(text, UPPER, LOWER)


#: Rows of an Arrow batch for Python: texts are long, and both sides hold whole batches.
BATCH_ROWS = 1000


def with_small_batches(df: DataFrame) -> DataFrame:
    """df itself; its session sends at most BATCH_ROWS rows a batch to Python from now on."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving freed memory back at its end: Spark uses a Python worker again for other stages, beside an executor's heap."""

    @functools.wraps(run)
    def to_the_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library keeps what it likes

    return to_the_end
