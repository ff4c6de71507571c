"""Parsers by source format. A parser turns accepted files (doc_id, filename, content) into a blocks table."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.sources import docx, files, latex

Parser = Callable[[DataFrame], DataFrame]
COLUMNS = ["doc_id", "ordinal", "block_id", "type", "level", "text", "start", "end", "page", "flags"]


def _docx(accepted: DataFrame) -> DataFrame:
    return docx.classified(docx.raw_rows(accepted))


def _latex(accepted: DataFrame) -> DataFrame:
    return latex.blocks(latex.raw_rows(accepted.select("doc_id", F.col("filename").alias("path"), files.decoded("content").alias("content"))))


PARSERS: dict[str, Parser] = {"docx": _docx, "latex": _latex}


def register(source_format: str, parser: Parser) -> None:
    PARSERS[source_format] = parser


def parse(accepted: DataFrame) -> DataFrame:
    """The blocks of all accepted files whose format has a parser, in one plan."""
    parts = [parser(accepted.filter(F.col("source_format") == fmt)).select(*COLUMNS) for fmt, parser in PARSERS.items()]
    return functools.reduce(DataFrame.unionByName, parts)
