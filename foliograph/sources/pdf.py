"""Page layouts from PDF files: a plug-in point. Induction itself (operators.pdf) works on tables and needs no library.

What the guards need, encryption and the number of pages, is read from the file's own dictionaries.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that one object stream may inflate to; a larger one is not looked into.
MAX_INFLATED = 16 << 20
_OBJECT_STREAM = re.compile(rb"/Type\s*/ObjStm\b.*?stream\r?\n", re.DOTALL)
_PAGE_TREE = re.compile(rb"<<(?:(?!<<|>>).)*?/Type\s*/Pages\b(?:(?!<<|>>).)*|<<(?:(?!<<|>>).)*?/Count\s+\d+(?:(?!<<|>>).)*?/Type\s*/Pages\b", re.DOTALL)
_COUNT = re.compile(rb"/Count\s+(\d+)")
_ENCRYPT = re.compile(rb"/Encrypt\s+(?:\d+\s+\d+\s+R|<<)")
FACTS = T.StructType().add("pages", "integer").add("encrypted", "boolean")


def _readable(raw: bytes) -> Iterator[bytes]:
    """The file, and what its object streams inflate to."""
    yield raw
    for m in _OBJECT_STREAM.finditer(raw):
        try:
            yield zlib.decompressobj().decompress(raw[m.end() :], MAX_INFLATED)
        except zlib.error:
            continue


def facts(raw: bytes | None) -> dict:
    """pages: the largest count of a page tree node, null if the file shows none; encrypted: whether a trailer names an encryption dictionary."""
    raw = raw or b""
    if _ENCRYPT.search(raw):
        return {"pages": None, "encrypted": True}
    counts = [int(n) for part in _readable(raw) for node in _PAGE_TREE.findall(part) for n in _COUNT.findall(node)]
    return {"pages": min(max(counts), 2**31 - 1) if counts else None, "encrypted": False}


@F.pandas_udf(FACTS)
def pdf_facts(contents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([facts(c) for c in contents], columns=["pages", "encrypted"]).astype({"pages": "Int32"})

#: name -> function of files (doc_id, content) that gives the tables raw_spans, toc, regions and images.
READERS: dict[str, Callable[[DataFrame], dict[str, DataFrame]]] = {}


def register(name: str, reader: Callable[[DataFrame], dict[str, DataFrame]]) -> None:
    READERS[name] = reader


def tables(files: DataFrame, reader: str | None = None) -> dict[str, DataFrame]:
    if not READERS:
        raise NotImplementedError("no PDF reader is registered: use sources.pdf.register")
    return READERS[reader or next(iter(READERS))](files)
