"""Sentence splitting with offsets. Spark's own splitter breaks after abbreviations, so this is an Arrow-batched function."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Abbreviations whose period does not end a sentence, Polish then English.
ABBREVIATIONS = set(
    "prof dr hab inż mgr p s ss r w ww np tj tzn itd itp m.in rys tab fig nr ang ds por zesz b.r ok str poz tom vol wyd n.p.m p.n.e n.e zob cdn jw bw tzw godz "
    "figs eq eqs sect ch chap e.g i.e cf al no nos pp vols jr sr mr mrs ms vs etc approx dept univ ed eds trans inc ltd co st ave".split()
)
# Stretches whose periods do not end a sentence: decimals, addresses, identifiers, dates, spaced ellipses, initials.
PROTECTED = [
    re.compile(p, f)
    for p, f in (
        (r"\b\d+[.,]\d+\b", 0),
        (r"\b(?:https?://|doi:|www\.)[^\s,;\"'„”\)\]>]+(?<![.,;:])", re.IGNORECASE),
        (r"\b10\.\d{4,9}/[^\s,;\"'„”\)\]>]+(?<![.,;:])", 0),
        (r"\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b", 0),
        (r"\.\s*\.\s*\.", 0),
        (r"(?<=\b[A-ZĄĆĘŁŃÓŚŹŻ])\.(?=\s+[A-ZĄĆĘŁŃÓŚŹŻ])", 0),
    )
]
_CANDIDATE = re.compile(r"[.!?…]{1,3}(?=([\s\"”’»)\]]+)(.))", re.DOTALL)
_TOKEN_BEFORE = re.compile(r"[^\W\d_.-]*(?:[.-]+[^\W\d_.-]*)*$")
OPENERS = "\"„'“«(-–—"
MIN_CHARS = 2
_MASK = ""


def _masked(text: str) -> str:
    cover = bytearray(len(text))
    for pattern in PROTECTED:
        for m in pattern.finditer(text):
            cover[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    return "".join(_MASK if c else x for x, c in zip(text, cover, strict=True)) if any(cover) else text


def _abbreviated(masked: str, dot: int) -> bool:
    token = _TOKEN_BEFORE.search(masked, max(0, dot - 24), dot)
    return bool(token) and token[0].lower().strip(".-") in ABBREVIATIONS


def split(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text, without the blanks around them."""
    masked, ends = _masked(text), []
    for m in _CANDIDATE.finditer(masked):
        last, follows = masked[m.end() - 1], m[2]
        if last == "." and _abbreviated(masked, m.end() - 1):
            continue
        if last != "." or follows.isupper() or follows.isdigit() or follows in OPENERS:
            ends.append(m.end())
    out = []
    for a, b in zip([0, *ends], [*ends, len(text)], strict=True):
        part = text[a:b]
        bare = part.strip()
        if len(bare) >= MIN_CHARS:
            start = a + part.index(bare[0])
            out.append((start, start + len(bare)))
    return out


@F.pandas_udf(T.ArrayType(T.StructType().add("start", "integer").add("end", "integer").add("text", "string")))
def split_sentences(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"start": a, "end": b, "text": t[a:b]} for a, b in split(t)] if t else [])
