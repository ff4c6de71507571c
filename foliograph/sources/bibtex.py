"""BibTeX entries, their braces counted, as rows of references."""

from __future__ import annotations

import re
from collections.abc import Iterator



_START = re.compile(r"@(\w+)\s*([{(])")
_FIELD = re.compile(r"\s*([\w-]+)\s*=\s*")
# Where a venue is named, by precedence.
VENUES = ("journal", "booktitle", "publisher", "school", "institution")


def _closed(text: str, at: int) -> int:
    """The place after the brace or parenthesis that closes the one at `at`."""
    opening = text[at]
    closing, depth = {"{": "}", "(": ")"}[opening], 0
    for i in range(at, len(text)):
        if text[i] == "\\":
            continue
        if text[i] == opening and text[i - 1 : i] != "\\":
            depth += 1
        elif text[i] == closing and text[i - 1 : i] != "\\":
            depth -= 1
            if not depth:
                return i + 1
    return len(text)


def _value(body: str, at: int, strings: dict[str, str]) -> tuple[str, int]:
    """A field's value from `at` on: braces, quotes, numbers and names of strings, joined by #."""
    parts = []
    while at < len(body):
        while at < len(body) and body[at] in " \t\r\n#":
            at += 1
        if at >= len(body) or body[at] == ",":
            break
        if body[at] == "{":
            end = _closed(body, at)
            parts.append(body[at + 1 : end - 1])
        elif body[at] == '"':
            end, depth = at + 1, 0
            while end < len(body) and (body[end] != '"' or depth):
                depth += (body[end] == "{") - (body[end] == "}")
                end += 1
            parts.append(body[at + 1 : end])
            end += 1
        else:
            word = re.match(r"[^,#\s]*", body[at:])[0]
            if not word:
                break
            parts.append(strings.get(word.lower(), word))
            end = at + len(word)
        at = end
    return "".join(parts), at


def entries(text: str) -> Iterator[dict]:
    """kind, key, fields and raw of each entry; @string names are filled in, comments and preambles left out."""
    strings: dict[str, str] = {}
    at = 0
    while m := _START.search(text, at):
        at = _closed(text, m.end() - 1)
        kind, body = m[1].lower(), text[m.end() : at - 1]
        if kind in ("comment", "preamble"):
            continue
        key, _, rest = ("", "", body) if kind == "string" else body.partition(",")
        fields, i = {}, 0
        while f := _FIELD.match(rest, i):
            value, i = _value(rest, f.end(), strings)
            fields[f[1].lower()] = " ".join(value.split())
            i = rest.find(",", i) + 1 if "," in rest[i:] else len(rest)
        if kind == "string":
            strings |= {k: v for k, v in fields.items()}
        elif key.strip():
            yield {"kind": kind, "key": key.strip(), "fields": fields, "raw": text[m.start() : at]}


def author(name: str) -> str:
    """Last, First as First Last."""
    last, comma, first = name.partition(",")
    return f"{first.strip()} {last.strip()}" if comma else name.strip()


def parsed(entry: dict) -> dict:
    """The reference that an entry describes."""
    f = {k: re.sub(r"[{}]", "", re.sub(r"\\[a-zA-Z]+\s*|\\.", "", v)).strip() for k, v in entry["fields"].items()}
    names = [author(a) for a in re.split(r"\s+and\s+", f.get("author", "")) if a.strip()]
    year = re.search(r"\d{4}", f.get("year", f.get("date", "")))
    url = f.get("url") or (f"https://arxiv.org/abs/{f['eprint']}" if f.get("eprint") else None)
    got = {"authors": names, "title": f.get("title") or None, "year": int(year[0]) if year else None, "venue": next((f[v] for v in VENUES if f.get(v)), None), "doi": f.get("doi") or None, "url": url}
    score = 0.35 * bool(got["title"]) + 0.25 * bool(names) + 0.2 * bool(year) + 0.15 * bool(got["doi"]) + 0.05 * bool(got["venue"])
    return got | {"ref_id": entry["key"], "raw": entry["raw"], "confidence": round(score, 2)}
