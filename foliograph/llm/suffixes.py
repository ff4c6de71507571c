"""Suffix-array dedup: bytes covered by a string of `length` bytes that also starts elsewhere.

Only suffixes that can matter are sorted. A window of `length` bytes is named by its anchor, the
place in it whose GRAM bytes hash lowest (the leftmost of equals), so equal windows have anchors
at the same offset. The windows of one anchor occurrence are consecutive and form a block:

1. All blocks are counted by (anchor hash, block hash). A block that occurs twice repeats whole.
2. Blocks that share their anchor with other blocks may share some windows. One occurrence of
   each gives its suffix from the anchor on (and the bytes before, reversed). Tasks sort these
   suffixes into runs, front-code them (length of the prefix shared with the suffix before, and
   the rest), and exchange the runs by anchor; a loser tree merges them. Every entry carries the
   length of its common prefix with the last output, and comparisons start there, so known
   prefixes are never compared again. Neighbouring common prefixes then give, with the common
   bytes before the anchor, exactly the windows that two blocks share.
3. Anchors with more than CROWDED different blocks are too many for one task: their windows are
   counted by hash instead, in one row for each different window of a task's blocks.
4. The covered stretches go back to every occurrence, and each text's stretches are united.

Defined results: a null text is empty; matches never cross rows, and a row that repeats another
repeats all its windows; texts under `length` bytes are never cut; a null id is carried; an empty
table gives no rows; other columns are not read, except that the stage keeps them all.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import as_rows, lean, table, text_key, text_of, with_small_batches
from foliograph.session import stored

LENGTH, GRAM = 400, 64
#: The pipeline's passages: at least so many words, found by strings of so many bytes (50 words of three letters and their blanks).
PASSAGE_WORDS, PASSAGE_BYTES, PASSAGE_GRAM = 50, 200, 40
SEGMENT = 1 << 18
RUN_BYTES = 6 << 20
CROWDED = 16_384
PAIRWISE = 24
BLOCKS_A_PART = 12_000
WINDOWS_A_BATCH = 200_000

_BASE = 0xD6E8FEB86659FD93
_POS = np.uint64((1 << 21) - 1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt)) * np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


class Hashes:
    """Hashes of any stretch of a buffer, from prefix sums."""

    def __init__(self, raw: bytes):
        codes = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
        up, self.down = _power_tables(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(codes * up[: len(codes)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start], salt)

    def sliding(self, size: int, salt: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mixed((self.sums[size:] - self.sums[:n]) * self.down[:n], salt)


def blocks(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The blocks of all texts: doc (index), pos (first window), n (windows), anchor (offset in the block), akey, bhash."""
    names = ("doc", "pos", "n", "anchor", "akey", "bhash")
    raw = b"".join(texts)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if len(raw) < length:
        return {c: np.empty(0, np.int64) for c in names}
    first = np.cumsum(sizes) - sizes
    h = Hashes(raw)
    grams = h.sliding(gram, 1)
    value = (grams & ~_POS) | np.arange(len(grams), dtype=np.uint64)
    span = length - gram + 1
    rows = -(-len(value) // span)
    padded = np.full(rows * span, np.uint64((1 << 64) - 1))
    padded[: len(value)] = value
    square = padded.reshape(rows, span)
    before = np.minimum.accumulate(square, axis=1).ravel()
    after = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    n_win = len(raw) - length + 1
    low = np.minimum(after[:n_win], before[span - 1 : span - 1 + n_win]) & _POS
    room = np.repeat(first + sizes - length, sizes)[:n_win]
    at = np.flatnonzero(np.arange(n_win) <= room)
    if not len(at):
        return {c: np.empty(0, np.int64) for c in names}
    anchor = low[at].astype(np.int64)
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])
    start, last, anchor = at[new], at[np.r_[new[1:] - 1, len(at) - 1]], anchor[new]
    doc = np.searchsorted(first, start, side="right") - 1
    bhash = h.of(start, last + length, 2) ^ _mixed((anchor - start).astype(np.uint64), 3)
    return {"doc": doc, "pos": start - first[doc], "n": last - start + 1, "anchor": anchor - start, "akey": _mixed(grams[anchor], 4).view(np.int64), "bhash": bhash.view(np.int64)}


def _batches(texts: Iterator[bytes], length: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """(texts, their row numbers, their offsets): short ones together, a long one in segments that overlap by a window less a byte."""
    part, rows, offs, size = [], [], [], 0
    for i, raw in enumerate(texts):
        for s in range(0, max(1, len(raw) - length + 1), SEGMENT):
            piece = raw[s : s + SEGMENT + length - 1] if len(raw) > SEGMENT + length else raw
            if len(piece) < length:
                continue
            if part and size + len(piece) > SEGMENT + length:
                yield part, np.array(rows), np.array(offs)
                part, rows, offs, size = [], [], [], 0
            part.append(piece)
            rows.append(i)
            offs.append(s)
            size += len(piece)
            if piece is raw:
                break
    if part:
        yield part, np.array(rows), np.array(offs)


def _bytes_of(column: pa.Array) -> Iterator[bytes]:
    for t in column.cast(pa.binary()):
        yield t.as_py() or b""


_OCCURRENCES = "tkey binary, dkey long, pos int, n int, anchor int, akey long, bhash long"


def occurrences(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """All blocks of all rows (tkey, dkey, text)."""
    schema = pa.schema([("tkey", pa.binary()), ("dkey", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("anchor", pa.int32()), ("akey", pa.int64()), ("bhash", pa.int64())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for texts, rows, offs in _batches(_bytes_of(b.column(2)), length):
                found = blocks(texts, length, gram)
                own = pa.array(rows[found["doc"]])
                cols = [b.column(0).take(own), b.column(1).take(own), found["pos"] + offs[found["doc"]], found["n"], found["anchor"], found["akey"], found["bhash"]]
                yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c).cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return keyed.select("tkey", "dkey", "text").mapInArrow(run, _OCCURRENCES)


# Front-coded runs and their merge.

_HEAD = struct.Struct("<HHHqq?")
Entry = tuple[bytes, bytes, int, int, bool]  # suffix, bytes before the anchor reversed, akey, bhash, occurs twice


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the common prefix, of which `known` bytes are known."""
    n = min(len(a), len(b))
    if n <= known:
        return n
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def encode_run(entries: list[Entry]) -> bytes:
    """Sorted entries, front-coded; an entry that repeats is left out."""
    out, last, seen = [], b"", None
    for right, left, akey, bhash, twice in sorted(entries):
        if seen == (akey, bhash):
            continue
        shared = common_prefix(last, right)
        out += (_HEAD.pack(shared, len(right) - shared, len(left), akey, bhash, twice), right[shared:], left)
        last, seen = right, (akey, bhash)
    return b"".join(out)


def decode_run(blob: bytes) -> Iterator[tuple[int, Entry]]:
    """(common prefix with the entry before, entry)."""
    at, last = 0, b""
    while at < len(blob):
        shared, more, n_left, akey, bhash, twice = _HEAD.unpack_from(blob, at)
        at += _HEAD.size
        last = last[:shared] + blob[at : at + more]
        at += more
        yield shared, (last, blob[at : at + n_left], akey, bhash, twice)
        at += n_left


def merge_runs(blobs: list[bytes]) -> Iterator[tuple[int, Entry]]:
    """All entries in order of their suffixes, each with its common prefix with the one before, by a loser tree."""
    runs = [decode_run(b) for b in blobs]
    size = 1 << max(0, (len(runs) - 1).bit_length())
    done: tuple[int, Entry | None] = (-1, None)
    heads = [next(r, done) for r in runs] + [done] * (size - len(runs))
    known = [0 if e is not None else -1 for _, e in heads]
    entry = [e for _, e in heads]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser): a longer common prefix with the last output is smaller; only equal ones are compared, from there on."""
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        if known[a] < 0:
            return a, b
        x, y = entry[a][0], entry[b][0]
        n = common_prefix(x, y, known[a])
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    losers = [0] * size
    winners = list(range(size))
    for level in range(size.bit_length() - 1, 0, -1):
        above = []
        for i in range(0, len(winners), 2):
            w, losers[(1 << level - 1) + i // 2] = play(winners[i], winners[i + 1])
            above.append(w)
        winners = above
    best = winners[0]
    while entry[best] is not None:
        yield known[best], entry[best]
        known[best], entry[best] = next(runs[best], done)
        node = (best + size) >> 1
        while node:
            best, losers[node] = play(best, losers[node])
            node >>= 1


def shared_windows(group: list[tuple[int, Entry]], length: int) -> dict[tuple[int, int], tuple[int, int]]:
    """Of suffixes in order with one anchor: (akey, bhash) -> the bytes before and after the anchor that repeated windows cover."""
    items: list[tuple[int, Entry]] = []
    shared_with_last = 0
    for k, (shared, e) in enumerate(group):
        shared_with_last = min(shared_with_last, shared) if k else 0
        if items and items[-1][1][2:4] == e[2:4]:
            continue
        items.append((shared_with_last, e))
        shared_with_last = len(e[0])
    reach: dict[tuple[int, int], tuple[int, int]] = {}

    def note(e: Entry, before: int, after: int) -> None:
        old = reach.get(e[2:4], (0, 0))
        reach[e[2:4]] = max(old[0], before), max(old[1], after)

    if len(items) <= PAIRWISE:
        for j in range(1, len(items)):
            right = length
            for i in range(j - 1, -1, -1):
                right = min(right, items[i + 1][0])
                a, b = items[i][1], items[j][1]
                if a[4] and b[4]:
                    continue
                left = common_prefix(a[1], b[1])
                if left + right >= length:
                    note(a, left, right)
                    note(b, left, right)
        return reach
    far = max(len(e[1]) for _, e in items)
    near = length - max(len(e[0]) for _, e in items)
    for d in range(max(0, near), min(far, length) + 1):  # windows that start d bytes before the anchor
        stretch, first = 0, {}
        for shared, e in items:
            stretch += shared < length - d
            if len(e[1]) < d or len(e[0]) < length - d:
                continue
            key = (stretch, e[1][:d])
            other = first.setdefault(key, e)
            if other is not e:
                note(e, d, length - d)
                note(other, d, length - d)
    return reach


def _runs(length: int, n_parts: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("run", pa.binary())])
        pending: dict[int, list[Entry]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            parts = sorted(pending)
            out = pa.record_batch([pa.array(parts, pa.int32()), pa.array([encode_run(pending[p]) for p in parts], pa.binary())], schema=schema)
            pending.clear()
            return out

        for b in batches:
            for raw, hits in zip(_bytes_of(b.column(0)), b.column(1), strict=True):
                for hit in hits.as_py():
                    anchor = hit["pos"] + hit["anchor"]
                    right, left = raw[anchor : hit["pos"] + hit["n"] - 1 + length], raw[hit["pos"] : anchor][::-1]
                    pending.setdefault(hit["akey"] % n_parts, []).append((right, left, hit["akey"], hit["bhash"], hit["twice"]))
                    size += len(right) + len(left) + 100
                    if size > RUN_BYTES:
                        yield flush()
                        size = 0
        if pending:
            yield flush()

    return run


_REACH = "akey long, bhash long, before int, after int"


def _merged(length: int, gram: int):
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        reach: dict[tuple[int, int], tuple[int, int]] = {}
        group: list[tuple[int, Entry]] = []
        for shared, e in merge_runs(list(pdf.run)):
            if shared < gram and group:
                reach |= shared_windows(group, length)
                group = []
            group.append((shared, e))
        if group:
            reach |= shared_windows(group, length)
        return pd.DataFrame([(*k, *v) for k, v in reach.items()], columns=["akey", "bhash", "before", "after"])

    return merge


def _window_rows(length: int):
    """One row for each different window of a task's blocks, with the blocks that have it."""
    schema = pa.schema([("akey", pa.int64()), ("d", pa.int32()), ("window", pa.int64()), ("blocks", pa.list_(pa.int64()))])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int, int], list[int]] = {}

        def flush() -> pa.RecordBatch:
            keys = list(zip(*seen, strict=True)) or [[]] * 3
            out = pa.record_batch([pa.array(c, f.type) for c, f in zip([*keys, list(seen.values())], schema, strict=True)], schema=schema)
            seen.clear()
            return out

        for b in batches:
            for raw, hits in zip(_bytes_of(b.column(0)), b.column(1), strict=True):
                for hit in hits.as_py():
                    block = raw[hit["pos"] : hit["pos"] + hit["n"] - 1 + length]
                    for k, w in enumerate(Hashes(block).sliding(length, 5).view(np.int64).tolist()):
                        seen.setdefault((hit["akey"], hit["anchor"] - k, w), []).append(hit["bhash"])
                    if len(seen) > WINDOWS_A_BATCH:
                        yield flush()
        yield flush()

    return run


def _reach_of_windows(length: int):
    """From repeated windows to the reach that they give each of their blocks."""
    schema = pa.schema([("akey", pa.int64()), ("bhash", pa.int64()), ("before", pa.int32()), ("after", pa.int32())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reach: dict[tuple[int, int], tuple[int, int]] = {}
            for akey, d, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for bhash in own:
                    old = reach.get((akey, bhash), (0, 0))
                    reach[akey, bhash] = max(old[0], d), max(old[1], length - d)
            cols = list(zip(*((*k, *v) for k, v in reach.items()), strict=True)) or [[]] * 4
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str | None = "doc_id", text_col: str = "text") -> DataFrame:
    """(tkey, spans): for each text with repeated strings, where they lie (array of start and end in bytes, in no order, overlapping)."""
    keyed = with_small_batches(docs).select(text_key(text_of(text_col)).alias("tkey"), F.xxhash64(*([id_col] if id_col else []), text_col).alias("dkey"), text_of(text_col).alias("text"))
    long = keyed.filter(F.octet_length("text") >= length)
    found = stored(occurrences(long, length, gram), "suffix-blocks")
    kinds = stored(found.groupBy("akey", "bhash").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("tkey", "dkey", "pos", "n", "anchor")).alias("one")), "suffix-kinds")
    mixed = kinds.groupBy("akey").agg(F.count(F.lit(1)).alias("kinds"), F.min("times").alias("least")).filter("kinds > 1 AND least = 1")
    hit = F.struct("one.pos", "one.n", "one.anchor", "akey", "bhash", (F.col("times") > 1).alias("twice"))
    wanted = kinds.join(mixed, "akey").select("one.tkey", "one.dkey", (F.col("kinds") > CROWDED).alias("crowded"), hit.alias("hit"))
    n_wanted = stored(wanted, "suffix-wanted")
    per_row = n_wanted.groupBy("tkey", "dkey", "crowded").agg(F.collect_list("hit").alias("hits"))
    placed = stored(long.join(per_row, ["tkey", "dkey"]).select("text", "hits", "crowded"), "suffix-texts")

    n_parts = min(1 << 20, max(12, math.ceil(n_wanted.count() / BLOCKS_A_PART)))
    runs = placed.filter("NOT crowded").select("text", "hits").mapInArrow(_runs(length, n_parts), "part int, run binary")
    reach = runs.groupBy("part").applyInPandas(_merged(length, gram), _REACH)
    windows = placed.filter("crowded").select("text", "hits").mapInArrow(_window_rows(length), "akey long, d int, window long, blocks array<long>")
    windows = stored(windows, "suffix-windows")
    often = windows.groupBy("akey", "d", "window").agg(F.sum(F.size("blocks")).alias("times")).filter("times > 1").drop("times")
    counted = windows.join(often, ["akey", "d", "window"]).select("akey", "d", "blocks").mapInArrow(_reach_of_windows(length), _REACH)
    counted = counted.groupBy("akey", "bhash").agg(F.max("before").alias("before"), F.max("after").alias("after"))
    reach = reach.unionByName(counted)

    covers = kinds.join(reach, ["akey", "bhash"], "left").filter("times > 1 OR before IS NOT NULL")
    whole = F.col("times") > 1
    covers = covers.select(
        "akey", "bhash",
        F.when(whole, 0).otherwise(F.col("one.anchor") - F.col("before")).alias("from"),
        F.when(whole, F.col("one.n") - 1 + length).otherwise(F.col("one.anchor") + F.col("after")).alias("to"),
    )
    covers = stored(covers, "suffix-covers")
    spans = found.join(covers, ["akey", "bhash"]).select("tkey", (F.col("pos") + F.col("from")).alias("start"), (F.col("pos") + F.col("to")).alias("end")).distinct()
    return spans.groupBy("tkey").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def united(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap joined."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for s, e in spans:
        parts.append(raw[at:s])
        at = e
    return b"".join([*parts, raw[at:]])


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans drawn in so that none cuts a UTF-8 character in two."""
    out = []
    for s, e in spans:
        while s < len(raw) and raw[s] & 0xC0 == 0x80:
            s += 1
        while e < len(raw) and raw[e] & 0xC0 == 0x80:
            e -= 1
        if s < e:
            out.append((s, e))
    return out


_DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removal_digest(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the bytes of its text, how many of them and in how many runs are removed, and the digest of the rest."""
    spans = repeated_spans(docs, length, gram, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), text_key(text_of(text_col)).alias("tkey"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, raw, found in zip(b.column(0).to_pylist(), _bytes_of(b.column(1)), b.column(2), strict=True):
                cut = united(found.as_py())
                out.append((doc_id, len(raw), sum(e - s for s, e in cut), len(cut), hashlib.sha256(without(raw, cut)).hexdigest()))
            cols = list(zip(*out, strict=True)) or [[]] * len(schema)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return rows.join(spans, "tkey", "left").select("doc_id", "text", "spans").mapInArrow(run, _DIGEST)


def op9_suffixes(spark, sf_dir: str) -> DataFrame:
    """All documents without the bytes of repeated strings of 400 bytes."""
    return removal_digest(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents
), w AS MATERIALIZED (SELECT rid, unnest(range(1, octet_length(b) - 398)) AS i, unnest(list_transform(range(1, octet_length(b) - 398), lambda i: md5_number(array_slice(b, i, i + 399)))) AS h FROM d WHERE octet_length(b) >= 400
), r AS MATERIALIZED (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS last FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)
), runs AS (SELECT rid, i, sum((last IS NULL OR i > last + 400)::INT) OVER (PARTITION BY rid ORDER BY i) AS run FROM r
), cut AS (SELECT rid, run, min(i) AS s, max(i) + 400 AS e FROM runs GROUP BY 1, 2
), piece AS (
  SELECT rid, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY s), 1) AS from_byte, s AS to_byte FROM cut UNION ALL SELECT rid, max(e), NULL FROM cut GROUP BY 1
), kept AS (SELECT rid, string_agg(hex(array_slice(b, from_byte, coalesce(to_byte, octet_length(b) + 1) - 1)), '' ORDER BY from_byte) AS bytes FROM piece JOIN d USING (rid) WHERE from_byte < coalesce(to_byte, octet_length(b) + 1) GROUP BY 1
), sums AS (SELECT rid, sum(e - s) AS n_removed, count(*) AS n_spans FROM cut GROUP BY 1
)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(CASE WHEN n_removed IS NULL THEN b ELSE unhex(coalesce(bytes, '')) END) AS kept_sha256
FROM d LEFT JOIN sums USING (rid) LEFT JOIN kept USING (rid)
"""


def passage_spans(raw: bytes, spans: list[tuple[int, int]], words: int) -> list[tuple[int, int]]:
    """Of spans, drawn in to whole characters, those that hold at least `words` words."""
    return [(s, e) for s, e in whole_characters(raw, spans) if len(raw[s:e].split()) >= words]


def without_passages(docs: DataFrame, length: int = PASSAGE_BYTES, gram: int = PASSAGE_GRAM, words: int = PASSAGE_WORDS, text_col: str = "text") -> DataFrame:
    """(row, kept): each row as a struct, and its text without repeated passages (null where nothing is cut)."""
    spans = repeated_spans(docs, length, gram, None, text_col).select(F.col("tkey").alias("key"), "spans")
    rows = as_rows(docs).withColumn("tkey", text_key(text_of(F.col("row").getField(text_col))))
    schema = rows.select("row").schema.add("kept", "string")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept: list[bytes | None] = []
            for raw, found in zip(_bytes_of(b.column(0).field(text_col)), b.column(1), strict=True):
                cut = passage_spans(raw, united(found.as_py()), words) if found.is_valid else []
                kept.append(without(raw, cut) if cut else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()).cast(pa.string())], ["row", "kept"])

    return rows.join(spans, rows.tkey == spans.key, "left").select("row", "spans").mapInArrow(run, schema)


def suffix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without the repeated passages, and n_chars to match; rows emptied stay.

    A passage is a maximal run of bytes covered by strings of PASSAGE_BYTES that also start
    elsewhere; it goes, whole characters only, if it holds at least PASSAGE_WORDS words. Unlike the
    digest of LENGTH bytes this meets passages of 50 words, most of which are under 400 bytes.
    """
    cut, kept, row = without_passages(docs), F.col("kept"), F.col("row")
    made = {"text": lambda c: F.coalesce(kept, c), "n_chars": lambda c: F.when(kept.isNull(), c).otherwise(F.length(kept).cast(docs.schema["n_chars"].dataType))}
    return cut.select(*(made.get(c, lambda x: x)(row.getField(c)).alias(c) for c in docs.columns))
