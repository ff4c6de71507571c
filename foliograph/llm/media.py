"""Media columns: ISO media containers, walked without decoding their payloads.

`wrap` stores bytes as samples of one PCM track: `ftyp`, then `moov` with its sample tables,
then `mdat`. `inspect` walks nested boxes by their headers, decodes the sample tables (stts,
stss, stsc, stsz, stz2, stco and co64) and the runs of fragments (trex, tfhd and trun), and gives
codec, duration, samples and the byte ranges of keyframes of all tracks; the payload itself is only
sliced by these ranges, never decoded. Counts are checked against the bytes there before tables
are read, and boxes nest as deep as they like.

Defined results: a null text is the empty one; a container that breaks off, whose tables disagree
or that has no track gives an error text and nulls instead of values, and stops no other row; a null
id is carried; repeated rows and equal texts get equal values; an empty table gives no rows; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliograph.llm.common import as_rows, lean, table, with_small_batches

SAMPLE = 192
CHUNK = 64
RATE = 8000
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_FTYP = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")


def wrap(payload: bytes, sample: int = SAMPLE, rate: int = RATE, chunk: int = CHUNK) -> bytes:
    """The container of a payload whose length is a multiple of `sample`: unsigned 8-bit mono PCM, `sample` frames a sample, `chunk` samples a chunk, the first of each chunk a keyframe."""
    n = len(payload) // sample
    n_chunks = -(-n // chunk)
    frames = len(payload)
    rest = n % chunk
    stsc = [(1, chunk, 1)] if n_chunks > (rest > 0) else []
    if rest:
        stsc.append((n_chunks, rest, 1))
    large = len(payload) > 0xF0000000

    def moov(first: int) -> bytes:
        offsets = first + np.arange(n_chunks, dtype=np.int64) * (chunk * sample)
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), _box(b"raw ", b"\0" * 6, struct.pack(">H8xHHIHH", 1, 1, 8, 0, rate, 0))),
            _full(b"stts", struct.pack(">III", 1, n, sample)),
            _full(b"stss", struct.pack(">I", n_chunks), (np.arange(n_chunks, dtype=np.int64) * chunk + 1).astype(">u4").tobytes()),
            _full(b"stsc", struct.pack(">I", len(stsc)), *(struct.pack(">III", *x) for x in stsc)),
            _full(b"stsz", struct.pack(">II", sample, n)),
            _full(b"co64" if large else b"stco", struct.pack(">I", n_chunks), offsets.astype(">u8" if large else ">u4").tobytes()),
        )
        minf = _box(b"minf", _full(b"smhd", b"\0" * 4), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">QQIQ", 0, 0, rate, frames), struct.pack(">HH", 0x55C4, 0), version=1), _full(b"hdlr", b"\0" * 4, b"soun", b"\0" * 12, b"samples\0"), minf)
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, frames), b"\0" * 8, struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, b"\0" * 8, version=1, flags=3)
        mvhd = _full(b"mvhd", struct.pack(">QQIQ", 0, 0, rate, frames), struct.pack(">IHH8x", 0x10000, 0x100, 0), _MATRIX, b"\0" * 24, struct.pack(">I", 2), version=1)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if large else struct.pack(">I4s", 8 + len(payload), b"mdat")
    first = len(_FTYP) + len(moov(0)) + len(head)
    return b"".join([_FTYP, moov(first), head, payload])


@dataclass
class Track:
    codec: str = ""
    handler: str = ""
    timescale: int = 0
    duration: int = 0
    channels: int = 0
    bits: int = 0
    width: int = 0
    height: int = 0
    n_samples: int = 0
    offsets: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    durations: np.ndarray = field(default_factory=lambda: np.empty((0, 2), np.int64))
    keys: np.ndarray | None = None
    fragment_duration: int = 0

    def add_runs(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Append the samples of fragments; with them every keyframe has a number."""
        keys = np.arange(1, self.n_samples + 1) if self.keys is None else self.keys
        offsets, sizes, is_key = (np.concatenate([p[k] for p in parts]) for k in range(3))
        self.keys = np.r_[keys, np.flatnonzero(is_key) + self.n_samples + 1]
        self.offsets, self.sizes = np.r_[self.offsets, offsets], np.r_[self.sizes, sizes]
        self.n_samples += len(sizes)

    def seconds(self) -> float | None:
        """The track's own duration, or where it has none that of its fragments."""
        return (self.duration or self.fragment_duration) / self.timescale if self.timescale else None

    def keyframes(self) -> list[tuple[int, int]]:
        """(offset, size) of each sample that starts decoding; all samples where there is no sync table."""
        at = np.arange(self.n_samples) if self.keys is None else self.keys - 1
        return list(zip(self.offsets[at].tolist(), self.sizes[at].tolist(), strict=True))

    def ranges(self) -> list[tuple[int, int]]:
        """(offset, size) of the samples in order, neighbours joined."""
        if not self.n_samples:
            return []
        ends = self.offsets + self.sizes
        first = np.flatnonzero(np.r_[True, self.offsets[1:] != ends[:-1]])
        last = np.r_[first[1:] - 1, self.n_samples - 1]
        return [(int(self.offsets[a]), int(ends[b] - self.offsets[a])) for a, b in zip(first, last, strict=True)]


def boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start of body, end) of the boxes between two places."""
    while at < end:
        if end - at < 8:
            raise ValueError("a box header breaks off")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if end - at < 16:
                raise ValueError("a box header breaks off")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} has a wrong size")
        yield kind, at + head, at + size
        at += size


def _table(data: bytes, at: int, end: int, dtype: str, columns: int = 1, counted: int = 4, rows: int | None = None) -> np.ndarray:
    """The rows of a table whose count stands `counted` bytes behind `at`; the count is checked before anything is read."""
    n = struct.unpack_from(">I", data, at + counted)[0] if rows is None else rows
    first = at + counted + 4
    if first + n * columns * np.dtype(dtype).itemsize > end:
        raise ValueError("a table breaks off")
    got = np.frombuffer(data, dtype, count=n * columns, offset=first).astype(np.int64)
    return got.reshape(n, columns) if columns > 1 else got


def _sizes(data: bytes, kind: bytes, a: int, z: int) -> tuple[int, int | np.ndarray]:
    """(samples, the size that all of them have, or their sizes) of `stsz` or `stz2`."""
    same, n = struct.unpack_from(">II", data, a + 4)
    if kind == b"stsz":
        return n, same or _table(data, a, z, ">u4", counted=8, rows=n)
    width = same & 0xFF
    if width == 4:
        pairs = _table(data, a, z, ">u1", counted=8, rows=(n + 1) // 2)
        return n, np.column_stack([pairs >> 4, pairs & 15]).ravel()[:n]
    if width in (8, 16):
        return n, _table(data, a, z, f">u{width // 8}", counted=8, rows=n)
    raise ValueError("sample sizes of an unknown width")


def _fields(data: bytes, at: int, flags: int, known: tuple[int, ...]) -> tuple[dict[int, int], int]:
    """The four-byte values that flags announce, by flag, and where they end."""
    found = {}
    for flag in known:
        if flags & flag:
            found[flag], at = struct.unpack_from(">I", data, at)[0], at + 4
    return found, at


#: Flags of `tfhd` and `trun`: which values follow, and the flag of a sample that is no keyframe.
DESCRIPTION, DURATION, SIZE, FLAGS, MOOF_BASE = 0x02, 0x08, 0x10, 0x20, 0x020000
DATA_OFFSET, FIRST_FLAGS, EACH = 0x01, 0x04, (0x100, 0x200, 0x400, 0x800)
NO_KEYFRAME = 0x10000


def inspect(data: bytes) -> list[Track]:
    """The tracks of a container in order, their samples from the sample tables and then from all fragments."""
    tracks: list[Track] = []
    by_id: dict[int, Track] = {}
    extends: dict[int, tuple[int, int, int]] = {}  # track -> duration, size and flags that samples of fragments have by default
    runs: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}  # track -> offsets, sizes, keyframes of each run
    tables: dict = {}
    fragment = {"base": 0, "track": 0, "next": 0, "defaults": (0, 0, 0)}

    def read(kind: bytes, a: int, z: int) -> None:
        t = tracks[-1] if tracks else Track()
        if kind == b"tkhd":
            by_id[struct.unpack_from(">I", data, a + (20 if data[a] else 12))[0]] = t
        elif kind == b"mdhd":
            t.timescale, t.duration = struct.unpack_from(">IQ" if data[a] else ">II", data, a + (20 if data[a] else 12))
        elif kind == b"hdlr":
            t.handler = data[a + 8 : a + 12].decode("latin-1")
        elif kind == b"stsd":
            for codec, b, _ in boxes(data, a + 8, z):
                t.codec = codec.decode("latin-1").strip()
                if t.handler == "soun":
                    t.channels, t.bits = struct.unpack_from(">HH", data, b + 16)
                elif t.handler == "vide":
                    t.width, t.height = struct.unpack_from(">HH", data, b + 24)
                break
        elif kind == b"stts":
            t.durations = _table(data, a, z, ">u4", 2)
        elif kind == b"stss":
            t.keys = _table(data, a, z, ">u4")
        elif kind == b"stsc":
            tables["runs"] = _table(data, a, z, ">u4", 3)
        elif kind in (b"stsz", b"stz2"):
            tables["samples"], tables["sizes"] = _sizes(data, kind, a, z)
        elif kind in (b"stco", b"co64"):
            tables["chunks"] = _table(data, a, z, ">u4" if kind == b"stco" else ">u8")
        elif kind == b"trex":
            track, _, *defaults = struct.unpack_from(">IIIII", data, a + 4)
            extends[track] = tuple(defaults)
        elif kind == b"tfhd":
            flags, track = struct.unpack_from(">II", data, a)
            at, base = a + 8, None
            if flags & 1:
                base, at = struct.unpack_from(">Q", data, at)[0], at + 8
            own, _ = _fields(data, at, flags, (DESCRIPTION, DURATION, SIZE, FLAGS))
            known = extends.get(track, (0, 0, 0))
            first = fragment["at"] if flags & MOOF_BASE or fragment["next"] == 0 else fragment["next"]
            fragment.update(track=track, base=first if base is None else base, defaults=tuple(own.get(f, d) for f, d in zip((DURATION, SIZE, FLAGS), known, strict=True)))
            fragment["next"] = fragment["base"]
        elif kind == b"trun":
            read_run(a, z)

    def read_run(a: int, z: int) -> None:
        flags, n = struct.unpack_from(">II", data, a)
        at, offset = a + 8, fragment["next"]
        if flags & DATA_OFFSET:
            offset, at = fragment["base"] + struct.unpack_from(">i", data, at)[0], at + 4
        head, at = _fields(data, at, flags, (FIRST_FLAGS,))
        each = [f for f in EACH if flags & f]
        if not each and n > len(data):
            raise ValueError("more samples than bytes")
        rows = _table(data, at - 8, z, ">u4", len(each), rows=n).reshape(n, len(each)) if each else np.empty((n, 0), np.int64)
        duration, size, flag = (rows[:, each.index(f)] if f in each else np.full(n, d, np.int64) for f, d in zip(EACH[:3], fragment["defaults"], strict=True))
        if FIRST_FLAGS in head and n:
            flag = np.r_[head[FIRST_FLAGS], flag[1:]]
        offsets = offset + np.cumsum(size) - size
        fragment["next"] = int(offset + size.sum())
        if n and (offsets.min() < 0 or fragment["next"] > len(data)):
            raise ValueError("a sample lies outside")
        runs.setdefault(fragment["track"], []).append((offsets, size, flag & NO_KEYFRAME == 0))
        if fragment["track"] in by_id:
            by_id[fragment["track"]].fragment_duration += int(duration.sum())

    def lay_out(t: Track) -> None:
        n = tables.get("samples", 0)
        if not n:
            return
        chunks, stsc = tables["chunks"], tables["runs"]
        if not len(stsc) or stsc[0, 0] != 1 or (np.diff(stsc[:, 0]) <= 0).any() or stsc[-1, 0] > len(chunks):
            raise ValueError("the sample tables disagree")
        times = np.diff(np.r_[stsc[:, 0], len(chunks) + 1])
        if sum(c * k for c, k in zip(stsc[:, 1].tolist(), times.tolist(), strict=True)) != n or (not isinstance(tables["sizes"], np.ndarray) and n * tables["sizes"] > len(data)):
            raise ValueError("the sample tables disagree")
        t.n_samples, sizes = n, tables["sizes"]
        t.sizes = sizes if isinstance(sizes, np.ndarray) else np.full(n, sizes, np.int64)
        per_chunk = np.repeat(stsc[:, 1], times)
        chunks, per_chunk = chunks[per_chunk > 0], per_chunk[per_chunk > 0]
        before = np.cumsum(t.sizes) - t.sizes
        first = np.cumsum(per_chunk) - per_chunk
        t.offsets = np.repeat(chunks - before[first], per_chunk) + before
        if t.offsets.min() < 0 or (t.offsets + t.sizes).max() > len(data) or (t.keys is not None and len(t.keys) and not 1 <= t.keys.min() <= t.keys.max() <= n):
            raise ValueError("a sample lies outside")

    def walk() -> None:
        levels = [(b"", boxes(data, 0, len(data)))]  # a stack of its own: boxes may nest as deep as they like
        while levels:
            parent, inner = levels[-1]
            found = next(inner, None)
            if found is None:
                levels.pop()
                if parent == b"trak":
                    lay_out(tracks[-1])
                continue
            kind, a, z = found
            if kind == b"trak":
                tracks.append(Track())
                tables.clear()
            elif kind == b"moof":
                fragment.update(at=a - 8 if data[a - 4 : a] == kind else a - 16, next=0, track=0, base=0, defaults=(0, 0, 0))
            if kind in NESTED:
                levels.append((kind, boxes(data, a, z)))
            else:
                read(kind, a, z)

    try:
        walk()
        for track, parts in runs.items():
            if track in by_id:
                by_id[track].add_runs(parts)
    except (struct.error, KeyError, IndexError, OverflowError, MemoryError) as e:
        raise ValueError(f"unreadable: {e}") from e
    return tracks


def describe(t: Track) -> str:
    """codec;handler;duration in seconds;channels;bits;samples;keyframes;first and last keyframe's byte range."""
    keys = t.keyframes()
    span = lambda k: f"{k[0]}+{k[1]}"
    seconds = t.seconds() or 0.0
    return f"codec={t.codec};handler={t.handler};seconds={seconds:.6f};channels={t.channels};bits={t.bits};samples={t.n_samples};keyframes={len(keys)}" + (f";first={span(keys[0])};last={span(keys[-1])}" if keys else "")


_TRACK = "codec: string, handler: string, duration_s: double, n_samples: bigint, keyframes: array<struct<offset: bigint, size: bigint>>"


def containers(media: DataFrame, content_col: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: the columns of keep, an error or null, and all tracks of the container in content_col; then the first track's codec, duration_s, n_samples and keyframes."""
    kept = as_rows(media.select(*keep)).schema["row"].dataType if keep else None
    out_schema = T.StructType([*([T.StructField("row", kept, False)] if keep else []), *T.StructType.fromDDL(f"error string, tracks array<struct<{_TRACK}>>")])
    span = pa.struct([("offset", pa.int64()), ("size", pa.int64())])
    track = pa.struct([("codec", pa.string()), ("handler", pa.string()), ("duration_s", pa.float64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(span))])

    def told(t: Track) -> dict:
        return {"codec": t.codec, "handler": t.handler, "duration_s": t.seconds(), "n_samples": t.n_samples, "keyframes": [{"offset": o, "size": s} for o, s in t.keyframes()]}

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            errors, tracks = [], []
            for content in b.column(b.num_columns - 1):
                try:
                    found = [told(t) for t in inspect(content.as_py() or b"")]
                    errors.append(None if found else "no track")
                    tracks.append(found or None)
                except ValueError as e:
                    errors.append(str(e))
                    tracks.append(None)
            own = [b.column(0)] if keep else []
            yield pa.RecordBatch.from_arrays([*own, pa.array(errors, pa.string()), pa.array(tracks, pa.list_(track))], [*["row"] * bool(keep), "error", "tracks"])

    content = F.col(content_col).alias("content")
    rows = media.select(F.struct(*keep).alias("row"), content) if keep else media.select(content)
    found = with_small_batches(rows).mapInArrow(run, out_schema)
    first = [F.get("tracks", F.lit(0)).getField(c).alias(c) for c in ("codec", "duration_s", "n_samples", "keyframes")]
    return found.select(*(["row.*"] if keep else []), "error", "tracks", *first)


_STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def stored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a container, read back: digests of payload and container, and what the walk finds."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                media = wrap(raw.ljust(max(1, -(-len(raw) // SAMPLE)) * SAMPLE, b" "))
                t = inspect(media)[0]
                digest, n, tail = hashlib.sha256(), 0, b""
                for at, size in t.ranges():
                    part = media[at : at + size]
                    digest.update(part)
                    n, tail = n + size, (tail + part[-16:])[-16:]
                rows.append((doc_id, len(raw), n, digest.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), describe(t)))
            cols = list(zip(*rows, strict=True)) or [[]] * len(schema)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return with_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _STORED)


def op6_media(spark, sf_dir: str) -> DataFrame:
    """All texts as media containers."""
    return stored_texts(table(spark, sf_dir, "documents"))
