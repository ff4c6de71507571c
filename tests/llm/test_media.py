import hashlib
import random
import struct
import zlib

import pytest
from foliograph.llm.media import containers, inspect, stored_texts, wrap


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 128, 500])
def test_round_trip(n):
    payload = random.Random(n).randbytes(192 * n)
    media = wrap(payload)
    (t,) = inspect(media)
    assert (t.codec, t.handler, t.channels, t.bits, t.n_samples) == ("raw", "soun", 1, 8, n)
    assert t.duration / t.timescale == len(payload) / 8000
    assert b"".join(media[o : o + s] for o, s in t.ranges()) == payload
    keys = t.keyframes()
    assert [media[o : o + s] for o, s in keys] == [payload[i * 192 : (i + 1) * 192] for i in range(0, n, 64)]
    assert b"".join(media[o : o + s] for o, s in zip(t.offsets.tolist(), t.sizes.tolist())) == payload


def test_other_layouts():
    """Sizes of each sample's own, two chunks apart, no sync table, and unknown boxes between."""

    def box(kind, body):
        return struct.pack(">I4s", 8 + len(body), kind) + body

    full = lambda kind, body: box(kind, b"\0" * 4 + body)
    data = b"AAABBBBBCC..DDDD"
    head = box(b"ftyp", b"isom\0\0\0\0") + box(b"mdat", data)
    first = len(head) - len(data)
    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1) + box(b"avc1", b"\0" * 24 + struct.pack(">HH", 640, 360) + b"\0" * 50)) + full(b"stts", struct.pack(">III", 1, 4, 10)) + full(b"stsc", struct.pack(">I6I", 2, 1, 3, 1, 2, 1, 1)) + full(b"stsz", struct.pack(">6I", 0, 4, 3, 5, 2, 4)) + full(b"stco", struct.pack(">III", 2, first, first + 12)))
    moov = box(b"moov", box(b"free", b"x") + box(b"trak", box(b"mdia", full(b"mdhd", struct.pack(">IIII", 0, 0, 10, 40) + b"\0" * 4) + full(b"hdlr", b"\0" * 4 + b"vide" + b"\0" * 13) + box(b"minf", stbl))))
    (t,) = inspect(head + moov)
    media = head + moov
    assert [media[o : o + s] for o, s in t.keyframes()] == [b"AAA", b"BBBBB", b"CC", b"DDDD"]
    assert (t.codec, t.width, t.height, t.duration) == ("avc1", 640, 360, 40)
    assert len(t.ranges()) == 2


def box(kind, *body):
    body = b"".join(body)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind, *body, flags=0):
    return box(kind, struct.pack(">I", flags), *body)


def fragmented(data, parts):
    """Two tracks; each part is (track, samples, flags of samples) and lies in a fragment of its own, base and offsets from its moof."""
    trak = lambda i, handler: box(b"trak", full(b"tkhd", struct.pack(">III", 0, 0, i) + b"\0" * 72), box(b"mdia", full(b"mdhd", struct.pack(">IIII", 0, 0, 100, 0) + b"\0" * 4), full(b"hdlr", b"\0" * 4 + handler + b"\0" * 13), box(b"minf", box(b"stbl", full(b"stsd", struct.pack(">I", 0)), full(b"stsz", struct.pack(">II", 0, 0))))))
    out = box(b"ftyp", b"isom\0\0\0\0") + box(b"moov", trak(1, b"vide"), trak(2, b"soun"), box(b"mvex", *(full(b"trex", struct.pack(">IIIII", i, 1, 10, 4, 0)) for i in (1, 2))))
    for track, samples, marks in parts:
        run = lambda off: full(b"trun", struct.pack(">Ii", len(samples), off), *(struct.pack(">II", len(x), m) for x, m in zip(samples, marks)), flags=0x1 | 0x200 | 0x400)
        moof = lambda off: box(b"moof", full(b"mfhd", b"\0" * 4), box(b"traf", full(b"tfhd", struct.pack(">I", track), flags=0x020000), run(off)))
        out += moof(len(moof(0)) + 8) + box(b"mdat", *samples)
    return out


def test_fragments_and_all_tracks(spark):
    media = fragmented(b"", [(1, [b"KEY1", b"d"], [0, 0x10000]), (2, [b"aa", b"bbb"], [0, 0]), (1, [b"dd", b"KEY2!"], [0x10000, 0])])
    video, sound = inspect(media)
    read = lambda spans: [media[o : o + s] for o, s in spans]
    assert read(video.keyframes()) == [b"KEY1", b"KEY2!"] and video.n_samples == 4 and video.seconds() == 0.4
    assert read(sound.keyframes()) == [b"aa", b"bbb"] and sound.n_samples == 2
    (r,) = containers(spark.createDataFrame([(bytearray(media), "x")], "content binary, tracks string"), keep=("tracks",)).drop("tracks").collect()
    assert (r.error, r.n_samples) == (None, 4)
    rows = containers(spark.createDataFrame([(bytearray(media),)], "content binary")).collect()
    assert [t.handler for t in rows[0].tracks] == ["vide", "soun"]


@pytest.mark.parametrize("width", [4, 8, 16])
def test_compact_sizes(width):
    sizes = [3, 1, 2, 5, 4]
    data = b"".join(bytes([65 + i]) * n for i, n in enumerate(sizes))
    packed = bytes(a << 4 | b for a, b in zip(sizes[::2], [*sizes[1::2], 0])) if width == 4 else b"".join(n.to_bytes(width // 8, "big") for n in sizes)
    head = box(b"mdat", data)
    stbl = box(b"stbl", full(b"stsc", struct.pack(">I3I", 1, 1, 5, 1)), full(b"stz2", struct.pack(">II", width, 5), packed), full(b"stco", struct.pack(">II", 1, 8)))
    (t,) = inspect(head + box(b"moov", box(b"trak", box(b"mdia", box(b"minf", stbl)))))
    assert [head[o : o + s] for o, s in t.keyframes()] == [bytes([65 + i]) * n for i, n in enumerate(sizes)]


def test_broken():
    media = wrap(b"x" * 192)
    for bad in (media[:-1], media[:50], b"\0\0\0\5ftyp"):
        with pytest.raises(ValueError):
            inspect(bad)
    track = lambda *tables: box(b"moov", box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", *tables)))))
    huge = struct.pack(">I", 0xFFFFFFFF)
    for tables in (
        [full(b"stsz", struct.pack(">I", 1) + huge), full(b"stsc", struct.pack(">I3I", 1, 1, 0xFFFFFFFF, 1)), full(b"stco", struct.pack(">II", 1, 0))],
        [full(b"stsz", struct.pack(">I", 0) + huge)], [full(b"stz2", struct.pack(">I", 16) + huge)], [full(b"stz2", struct.pack(">II", 7, 1))], [full(b"stss", huge)],
        [full(b"stsz", struct.pack(">II", 1, 1))], [full(b"stsz", struct.pack(">II", 1, 1)), full(b"stsc", struct.pack(">I", 0)), full(b"stco", struct.pack(">II", 1, 0))],
    ):
        with pytest.raises(ValueError):
            inspect(track(*tables))
    with pytest.raises(ValueError):
        inspect(box(b"moof", box(b"traf", full(b"tfhd", struct.pack(">I", 1)), full(b"trun", huge))))
    deep = b""
    for _ in range(3000):
        deep = box(b"moov", deep)
    assert inspect(deep) == []


def test_no_input_raises(spark):
    rng = random.Random(8)
    good = [wrap(rng.randbytes(192 * 3)), fragmented(b"", [(1, [b"KEY1", b"d"], [0, 1]), (2, [b"aa"], [0])])]
    rows = []
    for k in range(600):
        raw = bytearray(good[k % 2])
        for _ in range(rng.randrange(1, 6)):
            at = rng.randrange(len(raw))
            raw[at : at + rng.choice([1, 4])] = rng.randbytes(rng.choice([1, 4])) if rng.random() < 0.7 else b"\xff\xff\xff\xff"
        rows.append((k, raw[: rng.randrange(len(raw))] if rng.random() < 0.2 else raw))
    out = containers(spark.createDataFrame(rows, "id long, content binary"), keep=("id",)).collect()
    assert sorted(r.id for r in out) == list(range(600))
    assert all((r.error is None) == (r.tracks is not None) for r in out)


def test_columns(spark):
    rows = [(1, None), (2, ""), (3, "ż" * 5000), (None, "x"), (3, "x")]
    out = stored_texts(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, feature int")).collect()
    assert len(out) == 5
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        raw = (t or "").encode()
        pay = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert any((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:])) for r in by[i])
    assert by[1][0][1:] == by[2][0][1:]
    media = spark.createDataFrame([(1, bytearray(wrap(b"y" * 384))), (2, None), (3, bytearray(b"junk"))], "id long, content binary")
    found = {r.id: r for r in containers(media, keep=("id",)).collect()}
    assert (found[1].codec, found[1].n_samples, found[1].error) == ("raw", 2, None)
    assert found[2].error and found[3].error and found[3].codec is None
    assert stored_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
