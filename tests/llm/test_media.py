import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from siftwell.llm import media
from siftwell.llm.media import clips, cuts, text_videos, video_facts
from siftwell.llm.motion_jpeg import STANDARD, ZIGZAG, Broken, Video, decode_frames, encode_lossless, write_avi

SHARP = bytes([1]) * 64


def tables(standard):
    """Code and length of each symbol, by class; flat codes if not the standard ones."""
    out, segments = {}, b""
    for kind, size, symbols in ((0, 4, bytes(range(12))), (1, 8, bytes(x for x in range(255) if x & 15 <= 11))):
        counts = bytes(len(symbols) if i == size else 0 for i in range(1, 17))
        if standard:
            counts, symbols = (bytes.fromhex(x) for x in STANDARD[kind, 0])
        code, k, found = 0, 0, {}
        for length, n in enumerate(counts, 1):
            for s in symbols[k : k + n]:
                found[s] = (code, length)
                code += 1
            k, code = k + n, code << 1
        out[kind] = found
        segments += b"\xff\xc4" + struct.pack(">HB", 19 + len(symbols), kind << 4) + counts + symbols
    return out, b"" if standard else segments


def baseline(planes, sampling, interval=0, standard=False):
    """A plain encoder, one symbol at a time, for planes whose sizes are whole units."""
    codes, dht = tables(standard)
    height, width = planes[0].shape
    h, v = sampling
    bits, out, dc, unit = "", b"", [0] * len(planes), 0

    def number(x):
        return format(x if x > 0 else x + (1 << abs(x).bit_length()) - 1, f"0{abs(x).bit_length()}b") if x else ""

    def flush():
        nonlocal bits, out
        bits += "1" * (-len(bits) % 8)
        out += bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
        bits = ""

    n = np.arange(8)
    basis = np.where(n == 0, np.sqrt(1 / 8), 0.5)[:, None] * np.cos((2 * n[None] + 1) * n[:, None] * np.pi / 16)
    for y in range(0, height, 8 * v):
        for x in range(0, width, 8 * h):
            if interval and unit and unit % interval == 0:
                flush()
                out += b"\xff" + bytes([0xD0 + (unit // interval - 1) % 8])
                dc = [0] * len(planes)
            unit += 1
            for c, plane in enumerate(planes):
                spots = [(y + 8 * j, x + 8 * i) for j in range(v) for i in range(h)] if c == 0 else [(y // v, x // h)]
                for a, b in spots:
                    coded = np.rint(basis @ (plane[a : a + 8, b : b + 8].astype(float) - 128) @ basis.T).astype(int).ravel()[ZIGZAG]
                    diff, dc[c] = int(coded[0]) - dc[c], int(coded[0])
                    put = lambda kind, s: format(codes[kind][s][0], f"0{codes[kind][s][1]}b")
                    bits += put(0, abs(diff).bit_length()) + number(diff)
                    run = 0
                    for k in range(1, 64):
                        if not coded[k:].any():
                            bits += put(1, 0)
                            break
                        if coded[k] == 0:
                            run += 1
                            continue
                        while run > 15:
                            bits += put(1, 0xF0)
                            run -= 16
                        bits += put(1, run << 4 | abs(int(coded[k])).bit_length()) + number(int(coded[k]))
                        run = 0
    flush()
    parts = b"".join(bytes([i + 1, (h << 4 | v) if i == 0 else 0x11, 0]) for i in range(len(planes)))
    sof = struct.pack(">BHHB", 8, height, width, len(planes)) + parts
    sos = bytes([len(planes)]) + b"".join(bytes([i + 1, 0]) for i in range(len(planes))) + b"\0\x3f\0"
    dri = b"\xff\xdd" + struct.pack(">HH", 4, interval) if interval else b""
    return b"\xff\xd8\xff\xe0\0\4ab\xff\xdb\0\x43\0" + SHARP + dht + dri + b"\xff\xc0" + struct.pack(">H", 2 + len(sof)) + sof + b"\xff\xda" + struct.pack(">H", 2 + len(sos)) + sos + out + b"\xff\xd9"


def test_tables():
    assert ZIGZAG[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and ZIGZAG[-3:] == [55, 62, 63]
    for (kind, _), (counts, symbols) in STANDARD.items():
        counts, symbols = bytes.fromhex(counts), bytes.fromhex(symbols)
        assert len(counts) == 16 and sum(counts) == len(symbols) == len(set(symbols))
        assert set(symbols) == (set(range(12)) if kind == 0 else {0, 0xF0} | {r << 4 | s for r in range(16) for s in range(1, 11)})


@pytest.mark.parametrize("sampling,n,interval,standard", [((1, 1), 1, 0, False), ((1, 1), 1, 2, True), ((2, 2), 3, 0, True), ((2, 1), 3, 1, False), ((1, 1), 3, 3, True)])
def test_baseline_frames(sampling, n, interval, standard):
    r = np.random.default_rng(n)
    frames, want = [], []
    for _ in range(5):
        y, x = np.mgrid[0:32, 0:48]
        luma = np.clip(128 + 90 * np.sin(x / r.uniform(2, 9) + y / r.uniform(2, 9)) + r.normal(0, 12, (32, 48)), 0, 255).astype(np.uint8)
        planes = [luma, *[r.integers(0, 255, (32 // sampling[1], 48 // sampling[0])).astype(np.uint8) for _ in range(n - 1)]]
        frames.append(baseline(planes, sampling, interval, standard))
        want.append(luma)
    for got, luma in zip(decode_frames(frames), want, strict=True):
        assert got.shape == luma.shape and np.abs(got.astype(int) - luma).max() <= 2


@pytest.mark.parametrize("seed", range(6))
def test_lossless_round_trip(seed):
    r = np.random.default_rng(seed)
    shape = (int(r.integers(1, 9)), int(r.integers(1, 40)), int(r.integers(1, 40)))
    samples = r.integers(0, 256, shape) if seed % 2 else r.choice([0, 255, 254], shape)
    samples = samples.astype(np.uint8)
    assert np.array_equal(np.stack(decode_frames(encode_lossless(samples))), samples)


def test_indexes():
    frames = encode_lossless(np.random.default_rng(1).integers(0, 256, (7, 8, 6)).astype(np.uint8))
    data = write_avi(frames, 6, 8, 30000, 1001)
    v = Video(data)
    assert [v.frame(i) for i in range(7)] == frames and (v.rate, v.scale) == (30000, 1001)
    index = data.rindex(b"idx1")
    shift = data.index(b"movi")
    absolute = bytearray(data)
    for k in range(7):
        at = index + 8 + 16 * k + 8
        absolute[at : at + 4] = (int.from_bytes(absolute[at : at + 4], "little") + shift).to_bytes(4, "little")
    reordered = data[: index + 8] + b"".join(data[index + 8 + 16 * k : index + 24 + 16 * k] for k in (2, 0)) + data[index + 40 :]
    for other in (bytes(absolute), data[:index], data[: index + 8] + b"\xff" * (len(data) - index - 8)):  # counted from the start; none; broken
        assert [Video(other).frame(i) for i in range(7)] == frames
    assert Video(reordered).frame(0) == frames[2]
    # An index of indexes in the header, as large files have it.
    entries = [(v.frames[i][0], len(frames[i])) for i in (4, 5)]
    head = struct.pack("<HBBI4s12x", 4, 0, 0, 1, b"00dc")
    grown = len(head) + 16 + 8
    table = b"ix00" + struct.pack("<IHBBI4sQI", 24 + 16, 2, 0, 1, 2, b"00dc", grown, 0) + b"".join(struct.pack("<II", *e) for e in entries)
    strl = data.index(b"strl") - 8
    size = lambda at: int.from_bytes(data[at + 4 : at + 8], "little")
    end = strl + 8 + size(strl)
    hdrl = data.index(b"hdrl") - 8
    super_ = b"indx" + struct.pack("<I", len(head) + 16) + head + struct.pack("<QII", len(data) + grown, len(table), 2)
    out = bytearray(data[:end] + super_ + data[end:] + table)
    for at in (strl, hdrl):
        out[at + 4 : at + 8] = (size(at) + grown).to_bytes(4, "little")
    v = Video(bytes(out))
    assert len(v.frames) == 2 and [v.frame(i) for i in range(2)] == frames[4:6]


def test_cuts_follow_the_motion():
    r = np.random.default_rng(2)
    still, restless = np.tile(r.integers(0, 50, 32), (12, 1)), r.integers(0, 50, (20, 32))
    other = np.roll(np.sort(still[0]), 7)[None].repeat(10, 0)
    begins, change = cuts(np.concatenate([still, other, restless]))
    assert begins[0] == 0 and 12 in begins and 22 in begins and len(begins) < 8
    slow = [cuts(np.concatenate([still, other, restless])[: k + 1])[0].tolist() for k in range(42)]
    assert all(s == [b for b in begins if b <= k] for k, s in enumerate(slow))  # a threshold looks back only
    assert cuts(np.zeros((0, 32)))[0].tolist() == [] and cuts(still[:1])[0].tolist() == [0]


def plain(text):
    raw = (text or "").encode()
    return raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)


def test_texts_and_clips(spark):
    r = random.Random(4)
    texts = [None, "", "a", "é" * 288, "é" * 289, "x" * 576, "￿\U0010ffff", "ÿ" * 5000, "\xff\0" * 3000] + ["".join(chr(r.randint(1, 900)) for _ in range(r.randint(1, 5000))) for _ in range(40)]
    texts += ["".join(chr(r.randint(1, 90)) for _ in range(1_300_000))] + texts[:5]
    df = spark.createDataFrame([(i if i % 3 else None, t, b"m") for i, t in enumerate(texts)], "doc_id long, text string, `me dia` binary")
    made = text_videos(df)
    assert made.columns == ["doc_id", "me dia", "media"]
    stored = [x.media for x in made.collect()]
    got = video_facts(made).collect()
    assert got[0].asDict().keys() == {"doc_id", "me dia", "facts"}
    for t, x, raw in zip(texts, got, stored, strict=True):
        f, want = x.facts, plain(t)
        assert (f.error, f.n_samples, f.samples_sha256, f.tail_crc32) == (None, len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
        assert (f.n_frames, f.width, f.height, f.duration_ms) == (len(want) // 576, 24, 24, len(want) // 576 * 40)
        assert [c.first_frame for c in f.clips][:1] == [0] and sum(c.n_frames for c in f.clips) == f.n_frames
        assert all(a.end_ms == b.start_ms and a.first_frame + a.n_frames == b.first_frame for a, b in zip(f.clips, f.clips[1:]))
        assert b"".join(p.tobytes() for p in decode_frames([Video(raw).frame(i) for i in range(f.n_frames)])) == want
    assert stored[-5:] == stored[:5]
    assert clips(made).count() == sum(len(x.facts.clips) for x in got)


def test_broken_media(spark, monkeypatch):
    monkeypatch.setattr(media, "SLAB_FRAMES", 3)
    good = write_avi(encode_lossless(np.arange(5 * 48, dtype=np.uint8).reshape(5, 6, 8)), 8, 6)
    frame = baseline([np.zeros((8, 8), np.uint8)], (1, 1))
    progressive = frame.replace(b"\xff\xc0", b"\xff\xc2")
    first = Video(good).frames[0][0]
    files = [good, None, b"", b"RIFF", good[:30], good[: first + 4], good.replace(b"vids", b"auds"), write_avi([], 8, 8), write_avi([b"xx", frame], 8, 8), write_avi([progressive], 8, 8), write_avi([frame, frame[:-9]], 8, 8), write_avi([frame], 8, 8), good]
    got = [x.facts for x in video_facts(spark.createDataFrame([(i, x) for i, x in enumerate(files)], "facts_of int, media binary").coalesce(1)).collect()]
    assert got[0] == got[-1] and got[0].n_frames == 5 and got[1] is None and got[7].clips == [] and got[7].n_frames == 0 and got[11].n_samples == 64
    assert [bool(x and x.error) for x in got] == [False, False, True, True, True, True, True, False, True, True, got[10].error is not None, False, False]


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert clips(text_videos(empty)).collect() == []


def test_frames_that_are_refused():
    with pytest.raises(Broken):
        decode_frames([b"\xff\xd8\xff"])
    h = encode_lossless(np.zeros((1, 2, 2), np.uint8))[0]
    for a, b in ((b"\xda\0\x08\1\1\0\1", b"\xda\0\x08\1\1\0\2"), (b"\xff\xc3\0\x0b\x08", b"\xff\xc3\0\x0b\x0c")):
        assert a in h
        with pytest.raises(Broken):
            decode_frames([h.replace(a, b)])
