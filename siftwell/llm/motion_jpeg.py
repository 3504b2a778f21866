"""Motion-JPEG frames and the AVI files that hold them, as far as clips of a media column need them.

Frames are entropy-decoded side by side: one numpy step takes the next symbol of every frame (of every restart interval) with the
same header.  Baseline frames yield their luma after the inverse transform, lossless ones (predictor 1) their samples.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np

#: The order in which a block's coefficients are coded.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else -(i // 8)))
#: The Huffman tables of frames that carry none, as number of codes of 1 to 16 bits and symbols, by class and id.
STANDARD = {
    (0, 0): ("00010501010101010100000000000000", "000102030405060708090a0b"),
    (0, 1): ("00030101010101010101010000000000", "000102030405060708090a0b"),
    (1, 0): (
        "0002010303020403050504040000017d",
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a53545556575"
        "8595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1"
        "e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa",
    ),
    (1, 1): (
        "00020102040403040705040400010277",
        "0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758"
        "595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9da"
        "e2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa",
    ),
}
_RESTART, _END = re.compile(rb"\xff[\xd0-\xd7]"), re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_DCT = np.sqrt(np.where(np.arange(8) == 0, 1, 2)[:, None] / 8) * np.cos((2 * np.arange(8)[None] + 1) * np.arange(8)[:, None] * np.pi / 16)


class Broken(ValueError):
    """What is wrong with a media value."""


# --- Frames -----------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=64)
def _codes(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits that may come next: length of the code times 256, plus its symbol; 0 where there is none."""
    table, at, k = np.zeros(1 << 16, np.int32), 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[k : k + n]:
            table[at : at + (1 << 16 - length)] = length << 8 | symbol
            at += 1 << 16 - length
        k += n
    return table


def _standard(kind: int, i: int) -> np.ndarray:
    return _codes(*map(bytes.fromhex, STANDARD[kind, min(i, 1)]))


class Header:
    """What comes before a frame's entropy-coded bytes."""

    def __init__(self, data: bytes):
        self.tables, self.quantisers, self.interval, self.kind, at = {}, {}, 0, None, 2
        while at + 4 <= len(data):
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4])
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xC4:
                while len(body) > 16:
                    n = sum(body[1:17])
                    self.tables[body[0] >> 4, body[0] & 15] = _codes(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    values = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1)
                    self.quantisers[body[0] & 15] = values.astype(np.int32)
                    body = body[1 + 64 * (1 + bool(wide)) :]
            elif marker == 0xDD:
                self.interval = int.from_bytes(body[:2])
            elif marker in (0xC0, 0xC1, 0xC3):
                self.kind = "lossless" if marker == 0xC3 else "baseline"
                precision, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.parts = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
                if precision != 8:
                    raise Broken(f"samples of {precision} bits")
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise Broken("neither a baseline nor a lossless frame")
            elif marker == 0xDA:
                self.scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                self.predictor = body[1 + 2 * body[0]]
        if self.kind is None or not self.height * self.width or any(c not in self.parts for c, _, _ in self.scan):
            raise Broken("a frame without its header")
        if self.kind == "lossless" and (len(self.parts) > 1 or self.predictor != 1 or self.interval % self.width):
            raise Broken("a lossless frame of more than one component or of another predictor than 1")
        if self.kind == "baseline" and len(self.scan) != len(self.parts):
            raise Broken("a frame in several scans")

    def table(self, kind: int, i: int) -> np.ndarray:
        return self.tables[kind, i] if (kind, i) in self.tables else _standard(kind, i)


@lru_cache(maxsize=256)
def _header(data: bytes) -> Header:
    try:
        return Header(data)
    except (IndexError, struct.error) as e:
        raise Broken("a frame whose header is cut") from e


def split_frame(frame: bytes) -> tuple[bytes, list[bytes]]:
    """A frame's header and the entropy-coded bytes of its restart intervals, stuffing removed."""
    if frame[:2] != b"\xff\xd8":
        raise Broken("no frame")
    at = 2
    while True:
        if at + 4 > len(frame) or frame[at] != 0xFF:
            raise Broken("a frame whose header is cut")
        marker, at = frame[at + 1], at + 2 + int.from_bytes(frame[at + 2 : at + 4])
        if marker == 0xDA:
            break
    end = _END.search(frame, at)
    scan = frame[at : end.start() if end else len(frame)]
    return frame[:at], [x.replace(b"\xff\x00", b"\xff") for x in _RESTART.split(scan)]


class _Bits:
    """The bits of many byte strings, read side by side."""

    def __init__(self, parts: list[bytes]):
        size = np.array([len(x) + 8 for x in parts], np.int64)
        self.pos = (np.cumsum(size) - size) * 8
        self.end = self.pos + 8 * size - 32
        b = np.frombuffer(b"".join(x + bytes(8) for x in parts), np.uint8).astype(np.uint32)
        self.next = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]

    def peek(self, lanes) -> np.ndarray:
        pos = self.pos[lanes]
        return (self.next[pos >> 3] >> (16 - (pos & 7)).astype(np.uint32)).astype(np.int64) & 0xFFFF

    def symbol(self, lanes, table: np.ndarray) -> np.ndarray:
        found = table[self.peek(lanes)]
        self.pos[lanes] += found >> 8
        if not found.all() or (self.pos[lanes] > self.end[lanes]).any():
            raise Broken("a frame whose bits are no code")
        return found & 255

    def value(self, lanes, size: np.ndarray) -> np.ndarray:
        """Signed numbers of ``size`` bits each."""
        v = self.peek(lanes) >> (16 - size)
        self.pos[lanes] += size
        return v - np.where(v < 1 << np.maximum(size, 1) - 1, (1 << size) - 1, 0)


def _lossless(h: Header, scans: list[list[bytes]]) -> np.ndarray:
    rows = h.interval // h.width or h.height
    parts = [p for s in scans for p in s]
    per = -(-h.height // rows)
    if len(parts) != per * len(scans):
        raise Broken("a frame without all its restart intervals")
    bits, every = _Bits(parts), slice(None)
    lane_rows = np.minimum(rows, h.height - rows * (np.arange(len(parts)) % per))
    out = np.zeros((rows * h.width, len(parts)), np.int64)
    table = h.table(0, h.scan[0][1])
    for i in range(rows * h.width):
        lanes = every if lane_rows.min() * h.width > i else np.flatnonzero(lane_rows * h.width > i)
        out[i, lanes] = bits.value(lanes, bits.symbol(lanes, table))
    d = out.reshape(rows, h.width, len(parts))
    d[0, 0] += 128
    d[:, 0] = np.cumsum(d[:, 0], axis=0)
    got = (np.cumsum(d, axis=1) & 0xFFFF).astype(np.uint8).transpose(2, 0, 1)
    return got.reshape(len(scans), per * rows, h.width)[:, : h.height]


def _baseline(h: Header, scans: list[list[bytes]]) -> np.ndarray:
    """Luma planes: the first component of each frame."""
    one = len(h.scan) == 1  # then units are blocks, whatever the sampling factors say
    most = [1 if one else max(p[i] for p in h.parts.values()) for i in (0, 1)]
    across, down = -(-h.width // (8 * most[0])), -(-h.height // (8 * most[1]))
    layout = [(c, td, ta) for c, td, ta in h.scan for _ in range(1 if one else h.parts[c][0] * h.parts[c][1])]
    first = h.scan[0][0]
    n_first = sum(c == first for c, _, _ in layout)
    units, step = across * down, h.interval or across * down
    per = -(-units // step)
    parts = [p for s in scans for p in s]
    if len(parts) != per * len(scans):
        raise Broken("a frame without all its restart intervals")
    bits = _Bits(parts)
    left = np.minimum(step, units - step * (np.arange(len(parts)) % per))
    base = (np.arange(len(parts)) // per) * units + step * (np.arange(len(parts)) % per)
    blocks = np.zeros((len(scans) * units * n_first, 64), np.int32)
    dc = {c: np.zeros(len(parts), np.int64) for c, _, _ in h.scan}
    for unit in range(step):
        live = np.flatnonzero(left > unit)
        for place, (c, td, ta) in enumerate(layout):
            dc[c][live] += bits.value(live, bits.symbol(live, h.table(0, td)))
            at = (base[live] + unit) * n_first + place if c == first else None
            if at is not None:
                blocks[at, 0] = dc[c][live]
            k, lanes, own = np.ones(len(live), np.int64), live, at
            while len(lanes):
                s = bits.symbol(lanes, h.table(1, ta))
                run, size = s >> 4, s & 15
                go = (size > 0) | (run == 15)
                k, lanes, run, size, own = k[go] + run[go], lanes[go], run[go], size[go], own if own is None else own[go]
                if (k > 63).any():
                    raise Broken("a block of over 64 coefficients")
                v = bits.value(lanes, size)
                if own is not None:
                    blocks[own, k] += v.astype(np.int32)
                k = k + 1
                go = k < 64
                k, lanes, own = k[go], lanes[go], own if own is None else own[go]
    coded = np.zeros_like(blocks, dtype=np.float64)
    coded[:, ZIGZAG] = blocks * h.quantisers.get(h.parts[first][2], np.ones(64, np.int32))
    pixels = np.clip(np.rint(_DCT.T @ coded.reshape(-1, 8, 8) @ _DCT + 128), 0, 255).astype(np.uint8)
    fh, fv = (1, 1) if one else h.parts[first][:2]
    planes = pixels.reshape(len(scans), down, across, fv, fh, 8, 8).transpose(0, 1, 3, 5, 2, 4, 6).reshape(len(scans), down * fv * 8, across * fh * 8)
    return planes[:, : -(-h.height * fv // most[1]), : -(-h.width * fh // most[0])]


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """The luma (lossless: the samples) of each frame, in order; frames with equal headers are decoded together."""
    split = [split_frame(f) for f in frames]
    groups: dict[bytes, list[int]] = {}
    for i, (head, _) in enumerate(split):
        groups.setdefault(head, []).append(i)
    out: list = [None] * len(frames)
    for head, members in groups.items():
        h = _header(head)
        for i, plane in zip(members, (_lossless if h.kind == "lossless" else _baseline)(h, [split[i][1] for i in members]), strict=True):
            out[i] = plane
    return out


#: Code lengths of the categories of differences in the frames written here.
_LENGTHS = {5: 2, 6: 2, 4: 3, 7: 3, 0: 4, 3: 4, 1: 5, 2: 5, 8: 5}


def _difference_codes() -> tuple[bytes, np.ndarray, np.ndarray]:
    """The table's segment, and code and length for each difference of -255 to 255."""
    symbols = sorted(_LENGTHS, key=lambda s: (_LENGTHS[s], s))
    counts = bytes(sum(n == length for n in _LENGTHS.values()) for length in range(1, 17))
    code, codes, last = 0, {}, 0
    for s in symbols:
        code <<= _LENGTHS[s] - last
        last = _LENGTHS[s]
        codes[s], code = code, code + 1
    value, length = [], []
    for d in range(-255, 256):
        s = abs(d).bit_length()
        value.append(codes[s] << s | (d if d >= 0 else d + (1 << s) - 1))
        length.append(_LENGTHS[s] + s)
    body = bytes([0]) + counts + bytes(symbols)
    return b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body, np.array(value, np.uint32), np.array(length, np.int64)


_TABLE, _VALUE, _LENGTH = _difference_codes()


def encode_lossless(samples: np.ndarray) -> list[bytes]:
    """Frames of 8-bit ``samples[frame, row, column]``, each a JPEG file that decodes to the same samples."""
    n, height, width = samples.shape
    head = b"\xff\xd8" + _TABLE + b"\xff\xc3" + struct.pack(">HBHHB3B", 11, 8, height, width, 1, 1, 0x11, 0) + b"\xff\xda" + struct.pack(">HB2B3B", 8, 1, 1, 0, 1, 0, 0)
    x = samples.astype(np.int16)
    d = np.diff(x, axis=2, prepend=np.int16(0))
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    d = d.reshape(n, -1) + 255
    length, value = _LENGTH[d], _VALUE[d]
    ends = np.cumsum(length, axis=1)
    size = ends[:, -1] + 7 >> 3
    first = np.cumsum(size) - size
    start = (first[:, None] * 8 + ends - length).ravel()
    shifted = value.ravel() << (24 - (start & 7) - length.ravel()).astype(np.uint32)  # codes are of 13 bits at most
    at, total = start >> 3, int(size.sum()) + 2
    packed = sum(np.bincount(at + k, shifted >> (16 - 8 * k) & 255, total) for k in range(3)).astype(np.uint8)[:-2]
    spare = size * 8 - ends[:, -1]
    packed[first + size - 1] |= ((1 << spare) - 1).astype(np.uint8)
    stuffed = packed == 255
    wide = np.zeros(len(packed) + int(stuffed.sum()), np.uint8)
    wide[np.arange(len(packed)) + np.cumsum(stuffed) - stuffed] = packed
    to = np.cumsum(size + np.add.reduceat(stuffed.astype(np.int64), first)) if n else []
    raw = wide.tobytes()
    return [head + raw[a:b] + b"\xff\xd9" for a, b in zip([0, *to[:-1]], to, strict=True)]


# --- Files ------------------------------------------------------------------------------------------------------------


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], width: int, height: int, rate: int = 25, scale: int = 1) -> bytes:
    """An AVI file of one motion-JPEG stream, with an index."""
    longest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 * scale // rate, longest * rate // scale, 0, 0x10, len(frames), 0, 1, longest, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4H", 0, 0, 0, 0, scale, rate, 0, len(frames), longest, -1, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    stream = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    movi = b"movi" + b"".join(_chunk(b"00dc", f) for f in frames)
    size = np.array([len(f) for f in frames], np.int64)
    at = 4 + np.cumsum(8 + size + size % 2) - (8 + size + size % 2)
    index = np.zeros(len(frames), _ENTRY)
    index["id"], index["flags"], index["at"], index["size"] = b"00dc", 0x10, at, size
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + stream) + _chunk(b"LIST", movi) + _chunk(b"idx1", index.tobytes()))


_ENTRY = np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")])


def _chunks(data: bytes, at: int, end: int):
    """``(name, start, end)`` of the chunks between two places; for lists, the name is the list's."""
    while at + 8 <= end:
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        stop = min(at + 8 + size, end)
        if name in (b"LIST", b"RIFF"):
            yield data[at + 8 : at + 12], at + 12, stop
        else:
            yield name, at + 8, stop
        at += 8 + size + size % 2


class Video:
    """Where a file's frames lie, and their times."""

    def __init__(self, data: bytes):
        if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
            raise Broken("no AVI file")
        self.data, movi, old, wide, n_streams, self.stream = data, [], None, None, 0, None
        self.rate, self.scale = 25, 1
        for part, at, end in (x for riff, a, b in _chunks(data, 0, len(data)) if riff in (b"AVI ", b"AVIX") for x in _chunks(data, a, b)):
            if part == b"hdrl":
                for name, a, b in _chunks(data, at, end):
                    if name == b"avih" and (us := int.from_bytes(data[a : a + 4], "little")):
                        self.rate, self.scale = 1_000_000, us
                    elif name == b"strl":
                        inner = {x: (c, d) for x, c, d in _chunks(data, a, b)}
                        head = data[slice(*inner.get(b"strh", (0, 0)))]
                        if self.stream is None and head[:4] == b"vids" and len(head) >= 28:
                            self.stream = n_streams
                            scale, rate = struct.unpack_from("<II", head, 20)
                            if scale and rate:
                                self.rate, self.scale = rate, scale
                            wide = inner.get(b"indx")
                        n_streams += 1
            elif part == b"movi":
                movi.append((at, end))
            elif part == b"idx1":
                old = old or (at, end)
        if self.stream is None:
            raise Broken("no video stream")
        self.names = [b"%02d%s" % (self.stream, kind) for kind in (b"dc", b"db")]
        self.frames = self._wide(*wide) if wide else None
        if self.frames is None and old and movi:
            self.frames = self._old(*old, movi[0][0] - 4)
        if self.frames is None:
            self.frames = [(a, b - a) for at, end in movi for a, b in self._walk(at, end)]

    def _walk(self, at: int, end: int):
        for name, a, b in _chunks(self.data, at, end):
            if name == b"rec ":
                yield from self._walk(a, b)
            elif name in self.names:
                yield a, b

    def _old(self, at: int, end: int, movi: int) -> list[tuple[int, int]] | None:
        """By the index at the file's end: places count from the list of frames, or from the file's start."""
        index = np.frombuffer(self.data, _ENTRY, (end - at) // 16, at)
        index = index[np.isin(index["id"], self.names)]
        for base in (movi, 0):
            found = [(base + int(p) + 8, int(n)) for p, n in zip(index["at"], index["size"], strict=True)]
            if found and all(self.data[a - 8 : a - 4] in self.names and int.from_bytes(self.data[a - 4 : a], "little") == n and a + n <= len(self.data) for a, n in found):
                return found
        return None

    def _wide(self, at: int, end: int) -> list[tuple[int, int]] | None:
        """By the indexes of large files: an index of indexes in the header, each of which counts from a base."""
        found, head = [], self.data[at:end]
        if len(head) < 24 or head[3] != 0:
            return None
        for k in range(min(int.from_bytes(head[4:8], "little"), (len(head) - 24) // 16)):
            place = int.from_bytes(head[24 + 16 * k : 32 + 16 * k], "little")
            part = self.data[place : place + 32]
            if len(part) < 32 or part[11] != 1:
                return None
            n, base = int.from_bytes(part[12:16], "little"), int.from_bytes(part[20:28], "little")
            entries = np.frombuffer(self.data[place + 32 : place + 32 + 8 * n], "<u4").reshape(-1, 2)
            found += [(base + int(p), int(size) & 0x7FFFFFFF) for p, size in entries]
        return found if found and all(a + n <= len(self.data) for a, n in found) else None

    def frame(self, i: int) -> bytes:
        at, size = self.frames[i]
        return self.data[at : at + size]
