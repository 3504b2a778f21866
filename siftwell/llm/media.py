"""Media columns: binary columns of motion-JPEG AVI files, parsed by their indexes, decoded and cut into timed clips.

``video_facts`` reads a media column where it lies, without a shuffle: a file's index says where its frames are, frames of many
rows are decoded side by side (see ``motion_jpeg``), and only facts leave: sizes, times, hashes of the samples, and clips.  A shot
ends where the histograms of two frames differ by ``LEAST_CHANGE`` at least and by more than the mean and ``DEVIATIONS``
standard deviations of the ``WINDOW`` differences before, so that the threshold follows how much the pictures move.
``clips`` makes a row for each.

``text_videos`` stores texts as videos, losslessly: UTF-8 bytes as 8-bit samples of 24 x 24 frames in JPEG's lossless mode.

Memory is bounded by the largest file (its row has to be held) and ``SLAB_FRAMES`` decoded frames.

Defined cases: a null media value has null facts and no clips; one that is broken (no AVI file, a frame that can't be decoded)
has its ``error`` and no clips, and fails no other row; a file without frames has no clips.  A null text counts as empty and is
one frame of padding.  Equal texts give equal files; repeated rows are rows of their own, so there are no ties.  An AVI file
holds 4 GB, a Spark value 2 GB: longer texts fail.  An empty table gives an empty result; ``video_facts`` and ``text_videos``
carry other columns of any name along, but their own names must be free.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .motion_jpeg import Broken, Video, decode_frames, encode_lossless, write_avi
from .near_dedup import slabs

SIDE = 24
FRAME_BYTES = SIDE * SIDE
PADDING = 255
BINS = 32
WINDOW, DEVIATIONS, LEAST_CHANGE = 8, 2.5, 0.25
SLAB_FRAMES = 2048

CLIP = "struct<clip: int, first_frame: int, n_frames: int, start_ms: long, end_ms: long, change: int, motion: int>"
FACTS = f"struct<n_frames: int, width: int, height: int, duration_ms: long, n_samples: long, samples_sha256: string, tail_crc32: long, clips: array<{CLIP}>, error: string>"


def cuts(histograms: np.ndarray, window: int = WINDOW, deviations: float = DEVIATIONS, least: float = LEAST_CHANGE) -> tuple[np.ndarray, np.ndarray]:
    """The frames at which shots begin, the first included, and the difference of each frame from the one before (0 to 1)."""
    n = len(histograms)
    change = np.zeros(n)
    if n > 1:
        change[1:] = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / np.maximum(histograms[1:].sum(axis=1) + histograms[:-1].sum(axis=1), 1)
    one = np.concatenate([[0, 0], np.cumsum(change[1:])])[: n + 1]
    two = np.concatenate([[0, 0], np.cumsum(change[1:] ** 2)])[: n + 1]
    at = np.arange(n)
    from_ = np.maximum(at - window, 1)
    seen = np.maximum(at - from_, 0)
    mean = (one[at] - one[np.minimum(from_, at)]) / np.maximum(seen, 1)
    spread = np.sqrt(np.maximum((two[at] - two[np.minimum(from_, at)]) / np.maximum(seen, 1) - mean**2, 0))
    begins = (change >= least) & (change > mean + deviations * spread)
    begins[:1] = True
    return np.flatnonzero(begins), change


class _Seen:
    """What is known of one file while its frames are decoded."""

    def __init__(self, data: bytes | None):
        self.video, self.error, self.shape = None, None, (None, None)
        self.sha, self.last, self.n_samples, self.histograms = hashlib.sha256(), b"", 0, []
        if data is not None:
            try:
                self.video = Video(data)
            except Broken as e:
                self.error = str(e)
            except (ValueError, IndexError) as e:
                self.error = f"broken file: {e}"

    def add(self, planes: list[np.ndarray]) -> None:
        self.shape = self.shape if self.shape[0] else planes[0].shape
        for p in planes:
            raw = p.tobytes()
            self.sha.update(raw)
            self.last = (self.last + raw)[-32:]
            self.n_samples += len(raw)
        self.histograms.append(np.stack([np.bincount(p.ravel() >> 3, minlength=BINS) for p in planes]))

    def facts(self) -> dict | None:
        if self.error or self.video is None:
            return None if not self.error else {"error": self.error}
        v = self.video
        n = len(v.frames)
        ms = lambda frame: round(frame * 1000 * v.scale / v.rate)
        clips = []
        if n:
            begins, change = cuts(np.concatenate(self.histograms))
            change = np.rint(change * 1000).astype(np.int64)
            total = np.cumsum(change)
            for i, (a, b) in enumerate(zip(begins.tolist(), [*begins[1:].tolist(), n], strict=True)):
                clips.append({"clip": i, "first_frame": a, "n_frames": b - a, "start_ms": ms(a), "end_ms": ms(b), "change": int(change[a]), "motion": int(total[b - 1] - total[a]) // max(b - a - 1, 1)})
        return {
            "n_frames": n, "width": self.shape[1], "height": self.shape[0], "duration_ms": ms(n), "n_samples": self.n_samples,
            "samples_sha256": self.sha.hexdigest(), "tail_crc32": zlib.crc32(self.last), "clips": clips, "error": None,
        }


def _decoded(files: list[bytes | None]) -> list[_Seen]:
    """All frames of all files, ``SLAB_FRAMES`` at a time; a slab with a broken frame is decoded again file by file."""
    seen = [_Seen(x) for x in files]
    waiting: list[tuple[_Seen, int, int]] = []

    def run() -> None:
        parts = [([s.video.frame(i) for i in range(a, b)], s) for s, a, b in waiting if not s.error]
        waiting.clear()
        try:
            planes = decode_frames([f for frames, _ in parts for f in frames])
        except Broken:
            planes = []
            for frames, s in parts:
                try:
                    planes += decode_frames(frames)
                except Broken as e:
                    s.error = str(e)
                    planes += [None] * len(frames)
        at = 0
        for frames, s in parts:
            if not s.error:
                s.add(planes[at : at + len(frames)])
            at += len(frames)

    n = 0
    for s in seen:
        at, total = 0, len(s.video.frames) if s.video else 0
        while at < total:
            take = min(total - at, SLAB_FRAMES - n)
            waiting.append((s, at, at + take))
            at, n = at + take, n + take
            if n == SLAB_FRAMES:
                run()
                n = 0
    run()
    return seen


def video_facts(media: DataFrame, col: str = "media") -> DataFrame:
    """``media`` with the struct ``facts`` (``FACTS``) in place of the column ``col``."""
    rest = [f for f in media.schema.fields if f.name != col]
    schema = StructType([*rest, *StructType.fromDDL(f"facts {FACTS}").fields])
    kind = to_arrow_type(schema["facts"].dataType)

    def run(batches):
        for batch in batches:
            for part in slabs(batch, "__media"):
                facts = [s.facts() for s in _decoded(part.column("__media").to_pylist())]
                yield pa.record_batch([*[part.column(i) for i in range(len(rest))], pa.array(facts, kind)], names=[*part.schema.names[: len(rest)], "facts"])

    return media.select(*[F.col(f"`{f.name}`") for f in rest], F.col(f"`{col}`").cast("binary").alias("__media")).mapInArrow(run, schema)


def clips(media: DataFrame, col: str = "media") -> DataFrame:
    """A row for each clip of each file: the other columns of ``media`` and the fields of ``CLIP``."""
    f = video_facts(media, col)
    return f.select(*[F.col(f"`{c}`") for c in f.columns if c != "facts"], F.explode("facts.clips").alias("__clip")).select("*", "__clip.*").drop("__clip")


def _videos(batches):
    for batch in batches:
        for part in slabs(batch, "__text"):
            texts = [x.encode() for x in part.column("__text").to_pylist()]
            padded = [x + bytes([PADDING]) * ((-len(x)) % FRAME_BYTES if x else FRAME_BYTES) for x in texts]
            samples = np.frombuffer(b"".join(padded), np.uint8).reshape(-1, SIDE, SIDE)
            frames = [f for at in range(0, len(samples), SLAB_FRAMES) for f in encode_lossless(samples[at : at + SLAB_FRAMES])]
            ends = np.cumsum([len(x) // FRAME_BYTES for x in padded])
            files = [write_avi(frames[a:b], SIDE, SIDE) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            names = part.schema.names
            yield pa.record_batch([*[part.column(i) for i in range(len(names) - 1)], pa.array(files, pa.binary())], names=[*names[:-1], "media"])


def text_videos(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the column ``media``, an AVI file that holds the text's bytes, in place of the text."""
    rest = [f for f in docs.schema.fields if f.name != text_col]
    schema = StructType([*rest]).add("media", "binary")
    return docs.select(*[F.col(f"`{f.name}`") for f in rest], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text")).mapInArrow(_videos, schema)
