from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.llm import _bytes as B
from siftwell.llm import _exchange as X
from siftwell.llm._common import _scratch_root, bucket_bits, chunks_for, drop_scratch, materialize
from siftwell.llm.components import connected_components


def test_scratch_is_dropped(spark):
    df = materialize(spark.range(5), "five")
    root = Path(_scratch_root(spark).removeprefix("file:"))
    assert df.count() == 5 and root.is_dir()
    assert drop_scratch(spark) and not root.exists()


def test_counts_follow_the_input():
    assert chunks_for(0) == 1 and chunks_for(10 << 30) == 2560
    assert 2 ** bucket_bits(64 << 30) * (8 << 20) >= 64 << 30
    huge = 100 << 40
    assert huge / chunks_for(huge) <= 65 << 20 and huge / 2 ** bucket_bits(huge) <= 65 << 20
    assert huge / chunks_for(huge) / 6 / 2 ** bucket_bits(huge) > 1  # hashes a row, at six bytes a word


@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=30), max_size=20), st.integers(0, 3))
@settings(max_examples=60, deadline=None)
def test_concat_and_words(texts, skip):
    import re

    col = pa.array(texts, pa.string())[skip:]
    buf, off = B.concat(col)
    texts = texts[skip:]
    assert [bytes(buf[off[i] : off[i + 1] - 1]) for i in range(len(texts))] == [t.encode() for t in texts]
    starts, ends, counts = B.words(buf, off)
    want = [re.findall(rb"[^\x20\x09-\x0D]+", t.encode()) for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert [bytes(buf[a:b]) for a, b in zip(starts, ends, strict=True)] == [x for w in want for x in w]


@given(st.lists(st.integers(0, 3), min_size=0, max_size=60), st.integers(1, 20))
@settings(max_examples=80, deadline=None)
def test_window_hash_tells_windows_apart(items, n):
    h = B.window_hash(np.array(items, np.uint64), n)
    windows = [tuple(items[i : i + n]) for i in range(len(items) - n + 1)]
    assert len(h) == len(windows)
    assert len(set(h.tolist())) == len(set(windows))
    assert len({(w, x) for w, x in zip(windows, h.tolist(), strict=True)}) == len(set(windows))


def test_span_hash_of_long_spans():
    data = b"x" * 1000 + b"y" + b"x" * 1000 + b"\n" * 20
    buf = np.frombuffer(data, np.uint8)
    at, size = np.array([0, 1, 1001, 0, 500]), np.array([500, 500, 500, 501, 500])
    h = B.span_hash(buf, at, size)
    assert h[0] == h[1] == h[2] != h[3] and h[4] == h[0]


@given(st.lists(st.integers(0, (1 << 32) - 1), max_size=50))
@settings(max_examples=50, deadline=None)
def test_sorted_numbers_round_trip(x):
    x = np.sort(np.array(x, np.uint32))
    assert np.array_equal(X.unpack_sorted(X.pack_sorted(x)), x)
    wide = x.astype(np.int64) - 7
    assert np.array_equal(X.unplanes(X.planes(wide), "<i8", len(wide)), wide)


def test_buckets_cover_all_keys():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    edge = X.bounds(keys, 5, 59)
    assert edge[0] == 0 and edge[-1] == 1000 and len(edge) == 33
    assert all((keys[edge[b] : edge[b + 1]] >> np.uint64(59) == b).all() for b in range(32))


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 3), (5, 4), (9, 9)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)], [(i, i * 7 % 53) for i in range(53)]])
def test_components(spark, edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {x.k: x.root for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(up)}
