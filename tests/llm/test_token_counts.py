import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import token_counts as module
from siftwell.llm.token_counts import END_OF_DOCUMENT, VOCABULARY, count_token_files, document_token_counts, encode, scan_ranges


def brute(tokens, sep):
    out, n = [], 0
    for t in tokens:
        if t == sep:
            out.append(n)
            n = 0
        else:
            n += 1
    return out + ([n] if n else [])


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_files(spark, tmp_path, block):
    r, want = random.Random(block), {}
    for i in range(12):
        tokens = [r.choice([9, 9, 9, 1, 2, 3]) if i % 2 else r.choice([1, 2, 9] + [3] * 30) for _ in range(r.randint(0, 90))]
        if i == 11:
            tokens = [5] * 50
        np.array(tokens, np.uint16).tofile(tmp_path / f"{i}.bin")
        if brute(tokens, 9):
            want[f"{i}.bin"] = brute(tokens, 9)
    got = {}
    for x in count_token_files(spark, str(tmp_path), separator=9, block_tokens=block).orderBy("file", "ordinal").collect():
        got.setdefault(x.file.rsplit("/", 1)[1], []).append(x.n_tokens)
    assert got == want


@pytest.mark.parametrize("range_bytes", [2, 6, 50, 1 << 20])
def test_one_file_over_many_tasks(spark, tmp_path, range_bytes):
    """A file's byte ranges are read by different tasks; documents longer than ranges, and empty ones, are stitched."""
    r = random.Random(1)
    tokens = [x for n in [0, 0, 1, 700, 3, 0, 25, 26, 90, 0, *(r.randint(0, 40) for _ in range(30)), 11] for x in [*([5] * n), 9]][:-1]
    np.array(tokens, np.uint16).tofile(tmp_path / "one.tokens")
    blocks = scan_ranges(spark.createDataFrame([(f"file://{tmp_path}/one.tokens", 2 * len(tokens))], "file string, size long"), 9, 2, 16, range_bytes)
    assert blocks.select(F.spark_partition_id()).distinct().count() > 1 or range_bytes > 50
    got = count_token_files(spark, str(tmp_path), separator=9, block_tokens=16, range_bytes=range_bytes).orderBy("ordinal").collect()
    assert [x.n_tokens for x in got] == brute(tokens, 9) and [x.ordinal for x in got] == list(range(len(got)))


def test_torn_files_fail(spark, tmp_path):
    (tmp_path / "odd").write_bytes(b"abc")
    with pytest.raises(ValueError, match="whole number"):
        count_token_files(spark, str(tmp_path))


def test_without_arrow_file_system(spark, tmp_path, monkeypatch):
    np.array([1, 9, 9, 2, 2], np.uint16).tofile(tmp_path / "x.bin")
    monkeypatch.setattr(module, "_opened", lambda path: None)
    assert sorted((x.ordinal, x.n_tokens) for x in count_token_files(spark, str(tmp_path), separator=9).collect()) == [(0, 1), (1, 0), (2, 2)]
    df = spark.createDataFrame([(1, "a b c"), (2, None), (None, "d")], "doc_id long, text string")
    got = {x.doc_id: x.n_tokens for x in document_token_counts(df).collect()}
    assert got == {1: len(encode(["a b c"])[0]), 2: 0, None: len(encode(["d"])[0])}


def test_very_long_text_in_small_ranges(spark):
    text = "some words, again and again; " * 40_000
    df = spark.createDataFrame([(1, text), (2, ""), (3, "x")], "doc_id long, text string").coalesce(1)
    got = {x.doc_id: x.n_tokens for x in document_token_counts(df, range_bytes=1000, file_tokens=50).collect()}
    assert got == {1: len(encode([text])[0]), 2: 0, 3: 1}


def test_ordinals(spark, tmp_path):
    np.array([1, 9, 9, 2, 2, 9, 3], np.uint32).tofile(tmp_path / "x.bin")
    got = [(x.ordinal, x.n_tokens) for x in count_token_files(spark, str(tmp_path), separator=9, width=4, block_tokens=2).orderBy("ordinal").collect()]
    assert got == [(0, 1), (1, 0), (2, 2), (3, 1)]


def test_documents(spark):
    pytest.importorskip("tiktoken")
    texts = ["", None, "one two", "<|endoftext|> is text", "é" * 500, "word " * 3000, "\n\n"] * 3
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "x y", 0), (2, "again", 0)], "doc_id long, text string, file int").repartition(3)
    got = sorted(((x.doc_id, x.n_tokens) for x in document_token_counts(df, block_tokens=64).collect()), key=str)
    want = [(i, len(t)) for i, t in enumerate(encode(texts))] + [(None, len(encode(["x y"])[0])), (2, len(encode(["again"])[0]))]
    assert got == sorted(want, key=str)
    assert END_OF_DOCUMENT not in np.concatenate(encode(texts, VOCABULARY))


def test_empty_table(spark):
    assert document_token_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_documents_without_arrow_file_system_are_files_of_ranges(spark, monkeypatch):
    """Where only Spark can write, flat files are still written and cut regardless of documents, and boundaries stitched."""
    pytest.importorskip("tiktoken")
    seen, stitch = [], module.stitch
    monkeypatch.setattr(module, "_opened", lambda path: None)
    monkeypatch.setattr(module, "stitch", lambda blocks: seen.append(blocks.agg(F.max("block"), F.max(F.size("inner"))).first()) or stitch(blocks))
    texts = ["some words, again and again; " * 5000, "", None, "x", "word " * 300] + ["a b"] * 50
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = {i: len(t) for i, t in enumerate(encode(texts))}
    for file_tokens in (50, 1 << 20):
        assert {x.doc_id: x.n_tokens for x in document_token_counts(df, range_bytes=100, file_tokens=file_tokens).collect()} == want
    assert all(block > 100 and inner > 1 for block, inner in seen)
