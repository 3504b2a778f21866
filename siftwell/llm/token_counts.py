"""Tokens per document of flat token files without an index.

A flat token file is nothing but fixed-width token ids, an end-of-document id after each document.  The scan plans byte ranges
of ``RANGE_BYTES`` from the files' sizes, regardless of documents, and deals them to tasks, so one file of any size is read by
many.  A task searches its range block by block, each with one vectorised comparison, and keeps only: the tokens before the
range's first separator, those after its last, the lengths in between, and how many separators it has.  Which document a range
begins in, and how many of its tokens came before, follow from a prefix scan over four numbers a range; the lengths join the
result by range.  Token data is never shuffled.

``document_token_counts`` writes such files first: every task encodes its documents into files of at most ``FILE_TOKENS`` in
the shared scratch folder, and returns a file's name and its documents' ids only when it is complete, so what a lost task left
behind is never read.

Files are opened through Arrow's file systems (local, HDFS, S3, GCS, Azure); where Arrow doesn't know a path's scheme, given
files are read whole by Spark's binaryFile source, which is limited to 2 GB a file, and files of documents are written by Spark
as rows, one for each byte range, which are scanned and stitched like ranges of files.

Defined cases: an empty document has 0 tokens; tokens after the last separator are a document of their own, no tokens there
are none; an empty file has no documents; a file's size must be a multiple of the token width, else the scan fails.  A null
text is an empty document; texts of any length are encoded whole, and their tokens may lie in several ranges.  Repeated rows
are documents of their own, so there are no ties; null ids stay null.  An empty table gives an empty result; other columns play
no part and may have any name.
"""

from __future__ import annotations

import base64
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import id_and_text, materialize, scratch_dir
from .near_dedup import slabs

BLOCK_TOKENS = 1 << 16
RANGE_BYTES = 8 << 20
FILE_TOKENS = 32 << 20
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that splits text before the vocabulary's merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_DOCUMENT = 50256

_SUMMARY = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n_separators", pa.int64()), ("head", pa.int64()), ("tail", pa.int64()), ("inner", pa.list_(pa.int64())), ("last", pa.bool_())])
SUMMARY_SQL = "file string, block long, n_separators long, head long, tail long, inner array<long>, last boolean"


def summarise(file: str, block: int, last: bool, tokens: np.ndarray, separator: int, block_tokens: int) -> tuple:
    """The row of one range of a flat file."""
    found = [at + np.flatnonzero(tokens[at : at + block_tokens] == separator) for at in range(0, len(tokens), block_tokens)]
    at = np.concatenate(found) if found else np.zeros(0, np.int64)
    if len(at):
        return file, block, len(at), int(at[0]), len(tokens) - 1 - int(at[-1]), (np.diff(at) - 1).tolist(), last
    return file, block, 0, len(tokens), len(tokens), [], last


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SUMMARY)], schema=_SUMMARY)


def stitch(blocks: DataFrame) -> DataFrame:
    """``(file, ordinal, n_tokens)`` of every document, from the ranges' rows."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    b = blocks.drop("inner").withColumn("ordinal", F.coalesce(F.sum("n_separators").over(before), F.lit(0)))
    # Tokens of the open document that lie in earlier ranges: since, and with the tail of, the last range that has a separator.
    b = b.withColumn("all", F.coalesce(F.sum("tail").over(before), F.lit(0)))
    has = F.col("n_separators") > 0
    since = F.last(F.when(has, F.col("all")), ignorenulls=True).over(before)
    b = b.withColumn("carry", F.col("all") - F.coalesce(since, F.lit(0)))
    b = b.select("file", "block", "ordinal", "carry").join(blocks, ["file", "block"])
    none = F.array().cast("array<bigint>")
    ended = F.when(has, F.concat(F.array(F.col("carry") + F.col("head")), F.col("inner"))).otherwise(none)
    open_ = F.when(has, F.col("tail")).otherwise(F.col("carry") + F.col("tail"))
    ended = F.concat(ended, F.when(F.col("last") & (open_ > 0), F.array(open_)).otherwise(none))
    return b.select("file", "ordinal", F.posexplode(ended).alias("i", "n_tokens")).select("file", (F.col("ordinal") + F.col("i")).alias("ordinal"), "n_tokens")


def _opened(path: str):
    """Arrow's file system of a path and the path in it; ``None`` where Arrow has none."""
    try:
        return fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None


def _ranges(width: int, separator: int, block_tokens: int):
    """Reads each row's byte range, ``file, size, at, length``, and summarises it."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                system, path = fs.FileSystem.from_uri(r["file"])
                with system.open_input_file(path) as f:
                    raw = f.read_at(r["length"], r["at"])
                if len(raw) != r["length"]:
                    raise ValueError(f"{r['file']}: changed while it was read")
                yield _batch([summarise(r["file"], r["block"], r["at"] + r["length"] == r["size"], np.frombuffer(raw, f"<u{width}"), separator, block_tokens)])

    return run


def scan_ranges(files: DataFrame, separator: int, width: int, block_tokens: int, range_bytes: int) -> DataFrame:
    """The ranges' rows of ``files`` (``file, size``), one task for some ranges each."""
    step = max(1, range_bytes // width) * width
    spark = files.sparkSession
    at = files.filter("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(step).cast("long"))).alias("at"))
    at = at.select("file", "size", "at", F.least(F.lit(step), F.col("size") - F.col("at")).cast("long").alias("length"), (F.col("at") / step).cast("long").alias("block"))
    total = files.agg(F.coalesce(F.sum(F.ceil(F.col("size") / step)), F.lit(0))).first()[0]
    tasks = max(1, min(int(total), max(spark.sparkContext.defaultParallelism, int(total) // 8)))
    return at.repartition(tasks, "file", "at").mapInArrow(_ranges(width, separator, block_tokens), SUMMARY_SQL)


def _whole(width: int, separator: int, block_tokens: int):
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                raw = content.as_buffer()
                if raw is not None and raw.size:
                    yield _batch([summarise(path, 0, True, np.frombuffer(raw, f"<u{width}"), separator, block_tokens)])

    return run


def count_token_files(spark, path: str, separator: int = END_OF_DOCUMENT, width: int = 2, block_tokens: int = BLOCK_TOKENS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(file, ordinal, n_tokens)`` for all documents of the flat files at ``path`` (a folder or a pattern)."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [x for y in system.globStatus(at) or [] for x in (system.listStatus(y.getPath()) if y.isDirectory() else [y]) if x.isFile()]
    files = [(x.getPath().toString(), x.getLen()) for x in found if x.getPath().getName()[0] not in "._"]
    for name, size in files:
        if size % width:
            raise ValueError(f"{name}: {size} bytes are no whole number of {width}-byte tokens")
    if all(_opened(name) for name, _ in files[:1]):
        blocks = scan_ranges(spark.createDataFrame(files, "file string, size long"), separator, width, block_tokens, range_bytes)
    else:
        blocks = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_whole(width, separator, block_tokens), SUMMARY_SQL)
    return stitch(materialize(blocks, "blocks"))


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(texts: list[str | None], vocabulary: str = VOCABULARY) -> list[np.ndarray]:
    e = _encoder(vocabulary)
    return [e.encode_to_numpy(t or "", disallowed_special=()) for t in texts]


_FILES = "file string, size long, ids array<long>"


def _flat_files(vocabulary: str, folder: str, file_tokens: int):
    """Writes a task's documents as flat token files; a row for each complete file."""

    def run(batches):
        system, at = fs.FileSystem.from_uri(folder)
        system.create_dir(at)
        out, name, size, ids = None, "", 0, []
        for batch in batches:
            for part in slabs(batch):
                texts = encode(part.column("text").to_pylist(), vocabulary)
                for doc_id, tokens in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                    if out is None:
                        name, size, ids = f"{uuid.uuid4().hex}.tokens", 0, []  # each attempt of a task has files of its own
                        out = system.open_output_stream(f"{at}/{name}")
                    flat = np.append(tokens, END_OF_DOCUMENT).astype("<u2")
                    out.write(flat.tobytes())
                    size += 2 * len(flat)
                    ids.append(doc_id)
                    if size >= 2 * file_tokens:
                        out.close()
                        yield _file_row(folder, name, size, ids)
                        out = None
        if out is not None:
            out.close()
            yield _file_row(folder, name, size, ids)

    return run


def _file_row(folder: str, name: str, size: int, ids: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], names=["file", "size", "ids"])


_FLAT = pa.schema([("file", pa.string()), ("block", pa.int64()), ("last", pa.bool_()), ("raw", pa.binary()), ("ids", pa.list_(pa.int64()))])


def _flat_rows(vocabulary: str, file_tokens: int, step: int):
    """Where Arrow can't write: a task's flat files as rows that Spark writes, one for each byte range; the last has the ids."""

    def row(name: str, block: int, raw: bytes, ids: list | None) -> pa.RecordBatch:
        values = ([name], [block], [ids is not None], [raw], [ids or []])
        return pa.record_batch([pa.array(v, f.type) for v, f in zip(values, _FLAT, strict=True)], schema=_FLAT)

    def run(batches):
        name, block, size, flat, ids = uuid.uuid4().hex, 0, 0, bytearray(), []
        for batch in batches:
            for part in slabs(batch):
                texts = encode(part.column("text").to_pylist(), vocabulary)
                for doc_id, tokens in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                    raw = np.append(tokens, END_OF_DOCUMENT).astype("<u2").tobytes()
                    flat += raw
                    size += len(raw)
                    ids.append(doc_id)
                    while len(flat) > step:  # ranges end where they end, whatever document they are in
                        yield row(name, block, bytes(flat[:step]), None)
                        del flat[:step]
                        block += 1
                    if size >= 2 * file_tokens:
                        yield row(name, block, bytes(flat), ids)
                        name, block, size, flat, ids = uuid.uuid4().hex, 0, 0, bytearray(), []
        if ids:
            yield row(name, block, bytes(flat), ids)

    return run


def _rows_scanned(block_tokens: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield _batch([summarise(r["file"], r["block"], r["last"], np.frombuffer(r["raw"], "<u2"), END_OF_DOCUMENT, block_tokens)])

    return run


def document_token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS, range_bytes: int = RANGE_BYTES, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """``(doc_id, n_tokens)`` for every row: documents are encoded into flat token files, and the files are scanned."""
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col)
    folder = scratch_dir(spark)
    if _opened(folder):
        files = materialize(rows.mapInArrow(_flat_files(vocabulary, folder, file_tokens), _FILES), "files")
        blocks = materialize(scan_ranges(files.select("file", "size"), END_OF_DOCUMENT, 2, block_tokens, range_bytes), "blocks")
    else:
        step = max(1, range_bytes // 2) * 2
        flat = materialize(rows.mapInArrow(_flat_rows(vocabulary, file_tokens, step), "file string, block long, last boolean, raw binary, ids array<long>"), "flat")
        files = flat.filter("last").select("file", "ids")
        blocks = materialize(flat.select("file", "block", "last", "raw").mapInArrow(_rows_scanned(block_tokens), SUMMARY_SQL), "blocks")
    listed = files.select("file", F.posexplode("ids").alias("i", "doc_id"))
    return stitch(blocks).join(listed.withColumn("ordinal", F.col("i").cast("long")), ["file", "ordinal"]).select("doc_id", "n_tokens")
