"""Shared pieces of the training-data operators: scratch tables and chunk dealing."""

from __future__ import annotations

import math
import re
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Java form of the separators between words: the space and U+0009 to U+000D.
SEPARATORS = r"[\x20\x09-\x0D]+"
#: Bytes of text that one chunk holds on average; a chunk is what one Python call sees at once.
CHUNK_BYTES = 4 << 20
#: Bytes of text whose hashes meet in one bucket on average.
BUCKET_BYTES = 8 << 20
#: Chunks and buckets exchange a row for each pair of them that share a hash.  Beyond this many bytes both grow with the square
#: root of the input, so that a row goes on holding several hashes: up to 64 MB each, at some 16 TB.
STEADY_BYTES = 64 << 30
MOST_GROWTH = 16
#: Where a null id would be the largest number: for orders only, together with whether it is null.
LAST_ID = (1 << 63) - 1

#: Folders of the scopes that are open, innermost last.
_SCOPES: list[str] = []
_LEFT_AT_EXIT: set[str] = set()


def _scratch_root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, which all executors share.

    Where that setting is unset, a local session uses a local folder and a cluster its default file system; if that is local
    too, there is no place that all executors see, and the call fails.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        base = "file:///tmp/checkpoints"
    elif not base:
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.get(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.getUri().getScheme() == "file":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{fs.getHomeDirectory()}/checkpoints"
    return f"{base.rstrip('/')}/siftwell/{spark.sparkContext.applicationId}"


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_dir(spark: SparkSession) -> str:
    """A new folder for an intermediate table, inside the innermost open scope; what is left when the driver exits goes then."""
    root = _scratch_root(spark)
    if root not in _LEFT_AT_EXIT:
        _LEFT_AT_EXIT.add(root)
        at, fs = _path(spark, root)
        fs.deleteOnExit(at)
    return f"{_SCOPES[-1] if _SCOPES else root}/{uuid.uuid4().hex}"


@contextmanager
def scratch_scope(spark: SparkSession):
    """Intermediate tables made inside are deleted at the end, by when results must have been written elsewhere."""
    scope = f"{_scratch_root(spark)}/scope-{uuid.uuid4().hex}"
    _SCOPES.append(scope)
    try:
        yield
    finally:
        _SCOPES.remove(scope)
        at, fs = _path(spark, scope)
        fs.delete(at, True)


def drop_scratch(spark: SparkSession) -> bool:
    """Deletes all intermediate tables of this application; call it once results have been written."""
    at, fs = _path(spark, _scratch_root(spark))
    return fs.delete(at, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, col: str = "text") -> int:
    """UTF-8 bytes of all texts: one scan that returns one number."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(F.col(col).cast("string"))), F.lit(0))).first()[0])


def _growth(total: int, most: float) -> float:
    return min(most, max(1.0, math.sqrt(total / STEADY_BYTES)))


def chunks_for(total: int, per: int = CHUNK_BYTES) -> int:
    return max(1, math.ceil(total / (per * _growth(total, MOST_GROWTH))))


def bucket_bits(total: int, per: int = BUCKET_BYTES, least: int = 4) -> int:
    """log2 of the number of hash buckets; it follows the input, so that a bucket's size is bounded."""
    return max(least, math.ceil(math.log2(max(1, total / (per * _growth(total, MOST_GROWTH / 2))))))


def id_and_text(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """``(doc_id, text)``, and with ``carry`` the row as a struct: null ids stay null, null texts become empty."""
    more = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("carry")] if carry else []
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), *more)


def with_chunk(pairs: DataFrame, n_chunks: int) -> DataFrame:
    """Adds ``chunk``: set by the row's id and text, hence the same on every attempt of a task.

    Rows without an id may be many and equal, so their place in the input deals them out as well; such input should be a
    table of files, whose rows have the same places each time.
    """
    place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    return pairs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text", place), F.lit(n_chunks)).cast("int"))


def with_carry(schema: str, docs: DataFrame) -> StructType:
    """The fields of ``schema`` and the rows of ``docs`` as the struct ``carry``, whatever its columns are named."""
    fields = StructType.fromDDL(schema).fields
    return StructType([*fields, StructField("carry", StructType([StructField(f.name, f.dataType) for f in docs.schema.fields]))])
