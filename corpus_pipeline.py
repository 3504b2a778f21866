"""A training-corpus pipeline over ``documents``: five stages, each one operator over all that its predecessor kept.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``.  All stages but the last return the columns of ``documents``; the last adds what the mix decided.

Defined cases, for every stage: rows are judged one by one, so null ids and repeated ids are no reason to go; further columns,
whatever their names, pass unchanged; texts of any length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import toxicity
from siftwell.llm._common import scratch_dir, scratch_scope
from siftwell.llm.decontamination import without_leaks
from siftwell.llm.mixing import mix_by_quality
from siftwell.llm.near_dedup import without_near_duplicates
from siftwell.llm.suffix_dedup import suffix_dedup

#: Bytes of a repeated string that the third stage removes: passages of fifty short words have some 250.
REPEAT_BYTES = 200
REPEAT_ANCHOR = 48


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier, fitted on ``labels``, scores at its threshold or above.

    Null and empty texts get the score of a text without features, which is below it unless nearly all labels are 1; equal
    texts tie, so they stay or go together.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, carry=True)
    return scored.filter(F.col("score") < toxicity.THRESHOLD).select("carry.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked at a similarity of 0.8 on five-word shingles.

    Null ids order last; of rows with one id the one with the smallest hash of all columns stays, of rows equal in all columns
    one; null and empty texts all stay.
    """
    return without_near_duplicates(docs, shingle=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every repeated string of ``REPEAT_BYTES`` out of the texts; documents of which nothing is left go.

    All copies of a repeat are cut, those within one document and in equal rows too; null and empty texts stay as they are.
    """
    got = suffix_dedup(docs, length=REPEAT_BYTES, anchor=REPEAT_ANCHOR, carry=True)
    got = got.filter((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    cut = F.col("n_removed") > 0
    new = {"text": F.when(cut, F.col("kept_text")).otherwise(F.col("carry.text")), "n_chars": F.when(cut, F.char_length("kept_text").cast("long")).otherwise(F.col("carry.n_chars"))}
    return got.select(*[new.get(c, F.col(f"carry.`{c}`")).alias(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold an item of ``benchmark``, items with a null id included; null and empty texts hold none."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix with their number of ``copies``; sources weigh 1, 2, 3, repeating, over all that is left.

    Of the last document drawn of a source ``taken`` says how many words the mix takes, less than its copies hold; all others are
    taken whole.  A null source is a source of its own; ties of keys order by id, size, text and place.  An input column that has the name
    of one of the added columns is replaced by it.
    """
    got = mix_by_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=True).withColumn("copies", F.col("epochs") + F.col("drawn").cast("long"))
    added = ["size", "copies", "taken", "source_size", "target"]
    return got.filter("copies > 0").select(*[F.col(f"carry.`{c}`") for c in docs.columns if c.lower() not in added], *added)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_leaks),
    ("source_mixing", mix),
]

#: No SQL: the first two and the fourth stage are a trained model, a probabilistic join and a latent search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        at = f"{scratch_dir(spark)}/{name}"
        # What a stage wrote for itself goes once its result is written.
        with scratch_scope(spark):
            got = stage(spark, docs, sf_dir)
            got.write.parquet(at)
        docs = spark.read.schema(got.schema).parquet(at)
    return docs
