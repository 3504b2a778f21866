"""Joins and ranks whose hot keys are split, and rows that are dealt to tasks before much is made of them."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys that are split at most (the most frequent ones), rows from which a key is hot, and parts of a hot key.
MOST_HOT, HOT_ROWS, PARTS = 1000, 100_000, 32
#: Rows of a task that makes and parses a page of each.
DEALT_ROWS = 2000


def dealt(rows: DataFrame, key: str, most: int = DEALT_ROWS) -> DataFrame:
    """``rows`` by their unique ``key`` in tasks of about ``most``, and no fewer than there are cores.

    A file of many small rows is one task; where a page is made of each row and parsed, that task would be the whole job.  Deal
    narrow rows, before their texts are built.  Counting them reads no column.
    """
    n = rows.count()
    return rows.repartition(max(1, min(n, rows.sparkSession.sparkContext.defaultParallelism), ceil(n / most)), key)


def hot_keys(rows: DataFrame, on: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The keys of ``rows`` to be split, ``MOST_HOT`` at most."""
    return rows.groupBy(on).agg(F.count("*").alias("__n")).filter((F.col("__n") > hot_rows) & F.col(on).isNotNull()).orderBy(F.desc("__n"), on).limit(MOST_HOT).select(on, F.lit(True).alias("__hot"))


def salted_join(left: DataFrame, right: DataFrame, on: str, how: str = "left", hot_rows: int = HOT_ROWS, parts: int = PARTS, hot: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right``, whose ``on`` is unique: rows of hot keys of ``left`` are dealt to ``parts`` tasks by their content.

    ``left`` is read twice, for its hot keys first: it should be a written table, and where it is joined again and again its
    ``hot_keys`` a written one too, given as ``hot``.  They are ``MOST_HOT`` rows at most, which are broadcast; ``right`` is copied
    for them only.  ``how`` is inner, left, left_semi or left_anti.
    """
    hot = hot_keys(left, on, hot_rows) if hot is None else hot
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*left.columns), F.lit(parts))).otherwise(F.lit(0))
    dealt = left.join(F.broadcast(hot), on, "left").withColumn("__salt", salt.cast("int")).drop("__hot")
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    copied = right.join(F.broadcast(hot), on, "left").withColumn("__salt", F.explode(copies)).drop("__hot")
    return dealt.join(copied, [on, "__salt"], how).drop("__salt")


def first_of(rows: DataFrame, key: str, order: list[Column], most: Column, largest: int, parts: int = PARTS) -> DataFrame:
    """The first ``most`` rows (a column that is one value per key, ``largest`` at most) of each key, with their ``rank``.

    Parts of a key are ranked first and keep ``largest`` rows each, so no task ever orders a hot key whole.
    """
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(parts))
    some = rows.withColumn("__part", part).withColumn("__r", F.row_number().over(Window.partitionBy(key, "__part").orderBy(*order))).filter(F.col("__r") <= largest)
    return some.drop("__part", "__r").withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= most)
