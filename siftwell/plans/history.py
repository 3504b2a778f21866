"""Audits of one site over time: what changed between two snapshots, and which audit came before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

ADDED, REMOVED, CHANGED = "added", "removed", "changed"
#: What is compared of an evidence row unless the caller says so.
EVIDENCE = (
    "final_url", "http_status", "page_title", "meta_description", "canonical_url", "page_language", "h1_tags", "h2_tags", "internal_links", "external_links",
    "images_missing_alt_count", "images_empty_alt_count", "robots_txt", "sitemaps",
)


def _as_text(df: DataFrame, name: str) -> Column:
    """A value as text: nested ones as JSON, null as null."""
    nested = isinstance(df.schema[name].dataType, (ArrayType, StructType, MapType))
    return F.to_json(F.col(f"`{name}`")) if nested else F.col(f"`{name}`").cast("string")


def changes(before: DataFrame, after: DataFrame, key: str = "base_url", fields: tuple[str, ...] = EVIDENCE) -> DataFrame:
    """``key, change, field, old_value, new_value``: one row per field that differs between two snapshots.

    A row that only one snapshot has is one row without a field, ``added`` or ``removed``.  Keys are matched null-safely and
    should be unique in a snapshot; null to null is no change.  Arrays are compared whole and in order, as JSON.

    Each side is reduced to its key and one array of the fields as texts before the one exchange, and rows whose arrays are equal go
    no further than the join.
    """
    side = lambda df, name: df.select(F.col(f"`{key}`").alias(f"{name}_key"), F.array(*[_as_text(df, f) for f in fields]).alias(name))
    both = side(before, "old").join(side(after, "new"), F.col("old_key").eqNullSafe(F.col("new_key")), "full_outer")
    one = lambda change, field, old, new: F.struct(F.lit(change).alias("change"), field.cast("string").alias("field"), old.cast("string").alias("old_value"), new.cast("string").alias("new_value"))
    none, names = F.lit(None), F.array(*[F.lit(f) for f in fields])
    differs = F.filter(F.arrays_zip(names.alias("field"), F.col("old").alias("old"), F.col("new").alias("new")), lambda x: ~x["old"].eqNullSafe(x["new"]))
    rows = F.when(F.col("old").isNull(), F.array(one(ADDED, none, none, none))).when(F.col("new").isNull(), F.array(one(REMOVED, none, none, none)))
    rows = rows.otherwise(F.transform(differs, lambda x: one(CHANGED, x["field"], x["old"], x["new"])))
    found = both.filter(~F.col("old").eqNullSafe(F.col("new")))
    return found.select(F.when(F.col("old").isNull(), F.col("new_key")).otherwise(F.col("old_key")).alias(key), F.explode(rows).alias("c")).select(key, "c.*")


def audit_before(audits: DataFrame, at: DataFrame, url: str = "url", time: str = "created_at", keep: tuple[str, ...] = ("audit_id",), span: str = "month") -> DataFrame:
    """For each row of ``at``, the columns ``keep`` and ``time`` of the last audit of its URL strictly before it, as ``before_*``.

    Rows and audits meet in one exchange by URL and span of time, so a URL that is audited again and again is split; what the
    spans before held last is carried over by a window over one row per URL and span.  Of audits at the same moment the one
    with the largest kept columns counts.  A null URL or time has no audit before.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in keep])
    row = at.select(F.struct("*").alias("row")).schema["row"].dataType
    own = F.struct(F.col(f"`{time}`").cast("timestamp").alias("time"), kept.alias("kept"))
    line = lambda df, order, own, row: df.select(F.col(f"`{url}`").alias("url"), F.col(f"`{time}`").cast("timestamp").alias("time"), F.lit(order).alias("order"), own.alias("own"), row.alias("row")).withColumn("span", F.date_trunc(span, "time"))
    known = line(audits, 1, own, F.lit(None).cast(row)).filter("url is not null and time is not null")
    asked = line(at, 0, F.lit(None).cast(known.schema["own"].dataType), F.struct("*"))
    # Within a span, audits sort after what is asked at the same moment: only earlier ones precede it.
    before = Window.partitionBy("url", "span").orderBy("time", "order").rowsBetween(Window.unboundedPreceding, -1)
    met = known.unionByName(asked.filter("url is not null and time is not null")).withColumn("within", F.max("own").over(before)).filter("row is not null")
    earlier = Window.partitionBy("url").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    last = known.select("url", "span", "own").unionByName(met.select("url", "span", F.lit(None).cast(known.schema["own"].dataType).alias("own"))).groupBy("url", "span").agg(F.max("own").alias("own"))
    carried = last.select("url", "span", F.max("own").over(earlier).alias("carried"))
    got = met.join(carried, ["url", "span"], "left").select("row", F.coalesce("within", "carried").alias("b"))
    got = got.unionByName(asked.filter("url is null or time is null").select("row", F.col("own").alias("b")))
    return got.select("row.*", F.col("b.time").alias(f"before_{time}"), *[F.col("b.kept")[c].alias(f"before_{c}") for c in keep])
