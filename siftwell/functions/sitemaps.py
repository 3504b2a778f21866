"""Sitemap XML: how many URL entries it has."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def loc_count(content: Column) -> Column:
    """Number of ``<loc>`` elements, outside comments and CDATA; prefixed ones such as ``image:loc`` don't count."""
    bare = F.regexp_replace(F.coalesce(content, F.lit("")), r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>", "")
    return F.regexp_count(bare, F.lit(r"<loc[\s>/]")).cast("int")


def sitemap_evidence(url: Column, content: Column, status: Column, is_success: Column) -> Column:
    ok = F.coalesce(is_success, F.lit(False))
    return F.struct(url.alias("url"), ok.alias("is_accessible"), status.cast("int").alias("http_status"), F.when(ok, loc_count(content)).otherwise(F.lit(0)).alias("url_count"))
