"""Structured data of pages: JSON-LD blocks as VARIANT values, their items, types and missing fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html import parsed

#: The fields that an item of a type is expected to have; a parameter of ``structured_items``.
REQUIRED = {
    "Article": ("headline",),
    "BreadcrumbList": ("itemListElement",),
    "Event": ("name", "startDate", "location"),
    "FAQPage": ("mainEntity",),
    "LocalBusiness": ("name", "address"),
    "Organization": ("name", "url"),
    "Product": ("name",),
    "Recipe": ("name", "image"),
    "WebSite": ("name", "url"),
}


def json_ld(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with the array ``json_ld``, the texts of the page's JSON-LD scripts, from the one parse."""
    return pages.withColumn("json_ld", parsed(F.col(url), F.col(html))["json_ld"])


def structured_items(blocks: DataFrame, key: str, required: dict[str, tuple[str, ...]] = REQUIRED) -> DataFrame:
    """``key, block, item, type, missing, malformed``: a row per item and type of each JSON-LD block of ``key, json_ld``.

    Items are the block itself, the elements of an array and those of a ``@graph``; an item of several types has a row for each,
    one without a type a row with null.  ``missing`` lists the required fields of the type that are absent or null, in order.
    A block that is no JSON (one that is never closed among them), or neither object nor array, is one row that is
    ``malformed``; an empty array is one row without an item.  The table is not shuffled.
    """
    v = blocks.select(key, F.posexplode("json_ld").alias("block", "text")).select(key, "block", F.try_parse_json("text").alias("v"))
    kind = F.schema_of_variant("v")
    graph = F.try_variant_get("v", '$["@graph"]', "array<variant>")
    listed = F.try_variant_get("v", "$", "array<variant>")
    items = F.when(kind.startswith("ARRAY"), listed).when(graph.isNotNull(), graph).when(kind.startswith("OBJECT"), F.array("v"))
    found = v.select(key, "block", F.posexplode_outer(items).alias("item", "x"), items.isNull().alias("malformed"))
    types = F.coalesce(F.try_variant_get("x", '$["@type"]', "array<string>"), F.array(F.try_variant_get("x", '$["@type"]', "string")))
    named = found.select(key, "block", "item", "x", "malformed", F.explode(types).alias("type"))
    fields = lambda names: F.filter(F.array(*[F.when(F.coalesce(F.try_variant_get("x", f'$["{n}"]', "string"), F.try_variant_get("x", f'$["{n}"]', "variant").cast("string")).isNull(), F.lit(n)) for n in names]), lambda n: n.isNotNull())
    missing = F.array().cast("array<string>")
    for name, needs in required.items():
        missing = F.when(F.col("type") == name, fields(needs)).otherwise(missing)
    return named.select(key, "block", "item", "type", missing.alias("missing"), "malformed")
