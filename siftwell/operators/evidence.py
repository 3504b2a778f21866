"""Evidence: one row per audit from the resources that were fetched for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions.robots import robots_evidence
from ..functions.sitemaps import sitemap_evidence
from ..functions.urls import site_root
from ..schemas import EVIDENCE_FIELDS, ROBOTS, SITEMAP
from .html import parsed
from .links import classify

#: The phrase for what cannot be known, and what that is.
UNVERIFIABLE = "Could not be verified in this audit."
UNVERIFIABLE_FIELDS = (
    "Core Web Vitals (LCP, INP, CLS) — requires Lighthouse or PageSpeed Insights API",
    "Mobile-friendliness score — requires browser rendering",
    "Page speed / TTFB — requires a live performance test",
    "Structured data / JSON-LD schema — may be injected by JavaScript and is invisible in static HTML",
    "Google Search Console data — requires API access",
    "Keyword rankings — requires a rank-tracking tool",
    "Backlinks — requires a link index database (Ahrefs, Semrush, etc.)",
    "Competitor analysis — requires external data sources",
    "Full broken-link crawl — only the homepage links are visible in this audit",
    "HTTP response headers (HSTS, X-Robots-Tag, Cache-Control) — not accessible via static fetch",
    "Hreflang implementation — requires crawling multiple locale pages",
)


def missing_alt(images: Column) -> Column:
    return F.size(F.filter(images, lambda i: ~i["has_alt_attribute"])).cast("int")


def empty_alt(images: Column) -> Column:
    return F.size(F.filter(images, lambda i: i["has_alt_attribute"] & (i["alt"] == ""))).cast("int")


def home_fields(home: DataFrame) -> DataFrame:
    """Evidence of homepages: ``audit_id, base_url`` and all fields but robots, sitemaps and the fixed list.

    ``home``: audit_id, base_url, final_url, status_code, is_success, content.
    """
    content = F.when(F.coalesce("is_success", F.lit(False)), F.col("content")).otherwise(F.lit(""))
    p = home.withColumn("__page", parsed(F.col("base_url"), content))
    page = lambda name: F.col("__page")[name]
    internal, external = classify(page("links"), F.col("base_url"))
    final = F.coalesce(F.when(F.col("final_url") != "", F.col("final_url")), F.col("base_url"))
    length = lambda name: F.coalesce(F.char_length(page(name)), F.lit(0)).cast("int")
    return p.select(
        "audit_id",
        "base_url",
        final.alias("final_url"),
        F.coalesce(F.col("status_code"), F.lit(0)).cast("int").alias("http_status"),
        final.startswith("https://").alias("is_https"),
        page("page_title").alias("page_title"),
        length("page_title").alias("page_title_length"),
        page("meta_description").alias("meta_description"),
        length("meta_description").alias("meta_description_length"),
        page("canonical_url").alias("canonical_url"),
        page("page_language").alias("page_language"),
        page("h1_tags").alias("h1_tags"),
        page("h2_tags").alias("h2_tags"),
        internal.alias("internal_links"),
        external.alias("external_links"),
        page("images").alias("images"),
        missing_alt(page("images")).alias("images_missing_alt_count"),
        empty_alt(page("images")).alias("images_empty_alt_count"),
    )


def _fixed(df: DataFrame) -> DataFrame:
    return df.withColumn("unverifiable_fields", F.array(*[F.lit(x) for x in UNVERIFIABLE_FIELDS])).select("audit_id", *EVIDENCE_FIELDS)


def evidence(resources: DataFrame) -> DataFrame:
    """``audit_id`` and the evidence fields, from the ``RESOURCE`` table.

    Bodies are parsed where they are; only the small results meet, in one aggregation by audit.  The base URL is the
    homepage's requested one.  An audit without a homepage row has the evidence of one that failed, at the root of its site.
    """
    home = home_fields(resources.filter("kind = 'homepage'").withColumn("base_url", F.col("url")))
    names = [c for c in home.columns if c != "audit_id"]
    form = home.select(F.struct(*names).alias("home")).schema["home"].dataType
    blank = {"robots": F.lit(None).cast(ROBOTS), "sitemap": F.lit(None).cast(SITEMAP), "home": F.lit(None).cast(form)}

    def small(rows: DataFrame, seq: Column, root: Column, **given: Column) -> DataFrame:
        return rows.select("audit_id", seq.alias("seq"), root.alias("root"), *[given.get(name, empty).alias(name) for name, empty in blank.items()])

    root = site_root(F.col("url"))
    robots = resources.filter("kind = 'robots'")
    robots = small(robots, F.col("seq"), root, robots=robots_evidence(F.col("content"), F.col("status_code"), F.col("is_success"), F.col("is_fetched")).cast(ROBOTS))
    sitemap = sitemap_evidence(F.col("url"), F.col("content"), F.col("status_code"), F.col("is_success")).cast(SITEMAP)
    sitemaps = small(resources.filter("kind in ('sitemap', 'extra')"), F.col("seq"), root, sitemap=F.when((F.col("kind") == "extra") | F.col("is_fetched"), sitemap))
    whole = small(home, F.lit(0), site_root(F.col("base_url")), home=F.struct(*names)).unionByName(robots).unionByName(sitemaps).groupBy("audit_id")
    got = whole.agg(
        F.first("home", ignorenulls=True).alias("home"),
        F.min_by("root", "seq").alias("root"),
        F.first("robots", ignorenulls=True).alias("robots_txt"),
        F.array_sort(F.collect_list(F.when(F.col("sitemap").isNotNull(), F.struct("seq", "sitemap")))).alias("maps"),
    )
    return _fixed(got.select("audit_id", F.coalesce("home", _failed_home(F.col("root"), form)).alias("home"), "robots_txt", F.transform("maps", lambda m: m["sitemap"]).alias("sitemaps")).select("audit_id", "home.*", "robots_txt", "sitemaps"))


def _failed_home(root: Column, form: StructType) -> Column:
    """The homepage's fields as a failed fetch of ``root`` would have them."""
    known = {"base_url": root, "final_url": root, "is_https": root.startswith("https://")}

    def value(f: StructField) -> Column:
        if f.name in known:
            return known[f.name]
        if isinstance(f.dataType, ArrayType):
            return F.array().cast(f.dataType)
        return F.lit(0).cast(f.dataType) if isinstance(f.dataType, IntegerType) else F.lit(None).cast(f.dataType)

    return F.struct(*[value(f).alias(f.name) for f in form.fields])


def page_evidence(pages: DataFrame) -> DataFrame:
    """Evidence of captured pages alone (``audit_id, base_url, final_url, status_code, is_success, content``): no shuffle."""
    return _fixed(home_fields(pages).withColumn("robots_txt", F.lit(None).cast(ROBOTS)).withColumn("sitemaps", F.array().cast(f"array<{SITEMAP}>")))
