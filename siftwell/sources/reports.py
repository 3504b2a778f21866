"""Report tables: write, look up by id, and PDF files.

Ids are data, never paths: a lookup is a filter that Parquet pushes down, on a table that is partitioned by the id's prefix.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pdf import render_pdf
from ..schemas import REPORT


def prefix(audit_id: Column) -> Column:
    return F.substring(F.sha2(audit_id, 256), 1, 2)


def write_reports(reports: DataFrame, path: str, mode: str = "append") -> None:
    """One row per audit, in files by id prefix, ordered by id for row-group pruning."""
    rows = reports.select(*[f.split()[0] for f in REPORT.split(", ")]).withColumn("id_prefix", prefix(F.col("audit_id")))
    rows.repartition("id_prefix").sortWithinPartitions("id_prefix", "audit_id").write.mode(mode).partitionBy("id_prefix").parquet(path)


def write_reports_json(reports: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines with the keys of the report record, non-ASCII characters kept."""
    reports.select(*[f.split()[0] for f in REPORT.split(", ")]).write.mode(mode).json(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_reports_json(spark: SparkSession, path: str) -> DataFrame:
    """Rows that aren't whole records are left out, as if they were missing."""
    return spark.read.schema(REPORT).option("mode", "DROPMALFORMED").json(path).filter("audit_id is not null")


def find_report(reports: DataFrame, audit_id: str) -> DataFrame:
    """No row if the id is unknown.  Prunes to one prefix where the table has them."""
    if "id_prefix" in reports.columns:
        reports = reports.filter(F.col("id_prefix") == prefix(F.lit(audit_id)))
    return reports.filter(F.col("audit_id") == audit_id).withColumn("pdf_download_url", pdf_url(F.col("audit_id"), F.lit(True))).drop("id_prefix")


def lookups(reports: DataFrame, wanted: DataFrame, pdfs: DataFrame | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """What the API answers for each row of ``wanted`` (``audit_id``): 200 with the report, or 404 and its detail.

    A report's download URL is always given.  With ``pdfs`` (``audit_id``), ``pdf_status`` and ``pdf_detail`` say what a download
    answers.  Ids are compared as they are; a null id is unknown.  A row has one answer: of several reports of one id the
    smallest by URL and text.  ``also`` names further columns of all three tables that tell audits of one id apart.
    """
    keys = ["audit_id", *also]
    found = reports.groupBy(*keys).agg(F.min(F.struct("url", "markdown_report")).alias("r")).select(*keys, "r.*", F.lit(True).alias("__known"))
    out = wanted.select(*keys).join(found, keys, "left")
    known, no = F.col("__known").isNotNull(), lambda before, after: F.concat(F.lit(before), F.coalesce("audit_id", F.lit("null")), F.lit(after))
    out = out.withColumns({
        "http_status": F.when(known, 200).otherwise(404), "pdf_download_url": F.when(known, pdf_url(F.col("audit_id"), F.lit(True))),
        "detail": F.when(~known, no("Audit not found: ", ". Run a new audit to generate a report.")),
    }).drop("__known")
    if pdfs is None:
        return out
    there = out.join(pdfs.select(*keys, F.lit(True).alias("__pdf")).distinct(), keys, "left")
    has = F.col("__pdf").isNotNull()
    return there.withColumns({"pdf_status": F.when(has, 200).otherwise(404), "pdf_detail": F.when(~has, no("PDF not found for audit: ", ". Run the audit again to regenerate."))}).drop("__pdf")


def pdf_url(audit_id: Column, written: Column) -> Column:
    """Where a report's PDF is served; empty where none was written."""
    return F.when(written, F.concat(F.lit("/api/v1/audits/"), audit_id, F.lit("/pdf"))).otherwise("")


def pdf_name(audit_id: Column) -> Column:
    return F.concat(F.lit("seo-audit-"), F.substring(audit_id, 1, 8), F.lit(".pdf"))


def write_pdfs(reports: DataFrame, path: str, mode: str = "append") -> None:
    """The files of ``with_pdf`` as rows, ``audit_id, name, pdf``, laid out like the reports; audits without one have none."""
    rows = reports.filter("pdf is not null").select("audit_id", pdf_name(F.col("audit_id")).alias("name"), "pdf", prefix(F.col("audit_id")).alias("id_prefix"))
    rows.repartition("id_prefix").sortWithinPartitions("id_prefix", "audit_id").write.mode(mode).partitionBy("id_prefix").parquet(path)


def find_pdf(spark: SparkSession, path: str, audit_id: str) -> DataFrame:
    """``audit_id, name, pdf`` of one audit; no row if its id is unknown or it has no file.  Reads one prefix."""
    return spark.read.parquet(path).filter((F.col("id_prefix") == prefix(F.lit(audit_id))) & (F.col("audit_id") == audit_id)).drop("id_prefix")


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)


def with_pdf(reports: DataFrame) -> DataFrame:
    """Adds ``pdf`` (null where rendering failed, which fails no audit) and its download URL."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for url, created, markdown in batches:
            out = []
            for u, c, m in zip(url, created, markdown, strict=True):
                try:
                    out.append(render_pdf(u or "", pd.Timestamp(c).strftime("%d %B %Y at %H:%M UTC"), m))
                except Exception:  # noqa: BLE001  a report without a PDF is still a report
                    out.append(None)
            yield pd.Series(out)

    udf = F.pandas_udf(run, "binary")
    return reports.withColumn("pdf", udf("url", "created_at", "markdown_report")).withColumn("pdf_download_url", pdf_url(F.col("audit_id"), F.col("pdf").isNotNull()))
