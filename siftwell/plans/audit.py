"""The audit as one chain of transformations: URLs, captures, evidence, text, report.

Errors stay data: an invalid URL goes to the rejects, a failed fetch or report is columns of its row, and nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.urls import authority, normalize_url
from ..operators.evidence import evidence, page_evidence
from ..operators.render import evidence_text, user_message
from ..sources.captures import Getter, fetch, further_sitemaps, http_get, planned_requests
from ..sources.guidance import Guidance
from ..sources.providers import Provider, provider_of
from ..sources.reports import with_pdf
from .counters import RunCounters, fetch_metrics, reject_metrics

#: Bounds of a request's URL in characters.
SHORTEST_URL, LONGEST_URL = 3, 2048


def audit_id(url: Column, snapshot: str) -> Column:
    """The same id for the same URL and snapshot on every attempt of a task."""
    return F.sha2(F.concat_ws("|", url, F.lit(snapshot)), 256)


def checked_urls(requests: DataFrame, url: str = "url") -> DataFrame:
    """Adds the validation fields; ``http_error`` is 422 for a bad length, 400 for an invalid URL, else null."""
    n = F.char_length(F.col(url))
    body_ok = F.coalesce(n.between(SHORTEST_URL, LONGEST_URL), F.lit(False))
    out = requests.withColumn("__check", normalize_url(F.col(url))).select(*requests.columns, "__check.*")
    return out.withColumn("http_error", F.when(~body_ok, 422).when(~F.col("is_valid"), 400))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter("http_error is null")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter("http_error is not null")


def captured_evidence(pages: DataFrame, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """Evidence of captured pages: each row is one successful fetch of its normalised URL."""
    rows = pages.select(F.col(key).cast("string").alias("audit_id"), normalize_url(F.col(url)).alias("u"), F.col(html).alias("content"))
    home = rows.filter("u.is_valid").select("audit_id", F.col("u.normalized_url").alias("base_url"), F.lit("").alias("final_url"), F.lit(200).alias("status_code"), F.lit(True).alias("is_success"), "content")
    return page_evidence(home)


def with_evidence_text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("evidence_text", evidence_text(F.col("base_url")))



def template_report(system: str, message: str, evidence: str) -> str:
    """The default provider: the evidence under fixed headings, the same for the same input."""
    title = evidence.split("\n", 1)[0].removeprefix("## Verified Audit Evidence for ").strip()
    body = evidence.split("\n", 1)[1].strip() if "\n" in evidence else ""
    return f"# SEO Audit Report\n\n**Website:** {title}\n\n---\n\n{body}\n"


def _without_key(system: str, message: str, evidence: str) -> str:
    raise ValueError(MISSING_KEY)


#: The error of all rows if a hosted provider is to be asked without a key; the API answers 500 for it.
MISSING_KEY = "No key for the report provider is configured: set LLM_API_KEY in the environment or the .env file."


def with_reports(texts: DataFrame, guidance: Guidance | None = None, provider: Provider = template_report, snapshot: str = "", settings: Settings | None = None) -> DataFrame:
    """Reports for ``base_url, evidence_text``: ``audit_id, url, markdown_report, created_at, report_error``.

    A provider may call out, so write the result before using it twice.  A row it fails for keeps its error (502 at the API).
    With ``settings``, the template gives way to the provider of the model they name, and a provider other than the template
    needs their key; without it none is called and every row has ``MISSING_KEY``.
    """
    if settings is not None and provider is template_report:
        provider = provider_of(settings, template_report)
    if settings is not None and provider is not template_report and not settings.llm_api_key:
        provider = _without_key
    system = guidance.system_prompt_column(F.col("base_url")) if guidance else F.lit("")
    rows = texts.select(audit_id(F.col("base_url"), snapshot).alias("audit_id"), F.col("base_url").alias("url"), system.alias("system"), user_message(F.col("base_url"), F.col("evidence_text")).alias("message"), "evidence_text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            reports, errors = [], []
            for s, m, e in zip(b["system"], b["message"], b["evidence_text"], strict=True):
                try:
                    text = provider(s, m, e)
                    if not text or not text.strip():
                        raise RuntimeError("the provider returned no text")
                    reports.append(text)
                    errors.append(None)
                except Exception as x:  # noqa: BLE001  any failure of a provider is that row's error
                    reports.append(None)
                    errors.append(str(x))
            yield pd.DataFrame({"audit_id": b["audit_id"], "url": b["url"], "markdown_report": reports, "report_error": errors})

    out = rows.mapInPandas(run, "audit_id string, url string, markdown_report string, report_error string")
    return out.withColumn("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")).select("audit_id", "url", "markdown_report", "created_at", "report_error")


def results(reports: DataFrame) -> DataFrame:
    """What the API answers per audit, from ``with_reports`` and ``with_pdf``: 202 with the report, 500 without a key, or 502 and the error.

    A report whose PDF failed is still a result; its download URL is empty.
    """
    failed = F.col("report_error").isNotNull()
    return reports.select(
        "audit_id",
        "url",
        F.when(F.col("report_error") == MISSING_KEY, 500).when(failed, 502).otherwise(202).alias("http_status"),
        "markdown_report",
        F.when(failed, F.lit("")).otherwise(F.col("pdf_download_url")).alias("pdf_download_url"),
        "created_at",
        F.col("report_error").alias("detail"),
    )


def fetch_failures(resources: DataFrame) -> DataFrame:
    """What the API answers, in the columns of ``results``, for audits whose homepage request raised: 502 and the error.

    A homepage that was answered, with whatever status, is none of them: its audit goes on with what there is.
    """
    failed = resources.filter("kind = 'homepage' and not is_fetched")
    detail = F.concat(F.lit("Could not fetch the website: "), F.col("error_message"), F.lit(". Please check the URL and try again."))
    return failed.select("audit_id", "url", F.lit(502).alias("http_status"), F.lit(None).cast("string").alias("markdown_report"), F.lit("").alias("pdf_download_url"), F.lit(None).cast("string").alias("created_at"), detail.alias("detail"))


def audit_sites(requests: DataFrame, path: str, settings: Settings, get: Getter = http_get, guidance: Guidance | None = None, provider: Provider = template_report, snapshot: str = "", counters: RunCounters | None = None) -> dict[str, DataFrame]:
    """The whole chain for raw URLs (column ``url``): ``rejects, resources, evidence, reports`` and ``results``.

    Audits whose homepage request raised have no evidence and no report, but a result.

    What calls out, requests and the provider, is written below ``path`` before anything reads it, so that neither a retried
    task nor a second use of the result calls twice for what is there.

    ``counters`` fills with the writes: requests and rejects by code under ``requests``, resources asked for and retrieved under
    ``resources``, reports made and failed under ``reports``.
    """
    spark = requests.sparkSession
    counted = counters.watch if counters else lambda name, df, metrics: df

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    checked = checked_urls(requests)
    audits = accepted(counted("requests", checked, reject_metrics())).select(audit_id(F.col("normalized_url"), snapshot).alias("audit_id"), F.col("normalized_url").alias("url")).dropDuplicates(["audit_id"])
    first = kept(counted("resources", fetch(planned_requests(audits), settings, get), fetch_metrics()), "first")
    resources = first.unionByName(kept(counted("resources", fetch(further_sitemaps(first), settings, get), fetch_metrics()), "further"))
    failures = fetch_failures(resources)
    found = kept(evidence(resources).join(failures, "audit_id", "left_anti"), "evidence")
    made = with_reports(with_evidence_text(found).select("base_url", "evidence_text"), guidance, provider, snapshot, settings)
    reports = kept(counted("reports", made, {"made": F.count("markdown_report"), "failed": F.count("report_error")}), "reports")
    return {"rejects": rejected(checked), "resources": resources, "evidence": found, "reports": reports, "results": results(with_pdf(reports)).unionByName(failures)}


def host_rollup(rows: DataFrame) -> DataFrame:
    """Per host: pages, those without title, description, canonical or first heading, and images without alternative text."""
    missing = lambda c: F.count_if(F.col(c).isNull())
    return rows.groupBy(authority(F.col("base_url")).alias("host")).agg(
        F.count("*").alias("n_pages"),
        missing("page_title").alias("n_no_title"),
        missing("meta_description").alias("n_no_description"),
        missing("canonical_url").alias("n_no_canonical"),
        F.count_if(F.size("h1_tags") == 0).alias("n_no_h1"),
        F.sum(F.size("internal_links")).alias("n_internal_links"),
        F.sum("images_missing_alt_count").cast("long").alias("n_images_missing_alt"),
    )
