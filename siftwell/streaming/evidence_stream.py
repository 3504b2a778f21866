"""Evidence over files of captured pages as they arrive: stateless, the same plan as the batch one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.audit import captured_evidence, with_evidence_text

PAGES = "page_id long, url string, html string"


def page_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def evidence_stream(pages: DataFrame, counted: str | None = None) -> DataFrame:
    """With ``counted``, each micro-batch reports its pages and their bytes under that name; see ``StreamCounters``."""
    if counted:
        pages = pages.observe(counted, F.count("*").alias("pages"), F.count("html").alias("with_html"), F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).alias("bytes"))
    return with_evidence_text(captured_evidence(pages))


def write_evidence(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends Parquet, exactly once, until all files that are there have been read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
