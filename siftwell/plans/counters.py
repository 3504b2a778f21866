"""Counters of a run that arrive with its writes: observed metrics, no job of their own.

A batch writes an observed table and then has the numbers; a stream reports them with each micro-batch to a listener.  Numbers
count what successful tasks saw; a stage that is run again after a lost executor may count rows twice.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Codes of rejected requests, in the order in which rules are tried.
REJECT_CODES = ("empty", "too_short", "scheme_not_allowed", "no_domain", "invalid_domain", "length")


def reject_metrics() -> dict[str, Column]:
    """Counts over ``checked_urls``: requests, and rejects by code; ``length`` are bodies of a bad length whose URL is valid."""
    code = F.when(F.col("http_error").isNotNull(), F.when(F.col("is_valid"), "length").otherwise(F.col("error_code")))
    return {"requests": F.count("*")} | {f"rejected_{c}": F.count_if(code == c) for c in REJECT_CODES}


def fetch_metrics() -> dict[str, Column]:
    """Counts over the ``RESOURCE`` table: asked for, retrieved (answered with success), and not answered at all, by kind too."""
    kinds = ("homepage", "robots", "sitemap", "extra")
    ok = F.coalesce(F.col("is_success"), F.lit(False))
    every = {"asked": F.count("*"), "retrieved": F.count_if(ok), "raised": F.count_if(~F.coalesce(F.col("is_fetched"), F.lit(False))), "bytes": F.coalesce(F.sum(F.octet_length("content")), F.lit(0))}
    return every | {f"{name}_{k}": F.count_if((F.col("kind") == k) & more) for k in kinds for name, more in (("asked", F.lit(True)), ("retrieved", ok))}


class RunCounters:
    """Observed tables of one run, by name; ``get`` waits for the writes they are part of."""

    def __init__(self):
        self._seen: list[tuple[str, Observation]] = []

    def watch(self, name: str, df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
        seen = Observation()
        self._seen.append((name, seen))
        return df.observe(seen, *[c.alias(m) for m, c in metrics.items()])

    def get(self) -> dict[tuple[str, str], int]:
        """``(name, metric)`` to number; tables observed under one name add up."""
        total: Counter = Counter()
        for name, seen in self._seen:
            for metric, n in seen.get.items():
                total[name, metric] += n
        return dict(total)

    def table(self, spark: SparkSession) -> DataFrame:
        """The counters as rows ``name, metric, n``."""
        return spark.createDataFrame([(name, metric, n) for (name, metric), n in self.get().items()], "name string, metric string, n long")


class StreamCounters(StreamingQueryListener):
    """Adds up a stream's observed metrics over its micro-batches: ``spark.streams.addListener(StreamCounters("evidence"))``."""

    def __init__(self, name: str):
        self.name, self.total, self.batches = name, Counter(), 0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        row = event.progress.observedMetrics.get(self.name)
        if row is not None and event.progress.numInputRows:
            self.batches += 1
            self.total.update({k: v for k, v in row.asDict().items() if isinstance(v, int)})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
