"""The documented scoring tables as expressions: category weights, bands, grades, severities and priorities.

Only what the documentation gives numbers for is here; weights of single checks it leaves open, and no number is made up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
CATEGORY_WEIGHTS = {"Technical SEO": 40, "On-Page SEO": 25, "Content Quality": 15, "Performance": 10, "Accessibility": 5, "Security": 5}
BANDS = ((90, "Green", "Excellent"), (80, "Light Green", "Good"), (70, "Yellow", "Needs Improvement"), (60, "Orange", "Poor"), (0, "Red", "Critical"))
GRADES = ((95, "A+"), (90, "A"), (80, "B"), (70, "C"), (60, "D"), (0, "F"))
#: Severity: share of an issue's largest deduction, priority, and when to act.
SEVERITIES = {
    "Critical": (1.0, 1, "Fix Immediately"),
    "High": (0.75, 2, "Fix This Week"),
    "Medium": (0.4, 3, "Fix This Month"),
    "Low": (0.15, 4, "Future Optimisation"),
    "Information": (0.0, 5, "Monitor Only"),
}


def _step(score: Column, table, pick) -> Column:
    out = F.when(score >= table[0][0], F.lit(pick(table[0])))
    for row in table[1:-1]:
        out = out.when(score >= row[0], F.lit(pick(row)))
    return out.when(score.isNotNull(), F.lit(pick(table[-1])))


def status_band(score: Column) -> Column:
    return _step(score, BANDS, lambda r: r[2])


def band_colour(score: Column) -> Column:
    return _step(score, BANDS, lambda r: r[1])


def grade(score: Column) -> Column:
    return _step(score, GRADES, lambda r: r[1])


def _lookup(key: Column, table: dict, pick) -> Column:
    out = F.lit(None)
    for k, v in table.items():
        out = F.when(key == k, F.lit(pick(v))).otherwise(out)
    return out


def severity_multiplier(severity: Column) -> Column:
    return _lookup(severity, SEVERITIES, lambda v: v[0])


def priority(severity: Column) -> Column:
    return _lookup(severity, SEVERITIES, lambda v: v[1])


def deadline(severity: Column) -> Column:
    return _lookup(severity, SEVERITIES, lambda v: v[2])


def overall_score(scores: DataFrame, key: str, category: str, score: str) -> DataFrame:
    """``key, overall_score``: category scores (0 to 100) weighted; categories without a weight count nothing."""
    weight = F.coalesce(_lookup(F.col(category), CATEGORY_WEIGHTS, float), F.lit(0.0))
    return scores.groupBy(key).agg((F.sum(F.col(score) * weight) / 100).alias("overall_score"))


def severity_counts(findings: DataFrame, key: str, severity: str = "severity") -> DataFrame:
    """Findings of each severity per audit, as columns ``n_critical`` to ``n_information``."""
    return findings.groupBy(key).agg(*[F.count_if(F.col(severity) == s).alias(f"n_{s.lower()}") for s in SEVERITIES])


def top_findings(findings: DataFrame, key: str, order: list[str], n: int = 5, severity: str = "severity") -> DataFrame:
    """The ``n`` most urgent findings of each audit, by priority and then ``order``, with their ``rank``."""
    by = Window.partitionBy(key).orderBy(priority(F.col(severity)).asc_nulls_last(), *order)
    return findings.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= n)
