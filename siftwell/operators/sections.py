"""The twelve sections of a report, from evidence, issue records and the plan, as native expressions.

Every section is there, in order; one that has nothing to say says so.  Scores of single checks are documented nowhere, so the
overall score is reported as not verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.action_plan import action_plan, effort_minutes, plan_markdown
from . import scoring
from .evidence import UNVERIFIABLE
from .findings import CHECKS, check_statuses, findings

#: The sections' names, in the documented order; the longest summary in words; how many priorities a summary names.
SECTIONS = (
    "Cover Page", "Executive Summary", "Website Overview", "Overall SEO Score", "Priority Matrix", "Detailed Audit",
    "AI Recommendations", "30-Day Action Plan", "Developer Tasks", "Business Summary", "Appendix", "Report Metadata",
)
SUMMARY_WORDS, TOP = 400, 5
NOTHING = "Nothing to report in this section."
#: Categories whose issues are tasks for developers, and minutes up to which a task is called easy or of medium difficulty.
DEVELOPERS = ("Technical SEO", "Performance", "Security")
EASY, MEDIUM = 30, 240


def issue_counts(issues: DataFrame, key: str) -> DataFrame:
    """``key, n_issues, by_severity, by_category`` (maps) from one aggregation over three groupings."""
    sets = issues.groupingSets([[key, "severity"], [key, "category"], [key]], key, "severity", "category").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    entries = lambda g, name: F.map_from_entries(F.collect_list(F.when(F.col("g") == g, F.struct(name, "n"))))
    whole = sets.groupBy(key).agg(F.max(F.when(F.col("g") == 3, F.col("n"))).alias("n_issues"), entries(1, "severity").alias("by_severity"), entries(2, "category").alias("by_category"))
    return whole


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def within_words(sentences: Column, most: int = SUMMARY_WORDS) -> Column:
    """The first sentences that make up to ``most`` words together, joined by spaces; a sentence is kept whole or not at all."""
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("open"), F.array().cast("array<string>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        n = s["n"] + n_words(x)
        fits = s["open"] & (n <= most)
        return F.struct(F.when(fits, n).otherwise(s["n"]).alias("n"), fits.alias("open"), F.when(fits, F.concat(s["kept"], F.array(x))).otherwise(s["kept"]).alias("kept"))

    return F.aggregate(F.filter(sentences, lambda x: F.coalesce(x, F.lit("")) != ""), start, step, lambda s: F.array_join(s["kept"], " "))


def _listed(issues: Column, line) -> Column:
    return F.array_join(F.transform(issues, line), "\n")


def _recommendation(i: Column) -> Column:
    """The names of a recommendation's parts, and their order."""
    minutes = effort_minutes(i["estimated_effort"])
    difficulty = F.when(minutes <= EASY, "Easy").when(minutes <= MEDIUM, "Medium").otherwise("Hard")
    parts = {
        "Issue": i["issue"], "Business Impact": i["business_impact"], "Why It Matters": i["why_it_matters"], "Recommended Fix": i["recommendation"],
        "Implementation Difficulty": difficulty, "Estimated Time": i["estimated_effort"], "Expected SEO Benefit": F.concat(F.lit("Ends this: "), i["business_impact"]),
    }
    return F.array_join(F.array(*[F.concat(F.lit(f"- {name}: "), value) for name, value in parts.items()]), "\n")


def _summary(url: Column) -> Column:
    issues, n = F.col("issues"), lambda s: F.coalesce(F.try_element_at("by_severity", F.lit(s)), F.lit(0)).cast("string")
    some = lambda given, text: F.when(F.size(given) > 0, text)
    top = F.slice(issues, 1, TOP)
    ok = F.filter("checks", lambda c: c["status"] == "Pass")
    return F.array(
        F.concat(F.lit("The audit of "), url, F.lit(" found "), F.col("n_issues").cast("string"), F.lit(" issues, "), n("Critical"), F.lit(" of them critical and "), n("High"), F.lit(" of high severity.")),
        some(ok, F.concat(F.lit("Checks that hold: "), F.array_join(F.array_distinct(F.transform(ok, lambda c: c["check"])), ", "), F.lit("."))),
        some(issues, F.concat(F.lit("Weaknesses: "), F.array_join(F.transform(issues, lambda i: i["issue"]), ", "), F.lit("."))),
        some(issues, F.concat(F.lit("Business risks: "), F.array_join(F.array_distinct(F.transform(top, lambda i: i["business_impact"])), "; "), F.lit("."))),
        some(issues, F.concat(F.lit("Do first: "), F.array_join(F.transform(top, lambda i: i["recommendation"]), "; "), F.lit("."))),
        F.when(F.size(issues) > 0, "Fix these in the order of the plan and audit the site again.").otherwise("Keep the site as it is and audit it again when it changes."),
    )


def report_sections(rows: DataFrame, key: str = "audit_id", version: str = "1.0", summary_words: int = SUMMARY_WORDS) -> DataFrame:
    """``key, seq, title, body``: twelve rows per evidence row, the same for the same evidence."""
    found = findings(rows, key)
    order = F.struct("priority", "issue", "category", F.struct("*").alias("row"))
    issues = found.groupBy(key).agg(F.array_sort(F.collect_list(order)).alias("sorted")).select(key, F.transform("sorted", lambda x: x["row"]).alias("issues"))
    checks = check_statuses(rows, key)
    names = list(CHECKS)
    ranked = F.struct(F.array_position(F.array(*[F.lit(n) for n in names]), F.col("category")).alias("c"), "seq", "category", "check", "status")
    checks = checks.groupBy(key).agg(F.array_sort(F.collect_list(ranked)).alias("checks"))
    plan = plan_markdown(action_plan(found, key), key)
    whole = rows.join(issues, key, "left").join(issue_counts(found, key), key, "left").join(checks, key, "left").join(plan, key, "left")
    whole = whole.withColumns({"n_issues": F.coalesce("n_issues", F.lit(0)), "issues": F.coalesce("issues", F.array().cast(issues.schema["issues"].dataType))})
    url, said = F.col("base_url"), lambda c: F.coalesce(F.col(c).cast("string"), F.lit("not given"))
    lines = lambda *parts: F.concat_ws("\n", *parts)
    overview = lines(*[F.concat(F.lit(f"- {name}: "), value) for name, value in {
        "Final URL": said("final_url"), "HTTP status": said("http_status"), "Title": said("page_title"), "Description": said("meta_description"), "Language": said("page_language"),
        "Internal links": F.size("internal_links").cast("string"), "External links": F.size("external_links").cast("string"), "Images": F.size("images").cast("string"),
    }.items()])
    matrix = lines(*[F.concat(F.lit(f"- {s} ({when}): "), F.coalesce(F.try_element_at("by_severity", F.lit(s)), F.lit(0)).cast("string")) for s, (_, _, when) in scoring.SEVERITIES.items()])
    detailed = F.array_join(F.transform("checks", lambda c: F.concat(F.lit("- "), c["category"], F.lit(", "), c["check"], F.lit(": "), F.coalesce(c["status"], F.lit(UNVERIFIABLE)))), "\n")
    tasks = F.filter("issues", lambda i: i["category"].isin(*DEVELOPERS))
    bodies = [
        lines(F.concat(F.lit("Website: "), url)), within_words(_summary(url), summary_words), overview, F.lit(UNVERIFIABLE), F.when(F.col("n_issues") > 0, matrix), detailed,
        F.array_join(F.transform("issues", _recommendation), "\n\n"), F.col("plan"), _listed(tasks, lambda i: F.concat(F.lit("- "), i["recommendation"], F.lit(" ("), i["estimated_effort"], F.lit(")"))),
        _listed(F.col("issues"), lambda i: F.concat(F.lit("- "), i["severity"], F.lit(": "), i["business_impact"])), F.array_join(F.transform("unverifiable_fields", lambda x: F.concat(F.lit("- "), x)), "\n"),
        lines(F.concat(F.lit("- Audit: "), F.col(key).cast("string")), F.lit(f"- Format: {version}"), F.concat(F.lit("- Issues: "), F.col("n_issues").cast("string"))),
    ]
    one = lambda i, title, body: F.struct(F.lit(i).alias("seq"), F.lit(title).alias("title"), F.when(F.coalesce(body, F.lit("")) == "", NOTHING).otherwise(body).alias("body"))
    return whole.select(key, F.explode(F.array(*[one(i, t, b) for i, (t, b) in enumerate(zip(SECTIONS, bodies, strict=True), 1)])).alias("s")).select(key, "s.*")


def sections_markdown(sections: DataFrame, key: str = "audit_id") -> DataFrame:
    """``key, markdown_report``: a report's sections as one Markdown text."""
    text = F.concat(F.lit("## "), F.col("seq").cast("string"), F.lit(". "), F.col("title"), F.lit("\n\n"), F.col("body"))
    per = sections.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", text.alias("text")))).alias("s"))
    return per.select(key, F.concat(F.lit("# SEO Audit Report\n\n"), F.array_join(F.transform("s", lambda x: x["text"]), "\n\n"), F.lit("\n")).alias("markdown_report"))
