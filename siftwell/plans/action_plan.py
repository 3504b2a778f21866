"""The 30-day plan: an audit's issues packed into working days under a budget of minutes, the most urgent first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import scoring

#: Working days of the plan, days of a week, and minutes of work a day; parameters of ``action_plan``.
DAYS, WEEK, DAY_MINUTES = 30, 7, 120
#: What an effort that names no time is planned with.
UNKNOWN_MINUTES = 120


def effort_minutes(effort: Column) -> Column:
    """The upper end of an estimate such as ``5–10 minutes`` or ``1–2 hours``; ``UNKNOWN_MINUTES`` where there is none."""
    n = F.regexp_extract(effort, r"(\d+)\D*$", 1)
    hours = F.lower(effort).contains("hour")
    return F.coalesce(F.when(n != "", n.cast("int") * F.when(hours, 60).otherwise(1)), F.lit(UNKNOWN_MINUTES))


def action_plan(issues: DataFrame, key: str, order: tuple[str, ...] = ("issue",), minutes: str | None = None, day_minutes: int = DAY_MINUTES, days: int = DAYS) -> DataFrame:
    """``issues`` with ``minutes, first_day, last_day, week`` and ``planned``.

    Issues of an audit are taken by severity, then ``order``.  One goes to the current day if it fits there; one that doesn't goes
    to the next, and one that is longer than a day takes as many days from the next free one as it needs.  So no day holds more
    than ``day_minutes``, and a later issue never begins before an earlier one.  What would end after ``days`` is not planned:
    its days are null.  Issues without a severity come last; repeated issues are planned each.

    An audit has at most some dozen issues (one a check), so they are folded in one array, once per audit.
    """
    took = effort_minutes(F.col("estimated_effort")) if minutes is None else F.col(minutes).cast("int")
    took = F.greatest(F.coalesce(took, F.lit(UNKNOWN_MINUTES)), F.lit(0))
    named = F.struct(F.coalesce(scoring.priority(F.col("severity")), F.lit(len(scoring.SEVERITIES) + 1)).alias("rank"), *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], took.alias("minutes"), F.struct("*").alias("row"))
    per = issues.groupBy(F.col(key).alias("__key")).agg(F.array_sort(F.collect_list(named)).alias("all"))
    needs = lambda m: F.greatest(F.lit(1), F.ceil(m / F.lit(day_minutes)).cast("int"))

    def step(state: Column, x: Column) -> Column:
        m = x["minutes"]
        fits = state["used"] + m <= day_minutes
        first = F.when(fits, state["day"]).otherwise(state["day"] + 1)
        last = F.when(fits, state["day"]).otherwise(first + needs(m) - 1)
        used = F.when(fits, state["used"] + m).otherwise(m - (needs(m) - 1) * day_minutes)
        one = F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"), m.alias("minutes"))
        return F.struct(last.cast("int").alias("day"), used.cast("int").alias("used"), F.concat(state["done"], F.array(one)).alias("done"))

    none = F.array().cast("array<struct<first: int, last: int, minutes: int>>")
    start = F.struct(F.lit(1).alias("day"), F.lit(0).alias("used"), none.alias("done"))
    folded = per.withColumn("done", F.aggregate("all", start, step, lambda s: s["done"]))
    both = folded.select(F.explode(F.arrays_zip("all", "done")).alias("x")).select("x.all.row.*", F.col("x.done.minutes").alias("minutes"), F.col("x.done.first").alias("f"), F.col("x.done.last").alias("l"))
    planned = F.col("l") <= days
    return both.select(*issues.columns, *(["minutes"] if "minutes" not in issues.columns else []), F.when(planned, F.col("f")).alias("first_day"), F.when(planned, F.col("l")).alias("last_day"), F.when(planned, F.floor((F.col("f") - 1) / WEEK).cast("int") + 1).alias("week"), planned.alias("planned"))


def plan_markdown(plan: DataFrame, key: str) -> DataFrame:
    """``key, plan``: the plan as Markdown, a heading a week and a line an issue; weeks without work are left out."""
    line = F.concat(F.lit("- Day "), F.col("first_day"), F.when(F.col("last_day") > F.col("first_day"), F.concat(F.lit("–"), F.col("last_day"))).otherwise(F.lit("")), F.lit(": "), F.col("issue"), F.lit(" ("), F.col("severity"), F.lit(", "), F.col("minutes"), F.lit(" minutes)"))
    weeks = plan.filter("planned").groupBy(key, "week").agg(F.array_sort(F.collect_list(F.struct("first_day", "last_day", F.coalesce(scoring.priority(F.col("severity")), F.lit(9)).alias("p"), "issue", line.alias("line")))).alias("lines"))
    text = F.concat(F.lit("#### Week "), F.col("week"), F.lit("\n\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    return weeks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("week", text.alias("text")))), lambda x: x["text"]), "\n\n").alias("plan"))
