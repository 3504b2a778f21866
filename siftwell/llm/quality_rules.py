"""Quality rules with robust multivariate outliers, in DataFrame expressions only.

Base statistics are counted inside each row with array functions, without a shuffle.  Their transformed vector is judged per
language and source by the minimum covariance determinant: among the rows of a group, the ``H`` share with the smallest
Mahalanobis distances is found by concentration steps from two deterministic starts (coordinatewise medians and deviations;
spatial signs), the start with the smaller determinant wins, and one reweighting step follows.  Rows beyond a chi-square
quantile are rejected.

One concentration step is one pass: distances are binned on a log scale and moments are summed per group and bin (partial
aggregates, so that a group with a third of all rows is no bottleneck); the subset's moments are then a prefix sum over the
bins, on a table of groups times bins.  The square of a coordinate's ``FLOOR`` is added to each variance: most texts have
no symbols and no repeats at all, and a plain determinant would collapse on them.  The floor of repeated lines is small enough
for a text of nothing else to be rejected by them alone; for repeated words there is the base rule.  A covariance of five coordinates needs rows, so
languages and sources with under ``LEAST_ROWS`` of them are estimated together with the others such of their language, and
where these are under it too, with all others such; that last group is judged by its own estimate however small it is.

Defined cases: a null or empty text has no words and fails the base rule; texts of any length are counted whole; null language
and null source are values of their own; repeated rows count each, and rows that tie in distance fall into one bin, so they
are taken or left together; ids may be null; an empty table gives an empty result; other columns play no part and may have any
name.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize

H = 0.75
STEPS = 5
LEAST_ROWS = 60
CUT = 0.9999
#: Least standard deviation of each coordinate, in its own (logarithmic) units.
FLOOR = (0.2, 0.05, 0.3, 0.47, 0.5)
P = len(FLOOR)
_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
X = [f"x{i}" for i in range(P)]

_SPLIT = r"[\x20\x09-\x0D]+"

def base_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words`` to ``docs``."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    row = docs.withColumn("__text", text).withColumn("__lines", F.expr(r"filter(split(__text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
    words = F.filter(F.split("__text", _SPLIT), lambda x: x != "")
    facts = F.transform(
        F.array(words),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.when(F.size(w) >= 8, _repeat_words(w)).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        ),
    )[0]
    row = row.withColumn("__facts", facts)
    return row.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.col("__facts.n_words").alias("n_words"),
        F.col("__facts.word_chars").alias("word_chars"),
        F.regexp_count("__text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.col("__facts.n_repeat_words").alias("n_repeat_words"),
    )


def _repeat_words(w):
    """Words in 8-word windows that the text holds twice or more.

    Hashes of all windows are sorted with their positions; positions of equal neighbours, in order, cover up to 8 words
    each.  Every array that a lambda looks up is itself a lambda's variable, so that it is made once per row.
    """
    h = F.transform(F.sequence(F.lit(1), F.size(w) - 7), lambda i: F.xxhash64(F.slice(w, i, 8)))

    def covered(p):
        gap = F.transform(p, lambda x, j: F.least(F.lit(8), F.coalesce(F.get(p, j + 1) - x, F.lit(8))).cast("long"))
        return F.aggregate(gap, F.lit(0).cast("long"), lambda a, b: a + b)

    def twice(s):
        same = lambda e, j: F.when((F.get(s, j - 1)["x"] == e["x"]) | (F.get(s, j + 1)["x"] == e["x"]), e["i"])
        return F.transform(F.array(F.sort_array(F.filter(F.transform(s, same), lambda p: p.isNotNull()))), covered)[0]

    def count(h):
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(F.transform(F.array(ordered), twice)[0])

    return F.transform(F.array(h), count)[0]


def vector(df: DataFrame) -> DataFrame:
    """The transformed statistics: log length, log mean word length, log shares of symbols, repeated lines and words."""
    n = F.col("n_words") + 1
    return df.withColumns(
        {
            "x0": F.log(n.cast("double")),
            "x1": F.log((F.col("word_chars") + 1) / n),
            "x2": F.log1p(10 * F.col("n_symbols") / n),
            "x3": F.log1p(10 * F.col("n_dup_lines") / (F.col("n_lines") + 1)),
            "x4": F.log1p(10 * F.col("n_repeat_words") / n),
        }
    )


def _chi2_cdf(x: float, k: int) -> float:
    a, t = k / 2, x / 2
    term = total = 1 / a
    for i in range(1, 500):
        term *= t / (a + i)
        total += term
    return total * math.exp(-t + a * math.log(t) - math.lgamma(a)) if x > 0 else 0.0


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, k) < q else (low, mid)
    return low


def _consistency(share: float) -> float:
    return share / _chi2_cdf(chi2_quantile(share, P), P + 2)


def _factor(groups: DataFrame, scale: float = 1.0) -> DataFrame:
    """Adds the Cholesky factor ``l_i_j`` of the floored covariance ``s_i_j`` and ``logdet``; keeps ``m_i``."""
    g = groups
    for i, j in _PAIRS:
        cell = F.col(f"s_{i}_{j}") * scale
        if i == j:
            cell = F.greatest(cell, F.lit(0.0)) + FLOOR[i] ** 2
        for k in range(j):
            cell = cell - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        g = g.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(cell, F.lit(1e-12))) if i == j else cell / F.col(f"l_{j}_{j}"))
    return g.withColumn("logdet", sum((2 * F.log(f"l_{i}_{i}") for i in range(1, P)), 2 * F.log("l_0_0")))


def _keep_factor(g: DataFrame, *more: str) -> DataFrame:
    return g.select("grp", *more, *[f"m_{i}" for i in range(P)], *[f"l_{i}_{j}" for i, j in _PAIRS], "logdet")


def _distance(df: DataFrame) -> DataFrame:
    """Adds ``d2`` by forward substitution."""
    for i in range(P):
        y = F.col(X[i]) - F.col(f"m_{i}")
        for k in range(i):
            y = y - F.col(f"l_{i}_{k}") * F.col(f"y{k}")
        df = df.withColumn(f"y{i}", y / F.col(f"l_{i}_{i}"))
    return df.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, P)), F.col("y0") * F.col("y0"))).drop(*[f"y{i}" for i in range(P)])


def _moments() -> list:
    return [F.count("*").cast("double").alias("n"), *[F.sum(x).alias(f"t_{i}") for i, x in enumerate(X)], *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"q_{i}_{j}") for i, j in _PAIRS]]


_SUMS = ["n", *[f"t_{i}" for i in range(P)], *[f"q_{i}_{j}" for i, j in _PAIRS]]


def _from_moments(g: DataFrame) -> DataFrame:
    g = g.withColumns({f"m_{i}": F.col(f"t_{i}") / F.col("n") for i in range(P)})
    return g.withColumns({f"s_{i}_{j}": F.col(f"q_{i}_{j}") / F.col("n") - F.col(f"m_{i}") * F.col(f"m_{j}") for i, j in _PAIRS})


def _subset(binned: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Sums the moments of the bins, lowest first, up to the one in which ``share`` of the rows is reached."""
    low = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    b = binned.withColumn("before", F.coalesce(F.sum("n").over(low), F.lit(0.0))).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    return b.filter(F.col("before") < F.ceil(F.col("all") * share)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _SUMS])


def _medians(long: DataFrame, name: str) -> DataFrame:
    """Per group and coordinate, the centre of the bin (1/256 wide) that holds the median of ``value``."""
    count = long.withColumn("bin", F.floor(F.col("value") * 256)).groupBy("grp", "i", "bin").agg(F.count("*").alias("c"))
    upto = Window.partitionBy("grp", "i").orderBy("bin")
    count = count.withColumn("upto", F.sum("c").over(upto)).withColumn("all", F.sum("c").over(Window.partitionBy("grp", "i")))
    return count.filter("2 * upto >= all").groupBy("grp", "i").agg(((F.min("bin") + 0.5) / 256).alias(name))


def robust_scatter(rows: DataFrame, steps: int = STEPS, h: float = H) -> DataFrame:
    """Per ``grp`` of ``rows`` (``grp, x0 ...``): location ``m_i`` and Cholesky factor ``l_i_j`` of the reweighted estimate."""
    stack = "stack({}, {}) as (i, value)".format(P, ", ".join(f"{i}, {x}" for i, x in enumerate(X)))
    med = materialize(_medians(rows.select("grp", F.expr(stack)), "med"), "median")
    dev = rows.select("grp", F.expr(stack)).join(med, ["grp", "i"]).select("grp", "i", F.abs(F.col("value") - F.col("med")).alias("value"))
    both = materialize(_medians(dev, "mad").join(med, ["grp", "i"]).groupBy("grp").pivot("i", list(range(P))).agg(F.first("med").alias("med"), F.first("mad").alias("mad")), "mad")
    both = both.select("grp", *[F.col(f"{i}_med").alias(f"c_{i}") for i in range(P)], *[F.greatest(F.col(f"{i}_mad") * 1.4826, F.lit(FLOOR[i])).alias(f"w_{i}") for i in range(P)])

    # Spatial signs: the covariance of unit vectors around the median, scaled back.
    z = rows.join(both, "grp")
    z = z.withColumns({f"z{i}": (F.col(X[i]) - F.col(f"c_{i}")) / F.col(f"w_{i}") for i in range(P)})
    z = z.withColumn("norm", F.greatest(F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, P)), F.col("z0") * F.col("z0"))), F.lit(1e-9)))
    sign = z.groupBy("grp").agg(*[F.avg(F.col(f"z{i}") * F.col(f"z{j}") / (F.col("norm") * F.col("norm"))).alias(f"e_{i}_{j}") for i, j in _PAIRS])
    both = both.join(sign, "grp")
    plain = {f"s_{i}_{j}": F.col(f"w_{i}") * F.col(f"w_{i}") if i == j else F.lit(0.0) for i, j in _PAIRS}
    signs = {f"s_{i}_{j}": P * F.col(f"w_{i}") * F.col(f"w_{j}") * F.col(f"e_{i}_{j}") for i, j in _PAIRS}
    start = [both.select("grp", F.lit(k).alias("start"), *[F.col(f"c_{i}").alias(f"m_{i}") for i in range(P)], *[c.alias(n) for n, c in s.items()]) for k, s in enumerate((plain, signs))]
    cur = materialize(_keep_factor(_factor(start[0].unionByName(start[1])), "start"), "start")
    bin_ = F.floor(F.log2(F.col("d2") + 1e-6) * 32).cast("int")
    for _ in range(steps):
        binned = _distance(rows.join(cur, "grp")).withColumn("bin", bin_).groupBy("grp", "start", "bin").agg(*_moments())
        cur = materialize(_keep_factor(_factor(_from_moments(_subset(binned, ["grp", "start"], h))), "start"), "step")
    best = cur.groupBy("grp").agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
    cur = cur.join(best, ["grp", "start"]).drop("start")
    # Reweighting: all rows within the 0.975 quantile of the consistent raw estimate.
    near = _distance(rows.join(cur, "grp")).filter(F.col("d2") <= chi2_quantile(0.975, P) * _consistency(h))
    return materialize(_keep_factor(_factor(_from_moments(near.groupBy("grp").agg(*_moments())), _consistency(0.975))), "scatter")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cut: float = CUT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the base statistics, ``base_failed``, ``distance`` (squared, null where ``base_failed``), ``kept``."""
    small = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(f"`{lang_col}`").cast("string")), F.lit("null")).alias("lang"),
        F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit("null")).alias("source"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    )
    facts = vector(base_statistics(small).drop("text")).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    facts = materialize(facts, "facts")

    sound = facts.filter("not base_failed")
    size = sound.groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_lang = Window.partitionBy("lang")
    size = size.withColumn("own", F.col("n") >= LEAST_ROWS).withColumn("left", F.sum(F.when(~F.col("own"), F.col("n")).otherwise(0)).over(by_lang))
    size = size.withColumn("grp", F.when(F.col("own"), F.to_json(F.struct("lang", "source"))).when(F.col("left") >= LEAST_ROWS, F.to_json(F.struct("lang"))).otherwise(F.lit("rest")))
    size = materialize(size.select("lang", "source", "grp"), "groups")

    rows = materialize(sound.join(size, ["lang", "source"]).select("grp", *X), "rows")
    scatter = robust_scatter(rows)
    judged = _distance(facts.join(size, ["lang", "source"], "left").join(scatter, "grp", "left"))
    distance = F.when(~F.col("base_failed"), F.col("d2"))
    kept = ~F.col("base_failed") & (distance.isNull() | (distance <= chi2_quantile(cut, P)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", distance.alias("distance"), kept.alias("kept"))
