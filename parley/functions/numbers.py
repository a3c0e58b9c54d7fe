"""Statistics, arrays and hashes (MTH1-MTH8, ARR1-ARR6, STR15's arithmetic)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import cumulative, percentiles


def divergence(parts: DataFrame, by: list[str], n: str) -> DataFrame:
    """MTH1, AGG6: Jensen-Shannon divergence from the uniform distribution, natural logarithm, over the categories given (zeros count as categories). No mass: 1."""
    w = Window.partitionBy(*by)
    shares = parts.select(*by, F.try_divide(F.col(n), F.sum(n).over(w)).alias("p"), (F.lit(1.0) / F.count("*").over(w)).alias("u"))
    term = F.when(F.col("p") > 0, F.col("p") * F.ln(2 * F.col("p") / (F.col("p") + F.col("u")))).otherwise(F.lit(0.0)) + F.col("u") * F.ln(2 * F.col("u") / (F.col("p") + F.col("u")))
    return shares.groupBy(*by).agg(F.coalesce(0.5 * F.sum(F.when(F.col("p").isNotNull(), term)), F.lit(1.0)).alias("jsd"))


def divergence_of(counts: Column) -> Column:
    """MTH1 of an array of counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    u = F.lit(1.0) / F.size(counts)
    part = lambda x: F.when(x > 0, x / total * F.ln(2 * x / total / (x / total + u))).otherwise(F.lit(0.0)) + u * F.ln(2 * u / (x / total + u))
    return F.when((F.size(counts) == 0) | (total == 0), F.lit(1.0)).otherwise(0.5 * F.aggregate(counts, F.lit(0.0), lambda s, x: s + part(x)))


def thresholds(scores: DataFrame, score: str, ambiguous: float = 98.0, gold: float = 99.2) -> DataFrame:
    """MTH2, SIM2: one row with both percentiles over all scores, linearly interpolated and as FLOAT like the scores."""
    low, high = percentiles(scores, score, [ambiguous / 100, gold / 100])
    return scores.sparkSession.createDataFrame([(low, high)], "ambiguous float, gold float")


def index_percentile(values: Column, q: float) -> Column:
    """MTH3: the element at floor(n q) of the sorted values. values: of one group of a bounded size."""
    s = F.sort_array(F.collect_list(values))
    return F.element_at(s, (F.floor(F.size(s) * F.lit(q)) + 1).cast("int"))


def tenth(n: Column) -> Column:
    """MTH4: a tenth, rounded half to even, at least one."""
    return F.greatest(F.lit(1), F.bround(n * F.lit(0.1), 0).cast("int"))


def dot(a: Column, b: Column) -> Column:
    """MTH5: of two arrays of equal length, in doubles."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalised(a: Column) -> Column:
    """A vector of length one; zero stays zero."""
    length = F.sqrt(dot(a, a))
    return F.transform(a.cast("array<double>"), lambda x: F.coalesce(F.try_divide(x, length), F.lit(0.0)))


def stable_hash(x: str) -> int:
    """MTH6: SHA-256 as a number."""
    import hashlib

    return int(hashlib.sha256(x.encode()).hexdigest(), 16)


def base36(x: str) -> int | None:
    """MTH6: a base-36 id as a number, None if it is none."""
    try:
        return int(x, 36)
    except ValueError:
        return None


def weighted_accuracy(violating: Column, compliant: Column, weight_v: float = 1.0, weight_c: float = 1.0) -> Column:
    """MTH7."""
    return (violating * F.lit(weight_v) + compliant * F.lit(weight_c)) / F.lit(weight_v + weight_c)


def rank_correlation(rows: DataFrame, x: str, y: str) -> DataFrame:
    """MTH8: Spearman's rho with average ranks, its two-sided p-value, and the least-squares line. Ranks come from counts by value, not from one task."""
    def ranks(c: str) -> DataFrame:
        values = rows.groupBy(c).agg(F.count("*").alias("k"))
        return cumulative(values, c, "k", "before").select(F.col(c).alias(f"_{c}"), (F.col("before") + (F.col("k") + 1) / 2).alias(f"r_{c}"))

    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = both.join(ranks(x), F.col(x) == F.col(f"_{x}")).join(ranks(y), F.col(y) == F.col(f"_{y}"))
    out = ranked.agg(F.count("*").alias("n"), F.corr(f"r_{x}", f"r_{y}").alias("rho"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    return out.withColumn("p_value", p_value_udf()("rho", "n"))


def student_p(rho: float | None, n: int) -> float | None:
    """Two-sided p-value of a correlation, by the incomplete beta function's continued fraction."""
    from math import exp, lgamma, log

    if rho is None or n < 3:
        return None
    if abs(rho) >= 1:
        return 0.0
    if rho == 0:
        return 1.0
    df = n - 2
    x = 1 - rho * rho  # df / (df + t^2)
    a, b = df / 2, 0.5

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
        h = d
        for m in range(1, 500):
            for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + t * d or 1e-300)
                c = 1 + t / c or 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    if x < (a + 1) / (a + b + 2):
        return front * fraction(a, b, x) / a
    return 1 - front * fraction(b, a, 1 - x) / b


def p_value_udf():
    @F.pandas_udf("double")
    def run(rho: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([student_p(None if pd.isna(r) else float(r), int(k)) for r, k in zip(rho, n)], dtype="float64")

    return run


def common_prefix(a: Column, b: Column) -> Column:
    """ARR1: how many leading elements two arrays share; nulls are equal."""
    m = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), m), F.slice(b, F.lit(1), m), lambda x, y: x.eqNullSafe(y))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, m).cast("int")


def leveled(path: Column) -> Column:
    """ARR2: leaf to root turned over, each with its level."""
    return F.transform(F.reverse(path), lambda c, i: F.struct(i.alias("level"), c.alias("comment")))


def labelled_options(options: Column) -> Column:
    """ARR3: `(a)`, `(b)`, ... before each."""
    return F.transform(options, lambda o, i: F.struct(F.concat(F.lit("("), F.char(F.lit(97) + i), F.lit(")")).alias("label"), o.alias("rule")))


def label_of(options: Column, rule: Column) -> Column:
    """ARR4: the label of the first option with the rule, null if none has it."""
    return F.get(F.filter(options, lambda o: o["rule"] == rule), F.lit(0))["label"]


def sorted_join(x: Column) -> Column:
    """ARR5: distinct values in order, joined by commas."""
    return F.array_join(F.array_sort(F.collect_set(x)), ",")


def listed(rows: DataFrame, column: str, into: str) -> DataFrame:
    """ARR6: a row for each element of a comma list, trimmed and in lower case."""
    return rows.withColumn(into, F.explode(F.split(F.lower(F.col(column)), ","))).withColumn(into, F.trim(into))
