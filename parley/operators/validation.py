"""Checks of a pipeline's tables against each other (VAL1-VAL10): issues (stage, severity, message) in one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import missing


def issue(rows: DataFrame, stage: str, severity: str, message: Column) -> DataFrame:
    return rows.select(F.lit(stage).alias("stage"), F.lit(severity).alias("severity"), message.alias("message"))


def _absent(a: DataFrame, b: DataFrame, key: str, stage: str, severity: str, text: str) -> DataFrame:
    return issue(missing(a, b, key), stage, severity, F.concat(F.lit(f"{text}: "), F.col(key).cast("string")))


def both_ways(a: DataFrame, b: DataFrame, key: str, stage: str, left: str, right: str) -> DataFrame:
    """VAL1, VAL3, VAL5, VAL6, JON14: keys that only one side has."""
    return _absent(a, b, key, stage, "CRITICAL", left).union(_absent(b, a, key, stage, "WARNING", right))


def empty_counts(rows: DataFrame, key: str, n: str, stage: str) -> DataFrame:
    """VAL1, VAL4: listed, but with nothing in it."""
    return issue(rows.where(F.coalesce(F.col(n), F.lit(0)) == 0), stage, "CRITICAL", F.concat(F.lit("empty: "), F.col(key).cast("string")))


def total_is(rows: DataFrame, n: str, expected: int, stage: str) -> DataFrame:
    """VAL1, VAL3, VAL7: a sum against a summary's total."""
    total = rows.agg(F.coalesce(F.sum(n), F.lit(0)).alias("t"))
    return issue(total.where(F.col("t") != expected), stage, "CRITICAL", F.concat(F.lit("total "), F.col("t").cast("string"), F.lit(f" is not {expected}")))


def one_date(rows: DataFrame, date: str, stage: str) -> DataFrame:
    """VAL1, VAL3, VAL5: files of more than one run."""
    n = rows.agg(F.count_distinct(date).alias("n"))
    return issue(n.where("n > 1"), stage, "WARNING", F.concat(F.lit("files of "), F.col("n").cast("string"), F.lit(" dates")))


def under_collected(actual: DataFrame, expected: DataFrame, key: str, n: str, stage: str) -> DataFrame:
    """VAL4: fewer than expected, none included."""
    rows = expected.select(key, F.col(n).alias("_want")).join(actual.select(key, F.col(n).alias("_have")), key, "left")
    return issue(rows.where(F.coalesce("_have", F.lit(0)) < F.col("_want")), stage, "WARNING", F.concat(F.col(key).cast("string"), F.lit(": "), F.coalesce("_have", F.lit(0)).cast("string"), F.lit(" of "), F.col("_want").cast("string")))


def same_rows(a: DataFrame, b: DataFrame, stage: str) -> DataFrame:
    """VAL9: as many embeddings as metadata rows."""
    both = a.agg(F.count("*").alias("a")).crossJoin(F.broadcast(b.agg(F.count("*").alias("b"))))
    return issue(both.where("a <> b"), stage, "CRITICAL", F.concat_ws(" ", F.col("a").cast("string"), F.lit("rows,"), F.col("b").cast("string"), F.lit("metadata rows")))


def present(expected: DataFrame, files: DataFrame, key: str, stage: str) -> DataFrame:
    """VAL8, VAL10: expected files that are not there."""
    return _absent(expected, files, key, stage, "CRITICAL", "missing")


def media_totals(outcomes: DataFrame, successful: int, downloaded: int, stage: str = "7") -> DataFrame:
    """VAL7: complete and no_media against the manifest's successes, files against those it counts."""
    t = outcomes.agg(F.count_if(F.col("status").isin("complete", "no_media")).alias("s"), F.coalesce(F.sum("files_downloaded"), F.lit(0)).alias("f"))
    return issue(t.where((F.col("s") != successful) | (F.col("f") != downloaded)), stage, "CRITICAL", F.format_string("%d successful, %d files", "s", "f"))


def report(*issues: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, issues)


def summary(issues: DataFrame) -> DataFrame:
    """By stage: numbers of issues, and whether it fails."""
    return issues.groupBy("stage").agg(F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(F.col("severity") == "WARNING").alias("warnings")).withColumn("failed", F.col("critical") > 0)
