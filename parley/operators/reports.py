"""Tables behind reports (REP1-REP7, DRV4, SNK8-SNK9's data)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_performance(files: DataFrame, folder: str = "folder", name: str = "name") -> DataFrame:
    """REP1: the latest performance file of each folder, one with intervals before one without."""
    ci = F.col(name).endswith("_ci.json")
    return files.where(F.col(name).contains("performance")).groupBy(folder).agg(F.max_by(name, F.struct(ci, F.col(name))).alias(name))


def cluster_metrics(accuracies: DataFrame, grouping: str) -> DataFrame:
    """REP2: percent with interval by label, the best first; without an interval both ends are the accuracy; `Other` is `other`."""
    a = F.col("accuracy") * 100
    rows = accuracies.where(F.col("grouping") == grouping)
    return rows.select(F.when(F.col("value") == "Other", "other").otherwise(F.col("value")).alias("label"), a.alias("accuracy"), F.coalesce(F.col("low") * 100, a).alias("low"), F.coalesce(F.col("high") * 100, a).alias("high"), "n").orderBy(F.desc("accuracy"), "label")


def sizes(pairs: DataFrame, label: str) -> DataFrame:
    """REP3."""
    from .aggregates import cluster_sizes

    return cluster_sizes(pairs, label, "subreddit")


def shown_languages(counts: DataFrame, accuracies: DataFrame, least: int = 10) -> DataFrame:
    """REP4: languages with at least so many instances that some model has, with each model's accuracy, null where it has none."""
    langs = counts.where(F.col("n") >= least).join(accuracies.select("language").distinct(), "language", "left_semi")
    models = accuracies.select("model").distinct()
    return langs.crossJoin(F.broadcast(models)).join(accuracies, ["language", "model"], "left").select("language", "model", "n", "accuracy")


def performance_table(accuracies: DataFrame, near: float = 1e-4) -> DataFrame:
    """REP5, WIN6: model by context, with the difference from the context before and whether it is the best of its context."""
    from .aggregates import with_previous

    w = Window.partitionBy("context")
    rows = with_previous(accuracies, ["model"], "position", "accuracy")
    return rows.withColumn("best", F.abs(F.max("accuracy").over(w) - F.col("accuracy")) <= near)


def pivoted(rows: DataFrame, contexts: list[str]) -> DataFrame:
    """REP5: a row for each model, a column for each context."""
    return rows.groupBy("model").pivot("context", contexts).agg(F.first("accuracy"))


def size_and_accuracy(accuracies: DataFrame, sizes: DataFrame) -> DataFrame:
    """JON11: accuracy beside size for labels that both have, `other` left out."""
    return accuracies.join(sizes.select("label", "pairs"), "label").where(F.lower("label") != "other")


def responses(items: DataFrame, answers: DataFrame) -> DataFrame:
    """REP7: answers with the index of their question: its place in the form after the forms before. items: (form, position, question_id)."""
    per_form = items.groupBy("form").agg(F.count("*").alias("n"))
    before = per_form.select("form", F.coalesce(F.sum("n").over(Window.orderBy("form").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    w = Window.partitionBy("form").orderBy("position")
    placed = items.withColumn("_n", F.row_number().over(w)).join(before, "form").select("form", "question_id", (F.col("offset") + F.col("_n")).alias("question_index"))
    return answers.join(placed, ["form", "question_id"])


def stage_summary(rows: DataFrame, *measures: str) -> DataFrame:
    """DRV4: sums by community, the largest first."""
    return rows.groupBy("subreddit").agg(*[F.sum(m).alias(m) for m in measures]).orderBy(F.desc(measures[0]), "subreddit")


def failures(rows: DataFrame, top: int = 20) -> DataFrame:
    """TOP3: the most frequent errors."""
    from ..functions.text import error_category

    return rows.where("error IS NOT NULL").groupBy(error_category(F.col("error")).alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(top)
