"""Order statistics over all rows, by ranges: no task sees all rows or all values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged


def cumulative(rows: DataFrame, order: str, n: str, into: str) -> DataFrame:
    """rows with the sum of n over all rows before theirs in order.

    Rows are dealt into ranges of order, summed by range, and summed within theirs. The ranges are staged, as drawn twice they could differ; their sums are a row for each range.
    """
    spread = staged(rows.repartitionByRange(F.asc(order)).withColumn("_part", F.spark_partition_id()), "cumulative")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = spread.groupBy("_part").agg(F.sum(n).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return spread.join(F.broadcast(before), "_part").withColumn(into, F.col("_before") + F.coalesce(F.sum(n).over(within), F.lit(0))).drop("_part", "_before")


def percentiles(rows: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Exact percentiles with linear interpolation, as built-in ones, which hold all distinct values in one task. Nulls do not count."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    placed = cumulative(counts, "v", "n", "before")
    total = placed.agg(F.sum("n")).first()[0]
    if not total:
        return [None] * len(shares)
    wanted = sorted({k for q in shares for k in (int(q * (total - 1)), min(total - 1, int(q * (total - 1)) + 1))})
    hit = F.lit(False)
    for k in wanted:
        hit = hit | ((F.col("before") <= k) & (F.col("before") + F.col("n") > k))
    found = placed.where(hit).select("v", "n", "before").collect()
    at = {k: next(r["v"] for r in found if r["before"] <= k < r["before"] + r["n"]) for k in wanted}
    out = []
    for q in shares:
        pos = q * (total - 1)
        low = int(pos)
        a, b = at[low], at[min(total - 1, low + 1)]
        out.append(a if a == b else a + (b - a) * (pos - low))
    return out
