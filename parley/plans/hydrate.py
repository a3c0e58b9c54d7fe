"""Entry B: released ids filled with texts again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins as J


def threads_of(pairs: DataFrame) -> DataFrame:
    """A row for each thread of the pairs: key, subreddit and ids."""
    both = F.array(*[F.struct(F.lit(t).alias("thread_type"), F.col(f"{t}_thread_ids").alias("ids")) for t in ("violating", "compliant")])
    return pairs.select("split", "mod_comment_id", "subreddit", F.inline(both)).withColumn("key", F.concat_ws(":", "split", "mod_comment_id", "thread_type"))


def hydrate(pairs: DataFrame, comments: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """JON9 over all splits at once: comments are scanned and matched once, whichever splits want them. Missing texts are values, not errors."""
    filled = J.hydrated(threads_of(pairs), comments, "key", "ids", sources)
    out = pairs
    for t in ("violating", "compliant"):
        own = filled.select(F.col("key").alias(f"_{t}"), F.col("thread").alias(f"{t}_thread"))
        out = out.drop(f"{t}_thread").withColumn(f"_{t}", F.concat_ws(":", "split", "mod_comment_id", F.lit(t))).join(own, f"_{t}", "left").drop(f"_{t}")
    return out


def coverage(hydrated: DataFrame) -> DataFrame:
    """Comments by split and status."""
    every = F.concat(F.transform("violating_thread", lambda c: c["hydration_status"]), F.transform("compliant_thread", lambda c: c["hydration_status"]))
    return hydrated.select("split", F.explode(every).alias("status")).groupBy("split", "status").agg(F.count("*").alias("n"))
