"""Streams of comments: an extension beyond batch, for archives that arrive file by file.

A submission is emitted once as many different ids as are expected of it were seen; state
is the ids, not the texts. A line seen twice counts once, and one that comes after its
submission was emitted opens nothing anew until the submission has been quiet for long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import COMMENT, _struct


def comment_stream(spark: SparkSession, folder: str, files_a_batch: int = 16) -> DataFrame:
    """New JSON-lines files of a folder as a stream of comments."""
    return spark.readStream.schema(_struct(COMMENT)).option("maxFilesPerTrigger", files_a_batch).json(folder)


def completed(stream: DataFrame, expected: DataFrame, minutes: int = 60) -> DataFrame:
    """(submission_id, n, complete): submissions as they become complete. expected: a static table (submission_id, expected). A key without news for so long is given up and emitted as it stands."""
    import pandas as pd

    rows = stream.join(expected, "submission_id").select("submission_id", "id", "expected")

    def run(key, frames, state):
        seen, done = (set(state.get[0]), state.get[1]) if state.exists else (set(), False)
        if state.hasTimedOut:
            state.remove()
            if not done:
                yield pd.DataFrame({"submission_id": [key[0]], "n": [len(seen)], "complete": [False]})
            return
        want = 0
        for df in frames:
            seen |= set(df["id"])
            want = int(df["expected"].iloc[0])
        now = not done and len(seen) >= want
        state.update(([] if done or now else sorted(seen), done or now))
        state.setTimeoutDuration(minutes * 60_000)
        if now:
            yield pd.DataFrame({"submission_id": [key[0]], "n": [len(seen)], "complete": [True]})

    return rows.groupBy("submission_id").applyInPandasWithState(run, "submission_id string, n long, complete boolean", "ids array<string>, done boolean", "append", "ProcessingTimeTimeout")


def counts(stream: DataFrame, seconds: str = "created_utc", late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Comments of each community and day, with late ones allowed for."""
    at = F.timestamp_seconds(F.col(seconds).try_cast("double"))
    return stream.withColumn("at", at).withWatermark("at", late).groupBy(F.window("at", window), "subreddit").agg(F.count("*").alias("n"))
