"""Bootstrap resamples that are those of one sequential generator (BST1, BST2, LOD6).

`numpy.random.default_rng(seed).choice(n, (replicates, n))` is one long stream: 32-bit
words, each multiplied by n, its upper half the drawn place; a word whose lower half is too
small is skipped. The stream is cut into chunks, the generator advances straight to each,
and a first pass counts what the chunks skip. Then any range of replicates knows the word
that it begins with, and is drawn wherever there is room: the same places as in one
sequence, whatever model is scored with them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .splits import LEVEL, MOST_CELLS, REPLICATES, SEED

#: Words of a chunk of the stream; even, as a step of the generator gives two.
CHUNK = 1 << 22
#: Words drawn at a time, few enough for a core's cache, and replicates whose means are taken together.
TOGETHER, MEANS = 1 << 16, 256
#: Ranges of replicates, each drawn in one go.
RANGES = 256
#: Rows of a test set, whose cells (four bytes each) every task holds; more raise.
MOST_ROWS = 50_000_000


def words(seed: int, start: int, count: int) -> np.ndarray:
    """32-bit words start to start + count of the seed's stream. start is even."""
    bits = np.random.PCG64(seed).advance(start // 2)
    return bits.random_raw(-(-count // 2)).astype("<u8", copy=False).view("<u4")[:count]


def _skipped(drawn: np.ndarray, n: int) -> np.ndarray:
    """Which words are skipped: the lower halves of their products with n are too small."""
    return drawn * np.uint32(n) < np.uint32(((1 << 32) - n) % n)


def places(drawn: np.ndarray, n: int) -> np.ndarray:
    """What the words draw of n, the skipped ones left out."""
    drawn = drawn.astype(np.uint32, copy=False)
    skipped = _skipped(drawn, n)
    product = (drawn[~skipped] if skipped.any() else drawn).astype(np.uint64)
    product *= np.uint64(n)
    product >>= np.uint64(32)
    return product.view(np.int64)


class Stream:
    """The places that the one stream draws of n, from the start-th on. before: of accepted()."""

    def __init__(self, seed: int, n: int, before: np.ndarray, start: int, chunk: int = CHUNK):
        at = int(np.searchsorted(before, start, "right")) - 1
        self.n, self.bits, self.left = n, np.random.PCG64(seed).advance(at * chunk // 2), np.zeros(0, np.int64)
        skip = start - int(before[at])
        while skip:
            skip -= len(self.take(min(skip, TOGETHER)))

    def take(self, count: int) -> np.ndarray:
        """The next places, as many as asked for."""
        parts, have = [self.left], len(self.left)
        while have < count:
            parts.append(places(self.bits.random_raw(TOGETHER // 2).astype("<u8", copy=False).view("<u4"), self.n))
            have += len(parts[-1])
        found = np.concatenate(parts) if len(parts) > 1 else parts[0]
        self.left = found[count:]
        return found[:count]


def _spread(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema).repartition(max(1, min(len(rows), 256)))


def accepted(spark: SparkSession, n: int, replicates: int, seed: int = SEED, chunk: int = CHUNK) -> np.ndarray:
    """How many draws the chunks before each have made, for as many chunks as the replicates need."""
    if not 0 < n < 1 << 32:
        raise ValueError("n must be between 1 and 2^32 - 1")
    need = n * replicates
    # A word is skipped with a chance below n / 2^32: so many chunks are enough with a margin, else more are asked for.
    chunks = -(-int(need * (1 + n / 2**31) + chunk) // chunk)

    def kept(c: int) -> int:
        return chunk - sum(int(np.count_nonzero(_skipped(words(seed, c * chunk + a, min(TOGETHER, chunk - a)), n))) for a in range(0, chunk, TOGETHER))

    def count(batches):
        for df in batches:
            yield pd.DataFrame({"chunk": df["chunk"], "kept": [kept(c) for c in df["chunk"]]})

    while True:
        rows = _spread(spark, [(c,) for c in range(chunks)], "chunk long").mapInPandas(count, "chunk long, kept long").collect()
        before = np.append(0, np.cumsum([kept for _, kept in sorted((r["chunk"], r["kept"]) for r in rows)]))
        if before[-1] >= need:
            return before
        chunks *= 2


def replicate_places(seed: int, n: int, before: np.ndarray, first: int, count: int, chunk: int = CHUNK) -> np.ndarray:
    """Replicates first to first + count, a row of n places each. before: of accepted()."""
    return Stream(seed, n, before, first * n, chunk).take(count * n).reshape(count, n)


def _ranges(replicates: int) -> list[tuple[int, int]]:
    step = -(-replicates // RANGES) or 1
    return [(i, min(step, replicates - i)) for i in range(0, replicates, step)]


def indices(spark: SparkSession, n: int, replicates: int = REPLICATES, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """BST1: (replicate, places) of the one stream of the seed."""
    before = accepted(spark, n, replicates, seed, chunk)

    def run(batches):
        for df in batches:
            for first, count in df.itertuples(index=False):
                stream, step = Stream(seed, n, before, first * n, chunk), max(1, TOGETHER // n)
                for a in range(first, first + count, step):
                    k = min(step, first + count - a)
                    yield pd.DataFrame({"replicate": np.arange(a, a + k), "places": list(stream.take(k * n).reshape(k, n))})

    return _spread(spark, _ranges(replicates), "first long, count long").mapInPandas(run, "replicate long, places array<long>")


def cached_indices(spark: SparkSession, path: str, n: int, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """LOD6: indices() as stored under path for this seed, n and number of replicates; drawn and stored where they are not there."""
    place = f"{path.rstrip('/')}/seed={seed}/n={n}/replicates={replicates}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        indices(spark, n, replicates, seed).write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)


def intervals(scores: DataFrame, order: str, groups: tuple[str, ...] = (), replicates: int = REPLICATES, seed: int = SEED, level: float = LEVEL, chunk: int = CHUNK) -> DataFrame:
    """BST2: grouping, value, low and high as splits.bootstrap gives them, from the places of the one stream. order: the test set's order, the same for all models that are compared.

    Rows are places; a replicate counts how often it drew each cell of (groups, scores). Null scores are left out of their means; a group that a replicate did not draw counts as 0 there.
    """
    spark, keys = scores.sparkSession, [*groups, "violating", "compliant"]
    counted = scores.groupBy(*keys).agg(F.count("*").alias("n")).limit(MOST_CELLS + 1).toPandas().sort_values(keys, ignore_index=True)
    if len(counted) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells of groups and scores: scores must be of few values")
    n = int(counted["n"].sum())
    if n > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows")
    if not n:
        return spark.createDataFrame([], "grouping string, value string, low double, high double")
    names = spark.createDataFrame([(i, *(None if pd.isna(x) else x for x in row)) for i, row in enumerate(counted[keys].itertuples(index=False))], "cell int, " + ", ".join(f"_{k} {scores.schema[k].dataType.simpleString()}" for k in keys))
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = one if same is None else same & one
    cells = scores.join(names, same).orderBy(order, "cell").select("cell").toPandas()["cell"].to_numpy(np.min_scalar_type(max(1, len(counted) - 1)))
    labels: list[tuple[str, str | None]] = [("overall", None)]
    member = [np.ones(len(counted))]
    for g in groups:
        for v in sorted(counted[g].dropna().unique(), key=str):
            labels.append((g, str(v)))
            member.append((counted[g] == v).to_numpy(float))
    v, c = (counted[k].astype(float).to_numpy() for k in ("violating", "compliant"))
    before = accepted(spark, n, replicates, seed, chunk)
    shared = spark.sparkContext.broadcast((cells, np.stack(member), v, c, labels, before))

    def run(batches):
        cells, who, v, c, labels, before = shared.value
        for df in batches:
            for first, count in df.itertuples(index=False):
                stream, step = Stream(seed, n, before, first * n, chunk), max(1, TOGETHER // n)
                for a in range(first, first + count, MEANS):
                    many = min(MEANS, first + count - a)
                    drawn = np.zeros((many, len(v)))
                    for r in range(0, many, step):  # several small replicates, or one of many pieces
                        k = min(step, many - r)
                        for piece in range(0, k * n, TOGETHER):
                            at = cells[stream.take(min(TOGETHER, k * n - piece))]
                            if k > 1:
                                at = at + np.repeat(np.arange(k) * len(v), n)
                            drawn[r : r + k] += np.bincount(at, minlength=k * len(v)).reshape(k, len(v))
                    mean = lambda x: (drawn * np.nan_to_num(x)) @ who.T / np.maximum((drawn * ~np.isnan(x)) @ who.T, 1)  # noqa: B023, E731
                    value = (mean(v) + mean(c)) / 2
                    yield pd.DataFrame({"grouping": [g for g, _ in labels] * many, "value": [x for _, x in labels] * many, "accuracy": value.ravel()})

    drawn = _spread(spark, _ranges(replicates), "first long, count long").mapInPandas(run, "grouping string, value string, accuracy double")
    tail = (1 - level) / 2
    cut = F.percentile("accuracy", F.array(F.lit(tail), F.lit(1 - tail)))
    return drawn.groupBy("grouping", "value").agg(cut.alias("c")).select("grouping", "value", F.col("c")[0].alias("low"), F.col("c")[1].alias("high"))
