"""Answer options, adaptive splits, stratified samples and bootstrap intervals (RNG1, SPL1-SPL2, SMP1, BST1-BST2)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from .aggregates import numbered_within

NO_RULE = "No rules broken"
#: Bootstrap: replicates, seed and level.
REPLICATES, SEED, LEVEL = 100_000, 42, 0.95
#: Cells of groups and scores that are drawn over.
MOST_CELLS = 100_000
#: Replicates that one task draws together.
CHUNK = 500


def shuffled_options(rules: Column, comment_id: Column, suffix: str, rng: str = "mt19937") -> Column:
    """RNG1, ARR3: the rules and `No rules broken` in an order that the id seeds, labelled.

    mt19937: a Mersenne twister seeded with the base-36 id plus the SHA-256 of id and suffix, which no built-in draws. sha2: by digests, in built-ins.
    """
    every = F.concat(F.coalesce(rules, F.array().cast("array<string>")), F.array(F.lit(NO_RULE)))
    if rng == "sha2":
        keyed = F.array_sort(F.transform(every, lambda o, i: F.struct(F.sha2(F.concat_ws("|", comment_id, F.lit(suffix), i.cast("string"), o), 256).alias("k"), o.alias("o"))))
        return N.labelled_options(F.transform(keyed, lambda x: x["o"]))
    import random

    @F.pandas_udf("array<string>")
    def order(options: pd.Series, ids: pd.Series) -> pd.Series:
        out = []
        for o, i in zip(options, ids):
            o = list(o)
            own = N.base36(i)
            random.Random((0 if own is None else own) + N.stable_hash(i + suffix)).shuffle(o)
            out.append(o)
        return pd.Series(out)

    return N.labelled_options(order(every, comment_id))


def split_sizes(n: Column) -> tuple[Column, Column]:
    """SPL1: test and validation sizes of a group of n: 1: test only; 2: one test, one train; to 9: one each; from 10: a tenth each, half to even."""
    return F.when(n < 10, F.lit(1)).otherwise(N.tenth(n)), F.when(n < 3, F.lit(0)).when(n < 10, F.lit(1)).otherwise(N.tenth(n))


def assigned(pairs: DataFrame, by: str, key: str, rng: str = "sha2") -> DataFrame:
    """SPL1: each pair's split. Within a group pairs are ordered by digest (sha2) or by a seeded shuffle of their sorted keys (mt19937)."""
    n = pairs.groupBy(by).agg(F.count("*").alias("_n"))
    if rng == "sha2":
        order = F.sha2(F.concat_ws(":", F.col(by).cast("string"), F.col(key).cast("string")), 256)
        placed = numbered_within(pairs.withColumn("_o", order), by, [F.asc("_o"), F.asc(key)], "_place").drop("_o")
    else:
        placed = pairs.join(_shuffled(pairs, by, key), [by, key])
    rows = placed.join(n, by)
    test, val = split_sizes(F.col("_n"))
    return rows.withColumn("split", F.when(F.col("_place") <= test, "test").when(F.col("_place") <= test + val, "val").otherwise("train")).drop("_n", "_place")


def _shuffled(pairs: DataFrame, by: str, key: str) -> DataFrame:
    """Places of the keys of each group in its seeded shuffle. Groups stand together, sorted, within a partition, and go through in batches; a group's keys are held together, no other column is: for groups of up to some millions; `sha2` has no such bound."""
    import random

    import pyarrow as pa

    def places(group, n: int) -> list[int]:
        if n == 1:
            return [1]
        order, place = list(range(n)), [0] * n
        random.Random(N.stable_hash(str(group))).shuffle(order)
        for at, i in enumerate(order):
            place[i] = at + 1
        return place

    def run(batches):
        held: list[pa.RecordBatch] = []  # the end of the last batches: one group
        group, n = None, 0
        for batch in batches:
            groups, out, start = batch.column(0).to_pylist(), [], 0
            for i, g in enumerate(groups):
                if n and g != group:
                    out += places(group, n)
                    start, n = i, 0
                group, n = g, n + 1
            if out:
                whole = pa.Table.from_batches([*held, batch.slice(0, start)])
                yield from whole.append_column("_place", pa.array(out, pa.int32())).to_batches()
                held = []
            if start < len(groups):
                held.append(batch.slice(start))
        if n:
            yield from pa.Table.from_batches(held).append_column("_place", pa.array(places(group, n), pa.int32())).to_batches()

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    # Rows without a group have no place: they meet nothing later.
    rows = pairs.select(by, key).where(F.col(by).isNotNull()).repartition(by).sortWithinPartitions(F.asc(by), F.asc_nulls_last(key))
    return rows.mapInArrow(run, f"{by} {kinds[by]}, {key} {kinds[key]}, _place int")


def with_labels(pairs: DataFrame) -> DataFrame:
    """SPL2, ARR4: options and the correct label of both threads; the compliant one's is that no rule is broken, a rule that is not listed has none."""
    out = pairs
    for t, truth in (("violating", F.col("rule")), ("compliant", F.lit(NO_RULE))):
        out = out.withColumn(f"{t}_answer_options", shuffled_options(F.col("rules"), F.col("mod_comment_id"), t, "sha2"))
        out = out.withColumn(f"{t}_correct_answer", N.label_of(F.col(f"{t}_answer_options"), truth))
    return out


def assembled(pairs: DataFrame, submissions: DataFrame, files: DataFrame) -> DataFrame:
    """SPL2: a split's pairs of submissions that are there, with options, correct labels, and the submission's media files in order.

    The split's trees and its distribution of rules are tables of their own: split_trees, distribution.

    files: (file); a file is a submission's if the submission's id and an underscore begin its name.
    """
    known = submissions.select("submission_id").distinct()
    own = files.select(F.split_part("file", F.lit("_"), F.lit(1)).alias("submission_id"), "file").groupBy("submission_id").agg(F.array_sort(F.collect_set("file")).alias("media_files"))
    rows = with_labels(pairs.join(known, "submission_id", "left_semi")).join(own, "submission_id", "left")
    return rows.withColumn("media_files", F.coalesce("media_files", F.array().cast("array<string>"))).withColumn("num_media", F.size("media_files"))


def split_trees(pairs: DataFrame, comments: DataFrame, by: tuple[str, ...] = ("subreddit", "split")) -> DataFrame:
    """SPL2: the comment trees of a split, as rows of (by, comments' columns): those of submissions that its pairs belong to. A tree that two splits use is in both. Trees stay rows, as one of any size does; their links are in the comments' parent_id."""
    used = pairs.select(*by, F.col("submission_id").alias("_s")).distinct()
    return comments.join(used, F.col("submission_id") == F.col("_s")).select(*by, *comments.columns)


def distribution(pairs: DataFrame, by: tuple[str, ...] = ("subreddit", "split"), rule: str = "rule") -> DataFrame:
    """SPL2: (by, total_thread_pairs, n_rules, jsd_from_uniform) of each split.

    The divergence of rules in use from a uniform spread over them; pairs without a rule count in the total alone, and a split without any rule has 1. No list of all groups and rules is made: a rule that a split does not use takes no part.
    """
    used = F.coalesce(F.col(rule), F.lit("")) != ""
    counts = pairs.groupBy(*by, F.when(used, F.col(rule)).alias("_rule")).agg(F.count("*").alias("_n"))
    ruled = F.col("_rule").isNotNull()
    found = counts.groupBy(*by).agg(F.sum("_n").cast("bigint").alias("total_thread_pairs"), F.count_if(ruled).alias("n_rules"), F.sum(F.when(ruled, F.col("_n"))).alias("_all"), F.collect_list(F.when(ruled, F.col("_n"))).alias("_counts"))
    p, u = lambda n: n / F.col("_all"), F.lit(1.0) / F.col("n_rules")
    term = lambda n: p(n) * F.log(2 * p(n) / (p(n) + u)) + u * F.log(2 * u / (p(n) + u))
    jsd = 0.5 * F.aggregate(F.array_sort("_counts"), F.lit(0.0), lambda a, n: a + term(n))
    return found.select(*by, "total_thread_pairs", "n_rules", F.when(F.col("n_rules") > 0, jsd).otherwise(F.lit(1.0)).alias("jsd_from_uniform"))


def stratified(pool: DataFrame, total: int, seed: int, key: str = "key") -> DataFrame:
    """SMP1: uniform targets over clusters but `Other`, no community twice, then filled from `Other`.

    Each choice rules out communities for the next, so candidates are gone through in order. The pool is cut before: of each cluster and community one candidate can be chosen at most, and of each cluster no more than `total` communities can be passed over, so 2 * total communities of each suffice.
    """
    import random

    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("rule_cluster_label"), F.col("subreddit"), F.col(key).cast("string")), 256)
    one = pool.withColumn("_o", digest).groupBy("rule_cluster_label", "subreddit").agg(F.min_by(key, "_o").alias(key), F.min("_o").alias("_o"))
    w = Window.partitionBy("rule_cluster_label").orderBy("_o")
    few = one.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= 2 * total)

    def run(df: pd.DataFrame) -> pd.DataFrame:
        groups = {c: g.sort_values("_o")[["subreddit", key]].values.tolist() for c, g in df.groupby("rule_cluster_label")}
        names = sorted(c for c in groups if c != "Other")
        order = names[:]
        random.Random(seed).shuffle(order)
        base, extra = divmod(total, max(1, len(names)))
        target = {c: base + (i < extra) for i, c in enumerate(order)}
        used, out = set(), []

        def take(cluster: str, most: int) -> None:
            for sub, k in groups.get(cluster, []):
                if most <= 0:
                    return
                if sub not in used:
                    used.add(sub)
                    out.append((cluster, sub, k))
                    most -= 1

        for c in names:
            take(c, target[c])
        take("Other", total - len(out))
        return pd.DataFrame(out, columns=["rule_cluster_label", "subreddit", key])

    kind = pool.schema[key].dataType.simpleString()
    return few.groupBy(F.lit("all")).applyInPandas(run, f"rule_cluster_label string, subreddit string, {key} {kind}")


def bootstrap(scores: DataFrame, groups: tuple[str, ...] = (), replicates: int = REPLICATES, seed: int = SEED, level: float = LEVEL) -> DataFrame:
    """BST1, BST2: grouping, value, low and high of the accuracy's percentile interval, overall and by each of groups.

    A replicate draws as many rows as there are, with replacement. What it needs of a group is how many of its rows it drew with each pair of scores: rows are counted in cells of (groups, scores) first, and a replicate is a multinomial draw over cells, which has the distribution that drawing rows has and needs memory for cells, not rows. Chunks of replicates are seeded apart, so they run anywhere in any order.
    """
    import numpy as np

    counted = scores.groupBy(*groups, "violating", "compliant").agg(F.count("*").alias("n"))
    cells = counted.limit(MOST_CELLS + 1).toPandas().sort_values([*groups, "violating", "compliant"], ignore_index=True)
    if len(cells) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells of groups and scores: scores must be of few values")
    spark = scores.sparkSession
    if cells.empty:
        return spark.createDataFrame([], "grouping string, value string, low double, high double")
    labels: list[tuple[str, str | None]] = [("overall", None)]
    member = [np.ones(len(cells))]
    for g in groups:
        for v in sorted(cells[g].dropna().unique(), key=str):
            labels.append((g, str(v)))
            member.append((cells[g] == v).to_numpy(float))
    n = int(cells["n"].sum())
    v, c = (cells[k].astype(float).to_numpy() for k in ("violating", "compliant"))
    shared = spark.sparkContext.broadcast((np.stack(member), cells["n"].to_numpy() / n, v, c, labels))

    def run(batches):
        who, p, v, c, labels = shared.value
        for df in batches:
            for chunk, size in df.itertuples(index=False):
                drawn = np.random.default_rng([seed, chunk]).multinomial(n, p, size).astype(float)
                mean = lambda x: (drawn * np.nan_to_num(x)) @ who.T / np.maximum((drawn * ~np.isnan(x)) @ who.T, 1)
                value = (mean(v) + mean(c)) / 2
                yield pd.DataFrame({"grouping": [g for g, _ in labels] * size, "value": [x for _, x in labels] * size, "accuracy": value.ravel()})

    chunks = [(i, min(CHUNK, replicates - i * CHUNK)) for i in range(-(-replicates // CHUNK))]
    drawn = spark.createDataFrame(chunks, "chunk long, size long").repartition(min(len(chunks), 64)).mapInPandas(run, "grouping string, value string, accuracy double")
    tail = (1 - level) / 2
    cut = F.percentile("accuracy", F.array(F.lit(tail), F.lit(1 - tail)))
    return drawn.groupBy("grouping", "value").agg(cut.alias("c")).select("grouping", "value", F.col("c")[0].alias("low"), F.col("c")[1].alias("high"))


def with_intervals(accuracies: DataFrame, intervals: DataFrame) -> DataFrame:
    """BST2, REP2: accuracies with their intervals; [0, 0] where a group is empty."""
    i = intervals.select(F.col("grouping").alias("_g"), F.col("value").alias("_v"), "low", "high")
    return accuracies.join(i, (F.col("grouping") == F.col("_g")) & F.col("value").eqNullSafe(F.col("_v")), "left").drop("_g", "_v").fillna(0.0, ["low", "high"])


def group_codes(rows: DataFrame, column: str) -> DataFrame:
    """LOD5: sorted distinct values as codes from 0. A table of distinct groups, which are few."""
    return rows.select(column).where(F.col(column).isNotNull()).distinct().select(column, (F.row_number().over(Window.orderBy(column)) - 1).cast("bigint").alias("code"))
