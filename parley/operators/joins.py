"""Joins by key (JON1-JON15) and set operations (SET1-SET4). Catalyst chooses how; only what the docstrings bound is broadcast."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def of_targets(rows: DataFrame, targets: DataFrame, *keys: str) -> DataFrame:
    """JON1-JON4: rows whose key is among the targets'; repeated targets repeat nothing."""
    return rows.join(targets.select(*keys), list(keys), "left_semi")


def of_finished(rows: DataFrame, statuses: DataFrame, key: str = "submission_id", done: tuple[str, ...] = ("complete", "no_media")) -> DataFrame:
    """JON4: rows whose submission has been dealt with."""
    return of_targets(rows, statuses.where(F.col("status").isin(*done)), key)


def last_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """MAP1: one row for each key, the last in order."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("r")).select(*keys, "r.*")


def first_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("r")).select(*keys, "r.*")


def with_rule_text(comments: DataFrame, rules: DataFrame) -> DataFrame:
    """JON5: the rule's full text by (subreddit, rule name), of repeated rules the last; its name where there is none."""
    known = last_by(rules.select("subreddit", F.col("short_name_clean").alias("rule"), "rule_comprehensive", "rule_index"), ["subreddit", "rule"], "rule_index").drop("rule_index")
    return comments.join(known, ["subreddit", "rule"], "left").withColumn("rule_comprehensive", F.coalesce("rule_comprehensive", "rule"))


def exploded_clusters(clusters: DataFrame, column: str = "subreddit") -> DataFrame:
    """ARR6: a row for each community in a rule's comma list."""
    return clusters.withColumn(column, F.explode(F.split(F.lower(F.col(column)), ","))).withColumn(column, F.trim(column))


def strict(rows: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """JON6, JON7: an inner join that fails, when it runs, on a key the other side lacks."""
    marked = rows.join(other.withColumn("_there", F.lit(True)), list(keys), "left")
    message = F.concat(F.lit("no cluster for "), F.to_json(F.struct(*keys)))
    return marked.where(F.when(F.col("_there"), True).otherwise(F.raise_error(message).cast("boolean"))).drop("_there")


def cluster_name(cluster_id: Column, label: Column, other: str = "Other") -> Column:
    """JON7, AGG18: noise has one label."""
    return F.when(F.coalesce(cluster_id, F.lit(-1)) == -1, other).otherwise(F.coalesce(label, F.lit(other)))


def relabelled(results: DataFrame, communities: DataFrame, rules: DataFrame) -> DataFrame:
    """JON8: cluster ids and labels by community, and by the rule's text alone (its first row); what finds nothing keeps its own."""
    first = first_by(rules.select("rule", F.col("cluster_id").alias("_rid"), F.col("cluster_label").alias("_rlabel"), "seq"), ["rule"], "seq").drop("seq")
    own = communities.select("subreddit", F.col("cluster_id").alias("_cid"), F.col("cluster_label").alias("_clabel"))
    out = results.join(own, "subreddit", "left").join(first, "rule", "left")
    pairs = (("subreddit_cluster_id", "_cid"), ("subreddit_cluster_label", "_clabel"), ("rule_cluster_id", "_rid"), ("rule_cluster_label", "_rlabel"))
    return out.withColumns({a: F.coalesce(b, a) for a, b in pairs}).drop(*[b for _, b in pairs])


def aligned(scores: DataFrame, test_set: DataFrame, *keys: str) -> DataFrame:
    """JON10: the test set's rows with their scores, null where there is none."""
    return test_set.join(scores, list(keys), "left")


def with_traces(examples: DataFrame, traces: DataFrame) -> DataFrame:
    """JON12: a trace only where key, letter and submission agree."""
    t = traces.select(F.concat_ws("__", "mod_comment_id", "thread_type").alias("trace_key"), F.col("letter").alias("correct_answer"), "submission_id", F.struct("*").alias("trace"))
    e = examples.withColumn("trace_key", F.concat_ws("__", "mod_comment_id", "thread_type"))
    return e.join(t, ["trace_key", "correct_answer", "submission_id"], "left")


def by_position(a: DataFrame, b: DataFrame, form: str, order: str) -> DataFrame:
    """JON13: rows of two tables side by side by their place within a form."""
    from pyspark.sql import Window

    w = Window.partitionBy(form).orderBy(order)
    place = lambda df, p: df.select(F.col(form), F.row_number().over(w).alias("place"), F.struct("*").alias(p))
    return place(a, "left").join(place(b, "right"), [form, "place"], "full_outer")


def pairs_within(comments: DataFrame, rules: DataFrame, key: str = "subreddit") -> DataFrame:
    """JON15: each comment with each rule of its community: an equi-join, as many rows as comments times a community's rules."""
    return comments.join(rules, key)


def missing(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """JON14: keys of a that b lacks."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys), "left_anti")


def difference(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """SET3, JON14: keys that only one side has, and which."""
    return missing(a, b, *keys).withColumn("side", F.lit("left")).unionByName(missing(b, a, *keys).withColumn("side", F.lit("right")))


def all_ids(*tables: DataFrame) -> DataFrame:
    """SET1."""
    return reduce(DataFrame.unionByName, tables).distinct()


def tagged(splits: dict[str, DataFrame]) -> DataFrame:
    """SET2: splits in one table, each row with its split's name."""
    return reduce(DataFrame.unionByName, [df.withColumn("split", F.lit(name)) for name, df in splits.items()])


def hydrated(threads: DataFrame, comments: DataFrame, key: str, ids: str, sources: DataFrame | None = None) -> DataFrame:
    """JON9: threads of ids filled with the first copy of each comment, in order.

    An id without a comment is `missing`; one of a community that is not in sources is `source_unavailable`.
    """
    keys = ["subreddit", "id"]
    wanted = threads.select(key, "subreddit", F.posexplode(ids).alias("level", "id"))
    # Only wanted ids are looked for: a semi-join before the copies are compared.
    copies = comments.join(wanted.select(*keys).distinct(), keys, "left_semi")
    found = first_by(copies, keys, "seq")
    body = [c for c in found.columns if c not in keys]
    rows = wanted.join(found.withColumn("_found", F.lit(True)), keys, "left")
    status = F.when(F.col("_found"), "ok").otherwise("missing")
    if sources is not None:
        rows = rows.join(sources.select("subreddit").distinct().withColumn("_source", F.lit(True)), "subreddit", "left")
        status = F.when(F.col("_source").isNull(), "source_unavailable").otherwise(status)
    entry = F.struct("level", "id", status.alias("hydration_status"), *body)
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("thread"))


def dehydrated(pairs: DataFrame, threads: tuple[str, ...] = ("violating_thread", "compliant_thread"), sentinel: str = "[hydrate]", drop: tuple[str, ...] = ("trees",)) -> DataFrame:
    """PRJ4: texts out, ids kept: each thread as its ids, and as many sentinels."""
    more = {f"{t}_ids": F.transform(F.col(t), lambda c: c["id"]) for t in threads} | {t: F.array_repeat(F.lit(sentinel), F.size(t)) for t in threads}
    return pairs.withColumns({k: v for k, v in more.items() if k.endswith("_ids")}).withColumns({k: v for k, v in more.items() if not k.endswith("_ids")}).drop(*drop)


def unfinished(work: DataFrame, done: DataFrame, key: str = "key", content: str = "content") -> DataFrame:
    """MOD4: what is left to do; results without content count as failed and are done again."""
    return work.join(done.where(F.coalesce(F.col(content), F.lit("")) != "").select(key), key, "left_anti")
