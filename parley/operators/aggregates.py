"""Aggregations (AGG1-AGG23, AGG-D1) and ranking (WIN1-WIN8, TOP1-TOP3, SRT1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..staging import staged
from .joins import cluster_name


#: Items that in_buckets deals out.
MOST_ITEMS = 1_000_000


def per_key(rows: DataFrame, *keys: str) -> DataFrame:
    """AGG1."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def merged_stats(parts: DataFrame, key: str = "name", n: str = "n") -> DataFrame:
    """AGG2."""
    return parts.groupBy(key).agg(F.sum(n).alias(n))


def match_stats(comments: DataFrame, matches: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """AGG3: totals of each community's comments, matched and ambiguous ones, and the matched share."""
    count = lambda df, name: df.groupBy("subreddit").agg(F.count("*").alias(name))
    rows = count(comments, "total").join(count(matches, "matched"), "subreddit", "left").join(count(ambiguous, "ambiguous"), "subreddit", "left")
    rows = rows.fillna(0, ["matched", "ambiguous"])
    return rows.withColumn("matched_percent", F.coalesce(F.try_divide(100.0 * F.col("matched"), F.col("total")), F.lit(0.0)))


def match_summary(stats: DataFrame) -> DataFrame:
    """AGG4: one row over match_stats: communities, those with matches, totals, and the shares matched and ambiguous in percent (0 of nothing)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    rate = lambda c: F.coalesce(F.try_divide(100.0 * F.sum(c), F.sum("total")), F.lit(0.0))
    return stats.agg(F.count("*").alias("communities"), F.count_if(F.col("matched") > 0).alias("with_matches"), total("total").alias("total"), total("matched").alias("matched"), total("ambiguous").alias("ambiguous"), rate("matched").alias("match_rate"), rate("ambiguous").alias("ambiguous_rate"))


def rule_counts(rules: DataFrame, matches: DataFrame, *keys: str) -> DataFrame:
    """AGG3: matches of every rule, none included."""
    keys = keys or ("subreddit", "rule_index")
    n = matches.groupBy(*keys).agg(F.count("*").alias("n"))
    return rules.select(*keys).distinct().join(n, list(keys), "left").fillna(0, ["n"])


def totals_by_index(counts: DataFrame, top: int = 20) -> DataFrame:
    """AGG5: over communities, by the rule's index, the largest first. Rules that share an index are taken together, as the index is all that is compared."""
    return counts.groupBy("rule_index").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "rule_index").limit(top)


def divergence_by(counts: DataFrame, rules: DataFrame | None, by: str, category: str, n: str = "n") -> DataFrame:
    """AGG6: over all rules given, with zeros, or, without rules, over those observed."""
    if rules is not None:
        every = rules.select(by, category).union(counts.select(by, category)).distinct()
        counts = every.join(counts, [by, category], "left").fillna(0, [n])
    return N.divergence(counts, [by], n)


def prefer_clean(rows: DataFrame, keys: list[str], is_removed: Column, order: str) -> DataFrame:
    """AGG-D1: one copy of each key, the first clean one or else the first."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(is_removed, F.col(order))).alias("r"))
    return best.select(*keys, "r.*")


def clean_counters(rows: DataFrame, keys: list[str], is_removed: Column, order: str) -> DataFrame:
    """AGG-D1's counters, one row: first copies that are removed, of these later replaced, and removed copies seen after a clean one."""
    marked = rows.select(*keys, is_removed.alias("gone"), F.col(order).alias("_o"))
    w = Window.partitionBy(*keys)
    seen = marked.select("*", F.min("_o").over(w).alias("_first"), F.min(F.when(~F.col("gone"), F.col("_o"))).over(w).alias("_clean"))
    first = F.col("_o") == F.col("_first")
    return seen.agg(
        F.count_if(first & F.col("gone")).alias("removed"),
        F.count_if(first & F.col("gone") & F.col("_clean").isNotNull()).alias("overwritten"),
        F.count_if(F.col("gone") & (F.col("_o") > F.col("_clean"))).alias("preserved"),
    )


def distinct_counts(pairs: DataFrame) -> DataFrame:
    """AGG7, AGG9: exact."""
    return pairs.agg(F.count("*").alias("pairs"), F.count_distinct("subreddit").alias("communities"), F.count_distinct("subreddit", "rule").alias("rules"), F.count_distinct("rule_cluster_label").alias("rule_clusters"), F.count_distinct("subreddit_cluster_label").alias("community_clusters"))


def cluster_sizes(pairs: DataFrame, label: str, counted: str) -> DataFrame:
    """AGG8: distinct members and pairs of each label, by split and over all (split null)."""
    return pairs.groupingSets([["split", label], [label]], "split", label).agg(F.count_distinct(counted).alias("members"), F.count("*").alias("pairs"))


def split_totals(pairs: DataFrame) -> DataFrame:
    """AGG10."""
    return pairs.groupBy("split").agg(F.count("*").alias("pairs"), F.count_distinct("submission_id").alias("submissions"), F.count_if(F.size("media_files") > 0).alias("with_media"), F.sum(F.size("media_files")).alias("media"), F.sum(F.size("violating_thread") + F.size("compliant_thread")).alias("comments"))


def histogram(rows: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """AGG11: counts in half-open ranges between edges and beyond the last; empty ranges stay."""
    ranges = rows.sparkSession.createDataFrame([(i, float(a), float(b) if b is not None else None) for i, (a, b) in enumerate(zip(edges, [*edges[1:], None], strict=True))], "bucket int, low double, high double")
    place = F.lit(None).cast("int")
    for i, low in enumerate(edges):
        place = F.when(F.col(value) >= F.lit(float(low)), F.lit(i)).otherwise(place)
    counts = rows.select(place.alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    return ranges.join(counts, "bucket", "left").fillna(0, ["n"])


def accuracy(results: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """AGG12, AGG13: overall and by each of groups in one pass: grouping (its name, or `overall`), value, n and the three accuracies; null groups are left out.

    results: violating and compliant scores as 0 or 1.
    """
    sets = [[g] for g in groups] + [[]]
    both = F.sum("violating") + F.sum("compliant")
    measures = [F.count("*").alias("n"), F.coalesce(F.try_divide(both, 2 * F.count("*")), F.lit(0.0)).alias("accuracy"), F.coalesce(F.try_divide(F.sum("violating"), F.count("*")), F.lit(0.0)).alias("violating_accuracy"), F.coalesce(F.try_divide(F.sum("compliant"), F.count("*")), F.lit(0.0)).alias("compliant_accuracy")]
    if not groups:
        return results.agg(*measures).select(F.lit("overall").alias("grouping"), F.lit(None).cast("string").alias("value"), "*")
    out = results.groupingSets(sets, *groups).agg(*measures, *[F.grouping(g).alias(f"_g_{g}") for g in groups])
    name, value = F.lit("overall"), F.lit(None).cast("string")
    for g in groups:
        name = F.when(F.col(f"_g_{g}") == 0, g).otherwise(name)
        value = F.when(F.col(f"_g_{g}") == 0, F.col(g).cast("string")).otherwise(value)
    rows = out.select(name.alias("grouping"), value.alias("value"), "n", "accuracy", "violating_accuracy", "compliant_accuracy")
    return rows.where((F.col("grouping") == "overall") | F.col("value").isNotNull())


def majority(votes: DataFrame, keys: list[str], label: str, order: str) -> DataFrame:
    """AGG14: the label with most votes, of equals the one first seen."""
    n = votes.groupBy(*keys, label).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return n.groupBy(*keys).agg(F.min_by(label, F.struct(-F.col("n"), F.col("first"))).alias(label))


def agreed(annotations: DataFrame, key: str = "question_index", least: int = 2) -> DataFrame:
    """AGG15: answers that at least so many annotators selected. annotations: (key, annotator_id, selected array)."""
    votes = annotations.select(key, "annotator_id", F.explode(F.array_distinct("selected")).alias("answer"))
    return votes.groupBy(key, "answer").agg(F.count_distinct("annotator_id").alias("votes")).where(F.col("votes") >= least)


def ground_truth(items: DataFrame, annotations: DataFrame, key: str = "question_index") -> DataFrame:
    """AGG16: each item's answers by majority, else adjudicated, else none, and whether the prediction is among them."""
    most = agreed(annotations, key).groupBy(key).agg(F.array_sort(F.collect_set("answer")).alias("majority"))
    votes = annotations.groupBy(key).agg(F.count_distinct(F.to_json(F.struct(F.array_sort("selected").alias("s")))).alias("_kinds"))
    rows = items.join(most, key, "left").join(votes, key, "left")
    adjudicated = F.when(F.size("adjudicated_answers") > 0, F.col("adjudicated_answers"))
    truth = F.coalesce("majority", adjudicated)
    source = F.when(F.col("majority").isNotNull(), "majority").when(adjudicated.isNotNull(), "adjudicated").otherwise("none")
    agreement = F.when(F.col("_kinds") == 1, "unanimous").when(F.col("majority").isNotNull(), "majority").otherwise("none")
    return rows.select(*items.columns, truth.alias("truth"), source.alias("truth_source"), agreement.alias("agreement"), F.coalesce(F.array_contains(truth, F.col("predicted_answer")), F.lit(False)).alias("correct"))


def label_distribution(rows: DataFrame, cluster_id: str = "cluster_id", label: str = "cluster_label") -> DataFrame:
    """AGG18."""
    return rows.groupBy(F.lower(cluster_name(F.col(cluster_id), F.col(label), "other")).alias("label")).agg(F.count("*").alias("n"))


def centroids(points: DataFrame) -> DataFrame:
    """AGG19: median place and first label of each cluster."""
    return points.groupBy("cluster_id").agg(F.median("x").alias("x"), F.median("y").alias("y"), F.min_by("cluster_label", "seq").alias("label"))


def pass_rates(verdicts: DataFrame) -> DataFrame:
    """AGG20: judged, passed and rate, by community and over all (subreddit null)."""
    return verdicts.rollup("subreddit").agg(F.count("*").alias("judged"), F.count_if("passed").alias("passed"), F.coalesce(F.try_divide(F.count_if("passed"), F.count("*")), F.lit(0.0)).alias("rate"))


def rule_texts(rules: DataFrame) -> DataFrame:
    """AGG21: a row for each text over all splits, of rules that occur in pairs: its first row, with splits and communities as sorted lists and violations summed."""
    return rules.where("violations > 0").groupBy("full_text").agg(F.min_by("short_name", "seq").alias("short_name"), F.min_by("description", "seq").alias("description"), F.sum("violations").alias("total_violations"), N.sorted_join(F.col("split")).alias("splits"), N.sorted_join(F.col("subreddit")).alias("subreddit"), F.count_distinct("subreddit").alias("num_subreddits"))


def longest_input(prompts: DataFrame) -> DataFrame:
    """AGG22."""
    return prompts.agg(F.max(F.size("token_ids")).alias("max_tokens"), F.max(F.size("images")).alias("max_images"))


def interval_widths(ci: DataFrame) -> DataFrame:
    """AGG23: least, mean and largest half-width."""
    half = (F.col("high") - F.col("low")) / 2
    return ci.agg(F.min(half).alias("min_half"), F.avg(half).alias("avg_half"), F.max(half).alias("max_half"))


def numbered(rows: DataFrame, order: list[Column], into: str) -> DataFrame:
    """1-based numbers in an order over all rows.

    Rows are sorted in ranges, counted by range, and numbered within theirs: no task sees all rows. The ranges are staged, as drawn twice they could differ; their counts are a row for each range.
    """
    spread = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    placed = spread.withColumn("_part", F.shiftright("_at", 33))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(into, F.col("_before") + F.col("_at") - F.shiftleft("_part", 33) + 1).drop("_at", "_part", "_before")


def numbered_within(rows: DataFrame, key: str, order: list[Column], into: str) -> DataFrame:
    """1-based numbers within groups of any size: numbers over all rows by key and order, less each group's first."""
    out = numbered(rows, [F.asc(key), *order], "_no")
    first = out.groupBy(F.col(key).alias("_key")).agg(F.min("_no").alias("_first"))
    return out.join(first, F.col(key).eqNullSafe(F.col("_key"))).withColumn(into, F.col("_no") - F.col("_first") + 1).drop("_no", "_key", "_first")


def ranked(rows: DataFrame, score: str, tie: str, ok: Column | None = None, into: str = "rank", excluded: int = 999999) -> DataFrame:
    """WIN1, WIN2: 1-based rank by score, the largest first, nulls last; rows that are not ok get a rank beyond all."""
    order = [F.desc_nulls_last(score), F.asc(tie)]
    if ok is None:
        return numbered(rows, order, into)
    mark = F.coalesce(ok, F.lit(False))
    return numbered(rows.where(mark), order, into).unionByName(rows.where(~mark).withColumn(into, F.lit(excluded).cast("bigint")))


def ranked_english(rows: DataFrame, score: str, tie: str, language: str = "language", into: str = "rank") -> DataFrame:
    """WIN3: 1-based rank by score, the smallest first, among rows in exactly `en`; those in other languages or none have no rank."""
    english = F.coalesce(F.col(language) == "en", F.lit(False))
    some = numbered(rows.where(english), [F.asc_nulls_last(score), F.asc(tie)], into)
    return some.unionByName(rows.where(~english).withColumn(into, F.lit(None).cast("bigint")))


def ranked_within(rows: DataFrame, keys: list[str], order: list[Column], into: str = "rank") -> DataFrame:
    """WIN7: row numbers in groups."""
    return rows.withColumn(into, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))


def top_within(rows: DataFrame, keys: list[str], order: list[Column], k: int, into: str = "rank") -> DataFrame:
    """TOP1: the first k of each group; Spark limits groups before it shuffles them."""
    return ranked_within(rows, keys, order, into).where(F.col(into) <= k)


def best_by(rows: DataFrame, keys: list[str], value: str, score: str, tie: str) -> DataFrame:
    """WIN5: the value with the largest score, of equals the one with the smallest tie."""
    return rows.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col(score), F.col(tie))).alias(value), F.max(score).alias(score))


def with_previous(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """WIN6: the last earlier value that is neither null nor zero, and the difference from it."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.nullif(F.col(value), F.lit(0.0)), ignorenulls=True).over(w)
    return rows.withColumn("previous", before).withColumn("delta", F.col(value) - F.col("previous"))


def renumbered(clusters: DataFrame, cluster_id: str = "cluster_id") -> DataFrame:
    """WIN8: (old, new) ids, contiguous from 1 in order; noise keeps -1. The ids of clusters are few: their table is ranked in one task."""
    ids = clusters.select(F.col(cluster_id).alias("old")).where("old IS NOT NULL").distinct()
    w = Window.partitionBy(F.col("old") == -1).orderBy("old")
    return ids.select("old", F.when(F.col("old") == -1, F.lit(-1)).otherwise(F.row_number().over(w)).cast("bigint").alias("new"))


def in_buckets(items: DataFrame, key: str, size: str, buckets: int) -> DataFrame:
    """SRT1: each item's bucket, the largest first to the least loaded. Order-dependent over all items: for lists of files or communities, which one task holds. More than MOST_ITEMS raise."""
    import heapq

    import pandas as pd

    def run(df: pd.DataFrame) -> pd.DataFrame:
        loads = [(0, b) for b in range(buckets)]
        out = []
        for k, s in df.sort_values([size, key], ascending=[False, True])[[key, size]].itertuples(index=False):
            load, b = heapq.heappop(loads)
            out.append((k, s, b))
            heapq.heappush(loads, (load + s, b))
        return pd.DataFrame(out, columns=[key, size, "bucket"])

    if items.limit(MOST_ITEMS + 1).count() > MOST_ITEMS:
        raise ValueError(f"more than {MOST_ITEMS} items for one task")
    kinds = {f.name: f.dataType.simpleString() for f in items.schema.fields}
    return items.select(key, size).groupBy(F.lit("all")).applyInPandas(run, f"{key} {kinds[key]}, {size} {kinds[size]}, bucket int")
