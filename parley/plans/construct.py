"""Entry A: from archived comments to labelled, split thread pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as S
from ..operators import aggregates as A
from ..operators import filters as P
from ..operators import joins as J
from ..operators import models as M
from ..operators import similarity, splits, trees
from ..sources import tables
from ..staging import staged


@dataclass(frozen=True)
class Settings:
    """Parameters of construction."""

    gold: float = 99.2
    ambiguous: float = 98.0
    least_rules: int = 2
    cutoff: int = P.CUTOFF
    rng: str = "sha2"


def moderator_comments(lines: DataFrame, strict_prefilter: bool = True) -> DataFrame:
    """Stage 1: replies of moderators who are no bots. The prefilter sees compact JSON only, as archives hold."""
    wanted = ['"distinguished":"moderator"'] if strict_prefilter else ['"distinguished"']
    rows = tables.load_comments(lines.where(F.col("value").contains(wanted[0])))
    return rows.where(P.moderator_reply() & ~P.by_bot()).withColumn("body_clean", S.clean_markup(F.col("body")))


def community_ranks(comments: DataFrame) -> DataFrame:
    """Stage 1, WIN1: communities by moderators' comments."""
    return A.ranked(A.per_key(comments, "subreddit"), "n", "subreddit")


def safe_communities(ranks: DataFrame, communities: DataFrame, least: int = 1) -> DataFrame:
    """Stage 2, FLT5-FLT6, WIN4: safe ones with enough comments, ranked anew."""
    rows = P.at_least(ranks, "n", least).join(communities.where(P.safe_for_work()), "subreddit")
    return A.numbered(rows, [F.asc("rank")], "sfw_rank")


def clean_rules(rules: DataFrame) -> DataFrame:
    """Stage 2, PRJ5: cleaned texts, the rule in full, 1-based index."""
    rows = rules.withColumns({f"{c}_clean": S.clean_markup(F.col(c)) for c in ("short_name", "description", "violation_reason")})
    rows = rows.withColumn("rule_comprehensive", S.rule_text(F.col("short_name_clean"), F.col("description_clean"), F.col("violation_reason_clean")))
    return A.ranked_within(rows.drop("rule_index") if "rule_index" in rules.columns and "seq" in rules.columns else rows, ["subreddit"], [F.col("seq" if "seq" in rules.columns else "rule_index")], "rule_index")


def matches(comments: DataFrame, rules: DataFrame, settings: Settings = Settings(), embedder=M.HashEmbedder) -> DataFrame:
    """Stage 3: each moderator comment's rule, by similarity under percentiles over all scores."""
    kept = P.with_rules(rules, settings.least_rules)
    c = M.embedded(comments.select("subreddit", F.col("id").alias("comment_id"), "body_clean"), embedder, "body_clean")
    r = M.embedded(kept.select("subreddit", "rule_index", "rule_comprehensive"), embedder, "rule_comprehensive")
    scores = staged(similarity.similarities(c, r), "similarity")
    return P.matched(scores, N.thresholds(scores, "score", settings.ambiguous, settings.gold))


def submission_comments(comments: DataFrame, targets: DataFrame) -> DataFrame:
    """Stage 4: comments of the submissions wanted, one copy of each, clean ones first."""
    wanted = J.of_targets(comments, targets, "subreddit", "submission_id")
    return A.prefer_clean(wanted, ["subreddit", "submission_id", "id"], P.removed(), "seq")


def thread_pairs(comments: DataFrame, matched: DataFrame) -> DataFrame:
    """Stage 5."""
    return trees.pairs(comments, matched)


def usable_submissions(submissions: DataFrame, statuses: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Stages 6-8: submissions whose media were dealt with, not removed, not by staff, before the cutoff; of copies the last."""
    rows = J.of_finished(J.last_by(submissions, ["id"], "seq").withColumn("submission_id", F.col("id")), statuses)
    return rows.where(~P.removed_submission() & ~P.by_staff() & P.before_cutoff(cutoff=settings.cutoff))


def final_pairs(pairs: DataFrame, submissions: DataFrame, verdicts: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """Stage 8: pairs of usable submissions that the judge passed, with options, labels and splits."""
    rows = J.of_targets(pairs.where("status = 'success'"), submissions, "submission_id")
    if verdicts is not None:
        rows = J.of_targets(rows, verdicts.where(P.verified()), "mod_comment_id")
    return splits.assigned(splits.with_labels(rows), "subreddit", "mod_comment_id", settings.rng)


def with_clusters(pairs: DataFrame, rules: DataFrame, communities: DataFrame) -> DataFrame:
    """Stage 10, JON6-JON7: cluster ids and labels, strictly: a key without a cluster fails."""
    label = lambda p: J.cluster_name(F.col("cluster_id"), F.col("cluster_label")).alias(f"{p}_cluster_label")
    r = J.exploded_clusters(rules).select("subreddit", F.col("short_name").alias("rule"), F.col("cluster_id").alias("rule_cluster_id"), label("rule"))
    c = communities.select(F.trim(F.lower("subreddit")).alias("subreddit"), F.col("cluster_id").alias("subreddit_cluster_id"), label("subreddit"))
    return J.strict(J.strict(pairs, J.first_by(r.withColumn("_o", F.col("rule_cluster_id")), ["subreddit", "rule"], "_o").drop("_o"), "subreddit", "rule"), c, "subreddit")
