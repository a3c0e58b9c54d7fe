"""Entry C: votes by retrieval, scores, accuracies and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as S
from ..operators import aggregates as A
from ..operators import similarity, splits


def vote_baseline(queries: DataFrame, candidates: DataFrame, k: int, by: str | None = None, options: DataFrame | None = None) -> DataFrame:
    """SIM3, RAG1, TOP1, AGG17: the rule that a query's nearest candidates vote for. candidates: (id, embedding, rule, and by)."""
    near = similarity.nearest(queries, candidates, k, by)
    rules = candidates.select(F.col("id").alias("candidate_id"), "rule")
    return similarity.vote(near.join(rules, "candidate_id"), options=options)


def scored(results: DataFrame) -> DataFrame:
    """MOD3, STR7: 1 where the choice that an answer names is the correct one."""
    one = lambda t: F.coalesce((S.answer_choice(F.col(f"{t}_answer")) == F.col(f"{t}_correct_answer")).cast("int"), F.lit(0))
    return results.withColumns({t: one(t) for t in ("violating", "compliant")})


def evaluated(results: DataFrame, groups: tuple[str, ...], replicates: int = splits.REPLICATES) -> DataFrame:
    """AGG12, AGG13, BST2: accuracies with intervals, overall and by group."""
    return splits.with_intervals(A.accuracy(results, groups), splits.bootstrap(results, groups, replicates))


def relabelled_evaluation(results: DataFrame, communities: DataFrame, rules: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """REP6, JON8: accuracies after a change of labels."""
    from ..operators.joins import relabelled

    return A.accuracy(relabelled(results, communities, rules), groups)
