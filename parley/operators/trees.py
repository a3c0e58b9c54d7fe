"""Comment trees and threads (TREE1-TREE9).

Parents are followed by repeated equi-joins on (submission, id), each round doubling how
far a pointer reaches, so depth d takes log d rounds over all submissions together.
Thread pairing ranks candidates by joins and windows; only the greedy choice, which
depends on order within a submission, runs in a group, on ids and ranks alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as S
from ..staging import staged
from .filters import by_moderator, removed

#: Rounds of doubling: threads up to two to this power deep.
MOST_ROUNDS = 24
#: Rows that a task of a join sorts: what a task holds does not grow with the table.
TASK_ROWS = 1 << 18


def _spread(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """rows dealt by keys for a join by merging, n of them at most on the larger side. Small files of much text are not broadcast."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, -(-n // TASK_ROWS)), *keys).hint("merge")


def edges(comments: DataFrame) -> DataFrame:
    """TREE1: (submission_id, comment_id, parent_id, is_root). Comments without a parent are left out; a parent that is a submission makes a root. Numbers as parents are left out too, where raw tells them from text."""
    rows = comments.where(F.coalesce(F.col("parent_id"), F.lit("")) != "")
    if "raw" in comments.columns:
        rows = rows.where(F.coalesce(F.expr("schema_of_variant(variant_get(try_parse_json(raw), '$.parent_id'))"), F.lit("STRING")) == "STRING")
    root = F.col("parent_id").startswith("t3_")
    return rows.select("submission_id", F.col("id").alias("comment_id"), F.when(~root, S.strip_kind(F.col("parent_id"), "t1")).alias("parent_id"), root.alias("is_root"))


def depths(tree: DataFrame) -> DataFrame:
    """TREE2: edges with depth, 0 for roots. Orphans and cycles reach no root and have none: they are left out.

    Each open node points `far` steps up and settles when its pointer meets a settled one; pointers double every round. A round writes the nodes that were open in it and no other.
    """
    columns = ["submission_id", "comment_id", "parent_id", "is_root", "depth", "up", "far"]
    now = staged(tree.select("submission_id", "comment_id", "parent_id", "is_root", F.when(F.col("is_root"), F.lit(0)).alias("depth"), F.col("parent_id").alias("up"), F.lit(1).alias("far")), "depths")
    settled = now.where("depth IS NOT NULL")
    # No thread is longer than its submission: pointers that reach farther go in circles.
    longest, n = now.groupBy("submission_id").count().agg(F.max("count"), F.sum("count")).first()
    longest, n = longest or 0, n or 0
    for i in range(MOST_ROUNDS):
        open_ = now.where("depth IS NULL")
        if 1 << i > longest or open_.isEmpty():
            break
        above = settled.unionByName(open_).select("submission_id", F.col("comment_id").alias("up"), F.col("depth").alias("_d"), F.col("up").alias("_up"), F.col("far").alias("_far"))
        met = _spread(open_, n, "submission_id", "up").join(_spread(above, n, "submission_id", "up"), ["submission_id", "up"])  # a pointer to nothing never meets a root
        now = staged(met.select("submission_id", "comment_id", "parent_id", "is_root", (F.col("_d") + F.col("far")).alias("depth"), F.col("_up").alias("up"), (F.col("far") + F.col("_far")).alias("far")).select(*columns), "depths")
        settled = settled.unionByName(now.where("depth IS NOT NULL"))
    return settled.select("submission_id", "comment_id", "parent_id", "is_root", "depth")


def walked(nodes: DataFrame) -> DataFrame:
    """nodes (submission_id, comment_id, parent_id, issue and others) without parent_id, with ids, the ids from the comment to its root, or as far as parents are known, issue, the first on that way, and above, the first on it after the comment itself.

    Pointers double every round, and what lies between is joined on: a round writes the nodes that have not come to their root.
    """
    rest = [c for c in nodes.columns if c not in ("submission_id", "comment_id", "parent_id", "issue")]
    now = staged(nodes.select("submission_id", "comment_id", F.col("parent_id").alias("up"), F.array("comment_id").alias("ids"), "issue", F.lit(None).cast("string").alias("above"), *rest), "walked")
    n = now.count()
    done = now.where("up IS NULL")
    for _ in range(MOST_ROUNDS):
        open_ = now.where("up IS NOT NULL")
        if open_.isEmpty():
            break
        above = done.unionByName(open_).select("submission_id", F.col("comment_id").alias("up"), F.col("up").alias("_up"), F.col("ids").alias("_ids"), F.col("issue").alias("_issue"))
        met = _spread(open_, n, "submission_id", "up").join(_spread(above, n, "submission_id", "up"), ["submission_id", "up"], "left")
        ids = F.when(F.col("_ids").isNull(), F.col("ids")).otherwise(F.concat("ids", "_ids"))
        now = staged(met.select("submission_id", "comment_id", F.col("_up").alias("up"), ids.alias("ids"), F.coalesce("issue", "_issue").alias("issue"), F.coalesce("above", "_issue").alias("above"), *rest), "walked")
        done = done.unionByName(now.where("up IS NULL"))
    return done.drop("up")


def has_media() -> Column:
    filled = lambda c: ~F.coalesce(F.col(c), F.lit("")).isin("", "null", "{}", "false")
    return filled("media") | filled("media_metadata")


def comment_flags(comments: DataFrame, tree: DataFrame) -> DataFrame:
    """FLT12: what each comment fails on its own: removed, media, moderator; edited and answered by a moderator count at the leaf only.

    `edited` must be exactly false where it is there at all: an explicit null fails.
    """
    edited = F.col("edited").isNotNull() & (F.col("edited") != "false")
    if "raw" in comments.columns:
        edited = edited | (F.array_contains(F.json_object_keys("raw"), "edited") & F.col("edited").isNull())
    mods = comments.where(by_moderator()).join(tree.select("submission_id", F.col("comment_id").alias("id"), F.col("parent_id").alias("_up")), ["submission_id", "id"])
    answered = mods.select("submission_id", F.col("_up").alias("id")).distinct().withColumn("answered", F.lit(True))
    first = F.when(removed(), "removed_or_deleted").when(has_media(), "has_media").when(by_moderator(), "moderator_in_thread")
    rows = comments.join(answered, ["submission_id", "id"], "left")
    return rows.select("submission_id", F.col("id").alias("comment_id"), first.alias("issue"), F.coalesce(edited, F.lit(False)).alias("edited_leaf"), F.coalesce("answered", F.lit(False)).alias("answered_leaf"), F.coalesce("score", F.lit(0)).alias("score"))


def threads(comments: DataFrame, tree: DataFrame) -> DataFrame:
    """TREE4: each comment's thread root to leaf (ids, with level), its length, and the first issue met from leaf to root in either role."""
    keys = ["submission_id", "comment_id"]
    flags = comment_flags(comments, tree)
    # What a leaf has of its own goes with it, so that nothing is joined to the paths again.
    rows = walked(tree.select(*keys, "parent_id").join(flags.withColumn("own", F.col("issue")), keys))
    # At the leaf its own three checks come before the role's; then its ancestors'.
    return rows.select(
        *keys,
        F.transform(F.reverse("ids"), lambda x, i: F.struct(i.alias("level"), x.alias("id"))).alias("thread"),
        F.coalesce("own", F.when(F.col("edited_leaf"), "edited_comment"), "above").alias("violating_issue"),
        F.coalesce("own", F.when(F.col("answered_leaf"), "mod_response"), "above").alias("compliant_issue"),
        "score",
        F.size("ids").alias("length"),
    )


def candidates(violating: DataFrame, tree: DataFrame, of_violating: tuple[str, ...] = (), of_others: tuple[str, ...] = ()) -> DataFrame:
    """TREE5: for each violating comment (mod_comment_id, submission_id, comment_id, depth, parent_id), comments at its depth and, from depth 2, at the one above but its own parent: one equi-join. of_violating, of_others: further columns of either side that its pairs keep."""
    v = violating.select("mod_comment_id", "submission_id", F.col("comment_id").alias("violating_id"), F.col("depth").alias("violating_depth"), F.col("parent_id").alias("violating_parent"), *of_violating)
    alt = tree.select("submission_id", F.col("comment_id").alias("alt_id"), F.col("depth").alias("alt_depth"), *of_others)
    own, on = F.col("violating_depth"), ["submission_id", "alt_depth"]
    v = v.withColumn("alt_depth", F.explode(F.when(own >= 2, F.array(own, own - 1)).otherwise(F.array(own))))
    n = tree.count()
    rows = _spread(v, n, *on).join(_spread(alt, n, *on), on)
    return rows.where((F.col("alt_depth") == own) | ~F.col("alt_id").eqNullSafe(F.col("violating_parent"))).where("alt_id <> violating_id")


def ranked_candidates(violating: DataFrame, tree: DataFrame, thread: DataFrame) -> DataFrame:
    """TREE5, TREE6, WIN7: candidates() without issues by shared ancestors and length, the most first, then score, the least first, then id.

    Threads are joined to comments, before these meet: pairs never carry one through a shuffle.
    """
    from ..functions.numbers import common_prefix

    keys, ids = ["submission_id", "comment_id"], F.transform("thread", lambda c: c["id"])
    n = thread.count()
    a = _spread(thread.select(*keys, ids.alias("_v")), n, *keys)
    b = _spread(thread.where("compliant_issue IS NULL").select(*keys, ids.alias("_c"), F.col("length").alias("alt_length"), F.col("score").alias("alt_score")), n, *keys)
    v = _spread(violating.select(*keys, "mod_comment_id", "depth", "parent_id"), n, *keys).join(a, keys)
    others = staged(_spread(tree.select(*keys, "depth"), n, *keys).join(b, keys), "others")
    rows = candidates(v, others, ("_v",), ("_c", "alt_length", "alt_score"))
    rows = rows.withColumn("common_ancestors", common_prefix(F.col("_v"), F.col("_c"))).drop("_v", "_c", "violating_depth", "violating_parent", "alt_depth")
    w = Window.partitionBy("submission_id", "mod_comment_id").orderBy(F.desc("common_ancestors"), F.desc("alt_length"), "alt_score", "alt_id")
    return rows.withColumn("rank", F.row_number().over(w).cast("bigint"))


def greedy(ranked: DataFrame) -> DataFrame:
    """TREE8, TREE9: within a submission, moderators' comments in order of id each take the best alternative that none before took.

    Group by group on ids and ranks alone; batches of a group are gone through one by one, holding what was taken.
    """
    import pandas as pd

    rows = ranked.select("submission_id", "mod_comment_id", "rank", "alt_id")

    def run(batches):
        now, taken, done = None, set(), None
        for df in batches:
            out = []
            for sub, mod, _, alt in df.itertuples(index=False):
                if sub != now:
                    now, taken, done = sub, set(), None
                if done != mod and alt not in taken:
                    taken.add(alt)
                    done = mod
                    out.append((sub, mod, alt))
            yield pd.DataFrame(out, columns=["submission_id", "mod_comment_id", "alt_id"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    # A submission's rows stand together, sorted, within one partition; memory holds only the ids it took.
    spread = rows.repartition("submission_id").sortWithinPartitions("submission_id", "mod_comment_id", "rank")
    return spread.mapInPandas(run, f"submission_id {kind['submission_id']}, mod_comment_id {kind['mod_comment_id']}, alt_id {kind['alt_id']}")


def pairs(comments: DataFrame, matches: DataFrame) -> DataFrame:
    """TREE7: a row for each matched moderator comment (mod_comment_id, submission_id, violating_comment_id): status, and the pair where it is `success`."""
    tree = depths(edges(comments))
    thread = staged(threads(comments, tree), "threads")
    v = matches.select("mod_comment_id", "submission_id", F.col("violating_comment_id").alias("comment_id"))
    known = comments.select("submission_id", F.col("id").alias("comment_id")).distinct().withColumn("_there", F.lit(True))
    v = v.join(known, ["submission_id", "comment_id"], "left").join(tree.select("submission_id", "comment_id", "parent_id", "depth"), ["submission_id", "comment_id"], "left")
    v = v.join(thread.select("submission_id", "comment_id", "violating_issue", F.col("thread").alias("violating_thread"), F.col("score").alias("violating_score")), ["submission_id", "comment_id"], "left")
    status = F.when(F.col("_there").isNull(), "missing_violating_comment").when(F.col("depth").isNull(), "missing_depth").when(F.col("violating_issue").isNotNull(), F.concat(F.lit("violating_thread_has_"), F.col("violating_issue")))
    v = staged(v.withColumn("status", status), "violating")
    open_ = v.where("status IS NULL").select("mod_comment_id", "submission_id", "comment_id", "depth", "parent_id")
    order = ranked_candidates(open_, tree, thread).select("submission_id", "mod_comment_id", "rank", "alt_id", "common_ancestors")
    # Of a submission's i-th moderator comment, the ones before take i - 1 alternatives at most.
    place = F.dense_rank().over(Window.partitionBy("submission_id").orderBy("mod_comment_id"))
    order = staged(order.withColumn("_place", place).where(F.col("rank") <= F.col("_place")).drop("_place"), "candidates")
    chosen = greedy(order).join(order, ["submission_id", "mod_comment_id", "alt_id"])
    c = thread.select("submission_id", F.col("comment_id").alias("compliant_comment_id"), F.col("thread").alias("compliant_thread"), F.col("score").alias("compliant_score"))
    chosen = chosen.select("submission_id", "mod_comment_id", F.col("alt_id").alias("compliant_comment_id"), "common_ancestors").join(c, ["submission_id", "compliant_comment_id"])
    rows = v.join(chosen, ["submission_id", "mod_comment_id"], "left")
    return rows.select("mod_comment_id", "submission_id", F.col("comment_id").alias("violating_comment_id"), "compliant_comment_id", F.coalesce("status", F.when(F.col("compliant_comment_id").isNull(), "no_alternative_found"), F.lit("success")).alias("status"), "common_ancestors", F.col("depth").alias("violating_depth"), "violating_score", "compliant_score", "violating_thread", "compliant_thread")


def pair_status(found: DataFrame) -> DataFrame:
    """TREE7's counters, and successes by the violating thread's length."""
    return found.groupBy("status", F.when(F.col("status") == "success", F.size("violating_thread")).alias("length")).agg(F.count("*").alias("n"))
