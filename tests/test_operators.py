"""Joins, trees, retrieval, sources and sinks against plain Python on random fixtures."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from parley.functions import numbers as N
from parley.operators import aggregates as A
from parley.operators import clusters as C
from parley.operators import filters as P
from parley.operators import joins as J
from parley.operators import media as M
from parley.operators import models, similarity, splits, trees
from parley.operators import validation as V
from parley.plans import construct, hydrate
from parley.sources import sinks, tables

COMMENT = "submission_id string, id string, parent_id string, author string, body string, distinguished string, media string, media_metadata string, edited string, score bigint"


def forest(seed: int, n: int = 60):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        sub = str(rng.randrange(3))
        earlier = [r[1] for r in rows if r[0] == sub]
        kind = rng.random()
        parent = f"t3_{sub}" if kind < 0.25 or not earlier else f"t1_{rng.choice(earlier)}" if kind < 0.9 else rng.choice(["t1_gone", "", f"t1_c{(k + 1) % n}"])
        rows.append((sub, f"c{k}", parent, rng.choice(["a", "b", "[deleted]", "m"]), rng.choice(["x", "y", "[removed]", "z"]), rng.choice([None, None, None, "moderator"]), rng.choice([None, None, None, '{"a":1}']), None, rng.choice(["false", "false", "16.0", None]), rng.choice([None, 1, 2, 3])))
    return rows


def plain_threads(rows):
    by = {(r[0], r[1]): r for r in rows}
    kids = {}
    for r in rows:
        if r[2].startswith("t1_"):
            kids.setdefault((r[0], r[2][3:]), []).append(r)

    def walk(sub, cid, mode):
        path, seen, at = [], set(), cid
        while (sub, at) in by and at not in seen:
            seen.add(at)
            r = by[sub, at]
            path.append(at)
            if r[4] in P.S.GONE or r[3] in P.S.GONE:
                return None, "removed_or_deleted"
            if r[6] or r[7]:
                return None, "has_media"
            if r[5] == "moderator":
                return None, "moderator_in_thread"
            if len(path) == 1 and mode == "violating" and r[8] not in ("false", None):
                return None, "edited_comment"
            if len(path) == 1 and mode == "compliant" and any(c[5] == "moderator" for c in kids.get((sub, at), [])):
                return None, "mod_response"
            if r[2].startswith("t3_") or not r[2]:
                break
            at = r[2][3:]
        return path[::-1], None

    return walk


def plain_depths(rows):
    out = {(r[0], r[1]): 0 for r in rows if r[2].startswith("t3_")}
    moved = True
    while moved:
        moved = False
        for r in rows:
            k = r[0], r[1]
            if k not in out and r[2].startswith("t1_") and (r[0], r[2][3:]) in out:
                out[k], moved = out[r[0], r[2][3:]] + 1, True
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_trees_and_threads(spark, seed):
    rows = forest(seed)
    comments = spark.createDataFrame(rows, COMMENT)
    tree = trees.edges(comments)
    depth = {(r["submission_id"], r["comment_id"]): r["depth"] for r in trees.depths(tree).collect()}
    assert depth == plain_depths(rows)
    walk = plain_threads(rows)
    found = {(r["submission_id"], r["comment_id"]): r for r in trees.threads(comments, tree).collect()}
    for r in rows:
        if not r[2]:
            continue
        for mode in ("violating", "compliant"):
            path, issue = walk(r[0], r[1], mode)
            assert found[r[0], r[1]][f"{mode}_issue"] == issue, (r, mode)
            if issue is None:
                assert [c["id"] for c in found[r[0], r[1]]["thread"]] == path


def test_greedy_takes_each_alternative_once(spark):
    ranked = spark.createDataFrame([("s", "m1", 1, "a"), ("s", "m1", 2, "b"), ("s", "m2", 1, "a"), ("s", "m2", 2, "b"), ("s", "m3", 1, "a"), ("t", "m4", 1, "a")], "submission_id string, mod_comment_id string, rank bigint, alt_id string")
    assert {tuple(r) for r in trees.greedy(ranked).collect()} == {("s", "m1", "a"), ("s", "m2", "b"), ("t", "m4", "a")}


def test_pairs_status(spark):
    rows = [("s", "a", "t3_s", "u", "x", None, None, None, "false", 1), ("s", "b", "t3_s", "u", "y", None, None, None, "false", 2), ("s", "c", "t1_a", "u", "z", None, None, None, "99", 2)]
    matches = spark.createDataFrame([("m1", "s", "a"), ("m2", "s", "gone"), ("m3", "s", "c")], "mod_comment_id string, submission_id string, violating_comment_id string")
    found = {r["mod_comment_id"]: (r["status"], r["compliant_comment_id"]) for r in trees.pairs(spark.createDataFrame(rows, COMMENT), matches).collect()}
    assert found == {"m1": ("success", "b"), "m2": ("missing_violating_comment", None), "m3": ("violating_thread_has_edited_comment", None)}


def test_prefer_clean(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(8), i, rng.random() < 0.5) for i in range(80)]
    df = spark.createDataFrame(rows, "k int, seq int, gone boolean")
    best, removed, over, kept = {}, 0, 0, 0
    for k, i, gone in rows:
        if k not in best:
            best[k] = (i, gone)
            removed += gone
        elif best[k][1] and not gone:
            best[k] = (i, gone)
            over += 1
        elif gone and not best[k][1]:
            kept += 1
    assert {(r["k"], r["seq"]) for r in A.prefer_clean(df, ["k"], F.col("gone"), "seq").collect()} == {(k, i) for k, (i, _) in best.items()}
    assert tuple(A.clean_counters(df, ["k"], F.col("gone"), "seq").first()) == (removed, over, kept)


def test_matching_rules(spark):
    rows = [("s", "exact", 1, 5.0), ("s", "exact", 2, 1.0), ("s", "two", 1, 9.0), ("s", "two", 2, 4.5), ("s", "tie", 1, 5.0), ("s", "tie", 2, 0.0), ("s", "edge", 1, 6.0), ("s", "edge", 2, 4.0), ("s", "low", 1, 4.9)]
    scores = spark.createDataFrame(rows, "subreddit string, comment_id string, rule_index int, score double")
    cuts = spark.createDataFrame([(4.0, 5.0)], "ambiguous double, gold double")
    assert {(r["comment_id"], r["rule_index"]) for r in P.matched(scores, cuts).collect()} == {("exact", 1), ("tie", 1), ("edge", 1)}


def test_nearest_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (120, 6)).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id long, embedding array<double>, b long")
    for by in (None, "b"):
        found = {}
        for r in similarity.nearest(df.where("id % 4 = 0"), df, 5, by, block=16).collect():
            found.setdefault(r["query_id"], {})[r["rank"]] = r["candidate_id"]
        for q in range(0, 120, 4):
            pool = [i for i in range(120) if i != q and (by is None or i % 3 == q % 3)]
            want = sorted(pool, key=lambda i: (-round(float(x[q] @ x[i]), 12), i))[:5]
            assert [found[q][k] for k in range(1, 6)] == want


def test_votes(spark):
    rows = [(1, "x", 0.5, 1), (1, "y", 0.9, 2), (1, "x", 0.1, 3), (1, "y", 0.0, 4), (2, "x", 0.5, 2), (2, "y", 0.5, 1)]
    df = spark.createDataFrame(rows, "query_id int, rule string, score double, rank int")
    assert {tuple(r)[:2] for r in similarity.vote(df).collect()} == {(1, "y"), (2, "y")}
    options = spark.createDataFrame([(1, "x"), (2, "x")], "query_id int, rule string")
    assert {tuple(r)[:2] for r in similarity.vote(df, options=options).collect()} == {(1, "x"), (2, "x")}


def test_numbered_over_ranges(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 5000).alias("v"))
    rows = A.numbered(df, [F.desc("v")], "n").collect()
    assert all(r["n"] == 5000 - r["v"] for r in rows)


def test_drawn_is_whole_and_without_self(spark):
    df = spark.range(40).select("id", (F.col("id") % 2).alias("b"))
    rows = similarity.drawn(df, df, 3, "b").collect()
    assert len(rows) == 120 and all(r["query_id"] != r["candidate_id"] and (r["query_id"] - r["candidate_id"]) % 2 == 0 for r in rows)
    assert len({(r["query_id"], r["candidate_id"]) for r in rows}) == 120


def test_bootstrap_against_rows(spark):
    rng = np.random.default_rng(2)
    v, c, g = rng.integers(0, 2, 300), rng.integers(0, 2, 300), rng.integers(0, 2, 300)
    df = spark.createDataFrame([(int(a), int(b), f"g{k}") for a, b, k in zip(v, c, g)], "violating int, compliant int, g string")
    found = {(r["grouping"], r["value"]): (r["low"], r["high"]) for r in splits.bootstrap(df, ("g",), 4000).collect()}
    index = rng.integers(0, 300, (4000, 300))
    means = (v[index].mean(1) + c[index].mean(1)) / 2
    assert np.allclose(found["overall", None], np.percentile(means, [2.5, 97.5]), atol=0.01)
    assert set(found) == {("overall", None), ("g", "g0"), ("g", "g1")}


def test_strict_join_fails_on_missing_keys(spark):
    a = spark.createDataFrame([("x",), ("y",)], "k string")
    b = spark.createDataFrame([("x", 1)], "k string, c int")
    with pytest.raises(Exception, match="no cluster for"):
        J.strict(a, b, "k").collect()
    assert J.strict(a.where("k = 'x'"), b, "k").count() == 1


def test_hydration(spark):
    pairs = spark.createDataFrame([("train", "m", "s", ["a", "b"], ["a", "z"]), ("val", "n", "t", ["q"], [])], "split string, mod_comment_id string, subreddit string, violating_thread_ids array<string>, compliant_thread_ids array<string>")
    comments = spark.createDataFrame([("s", "a", "second", 2), ("s", "a", "first", 1), ("s", "b", "b", 3)], "subreddit string, id string, body string, seq int")
    sources = spark.createDataFrame([("s",)], "subreddit string")
    rows = {r["mod_comment_id"]: r for r in hydrate.hydrate(pairs, comments, sources).collect()}
    assert [(c["body"], c["hydration_status"]) for c in rows["m"]["violating_thread"]] == [("first", "ok"), ("b", "ok")]
    assert [c["hydration_status"] for c in rows["m"]["compliant_thread"]] == ["ok", "missing"]
    assert [c["hydration_status"] for c in rows["n"]["violating_thread"]] == ["source_unavailable"]


def test_merged_labels_follow_their_clusters(spark):
    own = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (-1, "noise")], "cluster_id int, cluster_label string")
    over = spark.createDataFrame([(2, "x"), (4, "x")], "cluster_id int, label string")
    assert {tuple(r) for r in C.merged(own, over).collect()} == {(1, 1, "a"), (2, 2, "x"), (3, 3, "c"), (4, 2, "x"), (-1, -1, "noise")}


def test_density_clusters_find_blobs():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, (40, 2)) for c in ((0, 0), (5, 5), (0, 5))] + [rng.uniform(-20, 20, (6, 2))])
    labels, strength = C.density_labels(x, 10, 3)
    assert all(len(set(labels[a : a + 40].tolist()) - {-1}) == 1 for a in (0, 40, 80)) and len(set(labels.tolist()) - {-1}) == 3
    quality, noise, n = C.quality(x, labels)
    assert n == 3 and quality > 0.5 and noise < 0.2 and strength.max() <= 1


def test_scan_keeps_the_last_line_and_counts_malformed(spark, tmp_path):
    lines = ['{"id":"a","author":"u","body":"x","subreddit":"r/S","created_utc":1,"edited":false,"link_id":"t3_p"}', "", "not json", '{"id":"b","author":null,"body":"y","subreddit":"s","created_utc":"2.0","edited":5}', '{"id":"c"}']
    (tmp_path / "S_comments.zst").write_bytes(zstandard.compress("\n".join(lines).encode()))
    found = tables.read_lines(spark, str(tmp_path / "S_comments.zst"))
    assert found.count() == 4
    parsed = tables.parse_json(found, tables.COMMENT)
    assert parsed.where("malformed").count() == 1
    rows = {r["id"]: r for r in tables.load_comments(found).collect()}
    assert set(rows) == {"a", "b"} and rows["a"]["edited"] == "false" and rows["b"]["created_utc"] == 2 and rows["a"]["subreddit"] == "s" and rows["a"]["submission_id"] == "p"
    assert [r["name"] for r in tables.listing(spark, str(tmp_path)).collect()] == ["S"]


def test_zst_writer_round_trip(spark, tmp_path):
    df = spark.range(100).select("id", F.concat(F.lit("é"), F.col("id").cast("string")).alias("t"))
    sinks.write_zst_lines(df, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out" / "*.zst"))
    assert {tuple(r) for r in back.select("id", "t").collect()} == {tuple(r) for r in df.collect()}


def test_tsv_keeps_rules_named_none(spark, tmp_path):
    df = spark.createDataFrame([("None", 1), ('a\t"b"\nc', 2), ("NA", -1)], "name string, cluster_id int")
    sinks.write_tsv(df, str(tmp_path / "t"))
    back = tables.read_tsv(spark, str(tmp_path / "t"), "name string, cluster_id int", ("name", "cluster_id"))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()}
    with pytest.raises(ValueError):
        tables.read_tsv(spark, str(tmp_path / "t"), "name string", ("absent",))


def test_digest_ignores_order(spark):
    df = spark.range(50).withColumn("x", F.col("id") % 3)
    a, b = (sinks.with_digest(d).first() for d in (df, df.orderBy(F.desc("id")).repartition(3)))
    assert a == b


def test_latex(spark):
    text = sinks.latex_table(spark.createDataFrame([("a_b", 1)], "name string, n int"), "c", "l")
    assert r"a\_b & 1 \\" in text and r"\begin{tabular}{lr}" in text


def test_media_statuses(spark):
    kind = tables.SUBMISSION
    base = {"id": "p", "is_self": False}
    rows = [base | {"over_18": True}, base | {"id": "q", "crosspost_parent": "x"}, base | {"id": "r"}, base | {"id": "s", "url": "https://i.redd.it/a.png"}]
    subs = spark.createDataFrame([json.dumps(r) for r in rows], "string").select(F.from_json("value", kind).alias("r")).select("r.*")
    got = models.fetched(M.plan(subs))
    found = {r["submission_id"]: (r["status"], r["errors"]) for r in M.outcomes(subs, got).collect()}
    assert found == {"p": ("skipped_nsfw", []), "q": ("skipped_crosspost", []), "r": ("no_media", []), "s": ("failed", ["404_not_found"])}


def test_validation(spark):
    a, b = spark.createDataFrame([("x", 0), ("y", 2)], "k string, n int"), spark.createDataFrame([("y",), ("z",)], "k string")
    found = V.report(V.both_ways(a, b, "k", "5", "no thread", "no tree"), V.empty_counts(a, "k", "n", "5"), V.total_is(a, "n", 2, "3"))
    assert {(r["stage"], r["severity"]) for r in found.collect()} == {("5", "CRITICAL"), ("5", "WARNING")}
    assert V.summary(found).first()["critical"] == 2


def test_construction_end_to_end(spark):
    lines, rules = [], []
    for k in range(40):
        lines.append({"id": f"v{k}", "author": f"u{k}", "body": f"text {k}", "subreddit": "s", "created_utc": k, "parent_id": f"t3_p{k % 8}", "link_id": f"t3_p{k % 8}", "edited": False, "score": k})
    for k in range(0, 40, 5):
        lines.append({"id": f"m{k}", "author": "human", "body": f"spam words {k % 2}", "subreddit": "s", "created_utc": k, "parent_id": f"t1_v{k}", "link_id": f"t3_p{k % 8}", "distinguished": "moderator", "edited": False})
    for i, name in enumerate(("No spam words", "Be kind always")):
        rules.append(("s", i + 1, name, "text", None))
    raw = spark.createDataFrame([(json.dumps(x, separators=(",", ":")), "p", i) for i, x in enumerate(lines)], "value string, path string, seq long")
    mods = construct.moderator_comments(raw)
    assert mods.count() == 8
    own = construct.clean_rules(spark.createDataFrame(rules, "subreddit string, rule_index int, short_name string, description string, violation_reason string"))
    matched = construct.matches(mods, own, construct.Settings(gold=60.0, ambiguous=50.0)).withColumnRenamed("comment_id", "mod_comment_id")
    matched = matched.join(mods.select(F.col("id").alias("mod_comment_id"), "submission_id", F.regexp_replace("parent_id", "t1_", "").alias("violating_comment_id")), "mod_comment_id")
    comments = construct.submission_comments(tables.load_comments(raw), matched)
    pairs = construct.thread_pairs(comments, matched)
    good = pairs.where("status = 'success'")
    assert good.count() > 0
    pairs = good.withColumn("subreddit", F.lit("s")).withColumn("rule", F.lit("No spam words")).withColumn("rules", F.array(F.lit("No spam words"), F.lit("Be kind always")))
    subs = pairs.select("submission_id").distinct()
    final = construct.final_pairs(pairs, subs)
    assert final.count() == good.count() and final.where("violating_correct_answer IS NULL").count() == 0 and "test" in {r["split"] for r in final.collect()}


def test_streams(spark, tmp_path):
    from parley.streaming import completion

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"id": f"c{i}", "link_id": "p" if i < 3 else "q"}) for i in range(5)))
    expected = spark.createDataFrame([("p", 3), ("q", 9)], "submission_id string, expected int")
    stream = completion.comment_stream(spark, str(tmp_path / "in")).withColumnRenamed("link_id", "submission_id")
    query = completion.completed(stream, expected).writeStream.format("memory").queryName("done").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [tuple(r) for r in spark.sql("SELECT * FROM done WHERE complete").collect()] == [("p", 3, True)]


def test_split_trees_and_distribution(spark):
    from parley.operators import splits

    pairs = spark.createDataFrame([("a", "test", "s1", "r"), ("a", "train", "s1", "r"), ("a", "train", "s2", "q"), ("a", "train", "s2", "q"), ("b", "test", "s3", None), ("b", "test", "lost", ""), (None, "val", "s4", "r")], "subreddit string, split string, submission_id string, rule string")
    comments = spark.createDataFrame([("s1", "c1", None), ("s1", "c2", "c1"), ("s2", "c3", None), ("s9", "c4", None)], "submission_id string, comment_id string, parent_id string")
    trees = {tuple(r) for r in splits.split_trees(pairs, comments).collect()}
    assert trees == {("a", "test", "s1", "c1", None), ("a", "test", "s1", "c2", "c1"), ("a", "train", "s1", "c1", None), ("a", "train", "s1", "c2", "c1"), ("a", "train", "s2", "c3", None)}
    found = {(r["subreddit"], r["split"]): (r["total_thread_pairs"], r["n_rules"], r["jsd_from_uniform"]) for r in splits.distribution(pairs).collect()}
    assert found[("a", "test")] == (1, 1, 0.0) and found[("b", "test")] == (2, 0, 1.0) and found[(None, "val")] == (1, 1, 0.0)
    p, u = [1 / 3, 2 / 3], 1 / 2
    jsd = sum(x * math.log(2 * x / (x + u)) + u * math.log(2 * u / (x + u)) for x in p) / 2
    assert found[("a", "train")][:2] == (3, 2) and abs(found[("a", "train")][2] - jsd) < 1e-12
    assert splits.distribution(pairs.limit(0)).count() == 0


def test_seeded_places_over_batches(spark):
    """Groups that reach over batches, of one key, of many, and string groups, as one shuffle of each group's sorted keys; groups take no pandas call each."""
    import random

    from parley.functions import numbers as N
    from parley.operators import splits

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(f"g{i % 5}", i * 37 % 101) for i in range(101)] + [("one", 5), (None, 3)] + [("long", i) for i in range(50)]
        df = spark.createDataFrame(rows, "g string, k long")
        found = splits._shuffled(df, "g", "k")
        got = {(r["g"], r["k"]): r["_place"] for r in found.collect()}
        assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for g in {g for g, _ in rows if g}:
        keys = sorted(k for h, k in rows if h == g)
        order = list(range(len(keys)))
        random.Random(N.stable_hash(g)).shuffle(order)
        want |= {(g, keys[i]): at + 1 for at, i in enumerate(order)}
    assert got == want


def test_ranked_candidates_join_threads_before_pairs(spark, monkeypatch):
    """Ranks against a plain loop, with joins dealt into tasks of few rows; greedy choice from ranks up to a comment's place is that from all ranks."""
    import random

    from pyspark.sql import Window

    from parley.operators import trees

    monkeypatch.setattr(trees, "TASK_ROWS", 16)
    rng = random.Random(4)
    parent = {(s, i): rng.randrange(i) if i > 2 else None for s in "ab" for i in range(40)}
    path = lambda s, i: [] if i is None else [*path(s, parent[s, i]), i]
    tree = spark.createDataFrame([(s, f"{i:02}", None if p is None else f"{p:02}", len(path(s, i)) - 1) for (s, i), p in parent.items()], "submission_id string, comment_id string, parent_id string, depth int")
    thread = spark.createDataFrame([(s, f"{i:02}", [{"id": f"{x:02}"} for x in path(s, i)], "bad" if i % 11 == 5 else None, len(path(s, i)), i % 4) for s, i in parent], "submission_id string, comment_id string, thread array<struct<id:string>>, compliant_issue string, length int, score long")
    v = tree.where("comment_id % 3 = 0").selectExpr("*", "concat('m', comment_id) AS mod_comment_id")
    ranked = trees.ranked_candidates(v, tree, thread)
    want = set()
    for s, i in parent:
        own, found = path(s, i), []
        for _, j in (k for k in parent if k[0] == s and i % 3 == 0 and k[1] != i):
            other = path(s, j)
            if j % 11 != 5 and (len(other) == len(own) or (len(own) >= 3 and len(other) == len(own) - 1 and j != parent[s, i])):
                common = next((n for n, (x, y) in enumerate(zip(own, other)) if x != y), min(len(own), len(other)))
                found.append((-common, -len(other), j % 4, f"{j:02}"))
        want |= {(s, f"m{i:02}", f[3], -f[0], rank) for rank, f in enumerate(sorted(found), 1)}
    got = {(r["submission_id"], r["mod_comment_id"], r["alt_id"], r["common_ancestors"], r["rank"]) for r in ranked.collect()}
    assert got == want
    place = F.dense_rank().over(Window.partitionBy("submission_id").orderBy("mod_comment_id"))
    few = ranked.withColumn("_place", place).where("rank <= _place")
    assert {tuple(r) for r in trees.greedy(few).collect()} == {tuple(r) for r in trees.greedy(ranked).collect()}
    assert trees._spread(tree, 160, "comment_id").rdd.getNumPartitions() >= 10
