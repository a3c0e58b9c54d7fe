"""Queries that take all rows and full settings, against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley import catalog
from parley.operators import clusters as C
from parley.operators import splits


def plain_dbcv(d, labels, dims):
    """The measure as it is published, on the whole matrix of distances."""
    ids = [k for k in np.unique(labels) if k >= 0]
    core, inner, sparse = {}, {}, {}
    for k in ids:
        own = np.nonzero(labels == k)[0]
        for i in own:
            near = [(1 / d[i, j]) ** dims for j in own if j != i]
            core[i] = (sum(near) / len(near)) ** (-1 / dims)
        # Equal weights make several least trees: this one grows from the first point, taking first points first.
        inside, edges = [own[0]], []
        while len(inside) < len(own):
            w, j, i = min((max(d[i, j], core[i], core[j]), j, inside.index(i)) for j in own if j not in inside for i in inside)
            edges.append((w, inside[i], j))
            inside.append(j)
        ends = [p for _, *e in edges for p in e]
        inner[k] = [i for i in own if ends.count(i) > 1]
        sparse[k] = max(w for w, i, j in edges if i in inner[k] and j in inner[k])
    total = 0.0
    for k in ids:
        gap = min(max(d[i, j], core[i], core[j]) for other in ids if other != k for i in inner[k] for j in inner[other])
        total += (labels == k).sum() / len(labels) * (gap - sparse[k]) / max(gap, sparse[k])
    return total


def test_grid_takes_all_points_and_combinations(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.3, (40, 6)) for c in (0, 4, 9)])
    # Ids beyond 400: none may be left out.
    spark.createDataFrame([(1000 + i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["combination"]: r for r in catalog.QUERIES["clu_grid_search"](spark, str(tmp_path)).collect()}
    assert len(got) == 480
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    for g in C.grid(spark).where("combination % 97 = 0").collect():
        reduced = (u * s)[:, : g["n_components"]]
        d = np.sqrt(((reduced[:, None] - reduced[None]) ** 2).sum(-1))
        labels, _ = C.density_labels(reduced, g["min_cluster_size"], g["min_samples"])
        r, ids = got[g["combination"]], [k for k in np.unique(labels) if k >= 0]
        assert r["n_clusters"] == len(ids) and np.isclose(r["noise_ratio"], (labels < 0).mean())
        assert np.isclose(r["dbcv"], plain_dbcv(d, labels, g["n_components"]))


def test_grid_has_a_task_for_each_tree(spark):
    points = spark.createDataFrame([(i, np.random.default_rng(i).normal(size=3).tolist()) for i in range(40)], "id long, embedding array<double>")
    found = C.searched(points, C.grid(spark, neighbours=(5,), components=(2, 3), min_samples=(1, 5, 10)))
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() == 6


def test_distances_of_equal_rows_are_zero():
    x = np.random.default_rng(3).normal(size=(60, 40)) * 1e3
    x[30:] = x[:30]
    to, d = C.distances(x), np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.allclose(to(np.arange(60)), d) and np.allclose(to(7), d[7]) and to(7)[37] == 0 and (to(np.arange(30))[range(30), range(30, 60)] == 0).all()


def test_spanning_tree_is_minimal():
    x = np.random.default_rng(2).normal(size=(150, 5))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, 4]
    own, tree = C.spanning(x, 4)
    assert np.allclose(own, core)
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    group, total = list(range(len(x))), 0.0
    for w, i, j in sorted((reach[i, j], i, j) for i in range(len(x)) for j in range(i)):
        if group[i] != group[j]:
            total, group = total + w, [group[i] if g == group[j] else g for g in group]
    assert np.isclose(sum(w for w, _, _ in tree), total)


def test_similarities_take_all_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    x, label = rng.normal(size=(90, 8)), rng.integers(0, 3, 90)
    ids = [int(i) for i in rng.choice(np.arange(1, 5000), 90, replace=False)]
    spark.createDataFrame([(i, v.tolist(), int(k)) for i, v, k in zip(ids, x, label)], "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    scores = {(int(label[a]), ids[a], ids[b]): np.float32(x[a] @ x[b]) for a in range(90) for b in range(90) if a != b and label[a] == label[b]}
    got = {(r["subreddit"], r["comment_id"], r["rule_index"]): r["score"] for r in catalog.QUERIES["sim_matrix_all"](spark, str(tmp_path)).collect()}
    assert got.keys() == scores.keys() and all(abs(got[k] - float(scores[k])) < 2e-5 for k in got)
    low, high = (np.float32(np.percentile([float(s) for s in scores.values()], q)) for q in (98, 99.2))
    want = set()
    for k, i in zip(label, ids):
        own = [(s, b) for (_, a, b), s in scores.items() if a == i]
        if own and sum(s > low for s, _ in own) <= 1 and max(own)[0] >= high:
            want.add((int(k), i, max(own)[1]))
    assert want and {tuple(r) for r in catalog.QUERIES["sim_match_threshold_all"](spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("shape", [(3, 4), (1024, 1024)])
def test_matches_hold_no_table_of_scores(spark, shape):
    """Blocked products in three passes against a plain loop: ties, equal scores, nulls, not-a-numbers, other lengths, string ids."""
    from parley.operators import similarity

    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.integers(-2, 3, 3)], int(rng.integers(0, 2))) for i in range(60)]
    rows += [(60, None, 0), (61, [1.0, None, 1.0], 0), (62, [1.0], 0), (63, [float("nan"), 0.0, 0.0], 1), (64, [1.0, 0.0, 0.0], None), (65, [1.0, 1.0, 1.0], 7)]
    df = spark.createDataFrame(rows, "rule_index long, embedding array<double>, subreddit int")
    comments = df.withColumn("comment_id", F.col("rule_index")).drop("rule_index")

    def plain(x, y):
        if x is None or y is None or len(x) != len(y) or None in x or None in y:
            return None
        return float(np.float32(sum(a * b for a, b in zip(x, y))))

    want = {(k, a, b): plain(x, y) for a, x, k in rows for b, y, j in rows if k is not None and k == j}
    got = {tuple(r)[:3]: r["score"] for r in similarity.similarities(comments, df, slice_=shape[0], block=shape[1]).collect()}
    assert got.keys() == want.keys() and all(got[k] == want[k] or (got[k] != got[k] and want[k] != want[k]) for k in got)
    for apart, low, high in ((False, 50.0, 60.0), (True, 98.0, 99.2), (True, 90.0, 95.0)):
        scores = {k: s for k, s in want.items() if s is not None and 63 not in k[1:] and not (apart and k[1] == k[2])}
        cuts = [np.float32(np.percentile([s for s in scores.values()], q)) for q in (low, high)]
        expected = set()
        for k, a in {k[:2] for k in scores}:
            own = [(s, -b) for (j, c, b), s in scores.items() if (j, c) == (k, a)]
            if sum(s > cuts[0] for s, _ in own) <= 1 and max(own)[0] >= cuts[1]:
                expected.add((k, a, -max(own)[1]))
        found = similarity.matches(comments.where("comment_id <> 63"), df.where("rule_index <> 63"), low, high, apart=apart, slice_=shape[0], block=shape[1])
        assert {tuple(r)[:3] for r in found.collect()} == expected
    assert similarity.matches(comments.limit(0), df).count() == 0


def test_rows_are_sent_a_bounded_number_of_times(spark, monkeypatch):
    """However many slices and blocks a community has, its rows go to SIDES cells, unless parts grow too large."""
    from parley.operators import similarity

    rows = spark.range(120).select(F.col("id").alias("rule_index"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"), F.lit(1).alias("subreddit"))

    def sent():
        counted = lambda left, right: left.select(["comment_id"]).append_column("n", [[right.num_rows] * left.num_rows])
        found = similarity._met(rows.withColumnRenamed("rule_index", "comment_id"), rows, "subreddit", 2, 3, counted, "comment_id long, n long")
        return found.withColumn("p", F.spark_partition_id()).groupBy("comment_id").agg(F.sum("n").alias("met"), F.countDistinct("p").alias("cells")).collect()

    assert all(r["met"] == 120 and r["cells"] <= similarity.SIDES for r in sent())
    monkeypatch.setattr(similarity, "PART", 20)
    assert {r["met"] for r in sent()} == {120} and max(r["cells"] for r in sent()) == 6


def test_intervals_of_both_groups_with_all_replicates(spark, smallest):
    got = {(r["grouping"], r["value"]): (r["low"], r["high"]) for r in catalog.QUERIES["bst_ci"](spark, smallest).collect()}
    assert {g for g, _ in got} == {"overall", "lang", "source"}
    want = splits.bootstrap(catalog._results(catalog.Tables(spark, smallest)), ("lang", "source"), 100_000).collect()
    assert {(r["grouping"], r["value"]): (r["low"], r["high"]) for r in want} == got


def test_grid_takes_more_points_than_the_old_cap(spark, monkeypatch):
    """Lists and powers in parts of few points, copies among them; no number of points raises."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.4, (25, 4)) for c in (0, 5)])
    x[30:34] = x[26:30]
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    grid = C.grid(spark, neighbours=(5,), components=(2, 4), min_sizes=(5,), min_samples=(1, 5))
    monkeypatch.setattr(C, "MAX_POINTS", 40, raising=False)  # the cap that was
    monkeypatch.setattr(C, "CHUNK", 16)
    got = {r["combination"]: r for r in C.searched(points, grid).collect()}
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    for g in grid.collect():
        reduced = (u * s)[:, : g["n_components"]]
        labels, strength = C.density_labels(reduced, 5, g["min_samples"])
        found, r = C.quality(reduced, labels), got[g["combination"]]
        assert np.isclose(r["dbcv"], found[0]) and (r["noise_ratio"], r["n_clusters"]) == found[1:] and np.isclose(r["mean_probability"], strength.mean())


@pytest.mark.parametrize("dims", [2, 5, 64])
def test_cores_of_several_labellings(dims):
    """Sums that labellings share against a plain loop: copies, lone points, far and near scales, parts of the rows."""
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(90, dims)) * np.where(rng.random((90, 1)) < 0.5, 1, 1e6)
    x[50:55] = x[40:45]
    labellings = [rng.integers(-1, 3, 90), np.where(np.arange(90) == 7, 1, 0)]
    got = C.all_points_cores(x, slice(None), labellings)
    for labels, found in zip(labellings, got, strict=True):
        for i in range(90):
            d = [np.linalg.norm(x[i] - x[j]) for j in range(90) if j != i and labels[j] == labels[i]]
            if labels[i] < 0 or not d or not min(d):
                assert found[i] == 0
            else:
                assert np.isclose(found[i], min(d) * np.mean((min(d) / np.array(d)) ** dims) ** (-1 / dims), rtol=1e-6)
    assert all(np.allclose(part, whole[20:60]) for part, whole in zip(C.all_points_cores(x, slice(20, 60), labellings), got, strict=True))


def test_tree_by_lists_is_the_tree_by_rows():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 3))
    x[200:220] = x[:20]
    for samples in (1, 4):
        core, tree = C.spanning(x, samples)
        plain = C._tree(x, core)
        assert np.isclose(sum(w for w, _, _ in tree), sum(w for w, _, _ in plain)) and sorted(i for _, _, i in tree) == list(range(1, 300))
