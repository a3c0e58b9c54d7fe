"""Hulls, overlaps and colours against plain versions over all pairs and in order."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import geometry as G


def blobs(n, seed, spread=10.0, odd=True):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        size = 10 ** rng.uniform(-1.5, 0.5)
        rows += [(k, float(a), float(b)) for a, b in rng.uniform(-spread, spread, 2) + size * rng.uniform(-1, 1, (int(rng.integers(3, 40)), 2))]
    if odd:
        rows += [(1000, 0.0, 0.0), (1001, -20.0, 0.0), (1001, 20.0, 0.5), (1002, 0.0, 0.0), (1002, 0.0, 0.0)]
    return rows


def meet(p, q):
    """Whether two convex polygons have a point in common: a corner of one in the other, or crossing edges."""
    edges = lambda r: [(r[i], r[(i + 1) % len(r)]) for i in range(len(r))]
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    inside = lambda c, r: len(r) > 2 and all(turn(a, b, c) >= 0 for a, b in edges(r))

    def on(c, a, b):
        return turn(a, b, c) == 0 and min(a[0], b[0]) <= c[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= c[1] <= max(a[1], b[1])

    def cross(a, b, c, d):
        return turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0 or on(a, c, d) or on(b, c, d) or on(c, a, b) or on(d, a, b)

    return any(inside(c, q) for c in p) or any(inside(c, p) for c in q) or any(cross(*e, *f) for e in edges(p) for f in edges(q))


def in_order(centres, pairs, colours):
    """Left to right with everything at hand."""
    order = [g for g, _ in sorted(centres, key=lambda r: (r[1], r[0]))]
    near = {g: {b if a == g else a for a, b in pairs if g in (a, b)} for g in order}
    got = {}
    for rank, g in enumerate(order):
        beside, used = {got[o] for o in near[g] if o in got}, set(got.values())
        steps = (
            lambda c: c not in used and all(abs(c - o) >= 2 for o in beside),
            lambda c: c not in used and c not in beside,
            lambda c: c not in used,
            lambda c: c not in beside,
            lambda c: True,
        )
        choices = next(x for x in ([c for c in range(colours) if s(c)] for s in steps) if x)
        ideal = int(rank / max(len(order) - 1, 1) * (colours - 1))
        got[g] = min(choices, key=lambda c: abs(c - ideal))
    return got


@pytest.fixture(scope="module")
def found(spark):
    rows = blobs(60, 5)
    points = spark.createDataFrame([*rows, (None, 1.0, 1.0), (7, None, 2.0)], "cluster_id int, x double, y double").repartition(7)
    return rows, G.hulls(points).cache()


def polygons_of(hulls):
    return {r["cluster_id"]: [(p["x"], p["y"]) for p in r["polygon"]] for r in hulls.collect()}


def test_hulls_hold_their_points_and_are_convex(found):
    rows, hulls = found
    polygons = polygons_of(hulls)
    assert set(polygons) == {g for g, _, _ in rows}
    for g, p in polygons.items():
        own = {(x, y) for k, x, y in rows if k == g}
        assert set(p) <= own
        if len(p) > 2:
            for (ax, ay), (bx, by), (cx, cy) in zip(p, p[1:] + p[:1], p[2:] + p[:2], strict=True):
                assert (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) > 0
                assert all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= -1e-9 for x, y in own)
    assert len(polygons[1000]) == len(polygons[1002]) == 1 and len(polygons[1001]) == 2
    assert G.hull_of([(0, 0), (1, 1), (2, 2)]) == [(0, 0), (2, 2)]


def test_overlaps_equal_all_pairs(found):
    polygons = polygons_of(found[1])
    got = [(r["a"], r["b"]) for r in G.overlaps(found[1]).collect()]
    keys = sorted(polygons)
    # Single points have no edges of their own; those at one place touch.
    wanted = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if (polygons[a] == polygons[b] if len(polygons[a]) == len(polygons[b]) == 1 else meet(polygons[a], polygons[b]))}
    assert len(got) == len(set(got)) and set(got) == wanted and len(wanted) > 20


def test_touching_nested_and_buffered(spark):
    box = lambda x, y, w: [{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + w, y), (x + w, y + w), (x, y + w))]
    rows = [(0, box(0, 0, 1)), (1, box(1, 0, 1)), (2, box(-100, -100, 300)), (3, box(0.25, 0.25, 0.1)), (4, box(2.5, 0, 1))]
    df = spark.createDataFrame(rows, f"cluster_id int, polygon {G.POLYGON}")
    assert {tuple(r) for r in G.overlaps(df).collect()} == {(0, 1), (0, 2), (0, 3), (1, 2), (2, 3), (2, 4)}
    assert (1, 4) in {tuple(r) for r in G.overlaps(df, buffer=0.4).collect()}
    assert G.overlaps(df.limit(0)).count() == 0


def test_centroids_and_rotation(spark):
    shapes = [("ell", [(0, 0), (2, 0), (2, 1), (1, 1), (1, 3), (0, 3)]), ("line", [(0, 0), (4, 2)]), ("flat", [(0, 0), (1, 1), (2, 2)])]
    df = spark.createDataFrame([(n, [{"x": float(a), "y": float(b)} for a, b in p]) for n, p in shapes], f"n string, polygon {G.POLYGON}")
    got = {r["n"]: (r["c"]["x"], r["c"]["y"]) for r in df.select("n", G.centroid(F.col("polygon")).alias("c")).collect()}
    # The ell is a 2 x 1 box and a 1 x 2 box on its left half.
    assert got["ell"] == pytest.approx(((2 * 1 + 2 * 0.5) / 4, (2 * 0.5 + 2 * 2) / 4))
    assert got["line"] == pytest.approx((2, 1)) and got["flat"] == pytest.approx((1, 1))
    x, y = spark.range(1).select(*G.rotated(F.lit(2.0), F.lit(1.0), 30)).first()
    assert (x, y) == pytest.approx((2 * math.cos(math.pi / 6) - 0.5, 2 * 0.5 + math.cos(math.pi / 6)))


@pytest.mark.parametrize(("n", "colours", "seed"), [(5, 26, 1), (40, 26, 2), (45, 6, 3)])
def test_colours_equal_choosing_in_order(spark, n, colours, seed):
    rng = random.Random(seed)
    centres = [(g, float(rng.randrange(n))) for g in range(n)]
    pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(2 * n)})
    got = {r["cluster_id"]: r["colour"] for r in G.coloured(spark.createDataFrame(centres, "cluster_id int, x double"), spark.createDataFrame(pairs, "a int, b int"), colours=colours).collect()}
    assert got == in_order(centres, pairs, colours)


def test_no_groups(spark):
    none = G.hulls(spark.createDataFrame([], "cluster_id int, x double, y double"))
    assert none.count() == 0
    assert G.coloured(spark.createDataFrame([], "cluster_id int, x double"), spark.createDataFrame([], "a int, b int")).count() == 0


def test_clu_coloured(spark, smallest):
    """The query against hulls, overlaps and choices made in one place."""
    from parley import catalog

    e = spark.read.parquet(f"{smallest}/embeddings.parquet").select("label", "embedding").collect()
    c, s = math.cos(math.pi / 6), math.sin(math.pi / 6)
    own: dict = {}
    for r in e:
        if r["label"] is not None and r["embedding"]:
            a, b = r["embedding"][:2]
            own.setdefault(r["label"], []).append((c * a - s * b, s * a + c * b))
    polygons = {g: G.hull_of(p) for g, p in own.items()}
    keys = sorted(polygons)
    pairs = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if meet(polygons[a], polygons[b])]
    got = {r["cluster_id"]: r for r in catalog.QUERIES["clu_coloured"](spark, smallest).collect()}
    assert pairs and {g: r["colour"] for g, r in got.items()} == in_order([(g, got[g]["x"]) for g in keys], pairs, 26)
    for g, p in polygons.items():
        cross = [a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1], strict=True)]
        x = sum((a[0] + b[0]) * k for a, b, k in zip(p, p[1:] + p[:1], cross, strict=True)) / (3 * sum(cross))
        assert got[g]["x"] == pytest.approx(x, abs=2e-6)
