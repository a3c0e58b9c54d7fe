"""Hard negatives by the pivot table against all pairs."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from parley.llm import hard_negatives as H


def plain(rows, anchor, positives=5, negatives=3, window=(50, 95)):
    """rows: (id, vector, label)."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda r: (-r[1], r[0] is None, r[0] or 0)
    out = []
    for k, (i, v, label) in enumerate(kept):
        if i is None or not anchor(i):
            continue
        scored = [(j, sum(x * y for x, y in zip(v, w)), other == label) for m, (j, w, other) in enumerate(kept) if m != k]
        for j, p, _ in sorted((r for r in scored if r[2]), key=order)[:positives]:
            fits = sorted((r for r in scored if not r[2] and window[0] * p <= 100 * r[1] <= window[1] * p), key=order)[:negatives]
            out += [(i, j, n + 1, r[0], p, r[1]) for n, r in enumerate(fits)]
    return sorted(out, key=str)


def planted(seed, n, dims=8, labels=4, spread=0.4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(labels)]
    return [(i, [c + rng.gauss(0, spread) for c in centres[k]], (k + (rng.random() < 0.3)) % labels) for i in range(n) for k in [rng.randrange(labels)]]


SCHEMA = "vec_id long, embedding array<double>, label int"


def found(df, **more):
    rows = H.hard_negatives(df, F.col("vec_id") % 5 == 0, F.col("label"), **more)
    return sorted((tuple(r) for r in rows.collect()), key=str)


@pytest.mark.parametrize("block", [8, 50, 1024])
def test_whatever_the_blocks(spark, block):
    rows = planted(3, 240)
    assert found(spark.createDataFrame(rows, SCHEMA), block=block, pivots=4) == plain(rows, lambda i: i % 5 == 0)


def test_brackets_skip_blocks(spark, monkeypatch):
    rows = planted(4, 400, dims=3, spread=0.05)
    monkeypatch.setattr(H, "SLICE", 1)
    seen = []
    write = H.staged
    monkeypatch.setattr(H, "staged", lambda df, name: seen.append((name, out := write(df, name))) or out)
    assert found(spark.createDataFrame(rows, SCHEMA), block=10, pivots=8) == plain(rows, lambda i: i % 5 == 0)
    met = [df.count() for name, df in seen if name == "meeting"]
    assert len(met) == 2 and sum(met) < 40 * 40  # over half of both times 40 x 40


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [*planted(5, 60), (5, [1.0] * 8, 1), (5, [1.0] * 8, 1), (None, [1.0] * 8, 2), (None, [0.9] * 8, 1), (70, None, 1), (75, [1.0, nan], 1), (80, [inf], 1), (85, [1.0, None], 1), (90, [1.0] * 8, None), (95, [], 1), (100, [0.5, 0.5], 2), (105, [2.0] * 11, 1)]
    rows += [(1000 + i, [1.0] * 8, i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"at": F.lit(1), "d": F.lit("x"), "block": F.lit(2), "score": F.lit(0), "a`b.c": F.lit(3)})
    assert found(df, block=16) == plain(rows, lambda i: i % 5 == 0)
    assert found(df.limit(0)) == [] and found(df.select("label", "vec_id")) == []
    assert found(spark.createDataFrame([(5, [1e300, -1e300], 1), (6, [1e300, 1.0], 1), (7, [1e300, 1.0], 2)], SCHEMA)) == []


def test_single_precision_and_relabelling(spark):
    rows = [(i, [float(x) for x in v], label) for i, v, label in planted(6, 150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    exact = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in df.collect()]
    rows = H.hard_negatives(df, F.col("vec_id") % 50 == 0, H.relabelled(df)).collect()
    assert sorted((tuple(r) for r in rows), key=str) == plain(exact, lambda i: i % 50 == 0)
