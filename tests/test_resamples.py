"""Resamples equal those of one sequential generator, however the stream is cut."""

from __future__ import annotations

import numpy as np
import pytest

from parley.operators import resamples as R


@pytest.mark.parametrize(("n", "chunk"), [(1, 64), (7, 64), (1000, 1 << 12), (3_000_000_000, 128)])
def test_places_of_one_stream(spark, n, chunk):
    """Of three thousand million, three words in ten are skipped."""
    rows, count = 5, min(n, 501)
    if n == count or n == 1000:
        got = {r["replicate"]: r["places"] for r in R.indices(spark, n, rows, 42, chunk).collect()}
        want = np.random.default_rng(42).choice(n, size=(rows, n), replace=True)
        assert [got[i] for i in range(rows)] == want.tolist()
    else:
        want = np.random.default_rng(42).choice(n, size=4000, replace=True)
        got = np.concatenate([R.places(R.words(42, i * chunk, chunk), n) for i in range(64)])[:4000]
        assert got.tolist() == want.tolist()


def test_ranges_begin_where_chunks_skipped(spark, monkeypatch):
    """A replicate's first word depends on all that was skipped before."""
    n, chunk = 5, 32
    monkeypatch.setattr(R, "places", lambda drawn, n: (drawn[drawn % 3 != 0] % n).astype(np.int64))
    stream = R.places(R.words(1, 0, 32 * 40), n)
    before = np.append(0, np.cumsum([len(R.places(R.words(1, c * chunk, chunk), n)) for c in range(40)]))
    for first in (0, 1, 17, 100):
        assert R.replicate_places(1, n, before, first, 3, chunk).ravel().tolist() == stream[first * n : (first + 3) * n].tolist()


def test_intervals_equal_one_generator(spark):
    rng = np.random.default_rng(0)
    n, b = 211, 400
    v, c, g = rng.integers(0, 2, n), rng.integers(0, 2, n), rng.integers(0, 3, n)
    df = spark.createDataFrame([(i, int(v[i]), int(c[i]), f"g{g[i]}") for i in range(n)], "k long, violating int, compliant int, lang string").repartition(5)
    got = {(r["grouping"], r["value"]): (r["low"], r["high"]) for r in R.intervals(df, "k", ("lang",), b, chunk=1 << 10).collect()}
    at = np.random.default_rng(42).choice(n, size=(b, n), replace=True)
    want = {}
    for key, own in [(("overall", None), np.ones(n, bool)), *((("lang", f"g{k}"), g == k) for k in range(3))]:
        held = own[at]
        acc = [((v[i][m].mean() + c[i][m].mean()) / 2 if m.any() else 0.0) for i, m in zip(at, held)]
        want[key] = tuple(np.percentile(acc, [2.5, 97.5]))
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=0, atol=1e-15) for k in want)
    assert R.intervals(df.limit(0), "k").count() == 0


def test_cache_is_kept_by_seed_and_size(spark, tmp_path):
    a = R.cached_indices(spark, str(tmp_path), 9, 20)
    again = R.cached_indices(spark, str(tmp_path), 9, 20)
    other = R.cached_indices(spark, str(tmp_path), 9, 20, seed=7)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(a) == rows(again) != rows(other) and set(a.inputFiles()) == set(again.inputFiles())


def test_replicates_draw_little_more_than_they_need(monkeypatch):
    n, first, count, drawn, places = 100_000, 50, 10, [], R.places
    monkeypatch.setattr(R, "places", lambda words, n: drawn.append(len(words)) or places(words, n))
    before = np.append(0, np.cumsum([len(places(R.words(42, c * R.CHUNK, R.CHUNK), n)) for c in range(2)]))
    got = R.replicate_places(42, n, before, first, count)
    assert sum(drawn) < 1.5 * (first * n - before[1] + count * n)
    assert (got == np.random.default_rng(42).choice(n, size=(first + count, n))[first:]).all()
