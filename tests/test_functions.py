"""String, number and cleaning functions against plain Python, traps included."""

from __future__ import annotations

import html
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.functions import numbers as N
from parley.functions import text as S


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def many(spark, values, f, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_prefixes(spark):
    assert many(spark, ["t3_ab", "t1_ab", "t3_", "", None, "ab"], lambda x: S.strip_kind(x, "t3")) == ["ab", "t1_ab", "", None, None, "ab"]


def test_community_names(spark):
    assert many(spark, ["r/Ask", "R/Ask", " Foo ", None], S.community_name) == ["ask", "r/ask", "foo", ""]


def test_bots(spark):
    assert many(spark, [None, "", "[Deleted]", "AutoModerator", "abbott", "alice"], S.bot_author) == [True, True, True, True, True, False]


def _clean(text: str) -> str:
    if not text:
        return ""
    t = html.unescape(text)
    for pattern, into, flags in ((r"<[^>]+>", "", 0), (r"\[([^\]]+)\]\([^\)]+\)", r"\1", 0), (r"https?://[^\s]+", "", 0), (r"\*\*([^\*]+)\*\*", r"\1", 0), (r"\*([^\*]+)\*", r"\1", 0), (r"^#+\s*", "", re.M), (r"```[^`]*```", "", re.S), (r"`([^`]+)`", r"\1", 0)):
        t = re.sub(pattern, into, t, flags=flags)
    before = t
    t = re.sub(r"^Rule\s*\d+[\.\w]*\s*[:\-\.]\s+", "", t, flags=re.I)
    t = re.sub(r"^General\s*[:\-\.]\s+", "", t, flags=re.I)
    return re.sub(r"\s+", " ", t if t.strip() else before).strip()


CLEAN = ["", None, "Rule 1: No spam", "rule 1", "General: ", "**b** and *i*", "## Head\n### Two", "see [here](http://x.y/z) or http://a.b", "a&nbsp;b &amp; c", " x  ", "```code\nmore``` `c`", "<b>bold</b>", "Rule 2b - be nice", "General - x"]


def test_cleaner(spark):
    assert many(spark, CLEAN, S.clean_markup) == [_clean(c) for c in CLEAN]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="aR ule1:*-.#`\n<>[]()&;General ", max_size=25), min_size=30, max_size=60))
def test_cleaner_on_anything(spark, texts):
    assert many(spark, texts, S.clean_markup) == [_clean(t) for t in texts]


def test_answers(spark):
    texts = ["(b)", "Answer: c", "option d", "b)", "b.", " B ", "<think>(a)", "<think>x</think>(b)", "prose only", None, "I think (c) then (d)"]
    assert many(spark, texts, S.answer_choice) == ["(b)", "(c)", "(d)", "(b)", "(b)", "(b)", "", "(b)", "", "", "(c)"]


def test_overrides(spark):
    lines = spark.createDataFrame([("# c", 0), ("5: A", 1), ("5: B: x", 2), ("x: y", 3), ("7:", 4), ("8", 5)], "value string, seq long")
    assert [tuple(r) for r in S.label_overrides(lines).collect()] == [(5, "B: x")]


def test_urls(spark):
    urls = ["https://i.redd.it/a.JPG?x=1", "https://www.reddit.com/a.png", "https://youtu.be/x.jpg", "https://imgur.com/abc", "http://u@h.com:80/p q.gif", "nourl", None]
    assert many(spark, urls, S.is_media_url) == [True, False, False, True, True, False, None]
    assert many(spark, urls, S.url_extension) == ["jpg", "png", "jpg", None, "gif", None, None]


def test_times(spark):
    assert one(spark, 0, S.posted_at, "bigint") == "Thu, Jan 1, 1970, 12:00AM"
    assert many(spark, ["12", "12.9", "x", None], S.seconds) == [12, 12, 0, 0]


def test_rationale(spark):
    rows = [(" t ", "", ""), ("", "a</think>b", ""), ("", "", "z<reasoning> r </reasoning>"), ("", "", " raw ")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    assert sorted(r[0] for r in df.select(S.rationale(F.col("a"), F.col("b"), F.col("c"))).collect()) == ["a", "r", "raw", "t"]


def test_divergence(spark):
    def plain(counts):
        p = np.array(counts, float)
        if not len(p) or p.sum() == 0:
            return 1.0
        p /= p.sum()
        u = np.full(len(p), 1 / len(p))
        m = (p + u) / 2
        return 0.5 * sum(x * np.log(x / y) for x, y in zip(p, m) if x) + 0.5 * sum(x * np.log(x / y) for x, y in zip(u, m))

    cases = [[1, 1, 1], [5, 0, 0], [3], [0, 0], [], [1, 2, 3, 4]]
    assert np.allclose(many(spark, cases, N.divergence_of, "array<bigint>"), [plain(c) for c in cases])


def test_common_prefix(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "b"]), (["a"], ["b"]), ([], ["a"]), (["a", None], ["a", None])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(N.common_prefix(F.col("a"), F.col("b"))).collect()] == [2, 0, 0, 2]


@pytest.mark.parametrize("rho, n, p", [(0.5, 10, 0.14111), (0.9, 5, 0.03739), (0.0, 8, 1.0), (1.0, 4, 0.0)])
def test_p_values(rho, n, p):
    assert abs(N.student_p(rho, n) - p) < 1e-4


def test_split_sizes(spark):
    from parley.operators.splits import split_sizes

    def plain(n):
        if n < 3:
            return (1, 0)
        return (1, 1) if n < 10 else (max(1, round(0.1 * n)),) * 2

    ns = list(range(1, 400))
    df = spark.createDataFrame([(n,) for n in ns], "n int").select("n", *split_sizes(F.col("n"))).orderBy("n")
    assert [tuple(r)[1:] for r in df.collect()] == [plain(n) for n in ns]


def test_seeded_options(spark):
    import random

    from parley.operators.splits import NO_RULE, shuffled_options

    wanted = ["x", "y", "z", NO_RULE]
    random.Random(int("k3j", 36) + N.stable_hash("k3jviolating")).shuffle(wanted)
    row = spark.createDataFrame([(["x", "y", "z"], "k3j")], "r array<string>, i string").select(shuffled_options(F.col("r"), F.col("i"), "violating").alias("o")).first()
    assert [(o["label"], o["rule"]) for o in row["o"]] == [(f"({c})", w) for c, w in zip("abcd", wanted)]


def test_percentiles_over_ranges(spark):
    from parley.functions.ordering import percentiles

    rng = np.random.default_rng(1)
    for x in (rng.normal(size=2001), rng.integers(0, 5, 300).astype(float), np.array([3.0])):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
        assert np.allclose(percentiles(df, "v", [0.0, 0.5, 0.98, 0.992, 1.0]), np.percentile(x, [0, 50, 98, 99.2, 100]), rtol=1e-12)
    assert percentiles(spark.createDataFrame([], "v double"), "v", [0.5]) == [None]
