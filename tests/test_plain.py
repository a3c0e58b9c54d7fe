"""Queries without SQL against plain Python."""

from __future__ import annotations

import html
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from parley import catalog
from parley.functions import numbers as N
from parley.functions import text as S
from parley.operators import splits


def test_cleaned_texts_with_entities(spark, smallest):
    def clean(x):
        t = html.unescape(x or "")
        for pattern, into in ((r"<[^>]+>", ""), (r"\[([^\]]+)\]\([^\)]+\)", r"\1"), (r"https?://[^\s]+", ""), (r"\*\*([^\*]+)\*\*", r"\1"), (r"\*([^\*]+)\*", r"\1"), (r"(?m)^#+\s*", ""), (r"```[^`]*```", ""), (r"`([^`]+)`", r"\1")):
            t = re.sub(pattern, into, t)
        cut = re.sub(r"(?i)^General\s*[:\-\.]\s+", "", re.sub(r"(?i)^Rule\s*\d+[\.\w]*\s*[:\-\.]\s+", "", t))
        return " ".join((cut if cut.split() else t).split())

    pages = {r["page_id"]: clean(r["html"]) for r in spark.read.parquet(f"{smallest}/pages.parquet").collect()}
    found = {r["page_id"]: r["cleaned"] for r in catalog.QUERIES["str_clean_entities"](spark, smallest).collect()}
    assert found.keys() == pages.keys() and all(found[k].split() == pages[k].split() for k in pages)


def test_seeded_splits(spark, smallest):
    groups = defaultdict(list)
    for r in spark.read.parquet(f"{smallest}/orders.parquet").collect():
        groups[r["o_custkey"]].append(r["o_orderkey"])
    want = {}
    for g, keys in groups.items():
        keys.sort()
        order = list(range(len(keys)))
        random.Random(N.stable_hash(str(g))).shuffle(order)
        n = len(keys)
        test, val = (1 if n < 10 else max(1, round(n * 0.1))), (0 if n < 3 else 1 if n < 10 else max(1, round(n * 0.1)))
        for at, i in enumerate(order):
            want[keys[i]] = "test" if at < test else "val" if at < test + val else "train"
    assert {r["o_orderkey"]: r["split"] for r in catalog.QUERIES["spl_assign_seeded"](spark, smallest).collect()} == want


def test_stratified_samples_repeat_no_community(spark, smallest):
    rows = catalog.QUERIES["smp_stratified"](spark, smallest).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{smallest}/documents.parquet").collect()}
    assert len(rows) == 12 and len({r["subreddit"] for r in rows}) == 12
    count = defaultdict(int)
    for r in rows:
        d = docs[r["key"]]
        assert d["source"] == r["subreddit"] and ("Other" if d["lang"] == "es" else d["lang"]) == r["rule_cluster_label"]
        count[r["rule_cluster_label"]] += 1
    assert sorted(count[c] for c in count if c != "Other") == [4, 4, 4]


def test_thread_prompts(spark, smallest):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{smallest}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r["conv_id"]].append((r["role"], r["text"]))
    want = {}
    for k, own in turns.items():
        names = list(dict.fromkeys(["user", *(role for role, _ in own)]))
        lines = [f"{'  ' * i}[USER{names.index(role) + 1}]: " + re.sub(r"u/\w+", "", text or "") for i, (role, text) in enumerate(own)]
        want[k] = "Thread\n\n" + "\n".join(lines)
    assert {r["conv_id"]: r["prompt"] for r in catalog.QUERIES["prj_thread_prompt"](spark, smallest).collect()} == want


def test_greedy_pairs(spark, smallest):
    """Among the best free alternatives of each submission, in the order of moderators' comments."""
    t = catalog.Tables(spark, smallest)
    parent = lambda e: e // 100 * 100 + (e % 100 - 1) // 2 if e % 100 else None
    events = {r["event_id"]: r for r in t.events.collect()}

    def path(e):
        return [*path(parent(e)), e] if parent(e) is not None else [e]

    paths = {e: path(e) for e in events}
    bad = {e: any(events[a]["event_type"] == "error" for a in paths[e]) for e in events}
    score = {r["id"]: r["score"] for r in catalog._comments(t).select(F.col("id").cast("long").alias("id"), "score").collect()}
    want, taken = {}, defaultdict(set)
    for v in sorted((e for e in events if events[e]["event_type"] == "signup"), key=lambda e: (str(e // 100), f"m{e}")):
        sub = v // 100
        if bad[v]:
            want[v] = None
            continue
        others = [a for a in range(sub * 100, sub * 100 + 100) if a in events and a != v and not bad[a] and (len(paths[a]) == len(paths[v]) or len(paths[v]) >= 3 and len(paths[a]) == len(paths[v]) - 1 and a != parent(v))]
        common = lambda a: sum(x == y for x, y in zip(paths[a], paths[v]))
        free = [a for a in sorted(others, key=lambda a: (-common(a), -len(paths[a]), score[a], str(a))) if a not in taken[sub]]
        want[v] = free[0] if free else None
        taken[sub] |= set(free[:1])
    found = {int(r["violating_comment_id"]): r["compliant_comment_id"] and int(r["compliant_comment_id"]) for r in catalog.QUERIES["tree_greedy_pairs"](spark, smallest).collect()}
    assert found == want


def test_clusters_cover_all_points(spark, smallest):
    rows = catalog.QUERIES["clu_kmeans_quality"](spark, smallest).collect()
    assert sum(r["n"] for r in rows) == spark.read.parquet(f"{smallest}/embeddings.parquet").count()
    assert 1 < len({r["cluster_id"] for r in rows}) <= 10


def test_context_flags_that_are_wrong_raise(spark):
    from parley.functions import text as S

    for bad in ("media", "submission-x"):
        with pytest.raises(Exception, match="context flag"):
            spark.createDataFrame([(bad,)], "c string").select(S.context_flags(F.col("c"))).collect()
    assert splits.SEED == 42


def test_python_functions_hold_few_texts_at_a_time(spark):
    from parley.operators import models

    rows = spark.range(40, numPartitions=1).select(F.col("id").alias("n"), F.when(F.col("id") != 7, F.repeat(F.lit("&amp;x"), 50_000)).alias("text"))
    found = models.token_lengths(rows, lambda: lambda texts: [sum(map(len, texts))] * len(texts)).select("n", "n_tokens").collect()
    assert {r["n"] for r in found} == set(range(40)) and max(r["n_tokens"] for r in found) <= 2 << 20
    plain = rows.select("n", S.unescape_html()("text").alias("t")).select("n", F.length("t").alias("k")).collect()
    assert {r["n"]: r["k"] for r in plain} == {i: None if i == 7 else 100_000 for i in range(40)}
