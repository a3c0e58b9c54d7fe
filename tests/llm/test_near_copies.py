"""The pipeline's near-duplicates against brute force over five-word shingles."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest

from parley.llm import near_copies, simhash


def plain_set(text: str | None) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def plain_kept(rows: list[tuple]) -> set:
    """The smallest ids of components of pairs with 5 * shared >= 4 * all."""
    sets = [plain_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return {min(i for (i, _), g in zip(rows, group) if g == own) for own in set(group)}


def edited(rng: random.Random) -> list[tuple]:
    """Texts, exact copies, and copies with words replaced or added, around similarity 0.8 and far from it; some few words."""
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a b"), (5, "A  b"), (6, "a b c")]
    for _ in range(30):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((8, 40, 120, 600)))]
        rows.append((len(rows) + 1, " ".join(base)))
        for _ in range(rng.randrange(1, 6)):
            copy = base[:]
            for _ in range(rng.randrange(0, max(2, len(base) // 25))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(5000)}"
            rows.append((len(rows) + 1, " ".join(copy)))
    # A chain: neighbours are near, ends are not; and many copies around one text.
    text = [f"c{i}" for i in range(200)]
    for i in range(25):
        rows.append((len(rows) + 1, " ".join(text[i * 4 :] + [f"d{k}" for k in range(i * 4)])))
    for i in range(60):
        rows.append((len(rows) + 1, " ".join(text[:100] + [f"e{rng.randrange(9)}" for _ in range(rng.randrange(30))])))
    rng.shuffle(rows)
    return rows


def test_edited_copies_beyond_two_bits_are_linked(spark):
    rng = random.Random(5)
    rows = edited(rng)
    want = plain_kept(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    assert simhash.keep_one(docs).count() > len(want)


def test_smallest_tables(some):
    rows = [(r["doc_id"], r["text"]) for r in some.collect()]
    assert {r["doc_id"] for r in near_copies.keep_one(some).collect()} == plain_kept(rows)


@pytest.mark.parametrize("hot", [0, 32])
def test_many_edited_copies_of_one_text(spark, monkeypatch, hot):
    """Copies at similarity 0.5 to 1 of each other: most pairs are not near, whatever counts as hot."""
    rng = random.Random(hot + 6)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    rows = []
    for i in range(160):
        copy = base[:]
        for _ in range(rng.randrange(2, 8)):
            copy[rng.randrange(150)] = f"x{rng.randrange(9)}"
        if rng.random() < 0.2:
            del copy[: rng.randrange(20)]
        rows.append((i, " ".join(copy)))
    monkeypatch.setattr(near_copies, "HOT_PAIRS", hot)
    docs = spark.createDataFrame(rows + [(1000 + i, t) for i, t in edited(rng)[:60]], "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in near_copies.keep_one(docs).collect())
    assert kept == sorted(plain_kept([(r["doc_id"], r["text"]) for r in docs.collect()]))
