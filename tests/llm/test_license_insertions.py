"""Licences interrupted by inserted text."""

from __future__ import annotations

import random

import pytest

from parley.llm import license_scan as L


@pytest.mark.parametrize(("name", "inserted"), [("cc-by-4.0-text", 20), ("cc-by-4.0-text", 30), ("mit-text", 40), ("mit-text", 60)])
def test_inserted_text_hides_no_template(name, inserted):
    words = L.words_of(dict(L.TEMPLATES)[name])
    half, tool = len(words) // 2, L.prepared(L.TEMPLATES)
    for offset in range(0, 60, 3):
        pad = lambda k, n: [b"%s%d" % (k, i) for i in range(n)]
        text = b" ".join(pad(b"p", offset) + words[:half] + pad(b"q", inserted) + words[half:] + pad(b"r", 90)).decode()
        found = {m[0]: m for m in L.scan(text, tool)}
        shingles = len(words) - L.WORDS + 1
        assert found[name][1] == pytest.approx((shingles - L.WORDS + 1) / shingles)
        assert found[name][2] <= offset + half and found[name][2] + found[name][3] >= offset + half + inserted


def test_blocks_of_half_a_template_hide_nothing():
    """Recall over random places against what holds by construction: all shingles but those across the cut."""
    rng = random.Random(4)
    tool, found, tried = L.prepared(L.TEMPLATES), 0, 0
    for name, template in L.TEMPLATES:
        words = L.words_of(template)
        if len(words) < 40:
            continue
        for _ in range(60):
            k = rng.randrange(5, len(words) - 5)
            block = [b"q%d" % i for i in range(rng.randrange(len(words) // 2 + 1))]
            around = [b"p%d" % i for i in range(rng.randrange(2 * len(words)))]
            text = b" ".join(around + words[:k] + block + words[k:] + around).decode()
            tried, found = tried + 1, found + (name in {m[0] for m in L.scan(text, tool)})
    assert tried >= 300 and found >= 0.99 * tried
