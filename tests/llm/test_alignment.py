"""Cross-tokenizer alignment against a walk over all token ranges."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P

from parley.llm import alignment
from parley.llm.bpe import byte_letters

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def ranges(parts):
    at, out = 0, []
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def plain(rows):
    """What the query returns, and all links of each text, by comparing every token with every other."""
    a_side, b_side = sides()
    letters, counts, made = byte_letters(), Counter(), []
    for i, t in rows:
        want = (" " + (t or "")).encode()
        a, b = (a_side.encode(" " + t, add_special_tokens=False).ids, b_side.encode(t)) if t else ([], [])
        a_bytes = [bytes(letters[c] for c in a_side.id_to_token(x)) for x in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_side.is_byte(x) else p.replace("▁", " ").encode() for x in b for p in [b_side.id_to_piece(x)]]
        if not t or b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            made.append((i, [], [], [], []))
            continue
        ra, rb = ranges(a_bytes), ranges(b_bytes)
        links = [(x, y) for x, (s, e) in enumerate(ra) for y, (u, v) in enumerate(rb) if s < v and u < e]
        shared = sorted({e for _, e in ra} & {e for _, e in rb})
        groups = [([x for x, (_, e) in enumerate(ra) if low < e <= high], [y for y, (_, e) in enumerate(rb) if low < e <= high]) for low, high in zip([0, *shared], shared)]
        counts.update((a[x], b[y]) for x, y in links)
        made.append((i, a, b, links, groups))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    out = []
    for i, a, b, links, groups in made:
        text = ";".join(",".join(str(a[x]) for x in g) + "|" + ",".join(str(b[y]) for y in h) for g, h in groups)
        pairs = [(a[x], b[y]) for x, y in links]
        out.append((i, len(a), len(b), len(groups), len(links), sum(counts[p] == top[p[1]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=str), made


def short(df):
    return df.selectExpr("doc_id", "substr(text, 1, 1500) AS text")


def test_texts(some, hostile, none):
    for df in (short(some.limit(40)), hostile):
        want, made = plain([(r["doc_id"], r["text"]) for r in df.collect()])
        assert sorted((tuple(r) for r in alignment.token_alignment(df, A, B).collect()), key=str) == want
        found = [(r["doc_id"], [(x["a_at"], x["b_at"]) for x in r["links"]]) for r in alignment.alignments(df, A, B).collect()]
        assert sorted(found, key=str) == sorted(((i, links) for i, _, _, links, _ in made), key=str)
        products = [(r["doc_id"], sorted((x["a_at"], x["b_at"], x["group"]) for x in r["links"])) for r in alignment.alignments(df, A, B, products=True).collect()]
        assert sorted(products, key=str) == sorted(((i, sorted((x, y, k) for k, (g, h) in enumerate(groups) for x in g for y in h)) for i, _, _, _, groups in made), key=str)
    assert alignment.token_alignment(none, A, B).count() == 0 and alignment.alignments(none, A, B).count() == 0
    assert alignment.token_alignment(none.drop("text"), A, B).columns[-1] == "groups_sha256"


def test_odd_characters(spark):
    texts = [" leads", "two  spaces", "a\n\nb \n c", "▁", "x▁y", "<s> </s> <unk> <|endoftext|>", "é é ﬁ ①", "\x00\x01", "日本語🙂 text", "tab\tand more", "trail ", "<0x41>", "\r\n", "don't we'll", "1234567890", "ΑΣ"]
    rows = list(enumerate(texts))
    want, _ = plain(rows)
    assert sorted((tuple(r) for r in alignment.token_alignment(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()), key=str) == want


def test_counts_over_batches(spark, some, monkeypatch):
    df = short(some.limit(30)).repartition(3)
    want, _ = plain([(r["doc_id"], r["text"]) for r in df.collect()])
    monkeypatch.setattr(alignment, "BATCH_BYTES", 2000)
    assert sorted((tuple(r) for r in alignment.token_alignment(df, A, B).collect()), key=str) == want


def test_long_text(spark):
    text = "some words that go on, " * 100_000
    a_side, b_side = sides()
    row = alignment.token_alignment(spark.createDataFrame([(1, text), (2, "x" * 300_000)], "doc_id long, text string"), A, B).where("doc_id = 1").first()
    assert row["n_a"] == len(a_side.encode(" " + text, add_special_tokens=False).ids) and row["n_b"] == len(b_side.encode(text))


def test_interval_arrays():
    ends, a, b, shared = alignment.align(np.array([2, 5, 6]), np.array([3, 5, 6]))
    assert ends.tolist() == [2, 3, 5, 6] and a.tolist() == [0, 1, 1, 2] and b.tolist() == [0, 0, 1, 2] and shared.tolist() == [5, 6]
    i, j = alignment.group_pairs(np.array([0, 0, 1]), np.array([0, 0, 1]))
    assert list(zip(i.tolist(), j.tolist())) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 2)]
