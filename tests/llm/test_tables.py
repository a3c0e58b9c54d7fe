"""Near-duplicates, components, language model, URL rules, mixing and the pipeline against brute force and SQL."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from parley.llm import components, lm_scoring, mixing, registry, simhash, url_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def plain_print(text):
    w = WORD.findall(lowered(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(values):
    a = np.array(values, np.uint64)
    top = list(range(len(a)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(a)):
        for j in np.nonzero(np.bitwise_count(a ^ a[i]) <= 2)[0]:
            x, y = root(i), root(int(j))
            top[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(a))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints(some):
    for r in some.limit(60).collect():
        assert simhash.fingerprint(r["text"]) == plain_print(r["text"])
    assert simhash.fingerprint(None) == 0 and simhash.fingerprint("A b") == plain_print("a B")


def test_components_of_documents(some, hostile, none):
    for df in (some, hostile):
        rows = [(r["doc_id"], plain_print(r["text"])) for r in df.collect()]
        distinct = sorted({p for _, p in rows})
        group = dict(zip(distinct, plain_classes(distinct)))
        least = {}
        for i, p in rows:
            if i is not None:
                least[group[p]] = min(i, least.get(group[p], i))
        want = sorted(((i, f"{p:016x}", least.get(group[p])) for i, p in rows), key=str)
        assert sorted((tuple(r) for r in simhash.simhash_components(df).collect()), key=str) == want
        kept = simhash.keep_one(df)
        assert kept.columns == df.columns and kept.count() == len(set(group.values()))
    assert simhash.simhash_components(none).count() == 0 and simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("hot", [1, 16, 4096])
def test_links_whatever_counts_as_hot(spark, hot):
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(40)}
    for b in list(values):
        for _ in range(rng.randrange(40)):
            x = b
            for _ in range(rng.randrange(1, 5)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    b = next(iter(values))
    values |= {b >> 32 << 32 | rng.getrandbits(32) for _ in range(150)} | {rng.getrandbits(32) << 32 | b & 0xFFFFFFFF for _ in range(150)} | {0, 1, 3, 7}
    values = sorted(values)
    links = simhash.links(spark.createDataFrame([(signed(v),) for v in values], "_fp long"), hot)
    pairs = [(r["a"], r["b"]) for r in links.collect()]
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for a, b in pairs)
    roots = {r["node"]: r["root"] for r in components.components(links, "a", "b").collect()}
    found = {}
    for v in values:
        found.setdefault(roots.get(signed(v), signed(v)), set()).add(v)
    want = {}
    for v, g in zip(values, plain_classes(values)):
        want.setdefault(g, set()).add(v)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000), (6001, 6000), (6002, 6001), (6000, 6002)]
    random.Random(1).shuffle(edges)
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1100)} | {i: 6000 for i in (6000, 6001, 6002)}
    assert found == want
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_base_scores(some, hostile, none):
    path = P.path("piece_bpe_32k.model")
    for df in (some, hostile):
        rows = [(r["doc_id"], [w.encode() for w in WORD.findall(lowered(r["text"]))] + [b""]) for r in df.collect()]
        held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        c = Counter(t for i, tokens in rows if not held(i) for t in tokens)
        n, v = sum(c.values()), len(c)
        want = sorted(((i, held(i), len(t), sum(c[x] > 0 for x in t), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), 6)) for i, t in rows), key=str)
        found = lm_scoring.lm_scores(df, path).collect()
        assert sorted(((*tuple(r)[:5], round(r["base_score"], 6)) for r in found), key=str) == want
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)
    assert lm_scoring.lm_scores(none, path).count() == 0


def plain_weights() -> dict[bytes, float]:
    """The file's pieces, the mark of a word's start as byte 255, with weights 1 / (10 + rank), made to sum to 1."""
    import sentencepiece as spm

    model = spm.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    out: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if piece == "<0xFF>":
            continue
        if model.is_byte(i):
            out.setdefault(bytes([int(piece[3:5], 16)]), 1 / 100_010)
        elif not model.is_control(i) and not model.is_unknown(i) and "\u2581" not in piece[1:] and not re.search("[A-Z]", piece):
            key = piece.replace("\u2581", "\0").encode().replace(b"\0", b"\xff")
            out[key] = max(out.get(key, 0), 1 / (10 + min(1e5, -model.get_score(i))))
    total = sum(out.values()) + 1 / 100_010  # the piece of byte 255 itself, which no text has
    return {k: v / total for k, v in out.items()}


def all_segmentations(word: bytes, weights: dict[bytes, float]) -> float:
    """Sum over every way to cut, one by one."""
    if not word:
        return 1.0
    return sum(weights[word[:k]] * all_segmentations(word[k:], weights) for k in range(1, len(word) + 1) if word[:k] in weights)


def by_prefixes(word: bytes, weights: dict[bytes, float]) -> float:
    """The log of the same sum, by prefixes, for words of any length."""
    ways = [0.0]
    for end in range(1, len(word) + 1):
        terms = [ways[k] + math.log(weights[word[k:end]]) for k in range(max(0, end - 60), end) if word[k:end] in weights]
        most = max(terms)
        ways.append(most + math.log(sum(math.exp(t - most) for t in terms)))
    return ways[-1]


def test_scores_sum_over_all_segmentations(spark):
    """The query's score of small texts against an enumeration of segmentations by the file's scores."""
    weights = plain_weights()
    texts = ["the cat", "THE  Cats\nsat", "\u00e9a xq $$", "z\u0107 \U0001f642", "", "a a a b", "thing"]
    rows = [(i, t) for i, t in enumerate(texts * 4)]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    words = {i: WORD.findall(lowered(t)) for i, t in rows}
    ends = sum(not held[i] for i in words)
    trained = ends + sum(len(w) for i, w in words.items() if not held[i])
    e = (ends + 1) / (trained + 2)
    want = {i: math.log10(e) + sum(math.log10((1 - e) * all_segmentations(b"\xff" + x.encode(), weights)) for x in w) for i, w in words.items()}
    assert any(held.values()) and not all(held.values())
    found = {r["doc_id"]: r["score"] for r in lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), P.path("piece_bpe_32k.model")).collect()}
    assert found.keys() == want.keys() and all(abs(found[i] - want[i]) < 1e-9 for i in want)


def test_scores_of_documents(some):
    """The query's score of whole documents against sums by prefixes."""
    weights = plain_weights()
    own = {r["doc_id"]: WORD.findall(lowered(r["text"])) for r in some.collect()}
    trained = [i for i in own if zlib.crc32(str(i).encode()) % 7 != 2]
    e = (len(trained) + 1) / (len(trained) + sum(len(own[i]) for i in trained) + 2)
    known: dict[str, float] = {}
    for w in {x for words in own.values() for x in words}:
        known[w] = by_prefixes(b"\xff" + w.encode(), weights)
    want = {i: (math.log(e) + sum(known[x] + math.log1p(-e) for x in words)) / math.log(10) for i, words in own.items()}
    found = {r["doc_id"]: r["score"] for r in lm_scoring.lm_scores(some, P.path("piece_bpe_32k.model")).collect()}
    assert found.keys() == want.keys() and all(abs(found[i] - want[i]) < 1e-6 for i in want)


def test_whole_words_are_arcs_of_the_lattice(spark):
    """Words of the training texts as further pieces, against an enumeration; the rest is shared by all segmentations."""
    weights = plain_weights()
    texts = ["the cat", "THE  Cats\nsat", "\u00e9a xq $$", "", "a a a b", "thing", "new words here"]
    rows = [(i, t) for i, t in enumerate(texts * 4)]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    words = {i: WORD.findall(lowered(t)) for i, t in rows}
    c = Counter(x for i, own in words.items() if not held[i] for x in own)
    n, v, ends = sum(c.values()), len(c), sum(not h for h in held.values())
    e = (ends + 1) / (n + ends + 2)
    chance = lambda x: (c[x] + v * all_segmentations(b"\xff" + x.encode(), weights)) / (n + v)
    want = {i: math.log10(e) + sum(math.log10((1 - e) * chance(x)) for x in own) for i, own in words.items()}
    found = {r["doc_id"]: r["score"] for r in lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), P.path("piece_bpe_32k.model"), whole_words=True).collect()}
    assert found.keys() == want.keys() and all(abs(found[i] - want[i]) < 1e-9 for i in want)


def test_query_scores_held_out_texts_near_their_base(spark, smallest):
    """The base gives words that training lacks more than any sum over all strings can, so the score may stay a little below."""
    rows = registry.QUERIES["op5_lm_scoring"](spark, smallest).where("held_out").collect()
    score, base = (sum(r[k] for r in rows) for k in ("score", "base_score"))
    assert rows and all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows) and score > 1.4 * base


def test_expected_counts_of_pieces():
    tool = lm_scoring.pieces(open(P.path("piece_bpe_32k.model"), "rb").read())
    logs = np.log(tool.first / tool.first.sum())
    words = [b"the", b"thing", "\u00e9a".encode(), b"xq", b"$$"]
    found, expected = tool.forward(words, logs, np.ones(len(words)))
    # Expected counts of pieces spell the words: their lengths add up.
    assert abs(sum(e * len(s) for e, s in zip(expected, tool.symbols)) - sum(len(w) + 1 for w in words)) < 1e-6
    again = np.zeros(len(logs))
    assert np.allclose([tool._long(w, logs, 1.0, again) for w in words], found) and np.allclose(again, expected)


def test_long_words_in_parts(monkeypatch):
    tool = lm_scoring.pieces(open(P.path("piece_bpe_32k.model"), "rb").read())
    logs = np.log(tool.first / tool.first.sum())
    long, weights = b"thething" * 40, plain_weights()
    whole = tool._long(long, logs, None, None)
    assert abs(whole - by_prefixes(b"\xff" + long, weights)) < 1e-8
    one = np.zeros(len(logs))
    assert tool._long(long, logs, 1.0, one) == whole and abs(sum(e * len(s) for e, s in zip(one, tool.symbols)) - len(long) - 1) < 1e-6
    monkeypatch.setattr(lm_scoring, "TOGETHER", 7)
    again = np.zeros(len(logs))
    assert abs(tool._long(long, logs, 1.0, again) - whole) < 1e-9 and np.allclose(again, one)


def test_fitted_weights_prefer_the_training_texts(some):
    path = P.path("piece_bpe_32k.model")
    mean = lambda rounds: np.mean([r["score"] / r["n_tokens"] for r in lm_scoring.lm_scores(some, path, rounds=rounds).collect()])
    assert mean(2) > mean(0) + 0.1


def test_scores_prefer_texts_to_noise(some):
    path = P.path("piece_bpe_32k.model")
    rows = lm_scoring.lm_scores(some, path).collect()
    per_token = np.mean([r["score"] / r["n_tokens"] for r in rows if not r["held_out"]])
    noise = some.select("doc_id", F.translate("text", "aeiourstn", "qxzjkqxzw").alias("text")).where("doc_id % 7 = 3").withColumn("doc_id", F.lit(None).cast("long"))
    both = lm_scoring.lm_scores(some.select("doc_id", "text").unionByName(noise.limit(1)), path)
    assert both.where("doc_id IS NULL").first()["score"] / both.where("doc_id IS NULL").first()["n_tokens"] < per_token


def test_url_rules_against_brute_force(spark):
    rng = random.Random(2)
    hosts, paths = ["a.b.c", "b.c", "c", "x.b.c", "xb.c", "", "net", "a.net", "C", "a..c", "bc"], ["", "/", "/a", "/a/b", "/A", "/a?x", "#f"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)] + [None, "nourl", "://", "x://y://z/a", "http://B.c/a\nb?c"]
    rules = sorted({(rng.choice(hosts[:5]), rng.choice(paths[:5]), rng.choice(["allow", "block"])) for _ in range(25)})

    def plain(u):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        if not m:
            return "", "", None, "allow"
        h, p = lowered(m[1]), m[2]
        fits = [((len(rh + rp), len(rh), v == "block"), rh + rp, v) for rh, rp, v in rules if h and (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        return (h, p, *(max(fits)[1:] if fits else (None, "allow")))

    pages = spark.createDataFrame([(i, u, "k", 1) for i, u in enumerate(urls)] + [(None, urls[0], "k", 1)], "page_id long, url string, key string, range int")
    found = url_rules.url_rules(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert sorted((tuple(r) for r in found), key=str) == sorted([(i, *plain(u)) for i, u in enumerate(urls)] + [(None, *plain(urls[0]))], key=str)
    empty = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in url_rules.url_rules(pages, empty, default="block").collect()} == {"block"}
    assert url_rules.url_rules(pages.limit(0), url_rules.rule_table(spark)).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, smallest, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{smallest}/{t}.parquet')")
    found = registry.QUERIES[name](spark, smallest).toPandas()
    want = con.execute(registry.ORACLES[name]).df()
    rows = lambda df: sorted((tuple(None if x is None or x != x else x for x in r) for r in df[sorted(df.columns)].astype(object).values.tolist()), key=str)
    assert sorted(found.columns) == sorted(want.columns) and rows(found) == rows(want)


def test_raking_meets_its_targets(spark, some):
    rows = mixing.mixing_weights(some, rounds=60).toPandas()
    total = rows.n_tokens.sum()
    for dim, power in mixing.TEMPER.items():
        own = rows.groupby(dim).n_tokens.sum()
        own = own[own > 0]
        goal = own**power / (own**power).sum()
        got = (rows.n_tokens * rows.weight).groupby(rows[dim]).sum()[own.index] / total
        assert np.allclose(got, goal, atol=1e-4), dim
    assert abs((rows.n_tokens * rows.probability).sum() / total - mixing.BUDGET) < 1e-6


def test_mixing_on_odd_rows(hostile, none):
    found = mixing.mixing_weights(hostile).collect()
    assert len(found) == hostile.count() and all(0 <= r["probability"] <= 1 for r in found)
    assert {r["source"] for r in found} >= {"(none)"}
    same = [r["selected"] for r in found if r["doc_id"] == 1]
    assert len(set(same)) == 1
    assert mixing.mix(hostile).columns == hostile.columns
    assert mixing.mixing_weights(none).count() == 0 and mixing.mix(none).count() == 0


def test_mixing_takes_given_targets(some):
    rows = mixing.mixing_weights(some, targets={"lang": {"en": 0.25, "de": 0.25, "fr": 0.25, "es": 0.25}}, rounds=60).toPandas()
    share = (rows.n_tokens * rows.weight).groupby(rows.lang).sum() / rows.n_tokens.sum()
    assert np.allclose(share, 0.25, atol=1e-3)


def test_mixing_shares_what_given_targets_leave(spark):
    rows = [(i, "w " * (3 + i % 5), "en" if i % 3 else "de", f"src{i % 4}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    whole = {f"src{k}": 0.0 for k in range(4)}

    def shares(key, **targets):
        found = mixing.mixing_weights(docs, targets=targets, rounds=40).toPandas()
        return (found.n_tokens * found.weight).groupby(found[key]).sum() / found.n_tokens.sum()

    got = shares("source", source={"src1": 0.5, "src2": 0.5})
    assert np.allclose([got[k] for k in sorted(whole)], [0, 0.5, 0.5, 0], atol=1e-6)
    got = shares("source", source={"src1": 0.4, "absent": 0.3})
    rest = {k: sum(len(t.split()) for _, t, _, s in rows if s == k) ** 0.7 for k in whole if k != "src1"}
    assert abs(got["src1"] - 0.4) < 1e-6 and all(abs(got[k] - 0.6 * v / sum(rest.values())) < 1e-6 for k, v in rest.items())
    got = shares("lang", lang={"de": 0.9})
    assert abs(got["de"] - 0.9) < 1e-6 and abs(got["en"] - 0.1) < 1e-6
    got = shares("lang", lang={"de": 0.2, "en": 0.2})
    assert np.allclose(got, 0.5, atol=1e-6)
    with pytest.raises(ValueError, match="sum"):
        mixing.mixing_weights(docs, targets={"source": {"src1": 0.7, "src2": 0.7}})


def test_mixing_tells_targets_that_cannot_be_met(spark):
    docs = spark.createDataFrame([(1, "a b c d", "en", "x"), (2, "e f g h", "de", "y")], "doc_id long, text string, lang string, source string")
    with pytest.warns(UserWarning, match="differ"):
        mixing.mixing_weights(docs, targets={"source": {"x": 0.9, "y": 0.1}, "lang": {"en": 0.1, "de": 0.9}})


def test_pipeline(spark, smallest, hostile, none):
    import corpus_pipeline
    from parley.llm.common import staged

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "simhash_dedup", "mixing", "bpe"]
    for docs in (hostile, none):
        now = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = staged(stage(spark, now, smallest), name)
            assert now.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, now, smallest).count() == now.count()
    whole = corpus_pipeline.run(spark, smallest).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{smallest}/documents.parquet").collect()}
    assert 0 < len(whole) < len(docs)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert all(r["token_ids"] == library.encode(docs[r["doc_id"]], add_special_tokens=False).ids for r in whole)
    prints = sorted(plain_print(docs[r["doc_id"]]) for r in whole)
    assert len(set(plain_classes(prints))) == len(prints)
