"""Token counts, BPE, language ID, FLAC, quality rules and license scans against libraries and brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from parley.llm import bpe, flac, language_id, license_scan, quality_rules, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def test_token_counts_are_the_librarys(spark, some, hostile, none):
    import sentencepiece as spm

    path = P.path("piece_bpe_32k.model")
    model = spm.SentencePieceProcessor(model_file=path)
    for df in (some, hostile):
        want = sorted(((i, len(t.encode()), len(model.encode(t))) for i, t in texts_of(df)), key=str)
        found = token_counts.token_counts(df, path, piece_bytes=64).collect()
        assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in found), key=str) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in found)
    assert token_counts.token_counts(none, path).count() == 0


def test_splits_are_safe_anywhere():
    import sentencepiece as spm

    proto = open(P.path("piece_bpe_32k.model"), "rb").read()
    model = spm.SentencePieceProcessor(model_proto=proto)
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab c▁\n  é日'.<s>") for _ in range(rng.randrange(200))) for _ in range(600)]
    for size in (1, 7, 60):
        assert token_counts.count_batch(texts, proto, size) == [len(x) for x in model.encode(texts)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_bpe_is_the_librarys(spark, some, hostile, none, library):
    path = P.path("byte_bpe_50k.json")
    for df in (some, hostile):
        want = []
        for i, t in texts_of(df):
            ids = library.encode(t, add_special_tokens=False).ids
            want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert sorted((tuple(r) for r in bpe.bpe_round_trip(df, path).collect()), key=str) == sorted(want, key=str)
    assert bpe.bpe_round_trip(none, path, with_ids=True).count() == 0


def test_bpe_on_random_texts(library):
    vocab = bpe.vocabulary(open(P.path("byte_bpe_50k.json"), "rb").read())
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab cdeTH\n\t  '\x0b\x1c\x85\xa0é日🙂01…—$_") for _ in range(rng.randrange(80))) for _ in range(3000)] + ["a" * 3000, "I'll 's don't", "<|endoftext|><|endoftext|> "]
    for t, joined in zip(texts, vocab.encode_texts(texts)):
        assert bpe.parse_ids(joined).tolist() == library.encode(t, add_special_tokens=False).ids


def test_pair_checks_are_exact():
    vocab = bpe.vocabulary(open(P.path("byte_bpe_50k.json"), "rb").read())
    rng = random.Random(3)
    ids = [i for i in range(50256) if vocab.whole[i]]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(3000)] + [(rng.choice(ids[:800]), rng.choice(ids[:800])) for _ in range(3000)]
    found = vocab.compatible(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert found.tolist() == [vocab.merge(vocab.bytes[a] + vocab.bytes[b]) == [a, b] for a, b in pairs]


def test_absent_columns_count_as_null(spark):
    docs = spark.createDataFrame([("two words",)], "text string")
    assert token_counts.token_counts(docs, P.path("piece_bpe_32k.model")).first()["doc_id"] is None
    assert bpe.bpe_round_trip(docs, P.path("byte_bpe_50k.json")).first()["doc_id"] is None
    bare = docs.select(F.lit(1).cast("long").alias("doc_id"))
    assert tuple(token_counts.token_counts(bare, P.path("piece_bpe_32k.model")).first()) == (1, 0, 0, False)
    assert bpe.bpe_round_trip(bare, P.path("byte_bpe_50k.json")).first()["n_tokens"] == 0


def test_small_caches_change_nothing(monkeypatch):
    vocab = bpe.Vocabulary(open(P.path("byte_bpe_50k.json"), "rb").read())
    texts = ["alpha beta gamma " + "q" * 400, "beta delta <|endoftext|> x", "gamma"]
    want = vocab.encode_texts(texts)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 2)
    assert [vocab.encode_texts([t])[0] for t in texts * 2] == want * 2


def test_language_id_held_out(spark, smallest, hostile, none):
    docs = spark.read.parquet(smallest.replace("sf0.001", "sf0.01") + "/documents.parquet")
    rows = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.95
    assert np.mean([r["accepted"] for r in rows]) > 0.98
    found = language_id.language_id(hostile).collect()
    assert len(found) == hostile.count() and all(0 <= r["score"] <= 1 for r in found)
    assert all(r["lang_pred"] == "und" and not r["accepted"] for r in found if r["doc_id"] in (3, 4, 6, 7, 10))
    assert language_id.language_id(none).count() == 0
    unlabelled = docs.limit(5).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.language_id(unlabelled).collect()} == {"und"}
    kept = language_id.keep_identified(hostile)
    assert kept.columns == hostile.columns and kept.count() <= hostile.count()


def test_language_id_keeps_every_language(spark):
    """Languages of texts without ids, of one text many times, and of long texts alone are learned; too many raise."""
    words = {"de": "und der nicht ist das wir haben schon", "fr": "et le pas est la nous avons déjà", "it": "e il non è la noi abbiamo già", "es": "y el no es la ya hemos todo"}
    rng = random.Random(9)
    text = lambda lang, n: " ".join(rng.choice(words[lang].split()) for _ in range(n))
    same = text("fr", 40)
    rows = [(None, text("de", 30), "de") for _ in range(5000)] + [(None, same, "fr") for _ in range(3000)] + [(i, text("it", 40_000), "it") for i in range(1, 4)] + [(i, text("es", 30), "es") for i in range(10, 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    dictionaries, margin = language_id.fit(docs)
    assert [lang for lang, _ in dictionaries] == ["de", "fr", "es", "it"]
    assert language_id.MIN_MARGIN <= margin <= language_id.MAX_MARGIN
    # Passages of a long text come from all over it.
    assert len(dict(dictionaries)["it"]) > 50_000
    found = language_id.language_id(docs).groupBy("lang_pred").count().collect()
    assert {r["lang_pred"]: r["count"] for r in found} == {"de": 5000, "fr": 3000, "it": 3, "es": 80}
    many = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError, match="languages"):
        language_id.language_id(many)


def test_language_sizes_are_the_librarys(spark, some):
    """Predictions, scores and margins from sizes that the library gives for each chunk and dictionary; a tie is the more frequent language's."""
    import zstandard as zstd

    dictionaries, least = language_id.fit(some)
    for r in language_id.language_id(some).collect()[:60]:
        t = some.where(F.col("doc_id") == r["doc_id"]).first()["text"]
        data = re.sub(r"[\W\d_]+", " ", (t or "").lower()).strip().encode()
        sizes = []
        for _, raw in dictionaries:
            tool = zstd.ZstdCompressor(level=language_id.LEVEL, dict_data=zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(tool.compress(data[i : i + 4096])) for i in range(0, len(data), 4096)))
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        rest = min(s for i, s in enumerate(sizes) if i != best)
        assert r["lang_pred"] == dictionaries[best][0]
        assert r["margin"] == pytest.approx((rest - sizes[best]) / sizes[best]) and r["accepted"] == (rest > sizes[best] and r["margin"] >= least)
    twice = [("b", dictionaries[0][1]), ("a", dictionaries[0][1])]
    assert language_id.classify(["some words of text"], twice)[0] == ("b", 0.5, 0.0, False)


def test_all_training_texts_are_learned_from(spark):
    """Words of texts beyond any number of passages reach the dictionary by their counts, and a wrong text among many moves the margin."""
    rows = [(None, f"ab{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} word", "x") for i in range(2600)] + [(None, "und der nicht", "y")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = dict(language_id.learned(docs))
    assert {w for _, t, lang in rows if lang == "x" for w in t.split()} <= set(found["x"].decode().split())
    assert found["x"].endswith(b" word ") and b"der " in found["y"]
    judged = [("a", "a" if i else "b", 0.01, True) for i in range(1500)] + [("a", "b", 0.005, True)] * 3 + [(None, "b", 0.5, True)] * 50
    margin = language_id.learned_margin(spark.createDataFrame(judged, "lang string, lang_pred string, margin double, accepted boolean"))
    assert margin == pytest.approx(0.01, abs=2e-5)


def test_margin_by_precision(monkeypatch):
    q = language_id
    assert q.fitted_margin([], []) == q.MIN_MARGIN
    margins = [0.3] * 2000 + [0.01] * 500 + [0.004] * 10 + [0.003] * 10

    def judged(wrong):
        monkeypatch.setattr(q, "classify", lambda texts, *_, **__: [("b" if i in wrong else "a", 0.9, m, True) for i, m in enumerate(margins)])
        return q.fitted_margin([("a", "x")] * len(margins), [("a", b"")])

    assert judged(()) == q.MIN_MARGIN
    assert judged({2501, 2505, 2512}) == 0.004  # three of 2520 are too many
    assert judged(set(range(2000))) == q.MAX_MARGIN


def test_marks_stay_on_their_letters():
    assert language_id.normalised("Ka\u0301r हिन्दी 12 x_y").decode().split() == ["ka\u0301r", "हिन्दी", "x", "y"]


def test_language_id_never_looks_at_other_columns(spark, some):
    a = {r["doc_id"]: r["lang_pred"] for r in language_id.language_id(some).collect()}
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    b = {r["doc_id"]: r["lang_pred"] for r in language_id.language_id(some.withColumn("lang", F.when(~held, F.col("lang"))).withColumn("source", F.lit("x"))).collect()}
    assert a == b


def test_flac_round_trips(hostile, none, some):
    for df in (hostile, some):
        texts = Counter((i, t) for i, t in texts_of(df))
        for r in flac.flac_round_trip(df).collect():
            t = next(t for (i, t) in texts if i == r["doc_id"] and len(t.encode()) == r["n_bytes"])
            payload, n = flac.padded_payload(t)
            assert (r["n_bytes"], r["payload_bytes"]) == (n, len(payload)) and len(payload) % 64 == 0 and payload[n:] == bytes(len(payload) - n)
            assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
    assert flac.flac_round_trip(none).count() == 0


def test_flac_streams():
    rng = np.random.default_rng(4)
    wave = bytes((100 + 60 * np.sin(np.arange(4096) / 9)).astype(np.uint8))
    payloads = [bytes(64), b"a" * 1088, wave, rng.bytes(3072), (b"text of some length, " * 200)[:4032], bytes([0] * 500 + [255] * 524)]
    streams = flac.encode_streams(payloads)
    assert [flac.payload_of(b) for b in flac.decode_streams(streams)] == payloads
    assert flac.encode_streams(payloads[2:3]) == streams[2:3]
    kinds = {m[flac.Header(m).frames + 6] >> 1 for m in streams}
    assert len(kinds) >= 3  # constant, verbatim and predicted subframes
    assert len(streams[2]) < 2000
    for a, b in ((0, 10), (1000, 3000), (4000, 4032)):
        assert flac.decode_range(streams[4], a, b) == payloads[4][a:b]
    whole = streams[4]
    head = flac.Header(whole)
    without_table = b"fLaC\x80" + whole[5:42] + whole[head.frames :]
    assert flac.payload_of(flac.decode_streams([without_table])[0]) == payloads[4]


def test_flac_damage_is_found():
    stream = flac.encode_streams([(b"some text to be damaged " * 100)[:2368]])[0]
    at = flac.Header(stream).frames
    rng = random.Random(5)
    for _ in range(60):
        bad = bytearray(stream)
        bad[rng.randrange(at, len(bad))] ^= 1 << rng.randrange(8)
        (status, blocks), (beside, own) = flac.decoded([bytes(bad), stream])
        assert (status, blocks) == ("damaged", []) and beside == "ok" and flac.payload_of(own) == (b"some text to be damaged " * 100)[:2368]
    assert [s for s, _ in flac.decoded([b"", b"fLaC", b"fLaC\x80", None])] == ["damaged", "damaged", "damaged", "missing"]


#: The third worked example of the format's specification (RFC 9639, appendix D.3), a linear predictor of order 3, and its samples.
EXAMPLE = "664c6143800000221000100000001f00001f07d000700000 0018f8f9e396f5cbcfc6dc807f9977906b32fff868020017e944004f6f313d1047d227cb6d090831452bdc2822228057a3"
SAMPLES = [0, 79, 111, 78, 8, -61, -90, -68, -13, 42, 67, 53, 13, -27, -46, -38, -12, 14, 24, 19, 6, -4, -5, 0]


def test_flac_reads_the_specifications_example():
    (status, blocks), = flac.decoded([bytes.fromhex(EXAMPLE)])
    assert status == "ok" and [b.tolist() for b in blocks] == [SAMPLES]


def test_flac_rows_of_missing_and_damaged_streams(spark):
    good = flac.encode_streams([b"x" * 1984])[0]
    bad = good[:-3] + b"abc"
    media = spark.createDataFrame([(1, good), (2, None), (None, bad), (1, good)], "doc_id long, media binary").coalesce(1)
    rows = [(r["doc_id"], r["status"], r["block"], r["sample_offset"], r["n_samples"]) for r in flac.pcm_blocks(media).collect()]
    ok = [(1, "ok", 0, 0, 1024), (1, "ok", 1, 1024, 960)]
    assert rows == [*ok, (2, "missing", None, None, None), (None, "damaged", None, None, None), *ok]
    stored = media.withColumns({"_at": F.monotonically_increasing_id(), "n_bytes": F.lit(1984), "media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    found = flac.features(stored).collect()
    assert [(r["doc_id"], r["status"], r["payload_bytes"]) for r in found] == [(1, "ok", 1984), (2, "missing", None), (None, "damaged", None), (1, "ok", 1984)]
    assert found[0]["payload_sha256"] == hashlib.sha256(b"x" * 1984).hexdigest() and found[1]["media_sha256"] is None


def test_flac_seek_tables_that_would_not_fit(monkeypatch):
    assert flac.points_apart(flac.MOST_POINTS) == 1 and flac.points_apart(flac.MOST_POINTS + 1) == 2 and flac.points_apart(5 * flac.MOST_POINTS) == 8
    monkeypatch.setattr(flac, "MOST_POINTS", 3)
    payload = bytes(range(256)) * 44
    stream = flac.encode_streams([payload])[0]
    assert [p[0] for p in flac.Header(stream).points] == [0, 4096, 8192]
    assert flac.payload_of(flac.decode_streams([stream])[0]) == payload and flac.decode_range(stream, 5000, 5009) == payload[5000:5009]


def test_flac_features(some):
    texts = dict(texts_of(some))
    for r in flac.flac_round_trip(some).collect()[:50]:
        x = np.frombuffer(flac.padded_payload(texts[r["doc_id"]])[0], np.uint8).astype(int) - 128
        want = f"blocks={-(-len(x) // 1024)};mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"
        assert r["feature"] == want and r["status"] == "ok"


def test_flac_media_of_texts_are_stored_small(some):
    texts = dict(texts_of(some))
    rows = flac.flac_media(some).collect()
    payload = sum(len(flac.padded_payload(texts[r["doc_id"]])[0]) for r in rows)
    assert len(zlib.compress(b"".join(bytes(r["media"]) for r in rows))) < 0.6 * payload
    tone = (np.sin(np.arange(1 << 14) / 20) * 100 + 128).astype(np.uint8).tobytes()  # where prediction saves more, it is still used
    assert len(flac.encode_streams([tone], least_saved=flac.LEAST_SAVED)[0]) < 0.7 * len(tone)


def test_flac_blocks_have_offsets(spark, some):
    media = flac.flac_media(some.limit(20))
    blocks = flac.pcm_blocks(media).collect()
    by = {}
    for b in blocks:
        by.setdefault(b["doc_id"], []).append(b)
    for r in media.collect():
        own = sorted(by[r["doc_id"]], key=lambda b: b["block"])
        assert [b["sample_offset"] for b in own] == list(np.cumsum([0] + [b["n_samples"] for b in own[:-1]]))


def counts(t: str):
    w = WORD.findall(t)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality_counts(spark, some, hostile, none):
    extra = spark.createDataFrame([(100, "a b c a b c a b c"), (101, "x\n x\nx\n\n\n"), (102, "a a a a a"), (103, "u v w x u v w"), (104, "one\x85two\u2028three # < 日本 " * 30)], "doc_id long, text string")
    for df in (some, hostile, extra):
        found = quality_rules.quality_rules(df).collect()
        want = sorted(((i, *counts(t)) for i, t in texts_of(df)), key=str)
        assert sorted(((r["doc_id"], *(r[c] for c in quality_rules.FEATURES)) for r in found), key=str) == want
        for r in found:
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
            assert not (r["kept"] and r["base_failed"])
    assert quality_rules.quality_rules(none).count() == 0
    kept = quality_rules.keep_good(hostile)
    assert kept.columns == hostile.columns


def test_quality_verdicts(spark, smallest):
    folder = smallest.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality_rules.quality_rules(docs).join(labels, "doc_id").where("NOT base_failed").collect()
    assert np.mean([r["kept"] for r in rows if r["quality"] == 1]) > 0.99
    assert np.mean([r["kept"] for r in rows if r["quality"] == 0]) < 0.1


def plain_rounds(votes, first, balance):
    """The same rounds on arrays: rates (rule, class) of bad votes, the share of good texts and each row's posterior."""
    q = quality_rules
    r = np.array([first] * votes.shape[1])
    good = lambda: 1 / (1 + np.exp(-(np.log(balance / (1 - balance)) + ((votes == -1) * np.log(r[:, 1] / r[:, 0])).sum(1) + ((votes == 1) * np.log((1 - r[:, 1]) / (1 - r[:, 0]))).sum(1))))
    for _ in range(q.ROUNDS):
        p = good()
        new = np.stack([[(((votes[:, j] == -1) * w).sum() + 1) / (((votes[:, j] != 0) * w).sum() + 2) for w in (1 - p, p)] for j in range(votes.shape[1])])
        share = (p.sum() + 1) / (len(p) + 2)
        moved = max(np.abs(new - r).max(), abs(share - balance))
        r, balance = new, share
        if moved < q.SETTLED:
            break
    return r, balance, good()


def planted(rng, n, balance, caught, blamed, voting):
    truth = rng.random(n) < balance
    bad = rng.random((n, len(caught))) < np.where(truth[:, None], blamed, caught)
    return truth, np.where(rng.random(bad.shape) < voting, np.where(bad, -1, 1), 0)


def votes_table(spark, votes):
    return spark.createDataFrame([tuple(int(x) for x in v) for v in votes], ", ".join(f"v_r{j} int" for j in range(votes.shape[1])))


def test_expectation_maximisation_against_numpy(spark):
    rng = np.random.default_rng(6)
    votes = rng.choice([-1, 0, 1], (500, 6), p=[0.1, 0.2, 0.7])
    rates, balance = quality_rules.fit_rates(votes_table(spark, votes))
    r, share, _ = plain_rounds(votes, quality_rules.FIRST, quality_rules.BALANCE)
    if (r[:, 0] - r[:, 1]).sum() < 0:
        r, share = r[:, ::-1], 1 - share
    assert np.allclose(list(rates.values()), r, atol=1e-9) and abs(balance - share) < 1e-9


def test_planted_accuracies_are_recovered(spark):
    rng = np.random.default_rng(7)
    caught, blamed = np.array([0.9, 0.8, 0.7, 0.6, 0.85, 0.75]), np.array([0.05, 0.1, 0.02, 0.2, 0.15, 0.3])
    truth, votes = planted(rng, 12_000, 0.7, caught, blamed, 0.8)
    table = votes_table(spark, votes)
    rates, balance = quality_rules.fit_rates(table)
    assert abs(balance - 0.7) < 0.05
    assert np.allclose(list(rates.values()), np.stack([caught, blamed], 1), atol=0.05)
    # Begun the wrong way round, the classes are named by what rules say of them.
    again, share = quality_rules.fit_rates(table, first=(0.05, 0.5), balance=0.2)
    assert np.allclose(list(again.values()), list(rates.values()), atol=1e-3) and abs(share - balance) < 1e-3
    p = np.array([r[0] for r in table.select(quality_rules.posterior(rates, balance)).collect()])
    kept, bad = p >= quality_rules.KEEP_FROM, (votes == -1).sum(1)
    assert np.mean(kept == truth) > np.mean((bad == 0) == truth) + 0.1
    # Neither does one bad vote always reject, nor does none always keep.
    assert kept[bad == 1].any() and not kept[bad == 1].all()


def test_no_votes_follow_the_balance(spark):
    rates, balance = {"r0": (0.6, 0.1)}, 0.3
    rows = spark.createDataFrame([(0,), (1,), (-1,)], "v_r0 int").select(quality_rules.posterior(rates, balance)).collect()
    assert rows[0][0] == pytest.approx(0.3) and rows[2][0] < rows[0][0] < rows[1][0]
    # Where most texts are bad, a text that no rule calls bad is not kept for that alone.
    assert rows[0][0] < quality_rules.KEEP_FROM


def test_verdicts_are_not_all_must_pass(spark, smallest):
    docs = spark.read.parquet(smallest.replace("sf0.001", "sf0.01") + "/documents.parquet")
    rows = docs.select("doc_id", F.col("text").alias("_text"))
    table = quality_rules.count_texts(rows, "_text").select("doc_id", *quality_rules.COUNTS).select("*", *quality_rules.vote())
    rates, balance = quality_rules.fit_rates(table.select(*[f"v_{n}" for n in quality_rules.RULES]))
    assert all(0 < x < 1 for r in rates.values() for x in r) and 0 < balance < 1
    bad = sum((F.col(f"v_{n}") == -1).cast("int") for n in quality_rules.RULES)
    votes = {r["doc_id"]: r["bad"] for r in table.select("doc_id", bad.alias("bad")).collect()}
    found = [r for r in quality_rules.quality_rules(docs).collect() if not r["base_failed"]]
    assert [r for r in found if r["kept"] and votes[r["doc_id"]]] and [r for r in found if not r["kept"]]


def test_license_scan(spark, some, hostile, none):
    found = {(r["doc_id"], r["license"]) for r in license_scan.license_scan(some).collect()}
    for name, template in license_scan.TEMPLATES[:5]:
        phrase = b" " + b" ".join(license_scan.words_of(template)) + b" "
        want = {i for i, t in texts_of(some) if phrase in b" " + b" ".join(license_scan.words_of(t)) + b" "}
        assert want <= {i for i, n in found if n == name}
    assert {(r["doc_id"], r["license"]) for r in license_scan.license_scan(hostile).collect()} == {(11, "all-rights-reserved")}
    assert license_scan.license_scan(none).count() == 0


def test_license_retrieval_misses_nothing():
    tool = license_scan.Templates(license_scan.TEMPLATES)
    rng = random.Random(7)
    for name, template in license_scan.TEMPLATES:
        words = template.split()
        for _ in range(40):
            own = list(words)
            if len(words) > 60:
                own[rng.randrange(len(own))] = "zzz"
            filler = [f"q{rng.randrange(999)}" for _ in range(rng.randrange(150))]
            found = license_scan.scan(" ".join(filler + own + filler), tool)
            assert name in [f[0] for f in found]


def plain_scan(text: str) -> set[str]:
    words, out = license_scan.words_of(text), set()
    for name, template in license_scan.TEMPLATES:
        t = license_scan.words_of(template)
        width = min(5, len(t))
        shingles = {tuple(t[i : i + width]) for i in range(len(t) - width + 1)}
        n = len(t) - width + 1
        size, step = n + -(-n // 2), max(1, n // 2)
        total = max(0, len(words) - width + 1)
        last = max(0, -(-(total - size) // step))
        for w in range(last + 1 if total else 0):
            own = {tuple(words[i : i + width]) for i in range(w * step, min(total, w * step + size))}
            if len(own & shingles) >= 0.8 * len(shingles):
                out.add(name)
    return out


def test_license_scan_against_all_windows(some):
    tool = license_scan.Templates(license_scan.TEMPLATES)
    rng = random.Random(8)
    texts = [t for _, t in texts_of(some.limit(40))]
    for _ in range(60):
        t = license_scan.TEMPLATES[rng.randrange(10)][1].split()
        cut = sorted(rng.sample(range(len(t) + 1), 2))
        texts.append(" ".join(["x y z"] * rng.randrange(9) + t[cut[0] : cut[1]] + ["w"] * rng.randrange(9)))
    for t in texts:
        assert {f[0] for f in license_scan.scan(t, tool)} == plain_scan(t)
