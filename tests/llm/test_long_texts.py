"""Every operator on very long texts, with and without white space."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import public_tokenizers as P
import pytest

from parley.llm import bpe, flac, language_id, license_scan, lm_scoring, mixing, near_copies, quality_rules, simhash, token_counts, url_rules

SIZE = 5_000_000
_rng = random.Random(11)
_words = ["".join(_rng.choice("abcdefghilmnorstu") for _ in range(_rng.randrange(2, 9))) for _ in range(40_000)]
SPACED = " ".join(_rng.choice(_words) for _ in range(SIZE // 6))[:SIZE]
JOINED = "".join(_rng.choice(_words) for _ in range(SIZE // 5))[:SIZE]


@pytest.fixture(scope="module")
def long(spark):
    rows = [(1, SPACED, "en", "a"), (2, JOINED, "en", "a"), (3, SPACED[: SIZE // 2] + " changed " + SPACED[SIZE // 2 :], "de", "b"), (4, "short text of a few words", "de", "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4, "doc_id").cache()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_token_counts(long):
    import sentencepiece as spm

    model = spm.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    found = by_id(token_counts.token_counts(long, P.path("piece_bpe_32k.model")))
    assert found[1]["n_tokens"] == len(model.encode(SPACED)) and found[1]["over_limit"]
    assert found[2]["n_tokens"] == len(model.encode(JOINED))


def test_bpe(long):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    found = by_id(bpe.bpe_round_trip(long, P.path("byte_bpe_50k.json")))
    for i, text in ((1, SPACED), (2, JOINED)):
        ids = library.encode(text, add_special_tokens=False).ids
        assert found[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_lm_scores(long):
    found = by_id(lm_scoring.lm_scores(long, P.path("piece_bpe_32k.model")))
    assert found[1]["n_tokens"] == len(SPACED.split()) + 1 and found[2]["n_tokens"] == 2
    # Both texts are spelt by the same pieces: what a byte costs is much the same, but for the marks of words' starts.
    assert 0.3 < (found[2]["score"] / SIZE) / (found[1]["score"] / SIZE) < 1.5


def test_simhash_and_near_copies(long):
    found = by_id(simhash.simhash_components(long))
    assert found[2]["fingerprint"] == f"{simhash.fingerprint(JOINED):016x}"
    assert sorted(r["doc_id"] for r in near_copies.keep_one(long).collect()) == [1, 2, 4]


def test_fingerprints_across_the_border_of_sums(monkeypatch):
    text = " ".join(_words[:3000])
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "AT_ONCE", 7)
    assert simhash.fingerprint(text) == whole


def test_language(long):
    found = by_id(language_id.language_id(long))
    assert found[1]["lang_pred"] in ("en", "de") and 0 <= found[2]["score"] <= 1


def test_flac(long):
    found = by_id(flac.flac_round_trip(long))
    for i, text in ((1, SPACED), (2, JOINED)):
        payload, n = flac.padded_payload(text)
        assert (found[i]["n_bytes"], found[i]["payload_sha256"], found[i]["tail_crc32"]) == (n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert found[i]["feature"].startswith(f"blocks={-(-len(payload) // 1024)};")


def test_flac_frames_across_the_border_of_what_goes_together(monkeypatch):
    payload = SPACED.encode()[: 64 * 400]
    whole = flac.encode_streams([payload, payload[:640]])
    monkeypatch.setattr(flac, "TOGETHER", 3)
    assert flac.encode_streams([payload, payload[:640]]) == whole and flac.payload_of(flac.decode_streams(whole)[0]) == payload


def test_quality(long):
    found = by_id(quality_rules.quality_rules(long))
    words = SPACED.split()
    seen, twice = {}, set()
    for i in range(len(words) - 2):
        k = tuple(words[i : i + 3])
        if k in seen:
            twice |= {seen[k], seen[k] + 1, seen[k] + 2, i, i + 1, i + 2}
        seen.setdefault(k, i)
    assert (found[1]["n_words"], found[1]["word_chars"], found[1]["n_repeat_words"]) == (len(words), sum(map(len, words)), len(twice))
    assert (found[2]["n_words"], found[2]["word_chars"], found[2]["base_failed"]) == (1, SIZE, True)


def test_mixing(long):
    found = by_id(mixing.mixing_weights(long, targets={"lang": {"en": 0.5, "de": 0.5}}))
    assert found[1]["n_tokens"] == len(SPACED.split()) and found[2]["n_tokens"] == 1


def test_licenses(spark):
    template = dict(license_scan.TEMPLATES)["mit-text"]
    texts = [(1, SPACED + " " + template), (2, JOINED), (3, template + " " + JOINED)]
    found = license_scan.license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in found if r["license"] == "mit-text"} == {1, 3}


def test_urls(spark):
    pages = spark.createDataFrame([(1, f"http://a.net/{JOINED}?{SPACED}"), (2, f"http://{'a.' * 100_000}net/x")], "page_id long, url string")
    found = {r["page_id"]: r for r in url_rules.url_rules(pages, url_rules.rule_table(spark)).collect()}
    assert [found[i]["rule"] for i in (1, 2)] == ["net/", "net/"] and len(found[1]["path"]) == SIZE + 1 and re.fullmatch(r"(a\.)+net", found[2]["host"])
