"""Language identification by compression: the language whose dictionary makes a text smallest.

A zstandard raw-content dictionary per language holds training texts. Whole texts
are compressed with each, in chunks of CHUNK_BYTES that start from the dictionary
anew, so that long texts give evidence all along and memory stays bounded. The
smallest total wins; where the second is within MIN_MARGIN of it, the document is
not accepted.

Only text and non-null `lang` of documents that are not held out are learned from.
The words of all of them are counted, and a dictionary holds the most frequent ones of
its language, as many as it has room for, the most frequent next to the text. Where it
has room for all, passages of PASSAGE_CHARS characters fill the rest, at most
PASSAGES_A_LANGUAGE by a hash of id, text and place. All texts that are learned from set
the margin: the least one, in steps of STEP between MIN_MARGIN and MAX_MARGIN, that is
right for a share PRECISION of them that it accepts. More than MAX_LANGUAGES languages
raise: none is dropped.

Cases. Null text or text without a letter: `und`, score 0, not accepted. A tie in
size: the language with more training documents, of equally many the first by name;
not accepted. A very long text: all of it, chunk by chunk. No language
learned: `und` for all. Null ids are trained on and never held out. Empty table:
no rows. Repeated rows: one result each. Further columns of any name are not
looked at.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, held_out, packed, staged, text_batches, unpacked

LEVEL = 12
CHUNK_BYTES = 4096
DICTIONARY_BYTES = 110_000
#: Dictionaries are shipped whole, at most 28 MB of them.
MAX_LANGUAGES = 256
PASSAGE_CHARS = 2048
PASSAGES_A_LANGUAGE = 400
#: Relative lead of the smallest size over the next: the least that is asked for, the most, and the precision that sets it between.
MIN_MARGIN = 0.002
MAX_MARGIN = 0.02
PRECISION = 0.999
STEP = 1e-5
#: Bytes of lead that make the score, a logistic of it, move by one unit.
SCORE_BYTES = 8.0
BATCH_BYTES = 2 << 20
UNKNOWN = "und"

_loaded: dict[tuple, list] = {}


@lru_cache(None)
def _no_letters():
    import regex

    return regex.compile(r"[^\p{L}\p{M}]+")


def normalised(text: str) -> bytes:
    """Lower case, runs of anything but letters and the marks on them as one space."""
    return _no_letters().sub(" ", text.lower()).encode()


def _passages(rows: DataFrame, counts: dict[str, tuple[int, float]], most: int) -> DataFrame:
    """lang, text, _n: of each language the first `most` passages by hash. rows: id, lang, text, _u."""
    # About four times the texts that are needed pass the hash, and at least the smallest.
    share = F.create_map(*[F.lit(x) for lang, (n, least) in counts.items() for x in (lang, max(least, min(1.0, 4.0 * most / n)))])
    picked = rows.where(F.col("_u") <= F.try_element_at(share, F.col("lang")))
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(PASSAGE_CHARS))
    cut = picked.select("id", "lang", F.posexplode(F.transform(starts, lambda i: F.substring(F.col("text"), i + 1, F.lit(PASSAGE_CHARS)))).alias("_at", "text"))
    best = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit("passage"), "id", "_at", "text"), "id", "_at", "text")
    return cut.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= most).select("lang", "text", "_n")


def _training(docs: DataFrame, modulus: int, remainder: int) -> DataFrame:
    """id, lang, text, _u of what is learned from."""
    rows = packed(docs)
    rows = rows.select(column(rows, "doc_id", "string").alias("id"), column(rows, "text", "string").alias("text"), column(rows, "lang", "string").alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id"), modulus, remainder))
    return rows.withColumn("_u", F.pmod(F.xxhash64(F.lit("sample"), "id", "text"), F.lit(1 << 30)) / float(1 << 30))


def _words(rows: DataFrame, dictionary_bytes: int) -> DataFrame:
    """lang, text, _n: of each language the words that a dictionary can hold, by how often all its texts have them."""
    words = rows.select("lang", F.explode(F.split(F.lower("text"), "[^\\p{L}\\p{M}]+")).alias("text")).where(f"text <> '' AND octet_length(text) < {dictionary_bytes}")
    often = Window.partitionBy("lang").orderBy(F.desc("_c"), "text")
    # A word and the space behind it take two bytes at least.
    counted = words.groupBy("lang", "text").agg(F.count("*").alias("_c"))
    return counted.withColumn("_n", F.row_number().over(often)).where(F.col("_n") <= dictionary_bytes // 2).select("lang", "text", "_n")


def learned(docs: DataFrame, modulus: int = 5, remainder: int = 0, dictionary_bytes: int = DICTIONARY_BYTES, passages: int = PASSAGES_A_LANGUAGE) -> list[tuple[str, bytes]]:
    """(language, dictionary), the most frequent language first: bounded by the parameters, whatever the input."""
    rows = _training(docs, modulus, remainder)
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("_u").alias("least")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: their dictionaries are not shipped whole")
    counts = {r["lang"]: (r["n"], r["least"]) for r in found}
    if not counts:
        return []
    # Passages have numbers below zero: they fill what words leave, and lie farther from the text.
    chosen = _words(rows, dictionary_bytes).unionByName(_passages(rows, counts, passages).withColumn("_n", -F.col("_n")))

    def dictionary(df: pd.DataFrame) -> pd.DataFrame:
        words, seen, size = [], set(), 0
        for text in df[df["_n"] > 0].sort_values("_n")["text"]:
            data = text.encode() + b" "
            if size + len(data) < dictionary_bytes:
                words.append(data)
                size += len(data)
        before = bytearray()
        for text in df[df["_n"] < 0].sort_values("_n", ascending=False)["text"]:
            data = normalised(text)
            if data not in seen and size + len(before) + len(data) < dictionary_bytes:
                seen.add(data)
                before += data + b"\n"
        # The most frequent words lie next to the text.
        return pd.DataFrame({"lang": [df["lang"].iloc[0]], "dictionary": [bytes(before) + b"".join(reversed(words))]})

    # A language's group holds the words of one dictionary and at most `passages`.
    made = staged(chosen, "dictionary-parts").groupBy("lang").applyInPandas(dictionary, "lang string, dictionary binary").collect()
    built = {r["lang"]: bytes(r["dictionary"]) for r in made}
    return [(lang, built[lang]) for lang in counts if len(built.get(lang, b"")) >= 8]


def learned_margin(found: DataFrame) -> float:
    """The margin that all training texts of found (lang, lang_pred, margin, accepted) set; lang is null where a text is not learned from. Margins come back in steps of STEP, those from MAX_MARGIN on as one."""
    step = F.floor(F.least("margin", F.lit(MAX_MARGIN)) / F.lit(STEP)).cast("int")
    judged = found.where("accepted AND lang IS NOT NULL").groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.count_if(F.col("lang_pred") == F.col("lang")).alias("right")).collect()
    return _least_margin([(r["step"] * STEP, r["n"], r["right"]) for r in judged])


def fit(docs: DataFrame, modulus: int = 5, remainder: int = 0, dictionary_bytes: int = DICTIONARY_BYTES, passages: int = PASSAGES_A_LANGUAGE) -> tuple[list[tuple[str, bytes]], float]:
    """The dictionaries of learned(), and the margin that the training texts set."""
    dictionaries = learned(docs, modulus, remainder, dictionary_bytes, passages)
    return dictionaries, learned_margin(identify(_training(docs, modulus, remainder).select("lang", "text"), dictionaries, "text"))


def fitted_margin(held: list[tuple[str, str]], dictionaries: list[tuple[str, bytes]]) -> float:
    """The margin that a few texts at hand set; learned_margin() counts those of all training texts."""
    found = classify([text for _, text in held], dictionaries, min_margin=MIN_MARGIN)
    return _least_margin([(margin, 1, int(pred == lang)) for (lang, _), (pred, _, margin, accepted) in zip(held, found, strict=True) if accepted])


def _least_margin(judged: list[tuple[float, int, int]]) -> float:
    """The least margin between MIN_MARGIN and MAX_MARGIN with which a share PRECISION of the texts accepted is told right; MAX_MARGIN where none has. judged: margin, texts of it and how many of them are told right."""
    by_margin: dict[float, list[int]] = {}
    for margin, n, right in judged:
        of = by_margin.setdefault(margin, [0, 0])
        of[0] += n
        of[1] += right
    n = right = 0
    best = MAX_MARGIN if judged else MIN_MARGIN
    for margin in sorted(by_margin, reverse=True):
        n, right = n + by_margin[margin][0], right + by_margin[margin][1]
        if right >= PRECISION * n:
            best = min(best, margin)
    # Where all are accepted at the least margin, nothing argues for more.
    return MIN_MARGIN if right >= PRECISION * n else best


def _compressors(dictionaries: list[tuple[str, bytes]], level: int) -> list:
    import zstandard as zstd

    key = (level, *((lang, hash(data)) for lang, data in dictionaries))
    if key not in _loaded:
        made = []
        for lang, data in dictionaries:
            own = zstd.ZstdCompressionDict(data, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=level)
            made.append((lang, zstd.ZstdCompressor(level=level, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)))
        _loaded.clear()
        _loaded[key] = made
    return _loaded[key]


def classify(texts: list[str | None], dictionaries: list[tuple[str, bytes]], level: int = LEVEL, min_margin: float = MIN_MARGIN) -> list[tuple[str, float, float, bool]]:
    """(language, score, relative margin, accepted) of each text."""
    tools = _compressors(dictionaries, level)
    out = []
    for text in texts:
        if not tools or not text or not any(c.isalpha() for c in text):
            out.append((UNKNOWN, 0.0, 0.0, False))
            continue
        data = normalised(text).strip()
        chunks = [data[i : i + CHUNK_BYTES] for i in range(0, len(data), CHUNK_BYTES)]
        sizes = sorted((sum(len(tool.compress(c)) for c in chunks), i) for i, (_, tool) in enumerate(tools))
        lead = (sizes[1][0] - sizes[0][0]) if len(sizes) > 1 else len(data)
        margin = lead / max(1, sizes[0][0])
        out.append((tools[sizes[0][1]][0], 1 / (1 + math.exp(-min(60.0, lead / SCORE_BYTES))), margin, lead > 0 and margin >= min_margin))
    return out


_SCHEMA = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("accepted", T.BooleanType())])


def identify(rows: DataFrame, dictionaries: list[tuple[str, bytes]], text: str, level: int = LEVEL, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The columns of rows, then lang_pred, score, margin and accepted. The dictionaries are bounded, so they are shipped whole."""
    shipped = rows.sparkSession.sparkContext.broadcast(dictionaries)
    schema = T.StructType([*rows.schema.fields, *_SCHEMA.fields])
    kinds = {"lang_pred": pa.string(), "score": pa.float64(), "margin": pa.float64(), "accepted": pa.bool_()}

    def run(batches):
        for batch in text_batches(batches, text, BATCH_BYTES):
            texts = batch.column(text).to_pylist()
            # Copies within a batch are compressed once.
            own = list(dict.fromkeys(texts))
            by_text = dict(zip(own, classify(own, shipped.value, level, min_margin), strict=True))
            found = [by_text[t] for t in texts]
            more = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *kinds])

    return rows.mapInArrow(run, schema)


def _labels(rows: DataFrame, modulus: int, remainder: int) -> Column:
    """A row's language where it is learned from, else null."""
    return F.when(~held_out(column(rows, "doc_id", "string"), modulus, remainder), column(rows, "lang", "string"))


def language_id(docs: DataFrame, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin and accepted of every document."""
    rows = packed(docs)
    rows = rows.select(column(rows, "doc_id", "bigint").alias("doc_id"), column(rows, "text", "string").alias("text"), _labels(rows, modulus, remainder).alias("lang"))
    # Every text is compressed once, for its prediction and, where it is learned from, for the margin.
    found = staged(identify(rows, learned(docs, modulus, remainder), "text").drop("text"), "identified")
    accepted = F.col("accepted") & (F.col("margin") >= learned_margin(found))
    return found.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "lang_pred", "score", "margin", accepted.alias("accepted"))


def keep_identified(docs: DataFrame, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """The documents whose language is told with enough margin; their columns as they were."""
    rows = packed(docs)
    rows = rows.select("_row", column(rows, "text", "string").alias("_text"), _labels(rows, modulus, remainder).alias("lang"))
    found = staged(identify(rows, learned(docs, modulus, remainder), "_text").where("accepted").drop("_text"), "identified")
    return unpacked(found.where(F.col("margin") >= learned_margin(found)))
