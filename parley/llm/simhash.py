"""SimHash near-duplicates by multi-index hashing.

A fingerprint's two halves of 32 bits are its segments. Fingerprints at 2 or fewer
differing bits have first halves at most 1 bit apart, or equal second halves: so
the ball of radius 1 around each first half, and each second half as it is, are
looked up in tables of the halves, and matches are verified on all 64 bits. Of two
neighbours in a ball only the one with the set bit looks.

A key that many fingerprints hold would bring quadratically many matches. All
fingerprints that touch such a key go through the ball of radius 1 around the whole
64 bits instead: two of them are linked exactly if their balls meet, and a point
lies in at most 65 balls, so that no group is large.

Everything runs on distinct fingerprints: however many copies a text has, it is one
row of them.

Cases. Null text or no words: fingerprint zero, linked like any other. Fewer words
than a shingle: all of them are the one shingle. Ties of a bit: not set. Null ids:
the component's smallest id is over the others; null if there is none. Repeated
rows: one result each; keep_one keeps one row of a component. Empty table: no rows.
Further columns of any name are carried untouched by keep_one, and not looked at
otherwise.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, packed, staged, text_batches, unpacked
from .components import components

WORDS = 3
SEED = 42
DISTANCE = 2
BATCH_BYTES = 4 << 20
#: A key with more matches than this to verify is hot.
HOT_MATCHES = 4096
#: Shingles whose bits are summed at once.
AT_ONCE = 1 << 15


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """64 bits, unsigned: a bit is set if over half of the shingles' hashes have it."""
    import xxhash

    # bytes.lower and bytes.split know ASCII alone: A to Z, and the six ASCII blanks.
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    one = partial(xxhash.xxh64_intdigest, seed=seed)
    if len(tokens) < words:
        hashes = np.array([one(b" ".join(tokens))], np.uint64)
    else:
        hashes = np.fromiter(map(one, map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))), np.uint64, len(tokens) - words + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), AT_ONCE):
        part = hashes[i : i + AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def with_fingerprints(rows: DataFrame, text: str, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """rows and _fp, the fingerprint's bits as a signed number."""
    schema = T.StructType([*rows.schema.fields, T.StructField("_fp", T.LongType())])

    def run(batches):
        for batch in text_batches(batches, text, BATCH_BYTES):
            found = np.fromiter((fingerprint(t, words, seed) for t in batch.column(text).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], names=[*batch.schema.names, "_fp"])

    return rows.mapInArrow(run, schema)


def links(prints: DataFrame, hot_matches: int = HOT_MATCHES) -> DataFrame:
    """(a, b): links that connect all of the distinct values of prints._fp at DISTANCE or fewer differing bits."""
    one = F.lit(1).cast("bigint")
    first = F.shiftrightunsigned("_fp", 32)
    second = F.col("_fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")).bitwiseOR(F.lit(1 << 32).cast("bigint"))
    set_bits = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.getbit(first, i) == 1)
    ball = F.transform(set_bits, lambda i: first.bitwiseXOR(F.call_function("shiftleft", one, i)))
    keys = F.concat(F.transform(F.array(first, second), lambda k: F.struct(k.alias("key"), F.lit(True).alias("held"))), F.transform(ball, lambda k: F.struct(k.alias("key"), F.lit(False).alias("held"))))
    rows = staged(prints.select("_fp", F.explode(keys).alias("k")).select("_fp", "k.key", "k.held"), "segments")
    sizes = rows.groupBy("key").agg(F.count_if("held").alias("_held"), F.count("*").alias("_all"))
    sizes = staged(sizes.where("_held > 0 AND _all > 1").select("key", (F.col("_held") * F.col("_all") > hot_matches).alias("hot")), "keys")
    touching = rows.join(sizes, "key")
    cold = touching.where("NOT hot")
    held = cold.where("held").select("key", F.col("_fp").alias("a"))
    looking = cold.select("key", F.col("_fp").alias("b"), F.col("held").alias("_h"))
    near = held.join(looking, "key").where((~F.col("_h") | (F.col("a") < F.col("b"))) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)).select("a", "b")
    points = F.concat(F.array("_fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("_fp").bitwiseXOR(F.call_function("shiftleft", one, i))))
    crowded = touching.where("hot").select("_fp").distinct().select("_fp", F.explode(points).alias("point"))
    met = crowded.groupBy("point").agg(F.collect_list("_fp").alias("m")).where(F.size("m") > 1)
    met = met.select(F.array_min("m").alias("a"), F.explode("m").alias("b")).where("a <> b")
    return near.union(met)


def classes(prints: DataFrame) -> DataFrame:
    """(_fp, _root) of the distinct fingerprints in prints, itself where nothing is near."""
    distinct = staged(prints.select("_fp").distinct(), "fingerprints")
    roots = components(links(distinct), "a", "b")
    return distinct.join(roots, distinct["_fp"] == roots["node"], "left").select("_fp", F.coalesce("root", "_fp").alias("_root"))


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    rows = packed(docs)
    rows = rows.select(column(rows, "doc_id", "bigint").alias("doc_id"), column(rows, "text", "string").alias("_text"))
    prints = staged(with_fingerprints(rows, "_text").select("doc_id", "_fp"), "simhash")
    by_root = classes(prints)
    ids = prints.groupBy("_fp").agg(F.min("doc_id").alias("_id")).join(by_root, "_fp")
    smallest = ids.groupBy("_root").agg(F.min("_id").alias("component_id"))
    named = ids.join(smallest, "_root").select("_fp", "component_id")
    return prints.join(named, "_fp").select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component: the smallest id's; of rows with the same id, one. Columns as they were."""
    rows = packed(docs)
    rows = rows.select("_row", column(rows, "text", "string").alias("_text"))
    table = staged(with_fingerprints(rows, "_text").select("_row", "_fp", F.monotonically_increasing_id().alias("_at")), "simhash-rows")
    prints = table.select(column(table, "doc_id", "bigint").alias("_id"), "_fp", "_at")
    order = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_at").alias("at"))
    firsts = prints.groupBy("_fp").agg(F.min(order).alias("_first")).join(classes(prints), "_fp")
    staying = firsts.groupBy("_root").agg(F.min("_first").alias("_first")).select(F.col("_first.at").alias("_at"))
    return unpacked(table.join(staying, "_at", "left_semi"))
