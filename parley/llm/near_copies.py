"""Near-copies by word shingles: SimHash and MinHash bands propose pairs, exact Jaccard similarity verifies them.

Words are ASCII lower-cased runs between ASCII blanks, as SimHash has them; a text is
the set of its shingles of WORDS words, as 64-bit hashes. Texts of equal sets are one
node. SimHash's multi-index lookup proposes the closest copies. At similarity LEAST two
fingerprints differ by about ten of 64 bits, beyond what balls can enumerate, so MinHash
proposes the rest: a pair at LEAST shares no band with probability
(1 - LEAST ** ROWS) ** BANDS, which is below 1e-6 for 0.8; a pair beyond it less. No pair
is linked unverified.

A band that many texts share would bring quadratically many pairs. So each text is
first verified against the smallest of each of its bands, and what that links is made
components; then pairs within a band that are still in different components are
verified. A group of copies is one component by then, so its pairs are never listed.

Texts that share a long passage share bands too, though they are not near. A band with
more than HOT_PAIRS pairs left is hot, and its texts are compared by prefixes instead:
with shingles in one order over all such texts, the rarest first, two sets at LEAST or
more have one in common among the first n - ceil(LEAST * n) + 1 of each (n: their
number). Moreover, what stands before their first common one, i shingles of one and j of
the other, is in one set alone, so that i + j may be at most the difference that LEAST
allows. That is exact. A passage that many texts share stands last in the order and
makes no pairs; copies with many edits of one text have those first, and make none with
each other. Prefixes go through the same rounds as bands, the set with the fewest
shingles before the common one (the least edited) taking the smallest's place. Where
that leaves a shingle hot, its sets are compared by what sets each apart from the first
one: two sets differ by as much as these differences differ, which are short for copies
of one text, and are met by prefixes in the same way.

Cases. Null text or no words: the empty set, all one node. Fewer words than a shingle:
all of them are the one shingle. Null ids, repeated rows, empty tables and further
columns: as in simhash.keep_one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, packed, staged, text_batches, unpacked
from .components import components
from .license_scan import shingle_hashes, word_hashes
from .simhash import fingerprint, links

WORDS = 5
LEAST = 0.8
BANDS, ROWS = 48, 6
#: Pairs of texts in different components from which a band is hot.
HOT_PAIRS = 32
#: Levels of a shingle's place in its set's order.
LEVELS = 32
BATCH_BYTES = 4 << 20
#: Shingles whose minima are taken at once.
AT_ONCE = 1 << 12

_rng = np.random.default_rng(17)
_mul = _rng.integers(0, 1 << 31, BANDS * ROWS, np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
_add = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32)[:, None]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    return np.unique(shingle_hashes(word_hashes(tokens), min(words, len(tokens))))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A number for each band's minima; none of an empty set."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), AT_ONCE):
        x = short[i : i + AT_ONCE] * _mul
        x += _add
        x ^= x >> np.uint32(15)
        x *= _mul[::-1]
        np.minimum(low, x.min(1), out=low)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column_ in low.reshape(BANDS, ROWS).T.astype(np.uint64):
        out = (out ^ column_) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def with_bands(rows: DataFrame, text: str) -> DataFrame:
    """rows without text, with _set (a digest of the shingles), _n (their number), _fp (SimHash) and _bands."""
    import xxhash

    carried = [f for f in rows.schema.fields if f.name != text]
    schema = T.StructType([*carried, T.StructField("_set", T.LongType()), T.StructField("_n", T.LongType()), T.StructField("_fp", T.LongType()), T.StructField("_bands", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in text_batches(batches, text, BATCH_BYTES):
            texts = batch.column(text).to_pylist()
            sets = [shingles(t) for t in texts]
            prints = np.fromiter(map(fingerprint, texts), np.uint64, len(texts))
            digests = np.fromiter((xxhash.xxh64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets))
            arrays = [pa.array(digests.view(np.int64)), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints.view(np.int64)), pa.array([bands(s).view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in carried), *arrays], names=schema.names)

    return rows.mapInArrow(run, schema)


def with_shingles(rows: DataFrame, text: str) -> DataFrame:
    """(_set, _shingles) of rows (_set, text)."""

    def run(batches):
        for batch in text_batches(batches, text, BATCH_BYTES):
            sets = pa.array([shingles(t).view(np.int64) for t in batch.column(text).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("_set"), sets], names=["_set", "_shingles"])

    return rows.mapInArrow(run, "_set long, _shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets' Jaccard similarity is LEAST or more."""
    left = sets.select(F.col("_set").alias("a"), F.col("_shingles").alias("_x"))
    right = sets.select(F.col("_set").alias("b"), F.col("_shingles").alias("_y"))
    both = F.size(F.array_intersect("_x", "_y"))
    return pairs.join(left, "a").join(right, "b").where(both >= LEAST * (F.size("_x") + F.size("_y") - both) - 1e-9).select("a", "b")


def near(n: str, m: str):
    """Whether sets of such numbers of shingles can have similarity LEAST."""
    return F.least(n, m) >= LEAST * F.greatest(n, m) - 1e-9


def close_prints(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets that SimHash proposes: of equal fingerprints, each with the smallest; of linked ones, the smallest of both."""
    firsts = staged(nodes.groupBy("_fp").agg(F.min(F.struct("_set", "_n")).alias("f")).select("_fp", F.col("f._set").alias("_first"), F.col("f._n").alias("_m")), "near-prints")
    equal = nodes.join(firsts, "_fp").where((F.col("_set") != F.col("_first")) & near("_n", "_m")).select(F.col("_first").alias("a"), F.col("_set").alias("b"))
    found = links(firsts.select("_fp"))
    left = firsts.select(F.col("_fp").alias("a"), F.col("_first").alias("_x"), F.col("_m").alias("_p"))
    right = firsts.select(F.col("_fp").alias("b"), F.col("_first").alias("_y"), F.col("_m").alias("_q"))
    both = found.join(left, "a").join(right, "b").where(near("_p", "_q"))
    return equal.union(both.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")))


def first_pairs(keys: DataFrame) -> DataFrame:
    """keys (key, _set, _n, _i: shingles before the key) with the first set of each key that several share (_first, _m, _j), by _i and then _set."""
    firsts = keys.groupBy("key").agg(F.min(F.struct("_i", "_set", "_n")).alias("f"), F.count("*").alias("c")).where("c > 1")
    return keys.join(firsts.select("key", F.col("f._set").alias("_first"), F.col("f._n").alias("_m"), F.col("f._i").alias("_j")), "key")


def meeting(i: str, j: str, n: str, m: str):
    """Whether sets of n and m shingles whose first common one stands after i and j others can have similarity LEAST."""
    most = (1 - LEAST) / (1 + LEAST) * (F.col(n) + F.col(m))
    return (F.col(i) + F.col(j) <= most + 1e-9) & near(n, m)


def stars(shared: DataFrame) -> DataFrame:
    """Pairs (a, b) of each set of first_pairs with its key's first."""
    return shared.where((F.col("_set") != F.col("_first")) & meeting("_i", "_j", "_n", "_m")).select(F.col("_first").alias("a"), F.col("_set").alias("b")).distinct()


def with_roots(shared: DataFrame, roots: DataFrame) -> DataFrame:
    rooted = shared.join(roots, shared["_set"] == roots["node"], "left")
    return rooted.select("key", "_set", "_n", "_i", "_first", F.coalesce("root", "_set").alias("_root"))


def apart(rooted: DataFrame, name: str) -> DataFrame:
    """The rows of keys whose sets are in several components, with _root, _big (the component with most of the key's sets), _pairs, the number of pairs in different ones, and _deep, the last level of its places."""
    deep = F.max(F.floor(F.col("_i") * LEVELS / F.greatest("_n", F.lit(1)))).cast("int")
    own = rooted.groupBy("key", "_root").agg(F.count("*").cast("double").alias("c"), deep.alias("deep"))
    split = own.groupBy("key").agg(F.count("*").alias("k"), F.max_by("_root", F.struct("c", "_root")).alias("_big"), ((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("_pairs"), F.max("deep").alias("_deep")).where("k > 1")
    return staged(rooted.join(split.drop("k"), "key"), name)


def pairs_between(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of the sets of a key in different components, but for those with the key's first, which were verified before.

    One side leaves out each key's largest component, and sets meet by their places' levels, so that no task goes through
    the pairs within a component or those too far into their orders.
    """
    rows = rows.where("_set <> _first")
    level = F.floor(F.col("_i") * LEVELS / F.greatest("_n", F.lit(1))).cast("int")
    # With m <= n / LEAST and m >= LEAST * n, j / m is at most (1 - LEAST) / (1 + LEAST) * (1 + 1 / LEAST) - LEAST * i / n.
    most = (1 - LEAST) / (1 + LEAST) * (1 + 1 / LEAST) - LEAST * F.col("_i") / F.greatest("_n", F.lit(1))
    last = F.least(F.floor(most * LEVELS + 1e-6).cast("int"), F.col("_deep"))
    left = rows.where("_root <> _big").select("key", "_set", "_n", "_i", "_root", "_big", last.alias("_l")).where("_l >= 0")
    left = left.withColumn("_l", F.explode(F.sequence(F.lit(0), F.col("_l"))))
    right = rows.select("key", level.alias("_l"), F.col("_set").alias("b"), F.col("_n").alias("_m"), F.col("_i").alias("_j"), F.col("_root").alias("_other"))
    once = (F.col("_other") == F.col("_big")) | (F.col("_set") < F.col("b"))
    found = left.join(right, ["key", "_l"]).where(once & (F.col("_root") != F.col("_other")) & meeting("_i", "_j", "_n", "_m"))
    return found.select(F.least("_set", "b").alias("a"), F.greatest("_set", "b").alias("b")).distinct()


def prefixes(sets: DataFrame) -> DataFrame:
    """(key, _set, _n, _i): the rarest shingles of each set of sets (_set, _shingles), as many as a pair at LEAST must meet in."""
    each = sets.select("_set", F.size("_shingles").alias("_n"), F.explode("_shingles").alias("key"))
    counts = each.groupBy("key").agg(F.count("*").alias("c"))
    ordered = each.join(counts, "key").groupBy("_set", "_n").agg(F.array_sort(F.collect_list(F.struct("c", "key"))).alias("o"))
    n = F.col("_n")
    # A hair below the product, so that rounding never shortens a prefix.
    return ordered.select("_set", n.cast("bigint").alias("_n"), F.posexplode(F.slice("o", F.lit(1), (n - F.ceil(n * LEAST - 1e-9) + 1).cast("int"))).alias("_i", "o")).select(F.col("o.key").alias("key"), "_set", "_n", "_i")


def differences(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """rows of apart() with, in place of each key, the shingles that set the set apart from the key's first one, rarest first, as far as pairs at LEAST must meet in them; _i: how many come before.

    A mark that all have stands last: sets without a common shingle there meet in it.
    """
    each = rows.where("_set <> _first").select("_first", "_set", "_n", "_root").distinct()
    own = sets.select("_set", F.col("_shingles").alias("_x"))
    first = sets.select(F.col("_set").alias("_first"), F.col("_shingles").alias("_c"))
    each = staged(each.join(own, "_set").join(first, "_first").select("_first", "_set", "_n", "_root", F.concat(F.array_except("_x", "_c"), F.array_except("_c", "_x")).alias("_e")), "near-differences")
    tokens = each.select("_first", "_set", F.explode("_e").alias("t"))
    counts = tokens.groupBy("_first", "t").agg(F.count("*").alias("c"))
    ordered = tokens.join(counts, ["_first", "t"]).groupBy("_first", "_set").agg(F.array_sort(F.collect_list(F.struct("c", "t"))).alias("o"))
    # The largest difference that a pair of n shingles and at most n / LEAST can have.
    most = F.floor((1 - LEAST) / (1 + LEAST) * (1 + 1 / LEAST) * F.col("_n") + 1e-6).cast("int")
    mark = F.struct(F.lit(None).cast("bigint").alias("c"), F.lit(None).cast("bigint").alias("t"))
    placed = each.drop("_e").join(ordered, ["_first", "_set"]).select("_first", "_set", "_n", "_root", F.posexplode(F.slice(F.concat("o", F.array(mark)), F.lit(1), most + 1)).alias("_i", "o"))
    return placed.select(F.xxhash64("_first", F.col("o.t")).alias("key"), "_set", "_n", "_i", "_first", "_root")


def classes(table: DataFrame, texts: DataFrame) -> DataFrame:
    """(_set, _root) of the distinct sets in table (_at, _set, _n, _fp, _bands), itself where nothing is near; texts: (_at, _text)."""
    nodes = staged(table.groupBy("_set").agg(F.min(F.struct("_at", "_n", "_fp", "_bands")).alias("r")).select("_set", "r.*"), "near-nodes")
    shared = staged(first_pairs(nodes.select("_set", "_n", F.lit(0).alias("_i"), F.explode("_bands").alias("key"))), "near-bands")
    prints = staged(close_prints(nodes), "near-prints")
    wanted = shared.select("_set").union(prints.select("a")).union(prints.select("b")).distinct()
    wanted = nodes.select("_at", "_set").join(wanted, "_set", "left_semi")
    sets = staged(with_shingles(texts.join(wanted, "_at").select("_set", "_text"), "_text"), "near-shingles")
    found = staged(verified(stars(shared).union(prints).distinct(), sets), "near-stars")
    roots = staged(components(found, "a", "b"), "near-roots")
    rest = apart(with_roots(shared, roots), "near-apart")
    cold, hot = rest.where(F.col("_pairs") <= HOT_PAIRS), rest.where(F.col("_pairs") > HOT_PAIRS)
    found = staged(found.union(verified(pairs_between(cold), sets)), "near-cold")
    if not hot.isEmpty():
        crowded = staged(first_pairs(prefixes(sets.join(hot.select("_set").distinct(), "_set", "left_semi"))), "near-prefixes")
        found = staged(found.union(verified(stars(crowded), sets)), "near-hot")
        roots = staged(components(found, "a", "b"), "near-roots")
        rest = apart(with_roots(crowded, roots), "near-apart")
        cold, hot = rest.where(F.col("_pairs") <= HOT_PAIRS), rest.where(F.col("_pairs") > HOT_PAIRS)
        pairs = pairs_between(cold)
        if not hot.isEmpty():
            pairs = pairs.union(pairs_between(apart(differences(hot, sets), "near-apart")))
        found = found.union(verified(pairs.distinct(), sets))
    roots = components(found, "a", "b")
    return nodes.join(roots, nodes["_set"] == roots["node"], "left").select("_set", F.coalesce("root", "_set").alias("_root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component: the smallest id's; of rows with the same id, one. Columns as they were."""
    rows = packed(docs)
    kept = staged(rows.select("_row", F.monotonically_increasing_id().alias("_at")), "near-rows")
    table = staged(with_bands(kept.select(column(kept, "doc_id", "bigint").alias("_id"), "_at", column(kept, "text", "string").alias("_text")), "_text"), "near-signatures")
    texts = kept.select("_at", column(kept, "text", "string").alias("_text"))
    order = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_at").alias("at"))
    firsts = table.groupBy("_set").agg(F.min(order).alias("_first")).join(classes(table, texts), "_set")
    staying = firsts.groupBy("_root").agg(F.min("_first").alias("_first")).select(F.col("_first.at").alias("_at"))
    return unpacked(kept.join(staying, "_at", "left_semi"))
