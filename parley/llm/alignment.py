"""Cross-tokenizer alignment by elementary intervals.

Two tokenizers cut the same bytes; the union of both arrays of token ends cuts them
into elementary intervals, and searchsorted finds the one token of each side that
owns an interval. So an interval is exactly one overlap of a token of A with a token
of B: a link. An end that both share closes a group; the product of a group's tokens
is expanded by group_pairs. Texts are laid end to end and aligned at once, as the end
of a text is shared. So is the end of a unit, what lies between single spaces that no
token can reach across: a worker aligns each unit once, all new ones of a batch
together, and a text's intervals are those of its units.

Counts of id pairs over the whole corpus need a shuffle, but not of links: a batch
writes its distinct pairs once, its units point to them, its documents to the units.
Pairs are summed by both ids, joined back to the batches that hold them, and looked up
there.

Cases. Null or empty texts, and texts of which either side's tokens spell other
bytes than a space and the text: no tokens, zeros, an empty groups_sha256. Null ids,
repeated rows: a result each. Empty table: no rows. Absent columns count as null.
Further columns of any name are not looked at. Ties of an id's highest count are all
best. A text of any length is aligned whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import SPLIT, byte_letters
from .common import named, read_shipped, staged, text_batches

BATCH_BYTES = 2 << 20
#: Remembered units of a worker, and the longest that are remembered. Results do not depend on them.
CACHE_UNITS = 700_000
CACHE_UNIT_CHARS = 64
#: Where no token can reach across: a single space between other characters.
BETWEEN = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


class SideA:
    """Byte-level BPE of a space and the text; strings of special tokens are plain text."""

    def __init__(self, source: bytes):
        import regex
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(source.decode()).model
        spec = json.loads(source)
        letters = byte_letters()
        shown = {b: c for c, b in letters.items()}
        self.letters = {b: shown[b] for b in range(256)}
        ids = spec["model"]["vocab"]
        self.bytes = [b""] * (1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in ids.items():
            self.bytes[i] = bytes(letters[c] for c in token if c in letters)
        self.lengths = np.array(list(map(len, self.bytes)), np.int64)
        self.split = regex.compile(SPLIT).findall
        self.words: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        words = [self.split(" " + t) for t in texts]
        if len(self.words) > CACHE_UNITS // 2:
            self.words.clear()
        new = {w for ws in words for w in ws if w not in self.words}
        long = {w: self.word(w) for w in new if len(w) > CACHE_UNIT_CHARS}
        self.words |= {w: self.word(w) for w in new if len(w) <= CACHE_UNIT_CHARS}
        get = (self.words | long).__getitem__ if long else self.words.__getitem__
        return [get(ws[0]) if len(ws) == 1 else [i for w in ws for i in get(w)] for ws in words]


class SideB:
    """Pieces of a sentencepiece model, which adds the space itself."""

    def __init__(self, proto: bytes):
        import sentencepiece as spm

        self.model = spm.SentencePieceProcessor(model_proto=proto)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.lengths = np.array(list(map(len, self.bytes)), np.int64)
        # Units may be encoded alone if no piece has a space after another character.
        self.splits = not any("▁" in p.lstrip("▁") for p in names)

    def encode(self, texts: list[str]) -> list[list[int] | None]:
        """ids of each text; None where its pieces spell other bytes."""
        spelt, found = self.bytes.__getitem__, self.model.encode(texts, num_threads=1)
        return [ids if b"".join(map(spelt, ids)) == b" " + t.encode() else None for t, ids in zip(texts, found, strict=True)]


_sides: dict[tuple[type, int], SideA | SideB] = {}


def side(kind: type, source: bytes):
    key = kind, hash(source)
    if key not in _sides:
        _sides[key] = kind(source)
    return _sides[key]


def align(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ends, a_owner, b_owner, shared): the elementary intervals' ends, which token of each side owns each, and the ends that both sides have."""
    ends = np.union1d(a_ends, b_ends)
    a, b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    return ends, a, b, ends[(a_ends[a] == ends) & (b_ends[b] == ends)] if len(ends) else ends


def group_pairs(a_groups: np.ndarray, b_groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all A-B pairs that share a group, given each token's group, ascending: the products of groups, expanded."""
    first, last = np.searchsorted(b_groups, a_groups, "left"), np.searchsorted(b_groups, a_groups, "right")
    n = last - first
    a = np.repeat(np.arange(len(a_groups)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive parts of values."""
    ends = np.cumsum(sizes)
    return np.diff(np.append(0, np.cumsum(values))[ends], prepend=0)


def _shown(n: int, mark: str) -> np.ndarray:
    return np.array([f"{i}{m}".encode() for i in range(n) for m in (",", mark)], object)


def _taken(docs: DataFrame, text: str, carry: str) -> DataFrame:
    return docs.select(named(docs, carry, "bigint").alias("c"), F.coalesce(named(docs, text, "string"), F.lit("")).alias("text"))


def alignments(docs: DataFrame, a_path: str, b_path: str, text: str = "text", carry: str = "doc_id", products: bool = False) -> DataFrame:
    """carry and links, an array of (a_at, b_at, a_id, b_id, first, last, group) of every text: token places, bytes from first to last, and the group's number.

    products: instead of overlaps all pairs of a group, whose first and last byte are the group's.
    """
    context = docs.sparkSession.sparkContext
    a_source, b_source = context.broadcast(read_shipped(a_path)), context.broadcast(read_shipped(b_path))
    taken = _taken(docs, text, carry)
    link = pa.struct([(n, pa.int64()) for n in ("a_at", "b_at", "a_id", "b_id", "first", "last", "group")])

    def run(batches):
        a, b = side(SideA, a_source.value), side(SideB, b_source.value)
        for batch in text_batches(batches, "text", BATCH_BYTES):
            found = Aligned(batch.column("text").to_pylist(), a, b)
            if products:
                i, j = group_pairs(found.a_group, found.b_group)
                last = found.shared[found.a_group[i]]
                first = np.append(0, found.shared)[found.a_group[i]]
            else:
                i, j, last = found.a_owner, found.b_owner, found.ends
                first = np.append(0, last)[: len(last)]
            of = np.searchsorted(found.text_ends, last)
            start = np.append(0, found.text_ends)
            group = found.a_group[i]
            columns = (i - (np.cumsum(found.n_a) - found.n_a)[of], j - (np.cumsum(found.n_b) - found.n_b)[of], found.a[i], found.b[j], first - start[of], last - start[of], group - np.searchsorted(found.shared, start[of], "right"))
            counts = np.zeros(batch.num_rows, np.int64)
            counts[found.rows] = np.bincount(of, minlength=len(found.rows))
            offsets = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
            listed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(link)))
            yield pa.RecordBatch.from_arrays([batch.column("c"), listed], names=["c", "links"])

    kind = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("a_at", "b_at", "a_id", "b_id", "first", "last", "group")]))
    return taken.mapInArrow(run, T.StructType([taken.schema["c"], T.StructField("links", kind)])).withColumnRenamed("c", carry)


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64, sum(map(len, lists)))


class Aligned:
    """A batch of texts, those without tokens left out: `rows` are the places of the others."""

    def __init__(self, texts: list[str], a: SideA, b: SideB):
        b_ids = b.encode(texts)
        good = [i for i, (t, ids) in enumerate(zip(texts, b_ids, strict=True)) if t and ids is not None]
        a_ids = a.encode([texts[i] for i in good])
        sizes = np.array([1 + len(texts[i].encode()) for i in good], np.int64)
        flat = _flat(a_ids)
        whole = np.flatnonzero(summed(a.lengths[flat], np.array(list(map(len, a_ids)), np.int64)) == sizes)
        self.rows = np.array(good, np.int64)[whole]
        a_ids, b_ids = [a_ids[k] for k in whole.tolist()], [b_ids[i] for i in self.rows.tolist()]
        self.n_a, self.n_b = (np.array(list(map(len, ids)), np.int64) for ids in (a_ids, b_ids))
        self.a, self.b = _flat(a_ids), _flat(b_ids)
        self.a_ends, self.b_ends = np.cumsum(a.lengths[self.a]), np.cumsum(b.lengths[self.b])
        self.ends, self.a_owner, self.b_owner, self.shared = align(self.a_ends, self.b_ends)
        self.text_ends = self.a_ends[np.cumsum(self.n_a) - 1] if len(self.rows) else self.a_ends
        self.a_group, self.b_group = np.searchsorted(self.shared, self.a_ends), np.searchsorted(self.shared, self.b_ends)

    def per_text(self, ends: np.ndarray) -> np.ndarray:
        """How many of the ascending ends lie in each text."""
        return np.diff(np.searchsorted(ends, self.text_ends, "right"), prepend=0)

    def written(self, shown: tuple[np.ndarray, ...]) -> list[bytes]:
        """Each text's groups as `a1,a2|b1;a3|b2,b3`. shown: each id of A, and of B, with a comma or its group's mark behind."""
        a_place = np.arange(len(self.a)) + np.searchsorted(self.b_group, self.a_group, "left")
        b_place = np.arange(len(self.b)) + np.searchsorted(self.a_group, self.b_group, "right")
        a_last, b_last = np.append(self.a_group[1:] != self.a_group[:-1], True), np.append(self.b_group[1:] != self.b_group[:-1], True)
        out = np.empty(len(self.a) + len(self.b), object)
        out[a_place] = shown[0][2 * self.a + a_last[: len(self.a)]]
        out[b_place] = shown[1][2 * self.b + b_last[: len(self.b)]]
        ends = np.cumsum(self.n_a + self.n_b)
        listed = out.tolist()
        return [b"".join(listed[i:j])[:-1] for i, j in zip((ends - self.n_a - self.n_b).tolist(), ends.tolist(), strict=True)]


class Units:
    """What units align to, each aligned once: counts, groups as text, and links as codes of id pairs, of a unit from starts to ends."""

    def __init__(self, a: SideA, b: SideB):
        self.a, self.b, self.width = a, b, len(b.bytes)
        self.shown = _shown(len(a.bytes), "|"), _shown(self.width, ";")
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.written: list[bytes] = []
        self.counts = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, links; an odd unit has none
        self.links = np.zeros(0, np.int64)

    def add(self, units: list[str]) -> None:
        found = Aligned(units, self.a, self.b)
        counts = np.zeros((len(units), 4), np.int64)
        counts[found.rows] = np.stack([found.n_a, found.n_b, found.per_text(found.shared), found.per_text(found.ends)], 1)
        written = [b""] * len(units)
        for i, text in zip(found.rows.tolist(), found.written(self.shown), strict=True):
            written[i] = text
        self.at |= zip(units, range(len(self.written), len(self.written) + len(units)), strict=True)
        self.written += written
        self.counts = np.concatenate([self.counts, counts])
        self.links = np.concatenate([self.links, found.a[found.a_owner] * self.width + found.b[found.b_owner]])

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(where, places, sizes, used): the units of all texts as places here and as places in used, how many each text has, and the used ones' places here. A text with an odd unit has none."""
        cut = [(BETWEEN.split(t) if self.b.splits else [t]) if t else [] for t in texts]
        if max(len(self.at), len(self.written), len(self.links) // 8) > CACHE_UNITS:
            self.clear()
        if new := list({u for units in cut for u in units if u not in self.at}):
            self.add(new)
        sizes = np.array(list(map(len, cut)), np.int64)
        where = np.fromiter(map(self.at.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        for u in new:
            if len(u) > CACHE_UNIT_CHARS:
                del self.at[u]
        of = np.repeat(np.arange(len(texts)), sizes)
        odd = np.bincount(of[self.counts[where, 0] == 0], minlength=len(texts)) > 0
        where, sizes = where[~odd[of]], np.where(odd, 0, sizes)
        used, places = np.unique(where, return_inverse=True)
        return where, places, sizes, used

    def links_of(self, units: np.ndarray) -> np.ndarray:
        """The links of units, one after the other."""
        n = self.counts[units, 3]
        starts = (np.cumsum(self.counts[:, 3]) - self.counts[:, 3])[units]
        return self.links[np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)]


_units: dict[tuple[int, int], Units] = {}


def units_of(a_source: bytes, b_source: bytes) -> Units:
    key = hash(a_source), hash(b_source)
    if key not in _units:
        _units[key] = Units(side(SideA, a_source), side(SideB, b_source))
    return _units[key]


#: A document points by `units` to its batch's units; these, in the batch's own row, have `sizes` links each and point by `links` to its pairs.
_BATCHED = "c {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, batch long, units array<int>, sizes array<int>, links array<int>, pairs array<long>, pair_times array<long>"


def _batched(taken: DataFrame, a_source, b_source) -> DataFrame:
    def run(batches):
        store = units_of(a_source.value, b_source.value)
        number = TaskContext.get().partitionId() << 32
        for batch in text_batches(batches, "text", BATCH_BYTES):
            n = batch.num_rows
            where, places, sizes, used = store.batch(batch.column("text").to_pylist())
            counts = [summed(store.counts[where, k], sizes) for k in range(4)]
            digests, end = [], 0
            for size in sizes.tolist():
                start, end = end, end + size
                digests.append(hashlib.sha256(b";".join(map(store.written.__getitem__, where[start:end].tolist()))).hexdigest() if size else "")
            pairs, links = np.unique(store.links_of(used), return_inverse=True)
            per_unit = store.counts[used, 3]
            times = np.zeros(len(pairs), np.int64)
            np.add.at(times, links, np.repeat(np.bincount(places, minlength=len(used)), per_unit))
            # The batch's own row is the last.
            mine = lambda values, kind: pa.ListArray.from_arrays(pa.array([0] * (n + 1) + [len(values)], pa.int32()), pa.array(values, kind))
            ends = np.append(0, np.cumsum(sizes))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([batch.column("c"), pa.nulls(1, batch.column("c").type)]),
                    *[pa.array(np.append(x, 0), pa.int64()) for x in counts],
                    pa.array([*digests, None], pa.string()),
                    pa.array(np.full(n + 1, number), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.append(ends, ends[-1]), pa.int32()), pa.array(places, pa.int32())),
                    mine(per_unit, pa.int32()),
                    mine(links, pa.int32()),
                    mine(pairs, pa.int64()),
                    mine(times, pa.int64()),
                ],
                names=["c", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "batch", "units", "sizes", "links", "pairs", "pair_times"],
            )
            number += 1

    return taken.mapInArrow(run, _BATCHED.format(kind=taken.schema["c"].dataType.simpleString()))


def token_alignment(docs: DataFrame, a_path: str, b_path: str, text: str = "text", carry: str = "doc_id") -> DataFrame:
    """carry, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every text."""
    context = docs.sparkSession.sparkContext
    a_source, b_source = context.broadcast(read_shipped(a_path)), context.broadcast(read_shipped(b_path))
    taken = _taken(docs, text, carry)
    table = staged(_batched(taken, a_source, b_source), "aligned")
    width = len(side(SideB, b_source.value).bytes)
    pairs = table.where("groups_sha256 IS NULL").select("batch", F.posexplode(F.arrays_zip("pairs", "pair_times")).alias("slot", "p")).select("batch", "slot", F.col("p.pairs").alias("pair"), F.col("p.pair_times").alias("n"))
    counts = staged(pairs.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    b_id = (F.col("pair") % width).alias("b_id")
    highest = counts.groupBy(b_id).agg(F.max("count").alias("highest"))  # a row for each id of B
    counts = counts.withColumn("b_id", b_id).join(highest, "b_id").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    known = pairs.join(counts, "pair").select(F.col("batch").alias("holder"), "slot", "count", "best")
    plain = ["c", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    documents = table.select(*plain, "batch", "units", "sizes", "links")
    schema = T.StructType([*[documents.schema[c] for c in plain], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def looked_up(left: pa.Table, right: pa.Table) -> pa.Table:
        count, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        slot = right["slot"].to_numpy()
        count[slot], best[slot] = right["count"].to_numpy(), right["best"].to_numpy(zero_copy_only=False)
        flat = lambda t, c: pc.list_flatten(t[c].combine_chunks()).to_numpy()
        own = pc.is_null(left["groups_sha256"])
        batch, out = left.filter(own), left.filter(pc.invert(own))
        sizes, links = flat(batch, "sizes"), flat(batch, "links")
        units, ends = flat(out, "units"), pc.list_value_length(out["units"]).to_numpy()
        out = out.select(plain)
        for name, values in (("n_best", best), ("count_sum", count)):
            out = out.append_column(name, pa.array(summed(summed(values[links], sizes)[units], ends)))
        return out

    out = documents.groupBy("batch").cogroup(known.groupBy("holder")).applyInArrow(looked_up, schema)
    return out.select(F.col("c").alias(carry), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
