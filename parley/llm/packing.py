"""Best-fit packing of documents into sequences of a fixed length, by local search.

Texts are encoded once; ids longer than a sequence are cut into pieces of its
length, and the rest of each document is one shorter piece. Whole pieces are
sequences of their own. Shorter ones are dealt by a hash into groups of bounded
size. In a group, best fit decreasing gives first bins, and a local search then
works on those that are not full: a piece moves from one bin to another, or one or
two pieces change places with one, whenever the sum of squared fills grows. The
emptiest bins give first, so that bins empty. What is not full after that is dealt
anew, by bins, into fewer groups, until one group holds the rest or a round empties
almost none: no task ever holds more than a group, and a bin is only ever improved.

Encoding: where the vocabulary's pre-tokenizer splits at white space, letters and other
signs, runs between ASCII white space are encoded once and remembered; those of Latin
letters and signs behind them go to the library's model as they are, all others through
the whole of the library. Texts of other vocabularies are encoded whole.

Cases. Null text, or one without tokens: the end id alone. Null ids and repeated
rows: packed like any other. Empty table: no rows. A text column or id that is
absent counts as null. Further columns of any name are not looked at. Ties of size
go by the place of the row, so that a retried task packs alike. A run of characters
of any length is encoded whole.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_letters
from .common import named, read_shipped, staged, text_batches

LENGTH = 2048
END_ID = 0
BATCH_BYTES = 4 << 20
#: Pieces that one task packs at a time.
GROUP = 8192
#: Times that the search goes over a group's bins; it ends sooner when nothing improves.
SWEEPS = 8
#: A round that empties a smaller share of its bins is the last.
LEAST_GAIN = 0.002
#: Remembered runs of a worker, and the longest that are remembered. Results do not depend on them.
CACHE_RUNS = 1_000_000
CACHE_RUN_BYTES = 64
#: Runs that the library gets at once.
AT_ONCE = 1024
#: The steps of a vocabulary whose runs are encoded alone as in a text.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A word and signs that are one part together, none of which begins a contraction or a special string.
WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([-.,;:!?$#*%&()\[\]\"/+=_@~^]*)")

_loaded: dict[int, Encoder] = {}


class Remembered(dict):
    """What `make` gives for a run of characters, kept if the run is short."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, run: bytes) -> bytes:
        ids = self.make(run)
        if len(run) <= CACHE_RUN_BYTES:
            self[run] = ids
        return ids


class Encoder:
    """ids of texts as little-endian 32-bit numbers."""

    def __init__(self, source: bytes):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source.decode())
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(source)
        steps, splits = ((spec[k] or {}).get(inner, []) for k, inner in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        self.by_run = [x["type"] for x in steps] == NORMALIZERS and [x["type"] for x in splits] == ["Split", "ByteLevel"] and splits[0]["pattern"] == {"Regex": SPLIT} and splits[0]["behavior"] == "Removed"
        shown = {b: c for c, b in byte_letters().items()}
        self.letters = {b: shown[b] for b in range(256)}
        self.cache = Remembered(self.run)

    def whole(self, texts: list[str]) -> list[bytes]:
        found = []
        for i in range(0, len(texts), AT_ONCE):
            found += [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts[i : i + AT_ONCE], add_special_tokens=False)]
        return found

    def word(self, word: str) -> bytes:
        """Of letters, in lower case."""
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.library.model.tokenize(shown)], "<u4").tobytes()

    def run(self, run: bytes) -> bytes:
        hit = WORD.fullmatch(run.decode())
        if hit is None:
            return self.whole([run.decode()])[0]
        word, signs = hit[1].lower(), hit[2]
        key = word.encode()
        if signs:
            return self.cache[key] + self.cache[signs.encode()]
        return self.cache[key] if key != run else self.word(word)

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_run:
            return self.whole(texts)
        if len(self.cache) > CACHE_RUNS:
            self.cache.clear()
        get = self.cache.__getitem__
        return [b"".join(map(get, t.encode().split())) for t in texts]  # bytes.split knows ASCII white space alone


def encoder(source: bytes) -> Encoder:
    key = hash(source)
    if key not in _loaded:
        _loaded[key] = Encoder(source)
    return _loaded[key]


def pieces(docs: DataFrame, vocabulary_path: str, length: int = LENGTH, end_id: int = END_ID, text: str = "text", carry: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """carry, piece, start, length and ids_crc32 of every document's pieces; with_ids adds their ids."""
    shipped = docs.sparkSession.sparkContext.broadcast(read_shipped(vocabulary_path))
    taken = docs.select(named(docs, carry, "bigint").alias("c"), F.coalesce(named(docs, text, "string"), F.lit("")).alias("text"))
    end, step = np.array([end_id], "<u4").tobytes(), 4 * length
    kinds = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    kinds += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []

    def run(batches):
        encode = encoder(shipped.value).encode
        for batch in text_batches(batches, "text", BATCH_BYTES):
            given = batch.column("text").to_pylist()
            own = list(dict.fromkeys(given))  # copies within a batch are encoded once
            by_text = {}
            for t, ids in zip(own, encode(own), strict=True):
                ids += end
                parts = [ids[i : i + step] for i in range(0, len(ids), step)]
                by_text[t] = [(i, i * length, len(p) // 4, zlib.crc32(p), *((np.frombuffer(p, "<u4").astype(np.int32),) if with_ids else ())) for i, p in enumerate(parts)]
            rows = [by_text[t] for t in given]
            at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            columns = zip(*(p for r in rows for p in r), strict=True)
            arrays = [pa.array(c, kind) for c, kind in zip(columns, [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("c").take(pa.array(at)), *arrays], names=["c", *[f.name for f in kinds]])

    return taken.mapInArrow(run, T.StructType([taken.schema["c"], *kinds])).withColumnRenamed("c", carry)


def best_fit(sizes: np.ndarray, length: int) -> np.ndarray:
    """The bin of each size: the largest first, each into the fullest bin that has room."""
    bins, free, n = np.zeros(len(sizes), np.int64), [[] for _ in range(length + 1)], 0
    rooms = 0  # a bit for each amount of room that some bin has
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        above = rooms >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            at = free[room].pop()
            if not free[room]:
                rooms ^= 1 << room
        else:
            at, room, n = n, length, n + 1
        bins[i] = at
        if room > size:
            free[room - size].append(at)
            rooms |= 1 << (room - size)
    return bins


def improve(sizes: np.ndarray, bins: np.ndarray, length: int, sweeps: int = SWEEPS) -> np.ndarray:
    """bins after moves and exchanges between those that are not full; each raises the sum of squared fills.

    A bin gives one piece or two and takes none or one. For each piece that it could
    take, the largest gift that the other bin then has room for is looked up; the best
    of all pieces is done.
    """
    fills = np.bincount(bins, sizes).astype(np.int64)
    loose = np.flatnonzero(fills[bins] < length)
    if not len(loose):
        return bins
    names, at = np.unique(bins[loose], return_inverse=True)
    size, fill = sizes[loose].astype(np.int64), fills[names]
    owned = [set() for _ in names]
    for i, b in enumerate(at.tolist()):
        owned[b].add(i)
    n = len(names)
    takes, of = np.concatenate([size, np.zeros(n, np.int64)]), np.concatenate([at, np.arange(n)])  # the last n: to take nothing
    for _ in range(sweeps):
        changed = False
        for a in np.argsort(fill, kind="stable").tolist():
            while owned[a] and fill[a] < length:
                own = sorted(owned[a], key=lambda i: (size[i], i))
                single = size[own]
                i, j = np.triu_indices(len(own), 1)
                gifts = np.concatenate([single, single[i] + single[j]])
                order = np.argsort(gifts, kind="stable")
                gifts = gifts[order]
                theirs = fill[of]
                room = length - theirs
                k = np.searchsorted(gifts, room + takes, "right") - 1
                net = gifts[k] - takes
                gain = net * (theirs + net - fill[a])
                gain[(k < 0) | (net <= 0) | (of == a) | (room == 0)] = 0
                best = int(gain.argmax())
                if gain[best] <= 0:
                    break
                b, given, changed = int(of[best]), int(order[k[best]]), True
                gone = [own[given]] if given < len(own) else [own[i[given - len(own)]], own[j[given - len(own)]]]
                back = [best] if best < len(size) else []
                for x in gone:
                    of[x] = b
                for x in back:
                    of[x] = a
                owned[a] = owned[a].difference(gone).union(back)
                owned[b] = owned[b].difference(back).union(gone)
                fill[a] -= net[best]
                fill[b] += net[best]
        if not changed:
            break
    out = bins.copy()
    out[loose] = names[of[: len(size)]]
    return out


def _search(rows: DataFrame, groups: int, salt: int, length: int, first: bool) -> DataFrame:
    """rows (_at, length, ...) with _bin, offset and _fill: packed within each group. The name of a bin is the smallest _at in it."""
    key = F.pmod(F.xxhash64(F.col("_at" if first else "_bin"), F.lit(salt)), F.lit(groups))
    kept = [f for f in rows.schema.fields if f.name not in ("_bin", "offset", "_fill")]
    schema = T.StructType([*kept, *[T.StructField(n, T.LongType()) for n in ("_bin", "offset", "_fill")]])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        at, sizes = table["_at"].to_numpy(), table["length"].to_numpy()
        bins = best_fit(sizes, length) if first else np.unique(table["_bin"].to_numpy(), return_inverse=True)[1]
        bins = improve(sizes, bins, length)
        order = np.argsort(bins, kind="stable")
        starts = np.flatnonzero(np.diff(bins[order], prepend=-1))
        counts = np.diff(starts, append=len(order))
        ends = np.cumsum(sizes[order])
        before = ends - sizes[order]
        offset, name, fill = (np.zeros(len(at), np.int64) for _ in range(3))
        offset[order] = before - np.repeat(before[starts], counts)
        name[order] = np.repeat(at[order][starts], counts)
        fill[order] = np.repeat(np.add.reduceat(sizes[order], starts), counts)
        out = table.select([f.name for f in kept])
        for n, values in (("_bin", name), ("offset", offset), ("_fill", fill)):
            out = out.append_column(n, pa.array(values))
        return out

    return rows.select("*", key.alias("_group")).groupBy("_group").applyInArrow(lambda t: run(t.drop_columns(["_group"])), schema)


def pack(rows: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """rows, each with a length from 1 to `length`, and their sequence_id and offset. Rows are staged first: what a place means must not change."""
    table = staged(rows.select("*", F.monotonically_increasing_id().alias("_at")), "pieces")
    done = table.where(F.col("length") >= length).select("*", F.col("_at").alias("_bin"), F.lit(0).cast("bigint").alias("offset"))
    loose, salt, before = table.where(F.col("length") < length), 0, None
    n = loose.count()
    while n:
        groups = -(-n // group)
        packed = staged(_search(loose, groups, salt, length, salt == 0), "packed")
        done = done.unionByName(packed.where(F.col("_fill") >= length).drop("_fill"))
        loose = packed.where(F.col("_fill") < length)
        n, bins = loose.agg(F.count("*"), F.count_if(F.col("_at") == F.col("_bin"))).first()
        if groups == 1 or before is not None and before - bins <= LEAST_GAIN * before:
            done = done.unionByName(loose.drop("_fill"))
            break
        before, salt = bins, salt + 1
    return done.drop("_at").withColumnRenamed("_bin", "sequence_id")


def packed_documents(docs: DataFrame, vocabulary_path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    found = pack(pieces(docs, vocabulary_path, length, end_id), length)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the sequences themselves, of packed pieces that carry their ids."""
    part = F.struct("offset", "ids", "doc_id")
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("p"))
    return rows.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.doc_id").alias("doc_ids"))
