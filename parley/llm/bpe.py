"""BPE encoding and decoding by speculation: greedy longest-match proposes, pair checks verify, the rest is merged exactly.

Tokens' ids follow the order of the merges, so two neighbouring tokens are
compatible exactly if merging the text of both yields them again; a proposal all
of whose neighbours are compatible is the exact encoding. The checks of all
neighbours of a batch run together on arrays.

Cases. Null text: the empty text (no tokens, the digests of nothing). A special
string inside a text becomes its special token, as the tokenizers library does by
default. Empty table: no rows. Repeated rows: one result each. Further columns of
any name: carried only if they are named in `carry`; a column named there or a text column that is
absent counts as null.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import named, read_shipped, text_batches

BATCH_BYTES = 4 << 20
#: Entries of a worker's word cache, about 300 MB; at the bound it starts anew. Results do not depend on it.
CACHE_WORDS = 1_500_000
#: Words longer than this are not kept in the cache.
CACHE_WORD_CHARS = 256
#: Words of so many bytes are merged without a heap.
SHORT = 24
#: Where a text may be cut: a single space between other characters.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: Fixed value: the pattern that byte-level BPE splits text by before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(None)
def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Bytes, merges and special tokens of a byte-level BPE vocabulary file."""

    def __init__(self, source: bytes):
        import regex

        spec = json.loads(source)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        ids = spec["model"]["vocab"]
        n = 1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes: list[bytes] = [b""] * n
        for token, i in ids.items():
            self.bytes[i] = raw(token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.ids = {raw(token): i for token, i in ids.items() if token not in self.special}
        self.longest = max(map(len, self.ids))
        self.byte_list = [self.ids[bytes([b])] for b in range(256)]
        merges = [(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        left, right = (np.array([ids[m[k]] for m in merges], np.int64) for k in (0, 1))
        made = np.array([ids["".join(m)] for m in merges], np.int64)
        if len(made) and (np.diff(made) <= 0).any() or len(made) and made[0] < 256:
            raise ValueError("token ids must follow the order of the merges")
        self.ranks = {(a, b): c for a, b, c in zip(left.tolist(), right.tolist(), made.tolist(), strict=True)}
        # Halves of each token: of a byte, itself. order: by merge, bytes first and equal.
        self.left, self.right = np.arange(n), np.arange(n)
        self.left[made], self.right[made] = left, right
        keys = left * n + right
        by = np.argsort(keys)
        self.pair_keys, self.pair_made, self.n = keys[by], made[by], n
        self.whole = np.zeros(n, bool)  # a token that its own text is not merged to is never proposed
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        for token, i in self.ids.items():
            self.whole[i] = len(token) == 1
        self.whole[made] = True
        odd = [i for i in made.tolist() if self.ids.get(self.bytes[i]) != i or self.merge(self.bytes[i]) != [i]]
        self.whole[odd] = False
        self.sound = {t: i for t, i in self.ids.items() if self.whole[i]}
        self.cache: dict[str, str] = {}

    def merge_short(self, word: bytes) -> list[int]:
        """merge() by looking at all pairs again after each merge: the quicker way for few bytes."""
        by_byte, get = self.byte_list, self.ranks.get
        ids = [by_byte[b] for b in word]
        made = list(map(get, zip(ids, ids[1:], strict=False)))
        while True:
            best, at = None, -1
            for i, c in enumerate(made):
                if c is not None and (best is None or c < best):
                    best, at = c, i
            if best is None:
                return ids
            ids[at : at + 2] = [best]
            # The pairs beside it are new ones.
            del made[at]
            if at < len(made):
                made[at] = get((best, ids[at + 1]))
            if at:
                made[at - 1] = get((ids[at - 1], best))

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the lowest merge first, leftmost among equals; n log n."""
        if len(word) <= SHORT:
            return self.merge_short(word)
        ids = [self.byte_list[b] for b in word]
        before, after = list(range(-1, len(ids) - 1)), list(range(1, len(ids) + 1))
        ranks, heap = self.ranks, []
        for i in range(len(ids) - 1):
            if (c := ranks.get((ids[i], ids[i + 1]))) is not None:
                heap.append((c, i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            c, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = c, -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
                if (d := ranks.get((c, ids[after[i]]))) is not None:
                    heapq.heappush(heap, (d, i, c, ids[after[i]]))
            if before[i] >= 0 and (d := ranks.get((ids[before[i]], c))) is not None:
                heapq.heappush(heap, (d, before[i], ids[before[i]], c))
        return [i for i in ids if i >= 0]

    def propose(self, word: bytes) -> list[int]:
        out, at, n, sound = [], 0, len(word), self.sound
        while at < n:
            end = min(n, at + self.longest)
            while (found := sound.get(word[at:end])) is None:
                end -= 1
            out.append(found)
            at = end
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of neighbours: would merging the text of both never join anything across their border?

        The later-made of the two tokens is undone first. Its half at the border was
        there until it was made, so a merge across the border is possible only if it
        comes before that; each round looks up that merge and undoes one token.
        """
        ok = np.zeros(len(a), bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        until = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            keys = a * self.n + b
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            made = np.where(self.pair_keys[at] == keys, self.pair_made[at], np.iinfo(np.int64).max)
            # Across the border, leftmost first: a merge of equal rank made on the left comes before, on the right after.
            going = made >= until
            live, a, b, until = live[going], a[going], b[going], until[going]
            solid_a, solid_b = self.left[a] == a, self.left[b] == b
            done = solid_a & solid_b
            ok[live[done]] = True
            live, a, b, solid_a, solid_b = (x[~done] for x in (live, a, b, solid_a, solid_b))
            rank_a, rank_b = np.where(solid_a, -1, a), np.where(solid_b, -1, b)
            undo_a = rank_a > rank_b
            # Undone on the left, its merge stands left of the border and wins ties; on the right it loses them.
            until = np.where(undo_a, rank_a, rank_b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return ok

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        proposed = [self.propose(w) for w in words]
        flat = np.fromiter((i for p in proposed for i in p), np.int64)
        lengths = np.fromiter(map(len, proposed), np.int64, len(proposed))
        word = np.repeat(np.arange(len(words)), lengths)
        inner = word[1:] == word[:-1]
        bad = ~self.compatible(flat[:-1][inner], flat[1:][inner])
        for i in np.unique(word[1:][inner][bad]):
            proposed[i] = self.merge(words[i])
        return proposed

    def chunks(self, text: str) -> list[str]:
        """Parts that are split alike alone or in the text: cut before single spaces between other characters."""
        first, *parts = BETWEEN.split(text)
        return [first, *map(" ".__add__, parts)]

    def pieces(self, text: str) -> list[str]:
        """The chunks of a text, special strings as chunks of their own."""
        if self.cut is None or not self.cut.search(text):
            return self.chunks(text)
        out, at = [], 0
        for hit in self.cut.finditer(text):
            if hit.start() > at:
                out += self.chunks(text[at : hit.start()])
            out.append(hit[0])
            at = hit.end()
        return out + (self.chunks(text[at:]) if at < len(text) else [])

    def encode_texts(self, texts: list[str]) -> list[str]:
        """The ids of each text, as decimals joined by commas."""
        cut = [self.pieces(t) if t else [] for t in texts]
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
            cache |= {s: str(i) for s, i in self.special.items()}
        elif not cache:
            cache |= {s: str(i) for s, i in self.special.items()}
        new = list({p for c in cut for p in c if p not in cache})
        words = [self.split.findall(p) for p in new]
        distinct = list({w for ws in words for w in ws if w not in cache})
        own = {w: ",".join(map(str, ids)) for w, ids in zip(distinct, self.encode_words([w.encode() for w in distinct]), strict=True)}
        both = cache if all(len(w) <= CACHE_WORD_CHARS for w in own) else dict(cache)
        both |= own
        both |= {p: ",".join([both[w] for w in ws]) for p, ws in zip(new, words, strict=True) if len(ws) > 1}
        if both is not cache:
            cache |= {p: both[p] for p in [*own, *new] if len(p) <= CACHE_WORD_CHARS}
        get = both.__getitem__
        return [",".join(map(get, c)) for c in cut]

    def decode(self, ids: np.ndarray) -> str:
        """Bytes of the tokens joined; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


_loaded: dict[int, Vocabulary] = {}


def vocabulary(source: bytes) -> Vocabulary:
    key = hash(source)
    if key not in _loaded:
        _loaded[key] = Vocabulary(source)
    return _loaded[key]


def parse_ids(joined: str) -> np.ndarray:
    return np.fromstring(joined, np.int64, sep=",") if joined else np.zeros(0, np.int64)


def bpe_round_trip(docs: DataFrame, vocabulary_path: str, carry: tuple[str, ...] = ("doc_id",), text: str = "text", with_ids: bool = False, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """carry, n_tokens, ids_sha256 and decoded_sha256 of every whole text; with_ids adds token_ids and decoded."""
    shipped = docs.sparkSession.sparkContext.broadcast(read_shipped(vocabulary_path))
    taken = docs.select(*[named(docs, c, "bigint").alias(f"c{i}") for i, c in enumerate(carry)], F.coalesce(named(docs, text, "string"), F.lit("")).alias("text"))
    names = [f"c{i}" for i in range(len(carry))]

    def run(batches):
        vocab = vocabulary(shipped.value)
        for batch in text_batches(batches, "text", batch_bytes):
            given = batch.column("text").to_pylist()
            # Copies within a batch are encoded once.
            own = list(dict.fromkeys(given))
            by_text = {}
            for text_, joined in zip(own, vocab.encode_texts(own), strict=True):
                ids = parse_ids(joined)
                back = vocab.decode(ids)
                digests_ = hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()
                by_text[text_] = (len(ids), *digests_, *((ids.astype(np.int32), back) if with_ids else ()))
            counts, digests, backs, *rest = zip(*map(by_text.__getitem__, given), strict=True)
            more = [pa.array(rest[0], pa.list_(pa.int32())), pa.array(rest[1], pa.string())] if with_ids else []
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(backs, pa.string()), *more], names=[*names, "n_tokens", "ids_sha256", "decoded_sha256", *["token_ids", "decoded"][: len(more)]])

    schema = T.StructType([T.StructField(c, taken.schema[c].dataType) for c in names] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] + ([T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())] if with_ids else []))
    out = taken.mapInArrow(run, schema)
    return out.toDF(*carry, *out.columns[len(carry) :])
