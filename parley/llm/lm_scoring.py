"""Document probabilities by a subword lattice, beside a word unigram base.

The vocabulary is an existing one, and its scores weight all segmentations. A score is
a log weight where the file is a unigram vocabulary. Where it is a byte-pair one its
scores are minus a rank, and one fixed map turns them into weights: 1 / (10 + rank), as
frequencies fall with rank; pieces without a rank (bytes) weigh as rank 100,000. The
weights are then normalised over the pieces that can occur. A piece never reaches over
white space, so a document's lattice is a chain of its words' lattices: a word's
marginal probability, over all its segmentations, is computed once for each distinct
word by a forward recursion in log space. A document's is the product over its words,
each with the chance that the text goes on, and of the chance that it ends; the two
chances are learned from the training texts' words and ends.

`rounds` above 0 fits the pieces' weights to the training words, from the file's, by
expectation-maximisation over whole lattices. `whole_words` adds one arc to each lattice
whose word the training texts hold: the word as a piece, with its share c / (n + v) of
their n words, of which v are distinct. All cuts into the vocabulary's pieces share the
rest, v / (n + v). As they then stand for words that the training texts lack, weights are
fitted to each distinct training word once. The query does both.

Texts are tokenised once, in blocks of up to BLOCK_BYTES that stay within a
partition. A block gives its distinct words with training counts, and for each
document numbers and counts of words. Words are aggregated over blocks, joined back
to them, and meet the block's documents in one group, bounded by the block's size. No
shuffle carries a row for each word of each document, and no task needs the
vocabulary of the corpus.

Cases. Null text: the empty text, one end token. Null ids: not held out. Empty table:
no rows. No training texts: half of all tokens are presumed ends. Repeated rows: one
result each, each trained on. A word that no piece matches is spelt by byte pieces. A
word of any length is gone through in parts, with a number for each byte only where
weights are fitted. Further columns of any name are not looked at.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, held_out, packed, read_shipped, staged, staged_path, text_batches

BLOCK_BYTES = 16 << 20
#: Added to each piece's expected count where weights are fitted.
SMOOTHING = 0.1
#: Words with more symbols go through the recursion one at a time.
LONG = 48
#: Words that go through the recursion together, and places of a long word whose pieces are looked up together.
TOGETHER = 20_000
#: The rank that pieces without one count as.
LAST_RANK = 1e5
END = b""
MARK = 256


class Pieces:
    """Pieces of a vocabulary as a trie over bytes and the mark of a word's start."""

    def __init__(self, proto: bytes):
        import sentencepiece as spm

        model = spm.SentencePieceProcessor(model_proto=proto)
        # Log probabilities of a unigram vocabulary are not whole numbers; ranks are.
        unigram = any(model.get_score(i) % 1 for i in range(model.get_piece_size()))
        found: dict[tuple[int, ...], float] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_control(i) or model.is_unknown(i):
                continue
            if model.is_byte(i):
                symbols = (int(piece[3:5], 16),)
            else:
                symbols = tuple(s for k, part in enumerate(piece.split("▁")) for s in ((MARK,) if k else ()) + tuple(part.encode()))
                # Words are in lower case and hold one mark, at their start.
                if MARK in symbols[1:] or re.search("[A-Z]", piece):
                    continue
            weight = math.exp(model.get_score(i)) if unigram else 1 / (10 + min(-model.get_score(i) if not model.is_byte(i) else LAST_RANK, LAST_RANK))
            found[symbols] = max(found.get(symbols, 0.0), weight)
        found.setdefault((MARK,), 1e-6)
        for b in range(256):
            found.setdefault((b,), 1e-6)
        self.symbols = sorted(found)
        self.first = np.array([found[s] for s in self.symbols])
        used = sorted({x for s in self.symbols for x in s})
        self.kind = np.zeros(MARK + 1, np.int32)
        self.kind[used] = np.arange(len(used))
        index: dict[tuple[int, ...], int] = {(): 0}
        for s in self.symbols:
            for k in range(1, len(s) + 1):
                index.setdefault(s[:k], len(index))
        self.step = np.full((len(index), len(used)), -1, np.int32)
        for s, state in index.items():
            if s:
                self.step[index[s[:-1]], self.kind[s[-1]]] = state
        self.piece = np.full(len(index), -1, np.int32)
        self.piece[[index[s] for s in self.symbols]] = np.arange(len(self.symbols))
        self.longest = max(map(len, self.symbols))

    def arcs(self, words: list[bytes]) -> tuple[np.ndarray, list[list[tuple[np.ndarray, np.ndarray]]]]:
        """Lengths, and for each start the (words, pieces) that end one, two, ... symbols later."""
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        width = int(lengths.max())
        flat = np.frombuffer(b"".join(words), np.uint8)
        grid = np.zeros((len(words), width), np.int32)
        grid[:, 0] = self.kind[MARK]
        rows = np.repeat(np.arange(len(words)), lengths - 1)
        starts = np.cumsum(lengths - 1) - (lengths - 1)
        grid[rows, np.arange(len(flat)) - np.repeat(starts, lengths - 1) + 1] = self.kind[flat]
        out = []
        for s in range(width):
            live = np.nonzero(lengths > s)[0]
            state = np.zeros(len(live), np.int32)
            own = []
            for e in range(s, width):
                keep = lengths[live] > e
                live, state = live[keep], state[keep]
                state = self.step[state, grid[live, e]]
                keep = state >= 0
                live, state = live[keep], state[keep]
                if not len(live):
                    break
                piece = self.piece[state]
                hit = piece >= 0
                own.append((live[hit], piece[hit]))
            out.append(own)
        return lengths, out

    def forward(self, words: list[bytes], logs: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log marginal probability of each word; with counts, also the pieces' expected counts."""
        total = np.zeros(len(words))
        expected = None if counts is None else np.zeros(len(logs))
        short = [i for i, w in enumerate(words) if len(w) < LONG]
        short.sort(key=lambda i: len(words[i]))
        for at in range(0, len(short), TOGETHER):
            own = np.array(short[at : at + TOGETHER])
            lengths, arcs = self.arcs([words[i] for i in own])
            alpha = np.full((len(own), int(lengths.max()) + 1), -np.inf)
            alpha[:, 0] = 0
            for s, ends in enumerate(arcs):
                for k, (w, p) in enumerate(ends):
                    alpha[w, s + k + 1] = np.logaddexp(alpha[w, s + k + 1], alpha[w, s] + logs[p])
            whole = alpha[np.arange(len(own)), lengths]
            total[own] = whole
            if counts is not None:
                beta = np.full_like(alpha, -np.inf)
                beta[np.arange(len(own)), lengths] = 0
                for s in range(len(arcs) - 1, -1, -1):
                    for k, (w, p) in enumerate(arcs[s]):
                        through = logs[p] + beta[w, s + k + 1]
                        expected += np.bincount(p, np.exp(alpha[w, s] + through - whole[w]) * counts[own[w]], len(logs))
                        beta[w, s] = np.logaddexp(beta[w, s], through)
        for i in (i for i, w in enumerate(words) if len(w) >= LONG):
            total[i] = self._long(words[i], logs, None if counts is None else counts[i], expected)
        return total, expected

    def _starts(self, word: bytes, begin: int, end: int) -> tuple[list[list[int]], list[list[int]]]:
        """For each start from begin to end, the lengths and the pieces of the arcs that leave it."""
        whole = np.concatenate([self.kind[[MARK] if begin == 0 else [word[begin - 1]]], self.kind[np.frombuffer(word, np.uint8)[begin : end + self.longest]]])
        lengths: list[list[int]] = [[] for _ in range(end - begin)]
        found: list[list[int]] = [[] for _ in range(end - begin)]
        live, state = np.arange(end - begin), np.zeros(end - begin, np.int32)
        for k in range(self.longest):
            keep = live + k < len(whole)
            live, state = live[keep], state[keep]
            state = self.step[state, whole[live + k]]
            keep = state >= 0
            live, state = live[keep], state[keep]
            piece = self.piece[state]
            for s, p in zip(live[piece >= 0].tolist(), piece[piece >= 0].tolist(), strict=True):
                lengths[s].append(k + 1)
                found[s].append(p)
        return lengths, found

    def _long(self, word: bytes, logs: np.ndarray, weight: float | None, expected: np.ndarray | None) -> float:
        """The same recursion over one word, in parts. A ring holds as many sums as a piece is long; all are kept only for expected counts."""
        n, ring = len(word) + 1, self.longest + 1
        value = logs.tolist()
        ahead = [-math.inf] * ring
        ahead[0] = 0.0
        alphas = array("d") if expected is not None and weight else None
        for begin in range(0, n, TOGETHER):
            end = min(n, begin + TOGETHER)
            lengths, found = self._starts(word, begin, end)
            for s in range(begin, end):
                at = s % ring
                here, ahead[at] = ahead[at], -math.inf
                if alphas is not None:
                    alphas.append(here)
                for k, p in zip(lengths[s - begin], found[s - begin], strict=True):
                    to = (s + k) % ring
                    a, b = ahead[to], here + value[p]
                    ahead[to] = b if a == -math.inf else max(a, b) + math.log1p(math.exp(-abs(a - b)))
        total = ahead[n % ring]
        if alphas is not None:
            behind = [-math.inf] * ring
            behind[n % ring] = 0.0
            for begin in range((n - 1) // TOGETHER * TOGETHER, -1, -TOGETHER):
                end = min(n, begin + TOGETHER)
                lengths, found = self._starts(word, begin, end)
                for s in range(end - 1, begin - 1, -1):
                    sum_ = -math.inf
                    for k, p in zip(lengths[s - begin], found[s - begin], strict=True):
                        b = value[p] + behind[(s + k) % ring]
                        expected[p] += weight * math.exp(alphas[s] + b - total)
                        sum_ = b if sum_ == -math.inf else max(sum_, b) + math.log1p(math.exp(-abs(sum_ - b)))
                    behind[s % ring] = sum_
        return total


_loaded: dict[int, Pieces] = {}


def pieces(proto: bytes) -> Pieces:
    key = hash(proto)
    if key not in _loaded:
        _loaded[key] = Pieces(proto)
    return _loaded[key]


_WORD = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("number", pa.int32()), ("token", pa.binary()), ("n", pa.int64()), ("numbers", pa.binary()), ("times", pa.binary())])


def _block(number: int, ids: list, held: list, texts: list[str]):
    """The rows of a block: its distinct words (n: training count), and its documents."""
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    end = numbers[END]
    docs, trained, sizes = [], [], []
    for text, out in zip(texts, held, strict=True):
        tokens = text.encode().lower().split()
        found = np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens))
        own, times = np.unique(np.append(found, np.int32(end)), return_counts=True)
        docs.append((own.astype(np.int32).tobytes(), times.astype(np.int32).tobytes()))
        sizes.append(len(tokens) + 1)
        if not out:
            trained.append((own, times))
    counts = np.zeros(len(numbers), np.int64)
    for own, times in trained:
        counts[own] += times
    n, d = len(numbers), len(docs)
    none = lambda size, kind: pa.nulls(size, kind)
    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), none(n, pa.int64()), none(n, pa.bool_()), none(n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), pa.array(list(numbers), pa.binary()), pa.array(counts), none(n, pa.binary()), none(n, pa.binary())], schema=_WORD)
    yield pa.RecordBatch.from_arrays([pa.array(np.full(d, number)), pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(sizes, pa.int64()), none(d, pa.int32()), none(d, pa.binary()), none(d, pa.int64()), pa.array([x for x, _ in docs], pa.binary()), pa.array([x for _, x in docs], pa.binary())], schema=_WORD)


def _tokenise(batches):
    number = (TaskContext.get().partitionId() << 24) - 1
    ids, held, texts, size = [], [], [], 0
    for batch in text_batches(batches, "text", BLOCK_BYTES // 16):
        ids += batch.column("doc_id").to_pylist()
        held += batch.column("held_out").to_pylist()
        texts += batch.column("text").to_pylist()
        size += batch.column("text").nbytes
        if size >= BLOCK_BYTES:
            number += 1
            yield from _block(number, ids, held, texts)
            ids, held, texts, size = [], [], [], 0
    if ids:
        yield from _block(number + 1, ids, held, texts)


def _expected(words: DataFrame, shipped, logs: np.ndarray, once: bool) -> np.ndarray:
    """Expected counts of all pieces over the training words (once: each distinct one counts once): a row for each piece and task, then one for each piece."""
    shared = words.sparkSession.sparkContext.broadcast(logs)

    def run(batches):
        tool, found = pieces(shipped.value), None
        for batch in batches:
            _, own = tool.forward(batch.column("token").to_pylist(), shared.value, batch.column("c").to_numpy().astype(float))
            found = own if found is None else found + own
        if found is not None:
            some = np.nonzero(found)[0]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], names=["piece", "n"])

    rows = words.where("c > 0 AND token <> X''").select("token", F.lit(1).cast("bigint").alias("c") if once else "c").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(logs))
    for r in rows:
        out[r["piece"]] = r["n"]
    return out


def file_logs(proto: bytes) -> np.ndarray:
    """Log weights of the pieces by the file's scores."""
    weights = pieces(proto).first
    return np.log(weights / weights.sum())


def lm_scores(docs: DataFrame, model_path: str, modulus: int = 7, remainder: int = 2, rounds: int = 0, whole_words: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every document.

    rounds: of fitting the pieces' weights to the training words; none leaves the vocabulary's own. whole_words: words of the training texts are pieces too.
    """
    spark = docs.sparkSession
    proto = read_shipped(model_path)
    shipped = spark.sparkContext.broadcast(proto)
    rows = packed(docs)
    rows = rows.select(column(rows, "doc_id", "bigint").alias("doc_id"), F.coalesce(column(rows, "text", "string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"))
    kinds = {"int64": T.LongType(), "bool": T.BooleanType(), "int32": T.IntegerType(), "binary": T.BinaryType()}
    schema = T.StructType([T.StructField(f.name, kinds[str(f.type)]) for f in _WORD])
    path = staged_path(spark, "lm-blocks")
    rows.mapInArrow(_tokenise, schema).withColumn("what", F.when(F.col("token").isNull(), "docs").otherwise("words")).write.partitionBy("what").parquet(path, compression="zstd")
    whole = T.StructType([*schema.fields, T.StructField("what", T.StringType())])
    block_words = spark.read.schema(whole).parquet(path).where("what = 'words'").select("block", "number", "token", "n")
    bags = spark.read.schema(whole).parquet(path).where("what = 'docs'").select("block", "doc_id", "held_out", "n_tokens", "numbers", "times")

    words = staged(block_words.groupBy("token").agg(F.sum("n").alias("c")), "lm-words")
    is_end = F.col("token") == F.lit(END)
    totals = words.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.sum(F.when(is_end, F.col("c"))).alias("ends")).first()
    trained, distinct, ends = (totals[k] or 0 for k in ("n", "v", "ends"))
    ending = (ends + 1) / (trained + 2)
    logs = file_logs(proto)
    for _ in range(rounds if trained > ends else 0):
        known = _expected(words, shipped, logs, whole_words) + SMOOTHING
        logs = np.log(known / known.sum())
    shared = spark.sparkContext.broadcast(logs)

    def marginal(batches):
        tool = pieces(shipped.value)
        for batch in batches:
            tokens = batch.column("token").to_pylist()
            found, _ = tool.forward([t for t in tokens if t != END], shared.value)
            it = iter(found)
            yield pa.RecordBatch.from_arrays([batch.column("token"), batch.column("c"), pa.array([None if t == END else next(it) for t in tokens], pa.float64())], names=["token", "c", "log_p"])

    valued = words.mapInArrow(marginal, "token binary, c long, log_p double")
    numbers = block_words.join(valued, "token").select(F.col("block").alias("of"), "number", "c", "log_p")
    over = float(trained + distinct + 1)
    # An end has no lattice: its value is null.
    end_value, going_on = math.log(ending), math.log1p(-ending)
    plain, kinds_of = trained - ends, distinct - (ends > 0)  # words of the training texts, and distinct ones
    joined = whole_words and plain > 0

    def score(own: pa.Table, found: pa.Table) -> pa.Table:
        at = found.column("number").to_numpy()
        c = np.zeros(len(at), np.int64)
        p = np.zeros(len(at))
        c[at], p[at] = found.column("c").to_numpy(), found.column("log_p").to_numpy().astype(float)
        base = np.log10((c + 1) / over)
        if joined:
            with np.errstate(divide="ignore", invalid="ignore"):
                p = np.logaddexp(np.log(c / (plain + kinds_of)), p + math.log(kinds_of / (plain + kinds_of)))
        p = np.where(np.isnan(p), end_value, p + going_on) / math.log(10)
        out = []
        for numbers, times in zip(own.column("numbers").to_pylist(), own.column("times").to_pylist(), strict=True):
            i, n = np.frombuffer(numbers, np.int32), np.frombuffer(times, np.int32)
            out.append((int(n[c[i] > 0].sum()), float(base[i] @ n), float(p[i] @ n)))
        return pa.table([own.column("doc_id"), own.column("held_out"), own.column("n_tokens"), pa.array([x for x, _, _ in out], pa.int64()), pa.array([trained] * len(out), pa.int64()), pa.array([x for _, x, _ in out], pa.float64()), pa.array([x for _, _, x in out], pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    result = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return bags.groupBy("block").cogroup(numbers.groupBy("of")).applyInArrow(score, result)
