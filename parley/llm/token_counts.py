"""Token counts: whole texts encoded in Arrow batches, lengths only.

Batches hold about BATCH_BYTES of text rather than a number of rows, and texts
over PIECE_BYTES are split where no vocabulary piece can reach across, so that a
batch of very long texts needs no more memory than one of short ones.

Cases. Null text: counted as the empty text (0 bytes, 0 tokens). Empty table:
no rows. Repeated rows: one result each. Null ids and further columns of any
name: carried only if they are asked for in `carry`; a column asked for or a text column that is absent counts as null. A long text without a safe
boundary is encoded whole.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import named, read_shipped, text_batches

LIMIT = 4096
BATCH_BYTES = 1 << 20
PIECE_BYTES = 1 << 15

_loaded: dict[int, tuple] = {}


def _encoder(proto: bytes):
    """The model, once a worker, and whether its pieces allow splits before white space."""
    import sentencepiece as spm

    key = hash(proto)
    if key not in _loaded:
        model = spm.SentencePieceProcessor(model_proto=proto)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        # A split before a space is safe if no piece has its mark after another character; before a line end, if no
        # piece but the byte's own has one.
        spaces = not any("▁" in p.lstrip("▁") for p in pieces)
        lines = not any("\n" in p for p in pieces)
        _loaded[key] = model, spaces, lines
    return _loaded[key]


def split_safely(text: str, size: int, spaces: bool, lines: bool) -> tuple[list[str], int]:
    """Parts that encode as the whole does, and how many tokens their added prefixes bring too many.

    A part that began with a space gives it up: the encoder's own prefix stands for
    it. A part that begins with a line end gets a prefix that joins nothing: one
    token too many.
    """
    marks = (r"(?<=[^\s▁])[ ](?=[^\s▁])" if spaces else "") + ("|" if spaces and lines else "") + (r"(?<=[^\s▁])\n" if lines else "")
    if len(text) <= size or not marks:
        return [text], 0
    find = re.compile(marks)
    parts, extra, at, skip = [], 0, 0, 0
    while len(text) - at > size:
        hit = find.search(text, at + size)
        if hit is None:
            break
        parts.append(text[at + skip : hit.start()])
        at, skip = hit.start(), int(hit[0] == " ")
        extra += 1 - skip
    parts.append(text[at + skip :])
    return parts, extra


def count_batch(texts: list[str], proto: bytes, size: int = PIECE_BYTES) -> list[int]:
    model, spaces, lines = _encoder(proto)
    parts: list[str] = []
    spans = []
    for text in texts:
        own, extra = split_safely(text, size, spaces, lines)
        spans.append((len(parts), len(parts) + len(own), extra))
        parts += own
    lengths = [len(ids) for ids in model.encode(parts, num_threads=1)]
    return [sum(lengths[a:b]) - extra for a, b, extra in spans]


def token_counts(docs: DataFrame, model_path: str, carry: tuple[str, ...] = ("doc_id",), text: str = "text", limit: int = LIMIT, batch_bytes: int = BATCH_BYTES, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """carry, then n_bytes, n_tokens and over_limit of every whole text."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(read_shipped(model_path))
    taken = docs.select(*[named(docs, c, "bigint").alias(f"c{i}") for i, c in enumerate(carry)], F.coalesce(named(docs, text, "string"), F.lit("")).alias("text"))

    def run(batches):
        for batch in text_batches(batches, "text", batch_bytes):
            texts = batch.column("text")
            found = count_batch(texts.to_pylist(), shipped.value, piece_bytes)
            sizes = pc.binary_length(texts).cast(pa.int64())
            kept = [batch.column(f"c{i}") for i in range(len(carry))]
            yield pa.RecordBatch.from_arrays([*kept, sizes, pa.array(found, pa.int64()), pa.array([n > limit for n in found], pa.bool_())], names=[*[f"c{i}" for i in range(len(carry))], "n_bytes", "n_tokens", "over_limit"])

    fields = [T.StructField(f"c{i}", taken.schema[f"c{i}"].dataType) for i in range(len(carry))]
    schema = T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return taken.mapInArrow(run, schema).toDF(*carry, "n_bytes", "n_tokens", "over_limit")
