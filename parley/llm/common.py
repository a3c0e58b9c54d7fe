"""What the training-data operators share: inputs, byte-balanced batches, staged tables, safe row carrying."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import drop_staged, shared_folder, staged, staged_path

__all__ = ["drop_staged", "shared_folder", "staged", "staged_path"]

#: ASCII white space: space, and tab to carriage return. Words are runs of anything else.
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Files shipped to executors whole (vocabularies) may not be larger than this.
MAX_SHIPPED_BYTES = 64 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def named(df: DataFrame, name: str, kind: str) -> Column:
    """A column by its name, or a typed null where the table lacks it."""
    return F.col(quoted(name)) if name.lower() in map(str.lower, df.columns) else F.lit(None).cast(kind)


def packed(df: DataFrame, name: str = "_row") -> DataFrame:
    """Every input column in one struct, so that working columns cannot clash with the input's."""
    return df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias(name))


def column(df: DataFrame, name: str, kind: str) -> Column:
    """A column of the packed row, or a typed null where the input lacks it."""
    fields = df.schema["_row"].dataType.names
    return F.col("_row")[name].cast(kind) if name in fields else F.lit(None).cast(kind)


def unpacked(df: DataFrame, *more: str) -> DataFrame:
    names = df.schema["_row"].dataType.names
    return df.select(*[F.col("_row")[n].alias(n) for n in names], *more)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, by remainder. A null id has no remainder: it is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def read_shipped(path: str) -> bytes:
    """A vocabulary file read on the driver, to be broadcast: its size is checked."""
    with open(path, "rb") as f:
        data = f.read(MAX_SHIPPED_BYTES + 1)
    if len(data) > MAX_SHIPPED_BYTES:
        raise ValueError(f"{path} is larger than {MAX_SHIPPED_BYTES} bytes and is not shipped to executors")
    return data


def text_batches(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of the incoming batches with about max_bytes of text each: at least a row, never part of one."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(text)).to_pylist()
        start = total = 0
        for i, n in enumerate(lengths):
            n = n or 0
            if i > start and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(lengths):
            yield batch.slice(start)
