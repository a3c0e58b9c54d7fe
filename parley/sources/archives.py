"""SRC1, SRC4: lines of zstandard archives with windows up to 2 GiB, which Spark's own text reader refuses over 128 MiB.

A file of many frames is many tasks. Where frames begin is told by the seek table that
seekable archives end with, or found by the headers of frames and blocks. A line belongs to
the task in whose frames it begins, or at whose end it begins; that task reads on until the
line ends, and the next one skips to the line after.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import file_system, matching

#: The largest window that the format's long mode has.
MAX_WINDOW = 1 << 31
CHUNK_BYTES = 1 << 20
ROWS = 10_000


#: Fixed values of the format: marks of a frame, of frames to skip, and of a seek table.
FRAME, SKIPPED, TABLE, TABLE_FRAME = 0xFD2FB528, 0x184D2A50, 0x8F92EAB1, 0x184D2A5E
#: Compressed bytes of a task, at least.
SPLIT_BYTES = 64 << 20


class ArchiveFile(InputPartition):
    """Frames of a file from byte `start` to before `end`; there are more before, or behind, unless it is the file's first, or last, byte."""

    def __init__(self, number: int, path: str, start: int, end: int, size: int):
        super().__init__((path, start))
        self.number, self.path, self.start, self.end, self.size = number, path, start, end, size


def seek_table(read, size: int) -> list[int] | None:
    """Where frames begin by the table at the end, if there is one. read(at, n): bytes of the file."""
    if size < 17:
        return None
    foot = read(size - 9, 9)
    if int.from_bytes(foot[5:], "little") != TABLE:
        return None
    count, entry = int.from_bytes(foot[:4], "little"), 12 if foot[4] & 0x80 else 8
    length = count * entry + 9
    if length + 8 > size:
        return None
    head = read(size - length - 8, 8)
    if int.from_bytes(head[:4], "little") != TABLE_FRAME or int.from_bytes(head[4:], "little") != length:
        return None
    rows, at, out = read(size - length, count * entry), 0, []
    for i in range(0, count * entry, entry):
        out.append(at)
        at += int.from_bytes(rows[i : i + 4], "little")
    return out if at == size - length - 8 else None


def frame_starts(read, size: int) -> list[int]:
    """Where frames begin, by their headers and those of their blocks; up to where the file stops being one of frames."""
    at, out = 0, []
    while at + 8 <= size:
        head = read(at, 18)
        mark = int.from_bytes(head[:4], "little")
        if mark & 0xFFFFFFF0 == SKIPPED:
            at += 8 + int.from_bytes(head[4:8], "little")
            continue
        if mark != FRAME:
            break
        start, flags = at, head[4]
        single = flags >> 5 & 1
        at += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
        while at + 3 <= size:
            block = int.from_bytes(read(at, 3), "little")
            at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)  # a repeated byte is stored once
            if block & 1:
                break
        at += 4 * (flags >> 2 & 1)
        if at > size:
            break
        out.append(start)
    return out


def splits(starts: list[int], size: int, least: int) -> list[tuple[int, int]]:
    """Ranges of whole frames with at least so many bytes each, but the last."""
    cuts = [0]
    for at in starts:
        if at - cuts[-1] >= least:
            cuts.append(at)
    return list(zip(cuts, [*cuts[1:], size], strict=True))


def owned(inside: Iterator[bytes], behind: Iterator[bytes], first: bool) -> Iterator[bytes]:
    """What of the chunks belongs to a range: without what comes before its first line, unless it is the file's first, and with the line that begins in it or at its end, whole."""
    skipping = not first
    for chunk in inside:
        if skipping:
            cut = chunk.find(b"\n")
            if cut < 0:
                continue
            chunk, skipping = chunk[cut + 1 :], False
        yield chunk
    if skipping:  # no line ends in it: what begins before it is another's, whole
        return
    for chunk in behind:
        cut = chunk.find(b"\n")
        yield chunk if cut < 0 else chunk[: cut + 1]
        if cut >= 0:
            return


def lines_of(chunks: Iterator[bytes]) -> Iterator[str]:
    """Lines of a text that comes in chunks cut anywhere, characters of several bytes included; the last needs no end.

    Bytes that are no UTF-8 become replacement characters. A carriage return before a line's end is dropped.
    """
    decoder, left = codecs.getincrementaldecoder("utf-8")("replace"), []
    for chunk in chunks:
        first, *more = decoder.decode(chunk).split("\n")
        left.append(first)
        if more:
            yield "".join(left).removesuffix("\r")
            for line in more[:-1]:
                yield line.removesuffix("\r")
            left = [more[-1]]
    if last := "".join(left) + decoder.decode(b"", True):
        yield last.removesuffix("\r")


class _ArchiveReader(DataSourceReader):
    def __init__(self, paths: list[str], least: int, walk: bool):
        self.paths, self.least, self.walk = paths, least, walk

    def ranges(self, path: str, size: int) -> list[tuple[int, int]]:
        if size < 2 * self.least:
            return [(0, size)]
        fs, at = file_system(path)
        with fs.open_input_file(at) as f:
            read = lambda at, n: f.read_at(min(n, size - at), at)
            starts = seek_table(read, size)
            if starts is None:
                starts = frame_starts(read, size) if self.walk else []
        return splits(starts, size, self.least)

    def partitions(self) -> list[InputPartition]:
        found = [(path, size) for given in self.paths for path, size in matching(given)]
        parts = [(path, *r, size) for path, size in found for r in self.ranges(path, size)]
        return [ArchiveFile(i, *p) for i, p in enumerate(parts)]

    def read(self, partition: ArchiveFile):
        import pyarrow as pa
        import zstandard

        fs, at = file_system(partition.path)

        def between(start: int, end: int) -> Iterator[bytes]:
            if start >= end:
                return
            with fs.open_input_file(at) as raw:
                part = raw if (start, end) == (0, partition.size) else Part(raw, start, end)
                with zstandard.ZstdDecompressor(max_window_size=MAX_WINDOW).stream_reader(part, read_across_frames=True) as data:
                    while chunk := data.read(CHUNK_BYTES):
                        yield chunk

        chunks = owned(between(partition.start, partition.end), between(partition.end, partition.size), partition.start == 0)

        def batch(first: int, own: list[str]) -> pa.RecordBatch:
            seq = [(partition.number << 40) + first + i for i in range(len(own))]
            return pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([partition.path] * len(own), pa.string()), pa.array(seq, pa.int64())], names=["value", "path", "seq"])

        n, own, size = 0, [], 0
        for line in lines_of(chunks):
            own.append(line)
            size += len(line)
            if len(own) >= ROWS or size >= 16 * CHUNK_BYTES:
                yield batch(n, own)
                n, own, size = n + len(own), [], 0
        if own:
            yield batch(n, own)


class Part:
    """A range of an open file, as a file of its own."""

    def __init__(self, raw, start: int, end: int):
        self.raw, self.at, self.end = raw, start, end

    def read(self, n: int = -1) -> bytes:
        n = self.end - self.at if n < 0 else min(n, self.end - self.at)
        data = self.raw.read_at(n, self.at) if n > 0 else b""
        self.at += len(data)
        return data


class ZstdArchive(DataSource):
    """`read.format("zstd_archive")`: value, path and seq of every line. A task holds the window and one batch. Options: splitBytes, compressed bytes of a task; walk, whether frames are found by their headers where a file has no seek table."""

    @classmethod
    def name(cls) -> str:
        return "zstd_archive"

    def schema(self) -> str:
        return "value string, path string, seq long"

    def reader(self, schema) -> DataSourceReader:
        return _ArchiveReader(self.options["paths"].split("\n"), int(self.options.get("splitBytes", SPLIT_BYTES)), self.options.get("walk", "true") == "true")


def read_archives(spark: SparkSession, paths: str | list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(value, path, seq) of every line of zstandard archives that is not blank; seq orders files and the lines within."""
    spark.dataSource.register(ZstdArchive)
    given = [paths] if isinstance(paths, str) else paths
    return spark.read.format("zstd_archive").options(paths="\n".join(given), splitBytes=split_bytes).load().where("trim(value) <> ''")
