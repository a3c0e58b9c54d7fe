"""Sinks (SNK1-SNK8, SNK10): compressed JSON lines, partitioned tables, nested documents, TSV and LaTeX."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceWriter, WriterCommitMessage

from .files import file_system

#: Rows of a report that is rendered on the driver.
MAX_REPORT_ROWS = 10_000


@dataclass
class _Written(WriterCommitMessage):
    """A task's file under its attempt's name, its name once committed, and how many lines it has."""

    temporary: str
    final: str
    lines: int


class _ZstdWriter(DataSourceWriter):
    """A zstandard file for each task.

    A task writes under its attempt's name; the job gives the files of the attempts that count their own names at its
    commit, and deletes the rest. Names hold the job's id, so that jobs that append never replace each other's files.
    """

    def __init__(self, path: str, level: int, overwrite: bool):
        self.path, self.level, self.overwrite, self.job = path.rstrip("/"), level, overwrite, uuid.uuid4().hex

    def write(self, iterator) -> WriterCommitMessage:
        import zstandard
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = file_system(self.path)
        fs.create_dir(f"{root}/_temporary/{self.job}", recursive=True)
        temporary = f"{root}/_temporary/{self.job}/{task.partitionId():05d}-{task.taskAttemptId()}"
        lines = 0
        with fs.open_output_stream(temporary, compression=None) as raw, zstandard.ZstdCompressor(level=self.level).stream_writer(raw, closefd=False) as out:
            for row in iterator:
                out.write((row[0] + "\n").encode())
                lines += 1
        return _Written(temporary, f"{root}/part-{task.partitionId():05d}-{self.job}.jsonl.zst", lines)

    def commit(self, messages) -> None:
        from pyarrow.fs import FileSelector

        fs, root = file_system(self.path)
        for m in messages:
            if m is not None and m.lines:
                fs.move(m.temporary, m.final)
        # New files are in place before old ones go: a driver lost between leaves both, never neither.
        if self.overwrite:
            for old in fs.get_file_info(FileSelector(root, allow_not_found=True)):
                if old.path.endswith(".jsonl.zst") and self.job not in old.base_name:
                    fs.delete_file(old.path)
        self._clear(fs, root)

    def abort(self, messages) -> None:
        self._clear(*file_system(self.path))

    def _clear(self, fs, root: str) -> None:
        from pyarrow.fs import FileSelector, FileType

        if fs.get_file_info(f"{root}/_temporary/{self.job}").type != FileType.NotFound:
            fs.delete_dir(f"{root}/_temporary/{self.job}")
        if fs.get_file_info(f"{root}/_temporary").type != FileType.NotFound and not fs.get_file_info(FileSelector(f"{root}/_temporary")):
            fs.delete_dir(f"{root}/_temporary")


@dataclass
class _Parted(WriterCommitMessage):
    """A task's files: under its attempt's name, and under the name they get."""

    files: list[tuple[str, str]]


class _ZstdByPath(_ZstdWriter, DataSourceArrowWriter):
    """A zstandard file for each path that a task has rows of, opened at the first of them.

    At most `most_open` files are open in a task: beyond that the one unused for longest is closed, and goes on in a
    further file if its path comes again.
    """

    def __init__(self, path: str, level: int, overwrite: bool, most_open: int):
        super().__init__(path, level, overwrite)
        self.most_open = most_open

    def write(self, iterator) -> WriterCommitMessage:
        from collections import OrderedDict

        import pyarrow.compute as pc
        import zstandard
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = file_system(self.path)
        attempt = f"{root}/_temporary/{self.job}/{task.partitionId():05d}-{task.taskAttemptId()}"
        fs.create_dir(attempt, recursive=True)
        files: list[tuple[str, str]] = []
        held: OrderedDict[str, tuple] = OrderedDict()

        def closed(pair) -> None:
            out, raw = pair
            out.close()
            raw.close()

        def opened(name: str):
            if name not in held:
                if len(held) >= self.most_open:
                    closed(held.popitem(last=False)[1])
                place = f"{attempt}/{len(files)}"
                raw = fs.open_output_stream(place, compression=None)
                held[name] = zstandard.ZstdCompressor(level=self.level).stream_writer(raw, closefd=False), raw
                files.append((place, f"{root}/{name}/part-{task.partitionId():05d}-{len(files)}-{self.job}.jsonl.zst"))
            held.move_to_end(name)
            return held[name][0]

        for batch in iterator:
            names = batch.column(0)
            for name in pc.unique(names).to_pylist():
                parts = [p for p in (name or "").split("/") if p]
                if not parts or any(p in (".", "..") or p.startswith("_") for p in parts):
                    raise ValueError(f"not a path of its own below the folder: {name!r}")
                own = batch.column(1).filter(pc.equal(names, name)).to_pylist()
                opened("/".join(parts)).write("".join(f"{line}\n" for line in own).encode())
        for pair in held.values():
            closed(pair)
        return _Parted(files)

    def commit(self, messages) -> None:
        from pyarrow.fs import FileSelector

        fs, root = file_system(self.path)
        folders = set()
        for temporary, final in (f for m in messages if m is not None for f in m.files):
            folders.add(final.rpartition("/")[0])
            fs.create_dir(final.rpartition("/")[0], recursive=True)
            fs.move(temporary, final)
        if self.overwrite:  # of the paths that were written
            for folder in folders:
                for old in fs.get_file_info(FileSelector(folder)):
                    if old.path.endswith(".jsonl.zst") and self.job not in old.base_name:
                        fs.delete_file(old.path)
        self._clear(fs, root)


class ZstdByPath(DataSource):
    """SRC1, SNK2: `write.format("zstd_by_path")` of (path, line): one scan to as many compressed outputs as there are paths."""

    @classmethod
    def name(cls) -> str:
        return "zstd_by_path"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _ZstdByPath(self.options["path"], int(self.options.get("level", 3)), overwrite, int(self.options.get("mostOpen", 64)))


def write_zst_by_path(df: DataFrame, folder: str, path: str, level: int = 3, mode: str = "append", most_open: int = 64) -> None:
    """SRC1, SNK2: rows as JSON lines, without the column `path`, in zstandard files below the folder that it names for each row; rows without a path are left out. No path without rows gets a file.

    Rows are balanced by path, where Spark splits those with many rows among tasks. `overwrite` replaces the files of the paths that are written.
    """
    df.sparkSession.dataSource.register(ZstdByPath)
    body = F.to_json(F.struct(*[F.col(c) for c in df.columns if c != path])).alias("line")
    rows = df.where(F.coalesce(F.trim(F.col(path)), F.lit("")) != "").select(F.col(path).cast("string").alias("path"), body).hint("rebalance", "path")
    rows.write.format("zstd_by_path").mode(mode).options(level=level, mostOpen=most_open).save(folder)


class ZstdLines(DataSource):
    """SNK1: `write.format("zstd_lines")` of one text column to a folder that all executors reach: a path, or a URI of a store that pyarrow knows. Spark's own writers take no zstandard for text."""

    @classmethod
    def name(cls) -> str:
        return "zstd_lines"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _ZstdWriter(self.options["path"], int(self.options.get("level", 3)), overwrite)


def write_zst_lines(df: DataFrame, path: str, level: int = 3, mode: str = "append") -> None:
    """SNK1: rows as JSON lines in zstandard files, beside those there (`append`) or instead of them (`overwrite`)."""
    df.sparkSession.dataSource.register(ZstdLines)
    df.select(F.to_json(F.struct("*")).alias("value")).write.format("zstd_lines").mode(mode).option("level", str(level)).save(path)


def write_by_community(df: DataFrame, path: str, column: str = "subreddit") -> None:
    """SNK2, SNK5, SNK10: a table partitioned by community; partitions that are written replace their old ones."""
    df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(column).parquet(path, compression="zstd")


def nested_document(pairs: DataFrame, key: str, *rows: str) -> DataFrame:
    """SNK3, SPL2: a JSON text for each key, its rows in one array. A key's rows are one value: it must be of a bounded size."""
    body = F.array_sort(F.collect_list(F.struct(*rows)))
    return pairs.groupBy(key).agg(F.to_json(F.struct(F.first(key).alias("name"), body.alias("thread_pairs"))).alias("document"))


def write_tsv(df: DataFrame, path: str) -> None:
    """SNK7."""
    df.write.mode("overwrite").options(sep="\t", header=True, quote='"', escape='"').csv(path)


def with_digest(df: DataFrame) -> DataFrame:
    """SNK6: one row with the number of rows and a digest of their content that no order or partitioning changes."""
    h = F.xxhash64(F.to_json(F.struct("*")))
    return df.agg(F.count("*").alias("rows"), F.hex(F.bit_xor(h)).alias("xor"), F.sum(h.cast("decimal(20,0)")).alias("sum"))


def _report_rows(df: DataFrame) -> list:
    rows = df.limit(MAX_REPORT_ROWS + 1).collect()
    if len(rows) > MAX_REPORT_ROWS:
        raise ValueError("too many rows for a report")
    return rows


def latex_table(df: DataFrame, caption: str, label: str) -> str:
    """SNK8: a small table as LaTeX; the first column left, others right."""
    rows = _report_rows(df)
    escape = lambda x: "" if x is None else str(x).replace("\\", r"\textbackslash{}").replace("&", r"\&").replace("%", r"\%").replace("_", r"\_").replace("#", r"\#")
    lines = [" & ".join(escape(x) for x in r) + r" \\" for r in rows]
    head = " & ".join(escape(c) for c in df.columns) + r" \\"
    return "\n".join([r"\begin{table}", r"\centering", rf"\caption{{{caption}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{l{'r' * (len(df.columns) - 1)}}}", r"\toprule", head, r"\midrule", *lines, r"\bottomrule", r"\end{tabular}", r"\end{table}"])


def pretty_json(df: DataFrame) -> str:
    """SNK4: a small table as indented JSON."""
    import json

    return json.dumps([json.loads(r[0]) for r in _report_rows(df.select(F.to_json(F.struct("*"))))], indent=2, ensure_ascii=False)
