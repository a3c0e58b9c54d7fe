"""Archives and sinks: windows beyond Spark's own reader, appends, retried tasks, reports."""

from __future__ import annotations

import json

import pytest
import zstandard
from pyspark.sql import functions as F

from parley.sources import sinks, tables
from parley.sources.archives import lines_of, read_archives


def test_lines_cut_anywhere():
    text = "één\n日本語 🙂\r\n\nlast ü"
    data = text.encode()
    for size in range(1, 9):
        assert list(lines_of(iter([data[i : i + size] for i in range(0, len(data), size)]))) == ["één", "日本語 🙂", "", "last ü"]
    assert list(lines_of(iter([b"a\xffb\n", b"\xe6\x97"]))) == ["a�b", "�"]


def test_windows_of_two_gigabytes(spark, tmp_path):
    rows = [json.dumps({"id": i, "body": "日本 é🙂" * (i % 40)}, ensure_ascii=False) for i in range(5000)]
    parameters = zstandard.ZstdCompressionParameters.from_level(1, window_log=31)
    with open(tmp_path / "long.zst", "wb") as raw, zstandard.ZstdCompressor(compression_params=parameters).stream_writer(raw) as out:
        out.write(("\n".join([*rows[:10], "", "{broken", *rows[10:]])).encode())
    # A second frame goes on where the first ended; the last line has no end.
    with open(tmp_path / "long.zst", "ab") as raw:
        raw.write(zstandard.ZstdCompressor().compress(b'\n{"id": -1, "body": "end"}'))
    lines = read_archives(spark, str(tmp_path / "*.zst"))
    found = tables.parse_json(lines, "id bigint, body string")
    assert found.where("malformed").count() == 1
    good = found.where("NOT malformed").orderBy("seq").collect()
    assert [r["raw"] for r in good[:-1]] == rows and good[-1]["id"] == -1


def test_appends_add_up_and_overwriting_replaces(spark, tmp_path):
    path = f"{tmp_path}/out"
    sinks.write_zst_lines(spark.range(10).repartition(3), path)
    sinks.write_zst_lines(spark.range(100, 105).repartition(3), path)
    ids = lambda: sorted(r["id"] for r in tables.parse_json(read_archives(spark, path), "id bigint").collect())
    assert ids() == [*range(10), *range(100, 105)]
    assert sorted(r["id"] for r in tables.parse_json(tables.read_lines(spark, path), "id bigint").collect()) == ids()
    sinks.write_zst_lines(spark.range(3), f"file://{path}", mode="overwrite")
    assert ids() == [0, 1, 2] and not (tmp_path / "out" / "_temporary").exists()


def test_attempts_that_do_not_count_leave_nothing(spark, tmp_path):
    path = f"{tmp_path}/out"
    writer = sinks._ZstdWriter(path, 3, False)

    class Task:
        attempt = 0

        def partitionId(self):
            return 0

        def taskAttemptId(self):
            Task.attempt += 1
            return Task.attempt

    import pyspark

    whole = pyspark.TaskContext.get
    pyspark.TaskContext.get = staticmethod(lambda: Task())
    try:
        writer.write(iter([("lost",)]))
        writer.commit([writer.write(iter([("kept",)]))])
        assert [r["value"] for r in read_archives(spark, path).collect()] == ["kept"]
        other = sinks._ZstdWriter(path, 3, False)
        other.write(iter([("never",)]))
        other.abort([])
    finally:
        pyspark.TaskContext.get = whole
    assert [p.name for p in (tmp_path / "out").iterdir()] == [f"part-00000-{writer.job}.jsonl.zst"]


def test_reports_are_never_cut(spark):
    assert json.loads(sinks.pretty_json(spark.range(2))) == [{"id": 0}, {"id": 1}]
    for render in (sinks.pretty_json, lambda df: sinks.latex_table(df, "c", "l")):
        with pytest.raises(ValueError, match="too many"):
            render(spark.range(sinks.MAX_REPORT_ROWS + 1).select(F.col("id")))
