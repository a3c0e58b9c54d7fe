"""Many outputs from one scan, archives of many frames, torrents, mirrors and roots with odd characters."""

from __future__ import annotations

import json
import random
from pathlib import Path

import pytest
import zstandard
from pyspark.sql import functions as F

from parley.operators import media
from parley.sources import archives, sinks, tables


def lines(path):
    out = []
    for p in Path(path).glob("*.jsonl.zst"):
        with open(p, "rb") as f:
            out += zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read().decode().splitlines()
    return sorted(out)


@pytest.mark.parametrize("most_open", [1, 64])
def test_one_scan_to_many_files(spark, tmp_path, most_open):
    rows = [(i, f"c{i % 7}/x" if i % 11 else None, "é" * (i % 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, place string, body string").repartition(3)
    sinks.write_zst_by_path(df, str(tmp_path / "out"), "place", most_open=most_open)
    for k in range(7):
        want = sorted(json.dumps({"id": i, "body": b}, ensure_ascii=False, separators=(",", ":")) for i, p, b in rows if p == f"c{k}/x")
        assert lines(tmp_path / f"out/c{k}/x") == want
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"c{k}" for k in range(7)]
    # Only the paths that are written again are replaced.
    sinks.write_zst_by_path(df.where("place = 'c1/x' AND id < 50"), str(tmp_path / "out"), "place", mode="overwrite")
    assert len(lines(tmp_path / "out/c1/x")) == sum(p == "c1/x" and i < 50 for i, p, _ in rows) and lines(tmp_path / "out/c2/x")


def test_paths_stay_below_the_folder(spark, tmp_path):
    df = spark.createDataFrame([(1, "../up")], "id long, place string")
    with pytest.raises(Exception, match="not a path of its own"):
        sinks.write_zst_by_path(df, str(tmp_path / "out"), "place")
    assert not (tmp_path / "up").exists() and not list((tmp_path / "out").rglob("*.zst"))


def framed(texts, table=False, checksum=False):
    parts = [zstandard.ZstdCompressor(level=1, write_checksum=checksum).compress(t) for t in texts]
    data = b"".join(parts)
    if table:
        rows = b"".join(len(p).to_bytes(4, "little") + len(t).to_bytes(4, "little") for p, t in zip(parts, texts))
        foot = len(parts).to_bytes(4, "little") + b"\x00" + archives.TABLE.to_bytes(4, "little")
        data += archives.TABLE_FRAME.to_bytes(4, "little") + (len(rows) + 9).to_bytes(4, "little") + rows + foot
    starts, at = [], 0
    for p in parts:
        starts.append(at)
        at += len(p)
    return data, starts


def test_frames_are_found():
    rng = random.Random(2)
    texts = [b"", b"a", b"\0" * 300_000, rng.randbytes(500_000), b"word " * 90_000, rng.randbytes(70)]
    for table in (False, True):
        for checksum in (False, True):
            data, starts = framed(texts, table, checksum)
            read = lambda at, n: data[at : at + n]
            assert archives.seek_table(read, len(data)) == (starts if table else None)
            assert archives.frame_starts(read, len(data)) == starts
    streamed = zstandard.ZstdCompressor().compressobj()
    data = streamed.compress(texts[3]) + streamed.flush() + (0x184D2A53).to_bytes(4, "little") + (5).to_bytes(4, "little") + b"12345" + framed([b"x"])[0]
    found = archives.frame_starts(lambda at, n: data[at : at + n], len(data))
    assert len(found) == 2 and zstandard.ZstdDecompressor().decompress(data[found[1] :]) == b"x"
    assert archives.frame_starts(lambda at, n: data[at : at + n], 0) == []


@pytest.mark.parametrize("table", [False, True])
def test_lines_for_every_cut(spark, tmp_path, table):
    """Cuts within characters, at line ends, in lines longer than frames, with empty frames and an end without a line end."""
    rng = random.Random(4)
    body = "\n".join("日本 é" * rng.choice([0, 1, 2, 40]) + str(i) for i in range(60)).encode()
    body = body.replace(b"\n", b"\r\n", 3)
    want = [x.removesuffix("\r") for x in body.decode().split("\n") if x.strip()]
    for step in (1, 7, 64, 200, len(body)):
        texts = [body[i : i + step] for i in range(0, len(body), step)]
        texts.insert(len(texts) // 2, b"")
        data, _ = framed(texts, table)
        path = tmp_path / f"{step}-{table}.zst"
        path.write_bytes(data)
        for split in (1, 50, 1 << 20) if step > 1 else (5000,):
            found = archives.read_archives(spark, str(path), split)
            assert [r["value"] for r in found.orderBy("seq").collect()] == want
            if split == 1 and step == 200:
                assert found.rdd.getNumPartitions() > 5


def bencoded(x):
    if isinstance(x, int):
        return b"i%de" % x
    if isinstance(x, str):
        x = x.encode()
    if isinstance(x, bytes):
        return b"%d:%s" % (len(x), x)
    if isinstance(x, list):
        return b"l" + b"".join(map(bencoded, x)) + b"e"
    return b"d" + b"".join(bencoded(k) + bencoded(v) for k, v in sorted(x.items())) + b"e"


def test_torrents(spark, tmp_path):
    many = {"announce": "http://t", "info": {"name": "Root", "piece length": 1, "pieces": b"\xff" * 20, "files": [{"length": 5, "path": ["a", "Ünï_Comments.ZST"]}, {"length": 0, "path": []}, {"length": 7, "path": ["b", "c", "x.zst"]}]}}
    (tmp_path / "many.torrent").write_bytes(bencoded(many))
    (tmp_path / "one.torrent").write_bytes(bencoded({"info": {"name": "Only.zst", "length": 9}}))
    rows = tables.torrent_files(spark, str(tmp_path)).select("index", "basename", "relpath", "length").collect()
    assert sorted(map(tuple, rows)) == [(1, "only.zst", "Only.zst", 9), (1, "ünï_comments.zst", "a/Ünï_Comments.ZST", 5), (3, "x.zst", "b/c/x.zst", 7)]
    assert tables.unbencoded(bencoded(many))[b"info"][b"pieces"] == b"\xff" * 20
    for broken in (b"", b"i1", b"5:abc", b"l1:a", b"1:ab", b"x", b"d1:ae"):
        with pytest.raises(ValueError):
            tables.unbencoded(broken)


def test_mirrors(spark, tmp_path):
    for name in ("a/X_comments.zst", "b/x_comments.zst", "b/other.zst"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"12")
    needed = spark.createDataFrame([("x_comments.zst",), ("y.zst",)], "basename string")
    rows = tables.mirrored(spark, str(tmp_path), needed).collect()
    assert [(r["basename"], r["path"].rpartition("/a/")[2], r["size"]) for r in rows] == [("x_comments.zst", "X_comments.zst", 2)]
    assert [r["basename"] for r in tables.missing_files(needed, tables.mirrored(spark, str(tmp_path), needed), "basename").collect()] == ["y.zst"]


def test_roots_are_text(spark):
    df = spark.createDataFrame([("/data.v1/(x)/m/s/c/p/r/f.json",), ("/dataXv1/(x)/m/s/c/p/r/f.json",)], "path string")
    assert [r[0] for r in df.select(media.relative_path(F.col("path"), "/data.v1/(x)/")).collect()] == ["m/s/c/p/r/f.json", "/dataXv1/(x)/m/s/c/p/r/f.json"]
    found = tables.result_folders(df.limit(1), "/data.v1/(x)").collect()
    assert [(r["model"], r["run_suffix"]) for r in found] == [("m", "r")]
