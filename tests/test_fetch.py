"""Files and pages from a server on this machine."""

from __future__ import annotations

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pytest

from parley.sources import fetch as W

MB = 1 << 20


class Handler(BaseHTTPRequestHandler):
    seen: Counter = Counter()
    sent: Counter = Counter()
    lock = threading.Lock()

    def log_message(self, *args):
        pass

    def answer(self, code, body=b"", kind="application/json", **headers):
        self.send_response(code)
        self.send_header("Content-Type", kind)
        for k, v in headers.items():
            self.send_header(k.replace("_", "-"), v)
        self.end_headers()
        try:
            for i in range(0, len(body), MB):
                self.wfile.write(body[i : i + MB])
                self.sent[self.path] += len(body[i : i + MB])
        except OSError:
            pass

    def do_GET(self):
        with self.lock:
            self.seen[self.path] += 1
            n = self.seen[self.path]
        name = self.path.split("?")[0]
        if name.startswith("/image"):
            self.answer(200, b"png" * 1000, "image/PNG; charset=x")
        elif name == "/page":
            self.answer(200, b"<html>", "text/html")
        elif name == "/exact":
            self.answer(200, bytes(MB), "image/gif")
        elif name == "/large":
            self.answer(200, bytes(40 * MB), "image/jpeg")
        elif name == "/flaky":
            self.answer(200, b"jpg", "image/jpeg") if n == 3 else self.answer(503)
        elif name == "/down":
            self.answer(500)
        elif name.startswith("/list/"):
            page = int(name.rpartition("/")[2])
            # The first key is told to slow down at every third page, any key once at page 5.
            if self.headers.get("Authorization") == "Bearer one" and page % 3 == 0 or page == 5 and n == 1:
                self.answer(429, Retry_After="0")
            elif page == 9:
                self.answer(200, b'{"data": []}')
            else:
                self.answer(200, json.dumps({"data": [{"id": page * 10 + i, "t": "ü"} for i in range(3)]}).encode())
        else:
            self.answer(404)


@pytest.fixture
def server():
    Handler.seen, Handler.sent = Counter(), Counter()
    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}"
    httpd.shutdown()


def files(folder):
    return sorted(str(p.relative_to(folder)) for p in Path(folder).rglob("*") if p.is_file() and not str(p.relative_to(folder)).startswith("_log"))


def test_fetch(spark, server, tmp_path):
    folder = str(tmp_path / "out")
    rows = [("a", f"{server}/image1", "s1/a"), ("b", f"{server}/page", "s1/b"), ("c", f"{server}/exact", "s2/c"), ("d", f"{server}/large", "s2/d"), ("e", f"{server}/flaky", "s3/e"), ("f", f"{server}/down", "s3/f"), ("g", f"{server}/none", "s3/g"), ("h", None, "s4/h"), ("i", "not a url", "s4/i"), ("a", f"{server}/image1", "s1/a")]
    items = spark.createDataFrame(rows, "id string, url string, file string")
    got = {r["id"]: r for r in W.fetch(items, folder, rate=1000, first=0.01, most=MB, shard=3).collect()}
    assert {k for k, r in got.items() if r["success"]} == {"a", "c", "e"} and len(got) == 9
    assert files(folder) == ["s1/a.png", "s2/c.gif", "s3/e.jpg"] and (tmp_path / "out/s1/a.png").read_bytes() == b"png" * 1000
    assert got["c"]["file_size"] == MB and got["d"]["error"] == "File too large" and Handler.sent["/large"] < 20 * MB
    assert got["b"]["error"] == "Invalid Content-Type: text/html" and got["e"]["tries"] == 3 and got["f"]["tries"] == 3 and got["f"]["error"].startswith("500") and got["g"]["error"].startswith("404") and got["g"]["tries"] == 1
    assert got["h"]["error"] and got["i"]["error"]
    # What was done is not asked for again; what failed is.
    before = dict(Handler.seen)
    again = {r["id"]: r for r in W.fetch(items, folder, rate=1000, first=0.01, most=64 * MB).collect()}
    assert Handler.seen["/image1"] == before["/image1"] == 1 and Handler.seen["/flaky"] == 3 and again["d"]["success"] and again["a"]["success"]
    assert files(folder) == ["s1/a.png", "s2/c.gif", "s2/d.jpg", "s3/e.jpg"]
    assert W.fetch(items.limit(0), folder).count() == 0


def test_a_broken_write_leaves_nothing(tmp_path):
    place = W.Folder(str(tmp_path))

    def broken():
        yield b"half"
        raise RuntimeError

    with pytest.raises(RuntimeError):
        place.put("x.png", broken())
    assert files(tmp_path) == []
    assert place.put("y/x.png", iter([b"a"])) == place.put("y/x.png", iter([b"b"])) and files(tmp_path) == ["y/x.png"] and (tmp_path / "y/x.png").read_bytes() == b"b"


def test_budget_and_pauses():
    now, slept = [0.0], []
    budget = W.Budget(4, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(9):
        budget.wait()
    assert now[0] == pytest.approx(2.0) and len(slept) == 8
    assert [W.pause(i, None) for i in range(4)] == [0.5, 1, 2, 4] and W.pause(0, "7") == 7 and W.pause(9, None) == 60


@pytest.mark.parametrize("size", [1, 4, 100])
def test_every_page_once(spark, server, size):
    rows = W.paged(spark, server + "/list/{page}", 11, items="data", keys="one,two", size=size, pause=0.01).collect()
    want = sorted((p, i, json.dumps({"id": p * 10 + i, "t": "ü"}, ensure_ascii=False, separators=(",", ":"))) for p in range(1, 12) if p != 9 for i in range(3))
    assert sorted(map(tuple, rows)) == want


def test_a_missing_page_fails(spark, server):
    with pytest.raises(Exception, match="page 1"):
        W.paged(spark, server + "/nothing/{page}?key={key}", 2, keys="k").collect()
