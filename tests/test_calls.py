"""Bulk requests to doubles of a service, and to a server on this machine."""

from __future__ import annotations

import base64
import json
import os
import sys
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from parley.operators import models
from parley.sources import calls as C

# Workers cannot import this file: its doubles travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Flaky:
    """Every third call is refused; each is noted in a shared file. `bad` has no content, `broken` raises, `deadly` ends the worker."""

    def __init__(self, notes: str, deadly: bool = False, broken: bool = True):
        self.notes, self.n, self.deadly, self.broken, self.lock = notes, 0, deadly, broken, threading.Lock()
        self.open = self.most = 0

    def call(self, body):
        with self.lock:
            self.n += 1
            n = self.n
            self.open += 1
            self.most = max(self.most, self.open)
        try:
            if n % 3 == 0:
                raise C.Busy("429 Too Many Requests")
            if self.deadly and n > 40:
                os._exit(9)
            with open(self.notes, "a") as f:
                f.write(f"{body} {os.getpid()} {self.most}\n")
            if body == "bad":
                return "", "thought"
            if body == "broken" and self.broken:
                raise ValueError("no")
            return f"to {body}", f"why {body}"
        finally:
            with self.lock:
                self.open -= 1


def notes_of(path) -> Counter:
    return Counter(line.split()[0] for line in open(path)) if os.path.exists(path) else Counter()


def requests(spark, n):
    return spark.range(n).select(F.concat(F.lit("r"), "id").alias("id"), F.concat(F.lit("b"), "id").alias("body"))


def test_none_is_lost_or_doubled(spark, tmp_path):
    notes, folder = str(tmp_path / "notes"), str(tmp_path / "log")
    rows = requests(spark, 200).union(requests(spark, 20)).union(spark.createDataFrame([(None, "x"), ("bad", "bad"), ("broken", "broken"), ("none", None)], "id string, body string"))
    found = {r["id"]: r for r in C.answered(rows, folder, lambda: Flaky(notes), workers=6, lanes=3, first=0.001, piece=7).collect()}
    assert len(found) == 203
    assert all(found[f"r{i}"]["content"] == f"to b{i}" and found[f"r{i}"]["reasoning"] == f"why b{i}" for i in range(200))
    assert found["none"]["content"] == "to []"
    assert found["bad"]["content"] == "" and "ValueError: no" in found["broken"]["error"]
    assert max(r["tries"] for r in found.values()) > 1
    assert set(notes_of(notes).values()) == {1}
    assert max(int(line.split()[2]) for line in open(notes)) <= 2
    # What failed, and nothing else, is asked again.
    again = {r["id"]: r for r in C.answered(rows, folder, lambda: Flaky(notes, broken=False), workers=6, lanes=2, first=0.001).collect()}
    assert again["broken"]["content"] == "to broken" and len(again) == 203
    assert {b for b, n in notes_of(notes).items() if n > 1} == {"bad", "broken"}


def test_a_lost_worker_repeats_at_most_a_piece(spark, tmp_path):
    notes, folder = str(tmp_path / "notes"), str(tmp_path / "log")
    rows = requests(spark, 100)
    with pytest.raises(Exception):  # noqa: B017 - one failure ends a job in local mode
        C.answered(rows, folder, lambda: Flaky(notes, deadly=True), workers=2, lanes=1, first=0.001, piece=5)
    before = notes_of(notes)
    assert 0 < len(before) < 100
    found = C.answered(rows, folder, lambda: Flaky(notes), workers=2, lanes=1, first=0.001, piece=5)
    assert found.where("content <> ''").count() == 100
    doubled = sum(n > 1 for n in notes_of(notes).values())
    assert doubled <= 5 + 2


def test_a_retried_task_reads_its_lane(tmp_path):
    place = C.Folder(str(tmp_path))
    one = C._Lane(place, "call", 3)
    one.rows = [{"id": "a", "content": "x", "reasoning": "", "error": None, "tries": 1, "finished": 1.0}]
    one.flush()
    assert C._Lane(place, "call", 3).done() == {"a"}
    assert C._Lane(place, "call", 4).done() == set() and C._Lane(place, "other", 3).done() == set()


def test_no_requests(spark, tmp_path):
    none = spark.createDataFrame([], "id string, body string")
    assert C.answered(none, str(tmp_path), lambda: Flaky("/dev/null")).count() == 0
    assert C.answers(spark, str(tmp_path / "absent")).count() == 0


class Server(BaseHTTPRequestHandler):
    seen: list = []
    busy: Counter = Counter()

    def log_message(self, *args):
        pass

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        said = body["input"][0]["content"]
        self.seen.append((self.headers["Authorization"], body))
        self.busy[said] += 1
        code = 400 if said == "refused" else 429 if self.busy[said] < 3 else 200
        output = [{"type": "reasoning", "summary": [{"text": "one"}, {"text": "two"}]}, {"type": "message", "content": [{"type": "output_text", "text": "(b) "}, {"type": "output_text", "text": said}]}]
        data = json.dumps({"output": output}).encode()
        self.send_response(code)
        self.send_header("Retry-After", "0")
        self.end_headers()
        self.wfile.write(data)


def test_http(spark, tmp_path):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/responses"
        prompts = spark.createDataFrame([("p_violating", [("user", "hé \"x\"", None)], []), ("q_violating", [("user", "refused", None)], [])], f"id string, messages {C.MESSAGES}, media_files array<string>")
        found = {r["id"]: r for r in C.answered(C.request_bodies(prompts), str(tmp_path), lambda: C.HttpService(url, "m", 64, "low", "k"), first=0.001).collect()}
    finally:
        server.shutdown()
    assert found["p_violating"]["content"] == '(b) hé "x"' and found["p_violating"]["reasoning"] == "one\ntwo" and found["p_violating"]["tries"] == 3
    assert found["q_violating"]["content"] == "" and "400" in found["q_violating"]["error"] and found["q_violating"]["tries"] == 1
    assert all(key == "Bearer k" and b["reasoning"]["effort"] == "low" and b["max_output_tokens"] == 64 for key, b in Server.seen)


def test_bodies(spark):
    text, image = lambda s: ("text", s, None), lambda p=None: ("image", None, p)
    rows = [
        ("a", [("system", "be \"good\"\n", None), ("user", None, [image(), text("é"), image("own.PNG"), image(), image()])], ["m/1.webp", "m/lost.jpg"]),
        ("b", [(None, None, None), ("user", None, [])], None),
        ("c", None, None),
        ("d", [("user", None, [image("x"), ("video", "v", None), text(None)])], []),
    ]
    prompts = spark.createDataFrame(rows, f"id string, messages {C.MESSAGES}, media_files array<string>")
    images = spark.createDataFrame([("m/1.webp", bytearray(b"w" * 100)), ("own.PNG", bytearray(b"p")), ("x", bytearray(b"j"))], "path string, content binary")
    found = {r["id"]: json.loads(r["body"]) for r in C.request_bodies(prompts, images).collect()}
    picture = lambda kind, b: {"type": "input_image", "image_url": f"data:image/{kind};base64,{base64.b64encode(b).decode()}", "detail": "low"}
    assert found["a"] == [{"role": "system", "content": 'be "good"\n'}, {"role": "user", "content": [picture("webp", b"w" * 100), {"type": "input_text", "text": "é"}, picture("png", b"p")]}]
    assert found["b"] == [{"role": "user", "content": ""}, {"role": "user", "content": []}] and found["c"] == []
    assert found["d"] == [{"role": "user", "content": [picture("jpeg", b"j"), {"type": "input_text", "text": ""}]}]
    without = {r["id"]: json.loads(r["body"]) for r in C.request_bodies(prompts).collect()}
    assert without["a"][1]["content"] == [{"type": "input_text", "text": "é"}]


def test_pairs_with_both_sides_and_their_answers(spark):
    pairs = spark.createDataFrame([("a", "ask"), ("b", "ask"), ("c", "ask")], "mod_comment_id string, prompt string")
    found = spark.createDataFrame([("a_violating", "x", "r"), ("a_compliant", "y", ""), ("b_violating", "x", ""), ("b_compliant", "", ""), ("c_violating", "x", "")], "id string, content string, reasoning string")
    both = C.complete_pairs(pairs, found)
    assert [tuple(r) for r in both.collect()] == [("a", "ask", "x", "r", "y", "")]

    class Second:
        def generate(self, prompts, most):
            assert most == 10 and all(p.endswith("\n\nFinal Choice:") for p in prompts)
            return [" (b)" for _ in prompts]

    assert models.extracted(both, Second, content="violating_content").first()["prediction"] == "(b)"
