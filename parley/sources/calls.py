"""Requests to a model service in bulk (MOD4): messages with images inlined, a bounded number of requests at a time, and a log that a later call goes on from.

answered() deals requests into lanes, one task each, and a task keeps `workers / lanes`
requests open. Answers are logged in pieces as they come, each a whole file or none, so a
task that is lost repeats at most its last piece; the task that replaces it reads its lane's
pieces first. An answer without content has failed, and the next call asks for it again.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from typing import Protocol

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fetch import Folder, pause

#: Requests open at a time, answers of a logged piece, tries, the first pause and an answer's time limit, both in seconds.
WORKERS, PIECE, TRIES, PAUSE, TIMEOUT = 50, 100, 5, 30.0, 900.0
#: The kinds of images by extension; others are sent as the first.
KINDS = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp"}
LOG = "id string, content string, reasoning string, error string, tries int, finished double"
_ARROW = pa.schema([("id", pa.string()), ("content", pa.string()), ("reasoning", pa.string()), ("error", pa.string()), ("tries", pa.int32()), ("finished", pa.float64())])


class Busy(Exception):
    """The service wants to be asked later; after_seconds, if it said when."""

    def __init__(self, reason: str, after_seconds: str | None = None):
        super().__init__(reason)
        self.after_seconds = after_seconds


class Service(Protocol):
    def call(self, body: str) -> tuple[str, str]: ...


class HttpService:
    """A service that takes messages as JSON by POST and answers with a list of output items: texts of messages, and a summary of the reasoning."""

    def __init__(self, url: str, model: str, max_tokens: int, effort: str | None = None, key: str = "", timeout: float = TIMEOUT):
        self.url, self.key, self.timeout = url, key, timeout
        self.fixed = {"model": model, "max_output_tokens": max_tokens} | ({"reasoning": {"effort": effort, "summary": "detailed"}} if effort else {})

    def call(self, body: str) -> tuple[str, str]:
        data = json.dumps(self.fixed | {"input": json.loads(body)}).encode()
        request = urllib.request.Request(self.url, data, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                output = json.loads(answer.read()).get("output") or []
        except urllib.error.HTTPError as e:
            if e.code in (408, 429):
                raise Busy(f"{e.code} {e.reason}", e.headers.get("Retry-After")) from e
            raise
        except TimeoutError as e:
            raise Busy("Timeout") from e
        texts = [c.get("text") or "" for item in output if item.get("type") == "message" for c in item.get("content") or [] if c.get("type") == "output_text"]
        thoughts = next((item.get("summary") or [] for item in output if item.get("type") == "reasoning"), [])
        return "".join(texts), "\n".join(s["text"] for s in thoughts if s.get("text"))


def asked(service: Service, body: str, tries: int, first: float, sleep: Callable[[float], None] = time.sleep) -> dict:
    """One request: asked again, after twice the pause each time, only where the service is busy."""
    for attempt in range(tries):
        try:
            content, reasoning = service.call(body)
            return {"content": content or "", "reasoning": reasoning or "", "error": None, "tries": attempt + 1}
        except Busy as e:
            error = str(e)
            if attempt + 1 < tries:
                sleep(pause(attempt, e.after_seconds, first, 16 * first))
        except Exception as e:  # whatever a service raises is this request's failure, not the job's
            return {"content": "", "reasoning": "", "error": f"{type(e).__name__}: {e}"[:200], "tries": attempt + 1}
    return {"content": "", "reasoning": "", "error": error, "tries": tries}


class _Lane:
    """The pieces of one lane of one call."""

    def __init__(self, folder: Folder, call: str, lane: int):
        self.folder, self.path, self.rows = folder, f"_calls/{call}-{lane:05d}", []

    def done(self) -> set[str]:
        from pyarrow.fs import FileSelector

        at = FileSelector(f"{self.folder.root}/{self.path}", allow_not_found=True)
        files = [f.path for f in self.folder.system.get_file_info(at) if f.is_file]
        return {i for f in files for i in pq.read_table(f, columns=["id"], filesystem=self.folder.system, partitioning=None).column("id").to_pylist()}

    def flush(self) -> None:
        if self.rows:
            out = pa.BufferOutputStream()
            pq.write_table(pa.Table.from_pylist(self.rows, _ARROW), out)
            self.folder.put(f"{self.path}/{uuid.uuid4().hex}.parquet", iter([out.getvalue().to_pybytes()]))
            self.rows = []


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """The last row of the log under folder of each request, one with content before one without."""
    from pyarrow.fs import FileSelector

    place = Folder(folder)
    uri = folder if "://" in folder else f"file://{folder}"
    lanes = place.system.get_file_info(FileSelector(f"{place.root}/_calls", allow_not_found=True))
    if not lanes:
        return spark.createDataFrame([], LOG)
    rows = spark.read.schema(LOG).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{uri}/_calls")
    last = F.max_by(F.struct("content", "reasoning", "error", "tries", "finished"), F.struct(F.col("content") != "", F.col("finished"))).alias("r")
    return rows.groupBy("id").agg(last).select("id", "r.*")


def answered(requests: DataFrame, folder: str, factory: Callable[[], Service], workers: int = WORKERS, lanes: int | None = None, tries: int = TRIES, first: float = PAUSE, piece: int = PIECE) -> DataFrame:
    """MOD4: the answers to requests (id, body); what the log under folder holds with content is not asked again.

    At most `workers` requests are open at a time over all lanes, however many tasks run. Repeated ids are asked once; null ids are left out; a null body is an empty list of messages. One call at a time may write to a folder.
    """
    spark = requests.sparkSession
    lanes = max(1, min(workers, lanes or spark.sparkContext.defaultParallelism))
    call = uuid.uuid4().hex
    rows = requests.select(F.col("id").cast("string").alias("id"), F.coalesce("body", F.lit("[]")).alias("body")).where("id IS NOT NULL")
    rows = rows.groupBy("id").agg(F.min("body").alias("body"))
    left = rows.join(answers(spark, folder).where("content <> ''").select("id"), "id", "left_anti")
    lane = F.pmod(F.xxhash64("id"), F.lit(lanes)).cast("int")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service, place, own, n = factory(), Folder(folder), {}, 0
        done: dict[int, set[str]] = {}
        with ThreadPoolExecutor(workers) as pool:
            open_: dict = {}

            def settle(most: int) -> None:
                nonlocal n
                while len(open_) > most:
                    for future in wait(open_, return_when=FIRST_COMPLETED).done:
                        k, i = open_.pop(future)
                        own[k].rows.append({"id": i, **future.result(), "finished": time.time()})
                        n += 1
                        if len(own[k].rows) >= piece:
                            own[k].flush()

            for df in batches:
                for i, body, k in df.itertuples(index=False):
                    if k not in own:
                        own[k] = _Lane(place, call, k)
                        done[k] = own[k].done()
                    if i not in done[k]:
                        # Lanes share the open requests: the first ones take what does not divide evenly.
                        settle(workers // lanes + (k < workers % lanes) - 1)
                        open_[pool.submit(asked, service, body, tries, first)] = (k, i)
            settle(0)
        for one in own.values():
            one.flush()
        yield pd.DataFrame({"n": [n]})

    # Each lane is a partition by its number; a count is all that comes back.
    left.withColumn("lane", lane).repartitionById(lanes, F.col("lane")).select("id", "body", "lane").mapInPandas(run, "n long").agg(F.sum("n")).collect()
    Folder(folder).clear_parts()
    return answers(spark, folder).join(rows.select("id"), "id", "left_semi")


_PART = "struct<type:string,text:string,image:string>"
MESSAGES = f"array<struct<role:string,content:string,parts:array<{_PART}>>>"


def request_bodies(prompts: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """MOD4: (id, body): messages as a service takes them, in JSON.

    prompts: id, messages (MESSAGES: a message is a text, or parts of type text or image), media_files (array of paths). images: (path, content), as spark.read.format("binaryFile") gives them; without, all images are left out. An image without a path of its own takes the next of media_files; one that is not there, or has no file, is left out; a null role is the user's. Only places and paths travel in the join, and each file's content once for each request that shows it.
    """
    rows = prompts.select("id", "messages", "media_files")
    if images is None:
        urls = F.create_map().cast("map<string,string>")
    else:
        one = rows.select("id", "media_files", F.posexplode("messages").alias("m", "message")).select("id", "media_files", "m", F.posexplode("message.parts").alias("p", "part"))
        shown = one.where("part.type = 'image'").select("id", "media_files", "m", "p", F.col("part.image").alias("image"))
        path_less = F.sum(F.when(F.coalesce(F.col("image"), F.lit("")) == "", 1).otherwise(0)).over(Window.partitionBy("id").orderBy("m", "p"))
        path = F.when(F.coalesce(F.col("image"), F.lit("")) == "", F.get("media_files", (path_less - 1).cast("int"))).otherwise(F.col("image"))
        named = shown.withColumn("path", path).select("id", F.concat_ws(":", "m", "p").alias("place"), "path")
        kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))), F.lit("image/jpeg"))
        found = named.join(images.select("path", "content"), "path").select("id", "place", F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.translate(F.base64("content"), "\r\n", "")).alias("url"))
        by_id = found.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("place", "url"))).alias("urls"))
        rows = rows.join(by_id, "id", "left")
        urls = F.coalesce("urls", F.create_map().cast("map<string,string>"))

    def part(m, x, p):
        url = F.element_at(urls, F.concat_ws(":", m.cast("string"), p.cast("string")))
        text = F.when(x["type"] == "text", F.to_json(F.struct(F.lit("input_text").alias("type"), F.coalesce(x["text"], F.lit("")).alias("text"))))
        return text.when((x["type"] == "image") & url.isNotNull(), F.to_json(F.struct(F.lit("input_image").alias("type"), url.alias("image_url"), F.lit("low").alias("detail"))))

    def message(x, m):
        said_by = F.coalesce(x["role"], F.lit("user")).alias("role")
        plain = F.to_json(F.struct(said_by, F.coalesce(x["content"], F.lit("")).alias("content")))
        role = F.to_json(F.struct(said_by))
        parts = F.filter(F.transform(x["parts"], lambda y, p: part(m, y, p)), lambda s: s.isNotNull())
        return F.when(x["parts"].isNull(), plain).otherwise(F.concat(F.regexp_replace(role, r"\}$", ""), F.lit(',"content":['), F.array_join(parts, ","), F.lit("]}")))

    body = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce("messages", F.array().cast(MESSAGES)), message), ","), F.lit("]"))
    return rows.select("id", body.alias("body"))


def complete_pairs(pairs: DataFrame, found: DataFrame, key: str = "mod_comment_id") -> DataFrame:
    """MOD4: pairs whose threads both have content, with content and reasoning of both. found: (id, content, reasoning), an id being the pair's key, an underscore and the thread."""
    kept = found.where("content <> ''").select("id", "content", "reasoning")
    for thread in ("violating", "compliant"):
        side = kept.select(F.col("id").alias("_id"), F.col("content").alias(f"{thread}_content"), F.col("reasoning").alias(f"{thread}_reasoning"))
        pairs = pairs.join(side, F.concat(F.col(key).cast("string"), F.lit(f"_{thread}")) == F.col("_id")).drop("_id")
    return pairs
