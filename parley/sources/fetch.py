"""Network in bulk: files fetched by host (SNK12, DRV2), and services read page by page (SRC14, SRC15).

fetch() deals items by host, so that a host's budget of requests a second is kept without
talk between tasks; a host with many items is dealt into shards, each with its part of the
budget. Bodies are streamed and stop at the byte cap. A file is written under a temporary
name and moved, so a retried task leaves one. What was done is a table of attempts; a later
call goes on from it.

PagedSource is a data source for spark.read: each partition holds a range of pages and one
of the keys, and goes to the next key when it is told to slow down.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.media import EXTENSIONS, MOST_BYTES

#: Answers that are asked for again, how often, and the first pause in seconds.
AGAIN = (429, 500, 502, 503, 504)
TRIES, PAUSE = 3, 0.5
TIMEOUT, PIECE = 30, 1 << 16
#: Requests a second to one host, and items of a host that one task fetches.
RATE, SHARD = 4.0, 10_000
LOG = "id string, url string, host string, success boolean, error string, content_type string, file_size long, file string, tries int, finished double"


class Budget:
    """At most `rate` requests a second."""

    def __init__(self, rate: float, clock=time.monotonic, sleep=time.sleep):
        self.gap, self.clock, self.sleep, self.next = 1 / rate, clock, sleep, 0.0

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap


def pause(attempt: int, told: str | None, first: float = PAUSE, most: float = 60.0) -> float:
    """Seconds before the next attempt: what the answer asks for, else twice as long each time."""
    return min(most, float(told)) if told and told.isdigit() else min(most, first * 2**attempt)


def fetched(url: str, write, budget: Budget, kinds=EXTENSIONS, most: int = MOST_BYTES, tries: int = TRIES, first: float = PAUSE, agent: str = "parley") -> dict:
    """One file: write(extension, pieces) is called with the body of an answer that is wanted, and names the file. pieces raises where the body passes the cap."""
    found = {"success": False, "error": None, "content_type": None, "file_size": None, "file": None, "tries": 0}
    for attempt in range(tries):
        budget.wait()
        found["tries"] = attempt + 1
        told = None
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=TIMEOUT) as answer:
                kind = (answer.headers.get("Content-Type") or "").lower().split(";")[0].strip()
                found["content_type"] = kind
                if kind not in kinds:
                    return found | {"error": f"Invalid Content-Type: {kind}"}
                size = 0

                def pieces():
                    nonlocal size
                    while piece := answer.read(min(PIECE, most + 1 - size)):
                        size += len(piece)
                        if size > most:
                            raise OverflowError
                        yield piece

                name = write(kinds[kind], pieces())
                return found | {"success": True, "error": None, "file_size": size, "file": name}
        except OverflowError:
            return found | {"error": "File too large"}
        except urllib.error.HTTPError as e:
            found["error"], told = f"{e.code} {e.reason}", e.headers.get("Retry-After")
            if e.code not in AGAIN:
                return found
        except TimeoutError:
            found["error"] = "Timeout"
        except (urllib.error.URLError, OSError, ValueError) as e:
            found["error"] = "Timeout" if isinstance(getattr(e, "reason", None), TimeoutError) else f"Download error: {str(e)[:50]}"
            if isinstance(e, ValueError):
                return found
        if attempt + 1 < tries:
            time.sleep(pause(attempt, told, first))
    return found


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


class Folder:
    """A folder that all executors share, by any file system that Arrow knows: whole files or none."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.system, self.root = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")

    def put(self, name: str, pieces: Iterator[bytes]) -> str:
        part = f"{self.root}/_parts/{uuid.uuid4().hex}"
        self.system.create_dir(f"{self.root}/_parts", recursive=True)
        try:
            with self.system.open_output_stream(part) as out:
                for piece in pieces:
                    out.write(piece)
            place = f"{self.root}/{name}"
            self.system.create_dir(place.rpartition("/")[0], recursive=True)
            self.system.move(part, place)
        except BaseException:
            if self.system.get_file_info(part).is_file:
                self.system.delete_file(part)
            raise
        return name

    def clear_parts(self) -> None:
        """What killed tasks have left."""
        if not self.system.get_file_info(f"{self.root}/_parts").type.name == "NotFound":
            self.system.delete_dir(f"{self.root}/_parts")


def attempts(spark, folder: str) -> DataFrame:
    """The table of attempts under folder, empty where there is none."""
    uri = folder if "://" in folder else f"file://{folder}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{uri}/_log")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(f"{uri}/_log")


def fetch(items: DataFrame, folder: str, rate: float = RATE, tries: int = TRIES, first: float = PAUSE, most: int = MOST_BYTES, shard: int = SHARD) -> DataFrame:
    """SNK12, DRV2: fetch items (id, url, file) that the log under folder does not hold as done; returns the log's last row of each item.

    file is a name without an extension, under folder; the answer's content type gives the extension. Items that failed for good are tried again by the next call, with what was not reached. Null or broken urls fail with an error. Repeated ids are fetched once.
    """
    spark = items.sparkSession
    rows = items.select(F.col("id").cast("string").alias("id"), "url", F.col("file").alias("name")).dropDuplicates(["id"])
    left = rows.join(attempts(spark, folder).where("success").select("id"), "id", "left_anti")
    host = F.pandas_udf(lambda urls: urls.map(host_of), "string")
    left = left.withColumn("host", host(F.coalesce("url", F.lit(""))))
    shards = left.groupBy("host").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    left = left.join(shards, "host").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))

    def run(batches):
        place, budgets = Folder(folder), {}
        for df in batches:
            out = []
            for r in df.itertuples(index=False):
                budget = budgets.setdefault((r.host, r.shard), Budget(rate / r.shards))
                write = lambda extension, pieces, name=r.name: place.put(name + extension, pieces)
                found = fetched(r.url or "", write, budget, EXTENSIONS, most, tries, first)
                out.append({"id": r.id, "url": r.url, "host": r.host, **found, "finished": time.time()})
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LOG.split(", ")]).astype({"file_size": "Int64"})

    # A shard's items stand together in one task, one after the other.
    done = left.repartition("host", "shard").sortWithinPartitions("host", "shard", "id").mapInPandas(run, LOG)
    uri = folder if "://" in folder else f"file://{folder}"
    done.write.mode("append").parquet(f"{uri}/_log")
    Folder(folder).clear_parts()
    last = F.max_by(F.struct("url", "host", "success", "error", "content_type", "file_size", "file", "tries"), F.struct("success", "finished")).alias("r")
    return attempts(spark, folder).join(rows.select("id"), "id", "left_semi").groupBy("id").agg(last).select("id", "r.*")


class Pages(InputPartition):
    def __init__(self, first: int, last: int, key: int):
        super().__init__((first, last))
        self.first, self.last, self.key = first, last, key


class PagedSource(DataSource):
    """spark.read.format("paged"): (page, place, item), item being each entry's JSON.

    Options: url, with {page} and, if it wants one, {key}; pages, how many there are, from `start` (1); items, the field of an answer that holds its entries (none: the answer is the list); keys, by commas; size, pages of a partition (10); tries for each page (6); pause, the first one in seconds (0.5).
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, place int, item string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.items = options["url"], options.get("items")
        self.start, self.pages = int(options.get("start", 1)), int(options["pages"])
        self.keys = [k for k in options.get("keys", "").split(",") if k] or [""]
        self.size, self.tries, self.first = int(options.get("size", 10)), int(options.get("tries", 6)), float(options.get("pause", PAUSE))

    def partitions(self) -> list[Pages]:
        end = self.start + self.pages
        return [Pages(a, min(end, a + self.size), k) for k, a in enumerate(range(self.start, end, self.size))]

    def answer(self, page: int, key: int) -> tuple[object, int]:
        """A page's content and the key that gave it: told to slow down, the next key is taken, and a pause once all have been."""
        error = None
        for attempt in range(self.tries * len(self.keys)):
            now = self.keys[key % len(self.keys)]
            url = self.url.replace("{page}", str(page)).replace("{key}", quote(now, safe=""))
            request = urllib.request.Request(url, headers={"Authorization": f"Bearer {now}"} if now and "{key}" not in self.url else {})
            told = None
            try:
                with urllib.request.urlopen(request, timeout=TIMEOUT) as found:
                    return json.loads(found.read()), key
            except urllib.error.HTTPError as e:
                error, told = e, e.headers.get("Retry-After")
                if e.code not in AGAIN:
                    break
                key += e.code == 429
            except (urllib.error.URLError, OSError, ValueError) as e:
                error = e
            if (attempt + 1) % len(self.keys) == 0:
                time.sleep(pause(attempt // len(self.keys), told, self.first))
        raise OSError(f"page {page}: {error}")  # the task fails and is retried; no page is left out

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        key = partition.key
        for page in range(partition.first, partition.last):
            content, key = self.answer(page, key)
            entries = content if self.items is None else content.get(self.items) or []
            texts = [json.dumps(e, ensure_ascii=False, separators=(",", ":")) for e in entries]
            if texts:
                yield pa.RecordBatch.from_arrays([pa.array([page] * len(texts), pa.int32()), pa.array(range(len(texts)), pa.int32()), pa.array(texts)], names=["page", "place", "item"])


def paged(spark, url: str, pages: int, **options) -> DataFrame:
    """SRC14, SRC15: all entries of all pages, each page once."""
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").options(url=url, pages=pages, **options).load()
