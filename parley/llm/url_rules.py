"""URL rules by a sort-merge range join.

A host's labels in reverse make its key: `net.example.` for example.net. A rule fits
its host and all subdomains, so it holds for the interval of keys that start with its
own; intervals nest or lie apart. Urls and the starts of intervals are dealt into
ranges of keys and sorted; one sweep keeps a stack of the intervals open at the
current key, and a url asks the open rules, the longest first, whether its path starts
with theirs.

Ranges are cut at sampled keys with a digest of the row behind, so that a host with
any share of the urls is cut as finely as the rest. A rule whose interval reaches over
cuts goes to each range it reaches into: at most as many ranges as there are, and
ranges hold only rules that are open there.

Cases. Null url or no `://`: host and path empty, no rule. An empty host matches no
rule. A url's path may be empty, and then starts with no rule's path but an empty
one. Of equally long rules, the one with the longer host wins; of repeated rules with
different verdicts, block. No rules: the default for all. Null ids and repeated rows:
one result each. Empty table: no rows. Further columns of any name are not looked at.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, packed

#: What urls that no rule fits get.
DEFAULT = "allow"
#: Urls per range, and sampled keys per cut, both about.
RANGE_ROWS = 250_000
SAMPLES = 16
#: Ranges at least and at most.
FEWEST, MOST = 48, 100_000
#: The rules of the query, as (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, *_LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def key_of(host: Column) -> Column:
    """Labels in reverse, each with a dot behind; empty for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(host, path, verdict) of rules written as `host/path`."""
    cut = [(r.partition("/")[0], "/" + r.partition("/")[2] if "/" in r else "", v) for v, r in rules]
    return spark.createDataFrame(cut, "host string, path string, verdict string")


def _cuts(keyed: DataFrame) -> list[bytes]:
    """Sorted places to cut at, from a sample whose size is bounded by SAMPLES for each range."""
    n = keyed.count()
    ranges = max(min(FEWEST, n), min(MOST, n // RANGE_ROWS))
    wanted = ranges * SAMPLES
    share = min(1.0, wanted / max(1, n))
    sample = keyed.where(F.pmod(F.xxhash64(F.lit("cut"), "place"), F.lit(1 << 30)) < int(share * (1 << 30))).select("place").limit(4 * wanted + 1000).collect()
    places = sorted(bytes(r["place"]) for r in sample)
    return sorted({places[len(places) * i // ranges] for i in range(1, ranges)}) if places else []


def _dealt(rows: DataFrame, cuts: list[bytes]) -> DataFrame:
    """rows with `range`: how many cuts are at or before the place. Cuts are bounded by MOST, so they are shipped whole."""
    shipped = rows.sparkSession.sparkContext.broadcast(cuts)

    def run(batches):
        for batch in batches:
            found = [bisect_right(shipped.value, p) for p in batch.column("place").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], names=[*batch.schema.names, "range"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("range", T.IntegerType())]))


def _sweep(default: str):
    def run(batches):
        now, stack = None, []
        for batch in batches:
            out = []
            for r, key, is_url, page, host, path, verdict in zip(*(batch.column(c).to_pylist() for c in ("range", "key", "is_url", "page_id", "host", "path", "verdict")), strict=True):
                if r != now:
                    now, stack = r, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if not is_url:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}, set()))
                    # Of repeated rules, block stands.
                    known = stack[-1][1].get(path)
                    stack[-1][1][path] = (host, "block" if known and "block" in (known[1], verdict) else verdict)
                    stack[-1][2].add(len(path))
                    continue
                best = None
                if key:
                    for _, rules, lengths in stack:
                        # Of a host's rules, one lookup for each length that their paths have.
                        for n in lengths:
                            if n <= len(path) and (rule := rules.get(path[:n])) and (best is None or (len(rule[0]) + n, len(rule[0])) > best[0]):
                                best = (len(rule[0]) + n, len(rule[0])), rule[0] + path[:n], rule[1]
                out.append((page, host, path, best[1] if best else None, best[2] if best else default))
            if out:
                kinds = [pa.int64(), *[pa.string()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names=["page_id", "host", "path", "rule", "verdict"])

    return run


def url_rules(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule and verdict of every url."""
    rows = packed(pages)
    rows = rows.select(column(rows, "page_id", "bigint").alias("page_id"), column(rows, "url", "string").alias("url"))
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.select("page_id", "host", "path", key_of(F.col("host")).alias("key"))
    spread = F.hex(F.xxhash64(F.lit("spread"), "page_id", "path"))
    # A key, a zero byte, and a digest: places order as keys do, and part the rows of a key evenly.
    urls = rows.withColumn("place", F.concat(F.col("key").cast("binary"), F.unhex(F.lit("00")), F.lpad(spread, 16, "0").cast("binary")))
    cuts = _cuts(urls)
    own = rules.select("host", "path", "verdict").where(F.col("host") != "").select(F.translate("host", *_LOWER).alias("host"), "path", "verdict").select("host", "path", "verdict", key_of(F.col("host")).alias("key"))
    first = own.withColumn("place", F.col("key").cast("binary"))
    last = F.concat(F.col("key").cast("binary"), F.unhex(F.lit("FF")))
    low = _dealt(first, cuts).withColumnRenamed("range", "low")
    both = _dealt(low.withColumn("place", last), cuts)
    opened = both.select(F.explode(F.sequence("low", "range")).alias("range"), "key", F.lit(False).alias("is_url"), F.lit(None).cast("bigint").alias("page_id"), "host", "path", "verdict", F.lit("").cast("binary").alias("place"))
    dealt = _dealt(urls, cuts).select("range", "key", F.lit(True).alias("is_url"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict"), "place")
    # Ranges are whole tasks or share one; sorted by range, a sweep starts anew at each.
    swept = dealt.unionByName(opened).repartition(max(1, len(cuts) + 1), "range").sortWithinPartitions("range", "key", "is_url", "path")
    return swept.drop("place").mapInArrow(_sweep(default), "page_id long, host string, path string, rule string, verdict string")


#: The same in DuckDB's SQL, for the rules of the query.
ORACLE = r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT page_id, host, path, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
