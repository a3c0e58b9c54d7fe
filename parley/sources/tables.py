"""Scans of compressed JSON lines, documents, TSV and result folders (SRC1-SRC17), with the tables' schemas."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as S


def _struct(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)


#: Fields that vary in type are read as text: the text keeps false, null, whole and fractional numbers apart.
COMMENT = "id string, author string, body string, subreddit string, created_utc string, parent_id string, link_id string, distinguished string, score bigint, edited string, media string, media_metadata string, author_flair_text string"
SUBMISSION = "id string, author string, title string, subreddit string, created_utc string, selftext string, selftext_html string, url string, over_18 boolean, over18 boolean, crosspost_parent string, crosspost_parent_list array<string>, is_self boolean, is_video boolean, media struct<oembed:struct<thumbnail_url:string>>, secure_media struct<oembed:struct<thumbnail_url:string>>, media_metadata map<string,struct<e:string,s:struct<u:string>>>, preview struct<images:array<struct<source:struct<url:string>>>>, distinguished string, link_flair_text string"
REQUIRED_COMMENT = ("id", "author", "body", "subreddit", "created_utc")
REQUIRED_SUBMISSION = ("id", "author", "title", "subreddit", "created_utc")


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """SRC1, SRC3, SRC5: (value, path, seq) of every line that is not blank, a last line without an end included.

    A compressed file is one task; seq orders lines within it and files by partition.
    """
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"))
    return lines.withColumn("seq", F.monotonically_increasing_id()).where(F.trim("value") != "")


def first_lines(spark: SparkSession, paths: str | list[str], n: int) -> DataFrame:
    """SRC3, LIM1: the first n lines."""
    return read_lines(spark, paths).orderBy("seq").limit(n)


def parse_json(lines: DataFrame, schema: str, contains: list[str] | None = None) -> DataFrame:
    """SRC1, JSN1, FLT1, FLT23: parsed fields, raw, path, seq and malformed. contains: texts that a raw line must hold, tested before parsing."""
    for text in contains or []:
        lines = lines.where(F.col("value").contains(text))
    whole = T.StructType([*_struct(schema).fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.select("value", "path", "seq", parsed.alias("r"))
    return rows.select("r.*", F.col("value").alias("raw"), "path", "seq").withColumn("malformed", F.col("_corrupt").isNotNull()).drop("_corrupt")


def has_keys(raw: Column, keys: tuple[str, ...]) -> Column:
    """FLT4: the keys are there; their values may be null."""
    found = F.json_object_keys(raw)
    out = found.isNotNull()
    for k in keys:
        out = out & F.array_contains(found, k)
    return out


def read_document(spark: SparkSession, paths: str | list[str], *levels: str) -> DataFrame:
    """SRC6: whole-document JSON, exploded along the levels named."""
    df = spark.read.option("multiLine", True).json(paths)
    for level in levels:
        df = df.withColumn(level.rpartition(".")[2], F.explode(level))
    return df


def listing(spark: SparkSession, folder: str, suffix: str = ".zst") -> DataFrame:
    """SRC7: (name, path, size) of a folder's files, the largest first; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(folder).select("path", F.col("length").alias("size"))
    return files.select(F.regexp_extract("path", r"([^/]+?)(?:_comments|_submissions)?\.[^/]*$", 1).alias("name"), "path", "size").orderBy(F.desc("size"), "path")


def of_community(rows: DataFrame, name: str, column: str = "subreddit") -> DataFrame:
    """SRC8: a community's rows whatever its case; tables partitioned by bucket are pruned to one."""
    if "bucket" in rows.columns:
        rows = rows.where(F.col("bucket") == S.name_bucket(F.lit(name)))
    return rows.where(F.lower(column) == name.lower())


def between_months(files: DataFrame, prefix: str, first: str, last: str) -> DataFrame:
    """SRC9: `PREFIX_YYYY-MM.zst` of months in the range, newest first, without files marked corrupted."""
    month = F.regexp_extract("path", rf"{re.escape(prefix)}_(\d{{4}}-\d{{2}})\.zst$", 1)
    found = files.withColumn("month", month).where((F.col("month") != "") & ~F.col("path").endswith("corrupted.zst"))
    return found.where(S.in_months(F.col("month"), first, last)).orderBy(F.desc("month"))


def read_tsv(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """SRC11: a quoted TSV with a header. A rule named `None` or `NA` is text, and an empty field an empty text."""
    header = spark.read.option("sep", "\t").option("header", True).csv(path).columns
    if missing := [c for c in required if c not in header]:
        raise ValueError(f"{path} lacks columns {missing}")
    kinds = {f.name: f.dataType for f in _struct(schema).fields}
    text = T.StructType([T.StructField(c, T.StringType()) for c in header])
    rows = spark.read.options(sep="\t", header=True, multiLine=True, quote='"', escape='"', nullValue="\u0000", emptyValue="").schema(text).csv(path)
    return rows.select([F.col(c).try_cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in header])


def unbencoded(data: bytes) -> object:
    """A bencoded value: whole numbers, byte strings, lists and maps. Anything else raises ValueError."""

    def value(at: int) -> tuple[object, int]:
        kind = data[at : at + 1]
        if kind == b"i":
            end = data.index(b"e", at)
            return int(data[at + 1 : end]), end + 1
        if kind in (b"l", b"d"):
            out, at = [], at + 1
            while data[at : at + 1] != b"e":
                item, at = value(at)
                out.append(item)
            return (out if kind == b"l" else dict(zip(out[::2], out[1::2], strict=True))), at + 1
        colon = data.index(b":", at)
        end = colon + 1 + int(data[at:colon])
        if not kind.isdigit() or end > len(data):
            raise ValueError(f"no bencoded value at byte {at}")
        return data[colon + 1 : end], end

    found, end = value(0)
    if end != len(data):
        raise ValueError(f"more after byte {end}")
    return found


def torrent_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """SRC12: (torrent, index, basename, relpath, length) of every file that torrents name: index from 1, basename in lower case. A torrent of one file has its name; entries without a path keep their number and give no row."""
    import pandas as pd

    columns = ["torrent", "index", "basename", "relpath", "length"]

    def run(batches):
        for df in batches:
            out = []
            for path, content in zip(df["path"], df["content"], strict=True):
                info = unbencoded(content)[b"info"]
                text = lambda x: x.decode("utf-8", "replace")
                listed = info[b"files"] if b"files" in info else [{b"path": [info[b"name"]], b"length": info.get(b"length")}]
                for i, f in enumerate(listed, 1):
                    parts = [text(p) for p in f.get(b"path.utf-8") or f.get(b"path") or []]
                    if parts and parts[-1]:
                        out.append((path, i, parts[-1].lower(), "/".join(parts), f.get(b"length")))
            yield pd.DataFrame(out, columns=columns).astype({"length": "Int64"})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "torrent string, index long, basename string, relpath string, length long")


def mirrored(spark: SparkSession, folder: str, needed: DataFrame) -> DataFrame:
    """SRC13: (basename, path, size) of the files anywhere below a local mirror that are needed, by names in lower case; of files of the same name the first path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.lower(F.element_at(F.split("path", "/"), -1)).alias("basename"), "path", F.col("length").alias("size"))
    wanted = needed.select(F.lower("basename").alias("basename")).distinct()
    first = F.min(F.struct("path", "size")).alias("f")
    return found.join(wanted, "basename", "left_semi").groupBy("basename").agg(first).select("basename", "f.path", "f.size")


def missing_files(needed: DataFrame, present: DataFrame, name: str = "name") -> DataFrame:
    """DRV1, JON14: names of a manifest that no file has."""
    return needed.select(name).distinct().join(present.select(name).distinct(), name, "left_anti")


def needed_files(names: DataFrame, name: str = "name") -> DataFrame:
    """SET4: each name's two files."""
    return names.select(F.col(name), F.explode(F.array(*[F.concat(F.col(name), F.lit(f"_{k}.zst")) for k in ("comments", "submissions")])).alias("basename"))


def traces(rows: DataFrame) -> DataFrame:
    """SRC16: a teacher's traces by key, the last of each; empty ones are left out."""
    usable = rows.where(F.coalesce(F.trim(S.rationale(F.col("trace_reasoning"), F.col("completion"), F.col("raw_content"))), F.lit("")) != "")
    newest = usable.groupBy("mod_comment_id", "thread_type").agg(F.max_by(F.struct("*"), "seq").alias("r"))
    return newest.select("r.*")


def result_folders(files: DataFrame, root: str) -> DataFrame:
    """SRC17: model, split, context, phrase and run suffix of result files, the latest file of each folder."""
    behind = F.expr(f"locate('{root.rstrip('/').replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39))}/', path)")
    inside = F.split(F.when(behind > 0, F.substr("path", behind + len(root.rstrip("/")) + 1)).otherwise(F.col("path")), "/")
    n = F.size(inside)
    parts = files.select("path", F.element_at(inside, -1).alias("file"), F.slice(inside, F.lit(1), n - 1).alias("d")).where(F.size("d") >= 4)
    rows = parts.select("path", "file", *[F.col("d")[i].alias(c) for i, c in enumerate(("model", "split", "context", "phrase"))], F.get("d", F.lit(4)).alias("run_suffix"))
    return rows.groupBy("model", "split", "context", "phrase", "run_suffix").agg(F.max_by("path", "file").alias("path"))


def community_maps(entries: DataFrame, order: str = "seq") -> DataFrame:
    """LOD2: rules, language, title and description of each community by lower-case name, of repeated ones the last; nameless entries are left out.

    entries: (subreddit struct<display_name, lang, title, public_description>, rules array, and order).
    """
    own = F.col("subreddit")
    name = F.lower(own["display_name"])
    r = F.struct(F.coalesce("rules", F.array()).alias("rules"), F.coalesce(own["lang"], F.lit("unknown")).alias("language"), F.coalesce(own["title"], F.lit("")).alias("title"), F.coalesce(own["public_description"], F.lit("")).alias("description"))
    return entries.where(F.coalesce(name, F.lit("")) != "").groupBy(name.alias("subreddit")).agg(F.max_by(r, order).alias("r")).select("subreddit", "r.*")


def load_comments(lines: DataFrame) -> DataFrame:
    """LOD1: valid comments with the community's name normalised and ids without prefixes."""
    rows = parse_json(lines, COMMENT).where(~F.col("malformed") & has_keys(F.col("raw"), REQUIRED_COMMENT))
    return rows.withColumns({"subreddit": S.community_name(F.col("subreddit")), "submission_id": S.strip_kind(F.col("link_id"), "t3"), "created_utc": S.seconds(F.col("created_utc"))})


def load_submissions(lines: DataFrame) -> DataFrame:
    rows = parse_json(lines, SUBMISSION).where(~F.col("malformed") & has_keys(F.col("raw"), REQUIRED_SUBMISSION))
    return rows.withColumn("subreddit", S.community_name(F.col("subreddit")))
