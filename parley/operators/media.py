"""Media of submissions (MEDIA1-MEDIA7): what to fetch, by priority, and what came of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as S


def item(url: Column, media_id: Column, source: str, index: Column | None = None) -> Column:
    """STR14."""
    plain = S.plain_ampersands(url)
    return F.struct(plain.alias("url"), media_id.alias("media_id"), F.lit(source).alias("source"), S.url_extension(plain).alias("extension_hint"), (index if index is not None else F.lit(None)).cast("int").alias("index"))


def _one(cond: Column, url: Column, name: str, source: str) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), F.array(item(url, F.lit(name), source))).otherwise(F.array().cast("array<struct<url:string,media_id:string,source:string,extension_hint:string,index:int>>"))


def gallery() -> Column:
    """MEDIA1, MAP2: images of the gallery with their place among all its entries."""
    entries = F.transform(F.map_entries("media_metadata"), lambda e, i: F.struct(e["key"].alias("id"), e["value"].alias("v"), i.alias("i")))
    images = F.filter(entries, lambda e: (e["v"]["e"] == "Image") & e["v"]["s"]["u"].isNotNull())
    none = F.array().cast("array<struct<url:string,media_id:string,source:string,extension_hint:string,index:int>>")
    return F.coalesce(F.transform(images, lambda e: item(e["v"]["s"]["u"], e["id"], "media_metadata", e["i"])), none)


def direct() -> Column:
    """MEDIA2."""
    return _one(S.is_media_url(F.col("url")), F.col("url"), "direct", "url")


def oembed() -> Column:
    """MEDIA2: of `media`, or where that is not there, of `secure_media`."""
    thumb = F.when(F.col("media").isNotNull(), F.col("media.oembed.thumbnail_url")).otherwise(F.col("secure_media.oembed.thumbnail_url"))
    return _one(F.coalesce(thumb, F.lit("")) != "", thumb, "oembed", "oembed")


def preview() -> Column:
    """MEDIA2, JSN2: the first preview image; none for posts of text."""
    url = F.get(F.col("preview.images"), F.lit(0))["source"]["url"]
    return _one((F.coalesce(url, F.lit("")) != "") & ~F.coalesce(F.col("is_self"), F.lit(False)), url, "preview", "preview")


def wanted() -> Column:
    """MEDIA3: the items of the first source that has any."""
    sources = [gallery(), direct(), oembed(), preview()]
    out = F.when(F.size(sources[0]) > 0, sources[0])
    for s in sources[1:]:
        out = out.when(F.size(s) > 0, s)
    return out.otherwise(sources[0])


def is_video() -> Column:
    """MEDIA4: recorded only; a video's images are fetched all the same."""
    kinds = F.transform(F.map_values("media_metadata"), lambda v: v["e"])
    return F.coalesce(F.col("is_video"), F.lit(False)) | F.coalesce(S.is_video_url(F.col("url")), F.lit(False)) | F.coalesce(F.exists(kinds, lambda e: e.isin("Video", "RedditVideo")), F.lit(False))


def status(wanted: Column, fetched: Column) -> Column:
    """MEDIA5: of numbers of items wanted and fetched."""
    nsfw = F.coalesce(F.col("over_18"), F.lit(False)) | F.coalesce(F.col("over18"), F.lit(False))
    cross = (F.coalesce(F.size("crosspost_parent_list"), F.lit(0)) > 0) | (F.coalesce(F.col("crosspost_parent"), F.lit("")) != "")
    return F.when(nsfw, "skipped_nsfw").when(cross, "skipped_crosspost").when(wanted == 0, "no_media").when(fetched == wanted, "complete").when(fetched > 0, "partial").otherwise("failed")


def file_name(submission_id: Column, item: Column) -> Column:
    """MEDIA6."""
    own = F.when(item["media_id"].isin("direct", "oembed", "preview"), item["media_id"]).otherwise(F.concat_ws("_", F.coalesce(item["index"], F.lit(0)).cast("string"), S.media_id(item["media_id"])))
    return F.concat(submission_id, F.lit("_"), own)


def plan(submissions: DataFrame) -> DataFrame:
    """MEDIA1-MEDIA4, MEDIA6: a row for each item to fetch."""
    rows = submissions.select(F.col("id").alias("submission_id"), is_video().alias("is_video"), F.explode(wanted()).alias("item"))
    return rows.select("submission_id", "is_video", "item.*", file_name(F.col("submission_id"), F.col("item")).alias("file"))


def outcomes(submissions: DataFrame, fetched: DataFrame) -> DataFrame:
    """MEDIA5: status of each submission. fetched: (submission_id, file, success, error)."""
    done = fetched.groupBy("submission_id").agg(F.count_if("success").alias("files_downloaded"), F.array_sort(F.collect_list(F.when(F.col("success"), F.col("file")))).alias("file_paths"), F.array_sort(F.collect_list(F.when(~F.col("success"), S.error_category(F.col("error"))))).alias("errors"))
    rows = submissions.withColumn("_wanted", F.size(wanted())).join(done, submissions["id"] == done["submission_id"], "left")
    none = F.array().cast("array<string>")
    return rows.select(F.col("id").alias("submission_id"), status(F.col("_wanted"), F.coalesce("files_downloaded", F.lit(0))).alias("status"), is_video().alias("is_video"), F.coalesce("files_downloaded", F.lit(0)).alias("files_downloaded"), F.coalesce("file_paths", none).alias("file_paths"), F.coalesce("errors", none).alias("errors"))


# Content types that are taken, with the extensions they are stored under, and the largest file.
EXTENSIONS = {"image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp", "image/bmp": ".bmp"}
MOST_BYTES = 50 * 1024 * 1024


def checked(answers: DataFrame) -> DataFrame:
    """SNK12: answers (content_type, file_size, error) with success, error and extension: only known content types, and no file over MOST_BYTES."""
    kind = F.trim(F.split_part(F.lower(F.coalesce("content_type", F.lit(""))), F.lit(";"), F.lit(1)))
    wrong = F.when(F.col("error").isNotNull(), F.col("error")).when(~kind.isin(*EXTENSIONS), F.concat(F.lit("Invalid Content-Type: "), kind)).when(F.col("file_size") > MOST_BYTES, F.lit("File too large"))
    known = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return answers.withColumns({"error": wrong, "success": wrong.isNull(), "extension": F.when(wrong.isNull(), F.try_element_at(known, kind))})


def left_to_fetch(submissions: DataFrame, files: DataFrame) -> DataFrame:
    """MEDIA7: submissions (submission_id, num_media) that files (submission_id, file) do not cover yet; those with as many files as they should have, and any, are skipped."""
    have = files.groupBy("submission_id").agg(F.count_distinct("file").alias("_have"))
    rows = submissions.join(have, "submission_id", "left")
    return rows.where(~((F.col("num_media") > 0) & (F.coalesce("_have", F.lit(0)) >= F.col("num_media")))).drop("_have")


def relative_path(path: Column, root: str) -> Column:
    """MEDIA7."""
    own = root.rstrip("/") + "/"
    return F.when(path.startswith(own), F.substr(path, F.lit(len(own) + 1))).otherwise(path)
