"""The engine's queries on the standard tables, by operator key, each with equivalent SQL where SQL can express it.

The tables stand for the engine's own: documents for comments, pages for submissions,
embeddings for vectors of comments and rules, labels for scores, events for trees and
raw records, orders and lineitem for pairs and ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import numbers as N
from .functions import text as S
from .operators import aggregates as A
from .operators import clusters as C
from .operators import filters as P
from .operators import joins as J
from .operators import media as M
from .operators import geometry, layout, neighbours, reports, resamples, similarity, splits, trees
from .operators import prompts as R
from .operators import validation as V
from .plans import evaluate
from .sources import tables
from .staging import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "rag_vote_accuracy"


class Tables:
    """Tables of a folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.folder = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _big(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


# Sources, filters and scalars


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, FALSE AS malformed FROM events")
def src_json_props(t: Tables) -> DataFrame:
    lines = t.events.select(F.col("props").alias("value"), F.lit("").alias("path"), F.col("event_id").alias("seq"))
    return tables.parse_json(lines, "k bigint").select(F.col("seq").alias("event_id"), "k", "malformed")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k_text FROM events WHERE contains(props, '\"k\"')")
def jsn_nested_get(t: Tables) -> DataFrame:
    return t.events.where(F.col("props").contains('"k"')).select("event_id", F.get_json_object("props", "$.k").alias("k_text"))


@query("SELECT event_id, json_exists(props, '$.k') AS has_k, json_exists(props, '$.absent') AS has_absent FROM events")
def flt_required_fields(t: Tables) -> DataFrame:
    return t.events.select("event_id", tables.has_keys(F.col("props"), ("k",)).alias("has_k"), tables.has_keys(F.col("props"), ("absent",)).alias("has_absent"))


_BOT = " OR ".join(f"contains(lower(a), '{m}')" for m in S.BOT_MARKS)


@query(f"SELECT doc_id, coalesce(a, '') = '' OR lower(a) IN ('[deleted]', '[removed]') OR {_BOT} AS is_bot FROM (SELECT doc_id, split_part(text, ' ', 1) AS a FROM documents)")
def flt_bot_author(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", S.bot_author(F.split_part("text", F.lit(" "), F.lit(1))).alias("is_bot"))


@query("SELECT role, count(*) AS n FROM (SELECT role, CASE WHEN conv_id % 7 = 0 THEN '[removed]' ELSE text END AS body FROM conversations) WHERE coalesce(body, '') NOT IN ('[deleted]', '[removed]') AND coalesce(role, '') NOT IN ('[deleted]', '[removed]') GROUP BY role")
def flt_removed(t: Tables) -> DataFrame:
    rows = t.conversations.withColumn("body", F.when(F.col("conv_id") % 7 == 0, "[removed]").otherwise(F.col("text")))
    return A.per_key(rows.where(~P.removed("body", "role")), "role")


@query("SELECT lang, count(*) AS n FROM documents WHERE lang IN (SELECT lang FROM documents GROUP BY lang HAVING count(*) >= 150) GROUP BY lang")
def flt_common_languages(t: Tables) -> DataFrame:
    return A.per_key(P.common_languages(t.documents.select("lang"), 150, "lang"), "lang")


_IDS = "CASE o_orderkey % 4 WHEN 0 THEN 't1_' || o_orderkey WHEN 1 THEN 't3_' || o_orderkey WHEN 2 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END"


@query(f"SELECT o_orderkey, CASE WHEN x <> '' THEN regexp_replace(x, '^t1_', '') END AS comment_id, CASE WHEN x <> '' THEN regexp_replace(x, '^t3_', '') END AS submission_id FROM (SELECT o_orderkey, {_IDS} AS x FROM orders)")
def str_prefix_strip(t: Tables) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    x = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("t1_"), k)).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("t3_"), k)).when(F.col("o_orderkey") % 4 == 2, "").otherwise(k)
    return t.orders.select("o_orderkey", S.strip_kind(x, "t1").alias("comment_id"), S.strip_kind(x, "t3").alias("submission_id"))


@query("SELECT c_custkey, trim(lower(regexp_replace('r/' || c_name || ' ', '^r/', ''))) AS name, CASE WHEN regexp_matches(lower(substr(c_name, 1, 1)), '^[a-z0-9]$') THEN lower(substr(c_name, 1, 1)) ELSE '_' END AS bucket FROM customer")
def str_community_name(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", S.community_name(F.concat(F.lit("r/"), "c_name", F.lit(" "))).alias("name"), S.name_bucket(F.col("c_name")).alias("bucket"))


@query("SELECT doc_id, split_part(replace(x, '_', '-'), '-', 1) AS root FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN lang || '-au' ELSE lang || '_BR' END AS x FROM documents)")
def str_language_root(t: Tables) -> DataFrame:
    x = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).when(F.col("doc_id") % 3 == 1, F.concat("lang", F.lit("-au"))).otherwise(F.concat("lang", F.lit("_BR")))
    return t.documents.select("doc_id", S.language_root(x).alias("root"))


_REPLIES = ("The answer is (b).", "Answer: c", "I pick option d", "b)", "e.", " f ", "<think>(a)", "<think>(x)</think> (g)", "prose without a choice")
_REPLY_SQL = "CASE event_id % 9 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(_REPLIES)) + " END"
_FORM_SQL = ", ".join(f"nullif(regexp_extract(y, '{p}', 1), '')" for p in S.ANSWER_FORMS)


@query(rf"SELECT event_id, coalesce('(' || coalesce({_FORM_SQL}) || ')', '') AS choice FROM (SELECT event_id, CASE WHEN contains(lower(x), '<think>') THEN '' ELSE lower(trim(x)) END AS y FROM (SELECT event_id, regexp_replace({_REPLY_SQL}, '(?is)<think>.*?</think>\s*', '', 'g') AS x FROM events))")
def str_answer_extract(t: Tables) -> DataFrame:
    reply = F.element_at(F.array(*[F.lit(r) for r in _REPLIES]), (F.col("event_id") % 9 + 1).cast("int"))
    return t.events.select("event_id", S.answer_choice(reply).alias("choice"))


_ERRORS = ("HTTP 404", "Not Found", "403", "Too Many Requests", "read TIMEOUT", "Connection reset", "bad SSL", "wrong Content-Type", "else")
_ERROR_SQL = "CASE event_id % 9 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(_ERRORS)) + " END"


@query(f"SELECT c AS category, count(*) AS n FROM (SELECT CASE WHEN contains(e, '404') OR contains(lower(e), 'not found') THEN '404_not_found' WHEN contains(e, '403') OR contains(lower(e), 'forbidden') THEN '403_forbidden' WHEN contains(e, '429') OR contains(lower(e), 'too many') THEN '429_rate_limited' WHEN contains(lower(e), 'timeout') THEN 'timeout' WHEN contains(lower(e), 'connection') THEN 'connection_error' WHEN contains(lower(e), 'ssl') OR contains(lower(e), 'certificate') THEN 'ssl_error' WHEN contains(lower(e), 'content-type') THEN 'invalid_content_type' ELSE 'other_error' END AS c FROM (SELECT {_ERROR_SQL} AS e FROM events)) GROUP BY c")
def str_error_category(t: Tables) -> DataFrame:
    e = F.element_at(F.array(*[F.lit(r) for r in _ERRORS]), (F.col("event_id") % 9 + 1).cast("int"))
    return reports.failures(t.events.select(e.alias("error")))


@query(r"SELECT conv_id, turn, regexp_replace(replace('u/' || role || ' ' || text, '  ', ' '), 'u/\w+', '', 'g') AS body FROM conversations")
def str_mentions(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", S.without_mentions(F.replace(F.concat(F.lit("u/"), "role", F.lit(" "), "text"), F.lit("  "), F.lit(" "))).alias("body"))


_CLEAN = r"""WITH a AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '<[^>]+>', '', 'g'), '\[([^\]]+)\]\([^\)]+\)', '\1', 'g'), 'https?://[^\s]+', '', 'g'), '\*\*([^\*]+)\*\*', '\1', 'g'), '\*([^\*]+)\*', '\1', 'g') AS t FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '(?m)^#+\s*', '', 'g'), '```[^`]*```', '', 'g'), '`([^`]+)`', '\1', 'g') AS t FROM b),
d AS (SELECT page_id, t, regexp_replace(regexp_replace(t, '(?i)^Rule\s*\d+[\.\w]*\s*[:\-\.]\s+', ''), '(?i)^General\s*[:\-\.]\s+', '') AS u FROM c)
SELECT page_id, trim(regexp_replace(CASE WHEN trim(regexp_replace(u, '\s+', ' ', 'g')) = '' THEN t ELSE u END, '\s+', ' ', 'g')) AS cleaned FROM d"""


@query(_CLEAN)
def str_clean_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", S.clean_markup(F.col("html"), entities=False).alias("cleaned"))


@query()
def str_clean_entities(t: Tables) -> DataFrame:
    return t.pages.select("page_id", S.clean_markup(F.col("html")).alias("cleaned"))


_HOST, _PATH = "lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1))", "lower(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1))"


@query(f"SELECT page_id, {_HOST} AS host, {_PATH} AS path, CASE WHEN contains({_PATH}, '.') AND split_part({_PATH}, '.', -1) IN ('jpg', 'jpeg', 'png', 'gif', 'webp', 'bmp') THEN split_part({_PATH}, '.', -1) END AS extension, FALSE AS is_video FROM pages")
def str_url_parts(t: Tables) -> DataFrame:
    u = F.col("url")
    return t.pages.select("page_id", S.url_host(u).alias("host"), S.url_path(u).alias("path"), S.url_extension(u).alias("extension"), S.is_video_url(u).alias("is_video"))


@query("SELECT event_id, replace(strftime(ts, '%a, %b %d, %Y, %I:%M%p'), ' 0', ' ') AS posted FROM events")
def dat_epoch_format(t: Tables) -> DataFrame:
    return t.events.select("event_id", S.posted_at(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("posted"))


def _submissions(t: Tables) -> DataFrame:
    k = F.col("page_id")
    thumb = lambda cond: F.when(cond, F.struct(F.struct(F.concat(F.lit("https://i.imgur.com/"), k.cast("string"), F.lit(".png?a&amp;b")).alias("thumbnail_url")).alias("oembed")))
    gallery = F.when(k % 5 == 1, F.map_from_arrays(F.array(F.lit("m|1"), F.lit("m2")), F.array(*[F.struct(F.lit(e).alias("e"), F.struct(F.concat(F.lit("https://i.redd.it/"), k.cast("string"), F.lit(x)).alias("u")).alias("s")) for e, x in (("Video", "v.mp4"), ("Image", "g.jpg"))])))
    seen = F.when(k % 5 == 3, F.struct(F.array(F.struct(F.struct(F.concat(F.lit("https://preview.redd.it/"), k.cast("string"), F.lit(".webp")).alias("url")).alias("source"))).alias("images")))
    return t.pages.select(k.alias("id"), F.when(k % 5 == 0, F.concat(F.lit("https://i.redd.it/"), k.cast("string"), F.lit(".JPG"))).otherwise(F.col("url")).alias("url"), (k % 11 == 0).alias("over_18"), F.lit(None).cast("boolean").alias("over18"), F.when(k % 13 == 0, "t3_x").alias("crosspost_parent"), F.array().cast("array<string>").alias("crosspost_parent_list"), F.lit(False).alias("is_self"), F.lit(None).cast("boolean").alias("is_video"), thumb(k % 5 == 2).alias("media"), thumb(F.lit(False)).alias("secure_media"), gallery.alias("media_metadata"), seen.alias("preview"))


_ITEM = "CASE page_id % 5 WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} WHEN 3 THEN {3} END"


@query("SELECT page_id AS submission_id, page_id % 5 = 1 AS is_video, " + _ITEM.format("'https://i.redd.it/' || page_id || '.JPG'", "'https://i.redd.it/' || page_id || 'g.jpg'", "'https://i.imgur.com/' || page_id || '.png?a&b'", "'https://preview.redd.it/' || page_id || '.webp'") + " AS url, " + _ITEM.format("'url'", "'media_metadata'", "'oembed'", "'preview'") + " AS source, " + _ITEM.format("'jpg'", "'jpg'", "'png'", "'webp'") + " AS extension_hint, page_id || '_' || " + _ITEM.format("'direct'", "'1_m2'", "'oembed'", "'preview'") + " AS file FROM pages WHERE page_id % 5 < 4")
def media_priority(t: Tables) -> DataFrame:
    return M.plan(_submissions(t)).select("submission_id", "is_video", "url", "source", "extension_hint", "file")


@query("SELECT page_id AS submission_id, CASE WHEN page_id % 11 = 0 THEN 'skipped_nsfw' WHEN page_id % 13 = 0 THEN 'skipped_crosspost' WHEN page_id % 5 = 4 THEN 'no_media' WHEN page_id % 2 = 0 THEN 'complete' ELSE 'failed' END AS status, CAST(CASE WHEN page_id % 5 < 4 AND page_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS files_downloaded FROM pages")
def media_status(t: Tables) -> DataFrame:
    subs = _submissions(t)
    got = M.plan(subs).select("submission_id", "file", (F.col("submission_id") % 2 == 0).alias("success"), F.lit("404").alias("error"))
    return _big(M.outcomes(subs, got).select("submission_id", "status", "files_downloaded"), "files_downloaded")


# Numbers and aggregates


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), g AS (SELECT u.user_id, k.event_type, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) k LEFT JOIN c ON c.user_id = u.user_id AND c.event_type = k.event_type),
s AS (SELECT user_id, n::DOUBLE / sum(n) OVER (PARTITION BY user_id) AS p, 1.0::DOUBLE / count(*) OVER (PARTITION BY user_id) AS u FROM g)
SELECT user_id, round(0.5 * sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + u)) ELSE 0 END + u * ln(2 * u / (p + u))), 9) AS jsd FROM s GROUP BY user_id""")
def mth_jsd_uniform(t: Tables) -> DataFrame:
    n = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    every = t.events.select("user_id").distinct().crossJoin(F.broadcast(t.events.select("event_type").distinct()))
    return A.divergence_by(n, every, "user_id", "event_type", "n").select("user_id", F.round("jsd", 9).alias("jsd"))


@query("SELECT CAST(l_linenumber AS BIGINT) AS rule_index, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20")
def agg_rule_distribution(t: Tables) -> DataFrame:
    counts = t.lineitem.groupBy("l_suppkey", F.col("l_linenumber").cast("bigint").alias("rule_index")).agg(F.count("*").alias("n"))
    return A.totals_by_index(counts)


@query("SELECT CAST(quantile_cont(l_extendedprice, 0.98) AS FLOAT)::DOUBLE AS ambiguous, CAST(quantile_cont(l_extendedprice, 0.992) AS FLOAT)::DOUBLE AS gold FROM lineitem")
def mth_percentile_global(t: Tables) -> DataFrame:
    return N.thresholds(t.lineitem, "l_extendedprice").select(F.col("ambiguous").cast("double").alias("ambiguous"), F.col("gold").cast("double").alias("gold"))


@query("SELECT o_custkey, list_extract(list_sort(list(o_totalprice)), CAST(floor(count(*) * 0.5) AS BIGINT) + 1) AS middle FROM orders GROUP BY o_custkey")
def mth_percentile_index(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(N.index_percentile(F.col("o_totalprice"), 0.5).alias("middle"))


@query("SELECT b.bucket, b.low, b.high, coalesce(c.n, 0) AS n FROM (VALUES (0::BIGINT, 0.0::DOUBLE, 5.0::DOUBLE), (1, 5.0, 10.0), (2, 10.0, 20.0), (3, 20.0, 1000.0), (4, 1000.0, NULL)) b(bucket, low, high) LEFT JOIN (SELECT CASE WHEN k >= 1000 THEN 4 WHEN k >= 20 THEN 3 WHEN k >= 10 THEN 2 WHEN k >= 5 THEN 1 ELSE 0 END AS bucket, count(*) AS n FROM (SELECT count(*) AS k FROM orders GROUP BY o_custkey) GROUP BY 1) c ON b.bucket = c.bucket")
def agg_histogram(t: Tables) -> DataFrame:
    return _big(A.histogram(t.orders.groupBy("o_custkey").agg(F.count("*").alias("k")), "k", [0, 5, 10, 20, 1000]), "bucket")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 3 = 0, event_id) AS k FROM events) WHERE k = 1")
def agg_dedup_prefer_clean(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_type", "event_id", "value")
    return A.prefer_clean(rows, ["user_id", "event_type"], F.col("event_id") % 3 == 0, "event_id")


@query("WITH m AS (SELECT event_id, event_id % 3 = 0 AS gone, min(event_id) OVER w AS f, min(CASE WHEN event_id % 3 <> 0 THEN event_id END) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id, event_type)) SELECT count(*) FILTER (event_id = f AND gone) AS removed, count(*) FILTER (event_id = f AND gone AND c IS NOT NULL) AS overwritten, count(*) FILTER (gone AND event_id > c) AS preserved FROM m")
def agg_dedup_counters(t: Tables) -> DataFrame:
    return A.clean_counters(t.events, ["user_id", "event_type"], F.col("event_id") % 3 == 0, "event_id")


@query("SELECT lang, source, count(DISTINCT toxic) AS members, count(*) AS pairs FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang, source), (source))")
def agg_cluster_sizes(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.col("lang").alias("split"), "source").join(t.labels, "doc_id")
    return A.cluster_sizes(rows, "source", "toxic").withColumnRenamed("split", "lang")


@query("SELECT source AS subreddit, count(*) AS judged, count(*) FILTER (quality = 1) AS passed, count(*) FILTER (quality = 1)::DOUBLE / count(*) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (source)")
def agg_pass_rates(t: Tables) -> DataFrame:
    return A.pass_rates(t.documents.select("doc_id", F.col("source").alias("subreddit")).join(t.labels, "doc_id").select("subreddit", (F.col("quality") == 1).alias("passed")))


@query("SELECT o_custkey, first(o_orderpriority ORDER BY n DESC, f) AS o_orderpriority FROM (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY ALL) GROUP BY o_custkey")
def agg_majority(t: Tables) -> DataFrame:
    return A.majority(t.orders, ["o_custkey"], "o_orderpriority", "o_orderkey")


@query("SELECT p_type AS full_text, arg_min(p_name, p_partkey) AS short_name, arg_min(p_brand, p_partkey) AS description, CAST(sum(p_size) AS BIGINT) AS total_violations, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS splits, string_agg(DISTINCT CAST(p_size AS VARCHAR), ',' ORDER BY CAST(p_size AS VARCHAR)) AS subreddit, count(DISTINCT p_size) AS num_subreddits FROM part WHERE p_size > 0 GROUP BY p_type")
def agg_rule_texts(t: Tables) -> DataFrame:
    return A.rule_texts(t.part.select(F.col("p_type").alias("full_text"), F.col("p_name").alias("short_name"), F.col("p_brand").alias("description"), F.col("p_size").cast("bigint").alias("violations"), F.col("p_brand").alias("split"), F.col("p_size").cast("string").alias("subreddit"), F.col("p_partkey").alias("seq")))


@query("SELECT s.subreddit, total, coalesce(m, 0) AS matched, coalesce(a, 0) AS ambiguous, 100.0 * coalesce(m, 0) / total AS matched_percent FROM (SELECT source AS subreddit, count(*) AS total, count(*) FILTER (doc_id % 3 = 0) AS m, count(*) FILTER (doc_id % 5 = 0) AS a FROM documents GROUP BY 1) s")
def agg_match_stats(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.col("source").alias("subreddit"))
    return A.match_stats(d, d.where("doc_id % 3 = 0"), d.where("doc_id % 5 = 0"))


@query("SELECT CASE WHEN label = 0 THEN 'other' ELSE 'l' || label END AS label, count(*) AS n FROM embeddings GROUP BY 1")
def agg_label_distribution(t: Tables) -> DataFrame:
    return A.label_distribution(t.embeddings.select(F.when(F.col("label") == 0, -1).otherwise(F.col("label")).alias("cluster_id"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("cluster_label")))


@query("SELECT label AS cluster_id, median(embedding[1]::DOUBLE) AS x, median(embedding[2]::DOUBLE) AS y, arg_min('v' || vec_id, vec_id) AS label FROM embeddings GROUP BY label")
def agg_centroids(t: Tables) -> DataFrame:
    return A.centroids(t.embeddings.select(F.col("label").alias("cluster_id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("cluster_label"), F.col("vec_id").alias("seq")))


# Joins and sets


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def jon_semi_targets(t: Tables) -> DataFrame:
    wanted = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return J.of_targets(t.orders.select("o_orderkey", "o_custkey"), wanted, "o_custkey").select("o_orderkey", "o_custkey")


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jon_anti_manifest(t: Tables) -> DataFrame:
    return J.missing(t.documents, t.labels, "doc_id")


@query("SELECT l_orderkey, len(list(l_partkey)) AS n, string_agg(coalesce(p_name, 'missing'), '|' ORDER BY l_linenumber, l_partkey) AS names FROM lineitem LEFT JOIN (SELECT p_partkey, p_name FROM part WHERE p_size <= 25) ON p_partkey = l_partkey GROUP BY l_orderkey")
def jon_hydrate_ids(t: Tables) -> DataFrame:
    threads = t.lineitem.groupBy(F.col("l_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("ids")).withColumn("subreddit", F.lit("s"))
    parts = t.part.where("p_size <= 25").select(F.lit("s").alias("subreddit"), F.col("p_partkey").alias("id"), "p_name", F.lit(0).alias("seq"))
    filled = J.hydrated(threads, parts, "l_orderkey", "ids")
    return filled.select("l_orderkey", F.size("thread").cast("bigint").alias("n"), F.array_join(F.transform("thread", lambda c: F.coalesce(c["p_name"], c["hydration_status"])), "|").alias("names"))


@query("SELECT s_suppkey, n_name AS cluster_label FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def jon_cluster_strict(t: Tables) -> DataFrame:
    n = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("cluster_label"))
    return J.strict(t.supplier.select("s_suppkey", "s_nationkey"), n, "s_nationkey").select("s_suppkey", "cluster_label")


@query("SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 7 ELSE 1 END::BIGINT AS subreddit_cluster_id, CASE WHEN lang = 'de' THEN 'new' ELSE 'old' END AS rule_cluster_label FROM documents")
def jon_relabel_left(t: Tables) -> DataFrame:
    results = t.documents.select("doc_id", F.col("source").alias("subreddit"), F.col("lang").alias("rule"), F.lit(1).cast("bigint").alias("subreddit_cluster_id"), F.lit("old").alias("subreddit_cluster_label"), F.lit(2).cast("bigint").alias("rule_cluster_id"), F.lit("old").alias("rule_cluster_label"))
    own = t.documents.select(F.col("source").alias("subreddit")).where("subreddit IN ('src1', 'src2')").distinct().select("subreddit", F.lit(7).cast("bigint").alias("cluster_id"), F.lit("c").alias("cluster_label"))
    rules = t.documents.where("lang = 'de'").select(F.col("lang").alias("rule"), F.lit(9).cast("bigint").alias("cluster_id"), F.lit("new").alias("cluster_label"), F.col("doc_id").alias("seq"))
    return J.relabelled(results, own, rules).select("doc_id", "subreddit_cluster_id", "rule_cluster_label")


@query("SELECT n_nationkey AS k, count(*) AS n FROM nation CROSS JOIN (SELECT DISTINCT r_regionkey FROM region) r WHERE n_regionkey = r_regionkey GROUP BY 1")
def jon_pairs_within(t: Tables) -> DataFrame:
    n = t.nation.select("n_nationkey", F.col("n_regionkey").alias("subreddit"))
    r = t.region.select(F.col("r_regionkey").alias("subreddit"))
    return J.pairs_within(n, r).groupBy(F.col("n_nationkey").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT doc_id AS k FROM documents) a FULL JOIN (SELECT DISTINCT doc_id AS k FROM labels) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def set_symmetric_difference(t: Tables) -> DataFrame:
    return J.difference(t.documents.select(F.col("doc_id").alias("k")), t.labels.select(F.col("doc_id").alias("k")), "k")


@query("SELECT c_name AS name, c_name || '_' || k || '.zst' AS basename FROM customer CROSS JOIN (VALUES ('comments'), ('submissions')) v(k)")
def set_needed_files(t: Tables) -> DataFrame:
    return tables.needed_files(t.customer.select(F.col("c_name").alias("name")))


# Ranking


@query("SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN row_number() OVER (PARTITION BY s_acctbal > 0 ORDER BY s_acctbal DESC NULLS LAST, s_suppkey) ELSE 999999 END AS rank FROM supplier")
def win_rank_filtered(t: Tables) -> DataFrame:
    return A.ranked(t.supplier.select("s_suppkey", "s_acctbal"), "s_acctbal", "s_suppkey", F.col("s_acctbal") > 0).select("s_suppkey", "rank")


@query("SELECT o_custkey, n, row_number() OVER (ORDER BY n DESC, o_custkey) AS rank FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def win_rank_communities(t: Tables) -> DataFrame:
    return A.ranked(A.per_key(t.orders, "o_custkey"), "n", "o_custkey")


@query("SELECT o_custkey, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM (SELECT * FROM orders) GROUP BY o_custkey")
def win_argmax(t: Tables) -> DataFrame:
    return A.best_by(t.orders, ["o_custkey"], "o_orderkey", "o_totalprice", "o_orderkey")


@query("SELECT o_custkey, o_orderkey, round(x, 6) AS x, round(p, 6) AS previous, round(x - p, 6) AS delta FROM (SELECT *, last_value(nullif(x, 0) IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 0.0::DOUBLE ELSE o_totalprice END AS x FROM orders))")
def win_prev_delta(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice")).alias("x"))
    return A.with_previous(rows, ["o_custkey"], "o_orderkey", "x").select("o_custkey", "o_orderkey", *[F.round(c, 6).alias(c) for c in ("x", "previous", "delta")])


@query("SELECT CAST(old AS BIGINT) AS old, CASE WHEN old = -1 THEN -1 ELSE row_number() OVER (PARTITION BY old = -1 ORDER BY old) END AS new FROM (SELECT DISTINCT CASE WHEN label = 0 THEN -1 ELSE label * 3 END AS old FROM embeddings)")
def win_dense_renumber(t: Tables) -> DataFrame:
    return _big(A.renumbered(t.embeddings.select(F.when(F.col("label") == 0, -1).otherwise(F.col("label") * 3).alias("cluster_id"))), "old")


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def top_k_bucket(t: Tables) -> DataFrame:
    return A.top_within(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


# Similarity and retrieval

_DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_SIM = f"SELECT a.label AS subreddit, a.vec_id AS comment_id, b.vec_id AS rule_index, CAST({_DOT} AS FLOAT) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id"


def _sides(t: Tables, asked: str = "TRUE") -> tuple[DataFrame, DataFrame]:
    """The vectors asked for as comments, and all as rules of their buckets."""
    rules = t.embeddings.select(F.col("label").alias("subreddit"), F.col("vec_id").alias("rule_index"), "embedding")
    return rules.where(asked).withColumnRenamed("rule_index", "comment_id"), rules


def _scores(t: Tables) -> DataFrame:
    """Every twentieth vector as a comment against all others of its bucket as rules."""
    return similarity.similarities(*_sides(t, "rule_index % 20 = 0")).where("comment_id <> rule_index")


@query(f"SELECT CAST(subreddit AS BIGINT) AS subreddit, comment_id, rule_index, round(score::DOUBLE, 5) AS score FROM ({_SIM})")
def sim_matrix(t: Tables) -> DataFrame:
    return _big(_scores(t), "subreddit").withColumn("score", F.round(F.col("score").cast("double"), 5))


@query(f"""WITH s AS ({_SIM}), c AS (SELECT CAST(quantile_cont(score::DOUBLE, 0.98) AS FLOAT) AS amb, CAST(quantile_cont(score::DOUBLE, 0.992) AS FLOAT) AS gold FROM s),
b AS (SELECT subreddit, comment_id, arg_min(rule_index, (-score, rule_index)) AS rule_index, max(score) AS score, count(*) FILTER (score > (SELECT amb FROM c)) AS o FROM s GROUP BY ALL)
SELECT CAST(subreddit AS BIGINT) AS subreddit, comment_id, rule_index FROM b WHERE o <= 1 AND score >= (SELECT gold FROM c)""")
def sim_match_threshold(t: Tables) -> DataFrame:
    return _big(similarity.matches(*_sides(t, "rule_index % 20 = 0"), apart=True).select("subreddit", "comment_id", "rule_index"), "subreddit")


def _all_scores(t: Tables) -> DataFrame:
    """Every vector as a comment against every vector as a rule of its bucket, itself left out."""
    return similarity.similarities(*_sides(t)).where("comment_id <> rule_index")


@query()
def sim_matrix_all(t: Tables) -> DataFrame:
    return _big(_all_scores(t), "subreddit").withColumn("score", F.round(F.col("score").cast("double"), 5))


@query()
def sim_match_threshold_all(t: Tables) -> DataFrame:
    return _big(similarity.matches(*_sides(t), apart=True).select("subreddit", "comment_id", "rule_index"), "subreddit")


_NEAR = f"""SELECT query_id, candidate_id, score, rank, thread_type, rule FROM (SELECT a.vec_id AS query_id, b.vec_id AS candidate_id, {_DOT} AS score, CASE WHEN b.vec_id % 3 = 0 THEN 'violating' ELSE 'compliant' END AS thread_type, CAST(b.label AS BIGINT) AS rule,
row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_DOT}, 12) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 5 = 0)"""


def _near(t: Tables, k: int) -> DataFrame:
    e = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    return similarity.nearest(e.where("id % 5 = 0"), e, k)


@query(f"SELECT query_id, candidate_id, round(score, 6) AS score, rank FROM ({_NEAR}) WHERE rank <= 5")
def rag_top(t: Tables) -> DataFrame:
    return _near(t, 5).withColumn("score", F.round("score", 6))


@query(f"SELECT query_id, candidate_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, candidate_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS candidate_id, {_DOT} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.label = b.label WHERE a.vec_id % 5 = 0)) WHERE rank <= 3")
def rag_top_in_bucket(t: Tables) -> DataFrame:
    e = t.embeddings.select(F.col("vec_id").alias("id"), "embedding", "label")
    return similarity.nearest(e.where("id % 5 = 0"), e, 3, by="label").withColumn("score", F.round("score", 6))


@query(f"""WITH n AS ({_NEAR}), o AS (SELECT *, row_number() OVER (PARTITION BY query_id, thread_type ORDER BY rank) AS r FROM n),
x AS (SELECT *, CASE WHEN thread_type = 'violating' AND r <= 3 THEN 0 WHEN thread_type = 'compliant' AND r <= 2 THEN 1 ELSE 2 END AS tier FROM o)
SELECT query_id, candidate_id, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, rank) AS position FROM x) WHERE position <= 5""")
def rag_mixed(t: Tables) -> DataFrame:
    e = t.embeddings.select(F.col("vec_id").alias("id"), "embedding", F.when(F.col("vec_id") % 3 == 0, "violating").otherwise("compliant").alias("thread_type"))
    q = e.where("id % 5 = 0").drop("thread_type")
    near = None
    for kind in ("violating", "compliant"):
        own = similarity.nearest(q, e.where(F.col("thread_type") == kind), 5).withColumn("thread_type", F.lit(kind))
        near = own if near is None else near.unionByName(own)
    near = A.ranked_within(near.drop("rank"), ["query_id"], [F.desc(F.round("score", 12)), F.asc("candidate_id")])
    return similarity.mixed(near, 5).select("query_id", "candidate_id", "position")


_VOTE = f"SELECT query_id, rule, count(*) AS votes, round(sum(score), 9) AS s, min(rank) AS f FROM ({_NEAR}) WHERE rank <= 7 GROUP BY ALL"
_VOTED = f"SELECT query_id, arg_min(rule, (-votes, -s, f)) AS predicted FROM ({_VOTE}) GROUP BY query_id"


def _votes(t: Tables) -> DataFrame:
    e = t.embeddings.select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("bigint").alias("rule"))
    return evaluate.vote_baseline(e.where("id % 5 = 0"), e, 7)


@query(_VOTED)
def rag_vote(t: Tables) -> DataFrame:
    return _votes(t).select("query_id", "predicted")


@query(f"""WITH v AS (SELECT query_id, predicted, CAST(label AS BIGINT) AS label, CASE WHEN predicted = label THEN 1 ELSE 0 END AS hit FROM ({_VOTED}) JOIN embeddings ON vec_id = query_id)
SELECT CASE WHEN grouping(label) = 0 THEN 'label' ELSE 'overall' END AS grouping, CASE WHEN grouping(label) = 0 THEN CAST(label AS VARCHAR) END AS value, count(*) AS n, round(2 * sum(hit)::DOUBLE / (2 * count(*)), 9) AS accuracy, round(sum(hit)::DOUBLE / count(*), 9) AS violating_accuracy, round(sum(hit)::DOUBLE / count(*), 9) AS compliant_accuracy FROM v GROUP BY GROUPING SETS ((label), ())""")
def rag_vote_accuracy(t: Tables) -> DataFrame:
    truth = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("label").cast("bigint").alias("label"))
    hit = (F.col("predicted") == F.col("label")).cast("int")
    rows = _votes(t).join(truth, "query_id").select("label", hit.alias("violating"), hit.alias("compliant"))
    return A.accuracy(rows, ("label",)).select("grouping", "value", "n", *[F.round(c, 9).alias(c) for c in ("accuracy", "violating_accuracy", "compliant_accuracy")])


# Trees: a hundred events make a submission, a node's parent has half its number

_EDGE = "SELECT event_id // 100 AS s, event_id AS c, CASE WHEN event_id % 100 > 0 THEN (event_id // 100) * 100 + (event_id % 100 - 1) // 2 END AS p, event_id % 100 = 0 AS r FROM events"
_DEPTH = f"WITH RECURSIVE e AS ({_EDGE}), d(s, c, p, depth, path) AS (SELECT s, c, p, 0, [c] FROM e WHERE r UNION ALL SELECT e.s, e.c, e.p, d.depth + 1, list_append(d.path, e.c) FROM e JOIN d ON e.s = d.s AND e.p = d.c)"


def _comments(t: Tables) -> DataFrame:
    s, k = F.floor(F.col("event_id") / 100), F.col("event_id") % 100
    parent = F.when(k == 0, F.concat(F.lit("t3_"), s.cast("string"))).otherwise(F.concat(F.lit("t1_"), (s * 100 + F.floor((k - 1) / 2)).cast("string")))
    return t.events.select(F.col("event_id").cast("string").alias("id"), s.cast("string").alias("submission_id"), parent.alias("parent_id"), F.when(F.col("event_type") == "error", "[removed]").otherwise(F.col("event_type")).alias("body"), F.concat(F.lit("a"), F.col("user_id").cast("string")).alias("author"), F.lit(None).cast("string").alias("distinguished"), F.lit(None).cast("string").alias("media"), F.lit(None).cast("string").alias("media_metadata"), F.lit("false").alias("edited"), F.col("value").cast("bigint").alias("score"))


def _tree(t: Tables) -> DataFrame:
    return trees.depths(trees.edges(_comments(t)))


@query(f"{_DEPTH} SELECT CAST(s AS VARCHAR) AS submission_id, CAST(c AS VARCHAR) AS comment_id, CAST(depth AS BIGINT) AS depth FROM d")
def tree_depth(t: Tables) -> DataFrame:
    return _big(_tree(t).select("submission_id", "comment_id", "depth"), "depth")


@query(f"{_DEPTH} SELECT CAST(s AS VARCHAR) AS submission_id, CAST(c AS VARCHAR) AS comment_id, array_to_string(path, '>') AS path, CAST(len(path) AS BIGINT) AS length FROM d")
def tree_thread_path(t: Tables) -> DataFrame:
    c = _comments(t)
    rows = trees.threads(c, _tree(t))
    return rows.select("submission_id", "comment_id", F.array_join(F.transform("thread", lambda x: x["id"]), ">").alias("path"), F.col("length").cast("bigint").alias("length"))


def _violating(t: Tables, tree: DataFrame) -> DataFrame:
    """Sign-ups are the comments that moderators answered."""
    role = t.events.where("event_type = 'signup'").select(F.col("event_id").cast("string").alias("comment_id"))
    return tree.join(role, "comment_id", "left_semi").withColumn("mod_comment_id", F.concat(F.lit("m"), "comment_id"))


_CAND = f"{_DEPTH}, v AS (SELECT d.* FROM d JOIN events ON event_id = c WHERE event_type = 'signup'), x AS (SELECT v.s, v.c AS v, v.path AS vp, a.c AS a, a.path AS ap FROM v JOIN d a ON a.s = v.s AND a.c <> v.c AND (a.depth = v.depth OR (v.depth >= 2 AND a.depth = v.depth - 1 AND a.c <> v.p)))"


@query(f"{_CAND} SELECT CAST(v AS VARCHAR) AS violating_id, count(*) AS n FROM x GROUP BY 1")
def tree_candidates(t: Tables) -> DataFrame:
    tree = _tree(t)
    return trees.candidates(_violating(t, tree), tree).groupBy("violating_id").agg(F.count("*").alias("n"))


@query(f"""{_CAND}, o AS (SELECT x.*, len(list_filter(range(1, 1 + least(len(vp), len(ap))), lambda i: vp[i] = ap[i])) AS common, CAST(e.value AS BIGINT) AS _s FROM x JOIN events e ON e.event_id = x.a WHERE NOT list_has_any(ap, (SELECT list(event_id) FROM events WHERE event_type = 'error')))
SELECT CAST(v AS VARCHAR) AS violating_id, CAST(a AS VARCHAR) AS alt_id, CAST(common AS BIGINT) AS common_ancestors FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY common DESC, len(ap) DESC, _s, CAST(a AS VARCHAR)) AS k FROM o) WHERE k = 1""")
def tree_best_alternative(t: Tables) -> DataFrame:
    tree = _tree(t)
    comments = _comments(t).withColumn("score", F.lit(None).cast("bigint")).drop("score").join(t.events.select(F.col("event_id").cast("string").alias("id"), F.round("value").cast("bigint").alias("score")), "id")
    # Staged, as both sides of a pair read it.
    thread = staged(trees.threads(comments, tree), "threads")
    ranked = trees.ranked_candidates(_violating(t, tree), tree, thread)
    return _big(ranked.where("rank = 1").select("violating_id", "alt_id", "common_ancestors"), "common_ancestors")


@query()
def tree_greedy_pairs(t: Tables) -> DataFrame:
    matches = _violating(t, _tree(t)).select("mod_comment_id", "submission_id", F.col("comment_id").alias("violating_comment_id"))
    return trees.pairs(_comments(t), matches).select("mod_comment_id", "submission_id", "violating_comment_id", "compliant_comment_id", "status", "common_ancestors")


# Splits, options and prompts

_SIZES = "CASE WHEN n < 10 THEN 1 ELSE greatest(1, round_even(n * 0.1, 0)) END::BIGINT AS test, CASE WHEN n < 3 THEN 0 WHEN n < 10 THEN 1 ELSE greatest(1, round_even(n * 0.1, 0)) END::BIGINT AS val"


@query(f"SELECT o_custkey, n, {_SIZES} FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def spl_adaptive_sizes(t: Tables) -> DataFrame:
    test, val = splits.split_sizes(F.col("n"))
    return A.per_key(t.orders, "o_custkey").select("o_custkey", "n", test.cast("bigint").alias("test"), val.cast("bigint").alias("val"))


@query(f"SELECT o_orderkey, o_custkey, CASE WHEN k <= test THEN 'test' WHEN k <= test + val THEN 'val' ELSE 'train' END AS split FROM (SELECT *, {_SIZES} FROM (SELECT o_orderkey, o_custkey, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY sha256(o_custkey || ':' || o_orderkey), o_orderkey) AS k FROM orders))")
def spl_assign_sha2(t: Tables) -> DataFrame:
    return splits.assigned(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey").select("o_orderkey", "o_custkey", "split")


@query()
def spl_assign_seeded(t: Tables) -> DataFrame:
    return splits.assigned(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", rng="mt19937").select("o_orderkey", "o_custkey", "split")


@query()
def smp_stratified(t: Tables) -> DataFrame:
    pool = t.documents.select(F.col("doc_id").alias("key"), F.col("source").alias("subreddit"), F.when(F.col("lang") == "es", "Other").otherwise(F.col("lang")).alias("rule_cluster_label"))
    return splits.stratified(pool, 12, 42)


def _conversations(t: Tables) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("author"), F.col("text").alias("body"))))
    return t.conversations.groupBy("conv_id").agg(F.transform(turns, lambda x, i: F.struct(i.alias("level"), x["turn"].cast("string").alias("id"), x["author"].alias("author"), x["body"].alias("body"))).alias("thread"))


@query("SELECT conv_id, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS ids, count(*) AS n, repeat('[hydrate]', count(*)::INT) AS texts FROM conversations GROUP BY conv_id")
def prj_dehydrate(t: Tables) -> DataFrame:
    rows = J.dehydrated(_conversations(t), ("thread",))
    return rows.select("conv_id", F.array_join("thread_ids", ",").alias("ids"), F.size("thread").cast("bigint").alias("n"), F.array_join("thread", "").alias("texts"))


@query("WITH o AS (SELECT p_partkey, unnest([p_name, p_brand, p_type, 'No rules broken']) AS o, unnest([0, 1, 2, 3]) AS i FROM part) SELECT p_partkey, string_agg('(' || chr(96 + k::INT) || ') ' || o, '|' ORDER BY k) AS options FROM (SELECT p_partkey, o, row_number() OVER (PARTITION BY p_partkey ORDER BY sha256(p_partkey || '|x|' || i || '|' || o), o) AS k FROM o) GROUP BY p_partkey")
def prj_options(t: Tables) -> DataFrame:
    options = splits.shuffled_options(F.array("p_name", "p_brand", "p_type"), F.col("p_partkey").cast("string"), "x", rng="sha2")
    return t.part.select("p_partkey", F.array_join(F.transform(options, lambda o: F.concat_ws(" ", o["label"], o["rule"])), "|").alias("options"))


@query("WITH f AS (SELECT conv_id, role, min(turn) AS f FROM conversations GROUP BY ALL), k AS (SELECT conv_id, role, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS u, f FROM f UNION SELECT DISTINCT conv_id, 'user', 0, -1 FROM conversations), g AS (SELECT conv_id, role, min(u) AS u, min(f) AS f FROM k GROUP BY ALL) SELECT conv_id, string_agg(role, ',' ORDER BY u, f) AS users FROM g GROUP BY conv_id")
def prj_user_map(t: Tables) -> DataFrame:
    return _conversations(t).select("conv_id", F.array_join(R.user_names(F.lit("user"), F.col("thread")), ",").alias("users"))


@query()
def prj_thread_prompt(t: Tables) -> DataFrame:
    names = R.user_names(F.lit("user"), F.col("thread"))
    return _conversations(t).select("conv_id", R.prompt(F.lit("Thread"), R.thread_block(F.col("thread"), names)).alias("prompt"))


# Evaluation


def _results(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang", "source").join(t.labels.select("doc_id", F.col("quality").cast("bigint").alias("violating"), F.col("toxic").cast("bigint").alias("compliant")), "doc_id")


_ACC = "count(*) AS n, round((sum(quality) + sum(toxic))::DOUBLE / (2 * count(*)), 9) AS accuracy, round(sum(quality)::DOUBLE / count(*), 9) AS violating_accuracy, round(sum(toxic)::DOUBLE / count(*), 9) AS compliant_accuracy"


@query(f"SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'overall' END AS grouping, coalesce(lang, source) AS value, {_ACC} FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (source), ())")
def eval_accuracy_sets(t: Tables) -> DataFrame:
    return A.accuracy(_results(t), ("lang", "source")).select("grouping", "value", "n", *[F.round(c, 9).alias(c) for c in ("accuracy", "violating_accuracy", "compliant_accuracy")])


@query()
def bst_ci(t: Tables) -> DataFrame:
    return evaluate.evaluated(_results(t), ("lang", "source"))


@query()
def bst_exact_ci(t: Tables) -> DataFrame:
    """The intervals of one sequential generator's resamples, in the order of documents."""
    return resamples.intervals(_results(t), "doc_id", ("lang", "source"))


_ANN = "SELECT event_id // 3 AS q, event_id AS a, CASE WHEN event_id % 7 = 0 THEN 'x' ELSE event_type END AS s FROM events"


@query(f"WITH a AS ({_ANN}), v AS (SELECT q, s, count(DISTINCT a) AS n FROM a GROUP BY ALL HAVING count(DISTINCT a) >= 2), m AS (SELECT q, min(s) AS s FROM v GROUP BY q) SELECT i.q AS question_index, coalesce(m.s, CASE WHEN i.q % 2 = 0 THEN 'view' END) AS truth, CASE WHEN m.s IS NOT NULL THEN 'majority' WHEN i.q % 2 = 0 THEN 'adjudicated' ELSE 'none' END AS truth_source, coalesce(coalesce(m.s, CASE WHEN i.q % 2 = 0 THEN 'view' END) = 'view', FALSE) AS correct FROM (SELECT DISTINCT q FROM a) i LEFT JOIN m ON m.q = i.q")
def human_vote_truth(t: Tables) -> DataFrame:
    q = F.floor(F.col("event_id") / 3).alias("question_index")
    notes = t.events.select(q, F.col("event_id").alias("annotator_id"), F.array(F.when(F.col("event_id") % 7 == 0, "x").otherwise(F.col("event_type"))).alias("selected"))
    items = notes.select("question_index").distinct().select("question_index", F.lit("view").alias("predicted_answer"), F.when(F.col("question_index") % 2 == 0, F.array(F.lit("view"))).otherwise(F.array().cast("array<string>")).alias("adjudicated_answers"))
    return A.ground_truth(items, notes).select("question_index", F.get("truth", F.lit(0)).alias("truth"), "truth_source", "correct")


@query("SELECT o_custkey AS model, context, accuracy, previous, delta, abs(max(accuracy) OVER (PARTITION BY context) - accuracy) <= 1e-4 AS best FROM (SELECT *, round(p, 6) AS previous, round(accuracy - p, 6) AS delta FROM (SELECT o_custkey, context, accuracy, last_value(nullif(accuracy, 0) IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY context ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM (SELECT o_custkey, o_orderpriority AS context, count(*)::DOUBLE AS accuracy FROM orders GROUP BY ALL)))")
def rep_performance_table(t: Tables) -> DataFrame:
    rows = t.orders.groupBy(F.col("o_custkey").alias("model"), F.col("o_orderpriority").alias("context")).agg(F.count("*").cast("double").alias("accuracy")).withColumn("position", F.col("context"))
    return reports.performance_table(rows).select("model", "context", "accuracy", F.round("previous", 6).alias("previous"), F.round("delta", 6).alias("delta"), "best")


@query("SELECT count(*) AS n, round(corr(rx, ry), 9) AS rho, round(regr_slope(y, x), 9) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM (SELECT x, y, avg(px) OVER (PARTITION BY x) AS rx, avg(py) OVER (PARTITION BY y) AS ry FROM (SELECT p_size::DOUBLE AS x, p_retailprice AS y, row_number() OVER (ORDER BY p_size) AS px, row_number() OVER (ORDER BY p_retailprice) AS py FROM part))")
def mth_rank_correlation(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return N.rank_correlation(rows, "x", "y").select("n", F.round("rho", 9).alias("rho"), F.round("slope", 9).alias("slope"), F.round("intercept", 6).alias("intercept"))


# Clusters and validation


@query("WITH o AS (SELECT DISTINCT CAST(label AS BIGINT) AS old, CASE WHEN label IN (2, 5, 7) THEN 'same' WHEN label = 3 THEN 'own' ELSE 'L' || label END AS l, label IN (2, 3, 5, 7) AS given FROM embeddings), m AS (SELECT old, l, CASE WHEN given THEN min(old) OVER (PARTITION BY l) ELSE old END AS lead FROM o) SELECT old AS old_id, dense_rank() OVER (ORDER BY lead) AS new_id, l AS label FROM m")
def clu_merge_labels(t: Tables) -> DataFrame:
    own = t.embeddings.select(F.col("label").cast("bigint").alias("cluster_id"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("cluster_label"))
    lines = t.spark.createDataFrame([("# ids", 0), ("2: same", 1), ("3: first", 2), ("5: same", 3), ("7: same", 4), ("3: own", 5), ("bad line", 6)], "value string, seq long")
    return C.merged(own, S.label_overrides(lines))


@query()
def clu_kmeans_quality(t: Tables) -> DataFrame:
    found = C.kmeans(t.embeddings.select("vec_id", "embedding", "label"), 10)
    return found.groupBy("cluster_id", "label").agg(F.count("*").alias("n"))


@query()
def clu_grid_search(t: Tables) -> DataFrame:
    return C.searched(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), C.grid(t.spark))


@query()
def clu_grid_tables(t: Tables) -> DataFrame:
    """The grid for any number of points: tables throughout, judged by relative validity."""
    return neighbours.explored(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), C.grid(t.spark))


@query()
def clu_layout(t: Tables) -> DataFrame:
    """All vectors in two dimensions."""
    points = t.embeddings.select(F.lit(0).alias("run"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return layout.layout(points).select("id", F.col("y")[0].alias("x"), F.col("y")[1].alias("y"))


def _plane(t: Tables) -> DataFrame:
    """Every labelled vector by its first two components, turned by 30 degrees."""
    e = t.embeddings.where("label IS NOT NULL AND embedding IS NOT NULL")
    x, y = geometry.rotated(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double"), 30)
    return e.select("vec_id", F.col("label").cast("bigint").alias("cluster_id"), x.alias("x"), y.alias("y"))


@query("""SELECT vec_id, round(sqrt(3) / 2 * embedding[1]::DOUBLE - 0.5 * embedding[2]::DOUBLE, 6) AS x, round(0.5 * embedding[1]::DOUBLE + sqrt(3) / 2 * embedding[2]::DOUBLE, 6) AS y
FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL""")
def mth_rotated(t: Tables) -> DataFrame:
    return _plane(t).select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query()
def clu_coloured(t: Tables) -> DataFrame:
    """CLU6, MTH9: a colour for the hull of each label, none that an overlapping one has, with its centre."""
    hulls = staged(geometry.hulls(_plane(t)), "label-hulls")
    centres = hulls.select("cluster_id", geometry.centroid(F.col("polygon")).alias("c")).select("cluster_id", F.col("c.x").alias("x"), F.col("c.y").alias("y"))
    return geometry.coloured(centres, geometry.overlaps(hulls)).join(centres, "cluster_id").select("cluster_id", F.col("colour").cast("bigint").alias("colour"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query()
def clu_neighbour_graph(t: Tables) -> DataFrame:
    """The 15 nearest of every vector, by descent."""
    points = t.embeddings.select(F.lit(0).alias("run"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return neighbours.neighbour_graph(points).select("id", "neighbour", F.round("distance", 6).alias("distance"))


@query("SELECT '1' AS stage, 'WARNING' AS severity, o_custkey || ': ' || count(*) || ' of 12' AS message FROM orders GROUP BY o_custkey HAVING count(*) < 12")
def val_totals(t: Tables) -> DataFrame:
    have = A.per_key(t.orders, "o_custkey")
    return V.under_collected(have, have.select("o_custkey", F.lit(12).alias("n")), "o_custkey", "n", "1")


@query("SELECT '9a' AS stage, 'CRITICAL' AS severity, a || ' rows, ' || b || ' metadata rows' AS message FROM (SELECT (SELECT count(*) FROM documents) AS a, (SELECT count(*) FROM labels) AS b) WHERE a <> b")
def val_rowcounts(t: Tables) -> DataFrame:
    return V.same_rows(t.documents, t.labels, "9a")


@query("SELECT 'CRITICAL' AS severity, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) HAVING count(*) > 0 UNION ALL SELECT 'WARNING', count(*) FROM labels WHERE quality = 1 AND doc_id NOT IN (SELECT doc_id FROM documents) HAVING count(*) > 0")
def val_both_ways(t: Tables) -> DataFrame:
    found = V.both_ways(t.documents, t.labels.where("quality = 1"), "doc_id", "5", "no labels", "no document")
    return A.per_key(found, "severity")
