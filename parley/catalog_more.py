"""More queries on the standard tables with equivalent SQL: sources, filters, texts, joins, aggregates, splits, reports, validation.

They are registered in the same dictionaries as catalog's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import _DEPTH, Tables, _comments, query
from .functions import numbers as N
from .functions import text as S
from .operators import aggregates as A
from .operators import clusters
from .operators import filters as P
from .operators import joins as J
from .operators import media as M
from .operators import models
from .operators import prompts as R
from .operators import reports, similarity, splits, trees
from .operators import validation as V
from .plans import construct, evaluate
from .sources import archives, calls, sinks, tables
from .staging import staged_path


def _pick(key: Column, *values: str | None) -> Column:
    """One of a few values, by the key's remainder."""
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), F.pmod(key, F.lit(len(values))).cast("int"))


def _pick_sql(key: str, *values: str | None) -> str:
    shown = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{shown}])[1 + {key} % {len(values)}]"


# Sources and sinks


@query("SELECT event_id, event_type, user_id FROM events WHERE event_type IS NOT NULL")
def snk_zst_by_path(t: Tables) -> DataFrame:
    """SRC1, SNK2: one scan to a folder of compressed lines for each event type, read back by their paths; archives of many frames are many tasks."""
    folder = staged_path(t.spark, "zst-by-path")
    rows = t.events.select("event_id", "user_id", F.col("event_type").alias("place"))
    sinks.write_zst_by_path(rows, folder, "place")
    kinds = [r[0] for r in rows.select("place").where("place IS NOT NULL").distinct().collect()]  # a handful of types
    lines = archives.read_archives(t.spark, [f"{folder}/{k}" for k in sorted(kinds)], split_bytes=1 << 16)
    found = tables.parse_json(lines, "event_id bigint, user_id bigint")
    return found.select("event_id", F.element_at(F.split("path", "/"), -2).alias("event_type"), "user_id")


@query("SELECT event_id, user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def src_zst_lines(t: Tables) -> DataFrame:
    """SRC1, SNK1: written as compressed lines, in two appends, and scanned again."""
    path = staged_path(t.spark, "zst-lines")
    rows = t.events.select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    for odd in (0, 1):
        sinks.write_zst_lines(rows.where(F.col("user_id") % 2 == odd), path)
    found = tables.parse_json(archives.read_archives(t.spark, path), "event_id bigint, user_id bigint, event_type string, k bigint")
    return found.where("NOT malformed").select("event_id", "user_id", "event_type", "k")


_LINES = ('{"id": 1, "v": "x"}', '{"id": 2', "", '{"id": null, "v": "y"}', "not json", '{"v": "z"}')


@query(f"SELECT event_id, CASE event_id % 6 WHEN 0 THEN 1 ELSE -1 END::BIGINT AS id, CASE event_id % 6 WHEN 0 THEN 'x' WHEN 3 THEN 'y' WHEN 5 THEN 'z' END AS v, event_id % 6 IN (1, 4) AS malformed FROM events WHERE trim({_pick_sql('event_id', *_LINES)}) <> ''")
def src_malformed_lines(t: Tables) -> DataFrame:
    """FLT23, JSN1."""
    lines = t.events.select(_pick(F.col("event_id"), *_LINES).alias("value"), F.lit("").alias("path"), F.col("event_id").alias("seq")).where(F.trim("value") != "")
    rows = tables.parse_json(lines, "id bigint, v string")
    return rows.select(F.col("seq").alias("event_id"), F.coalesce(F.when(~F.col("malformed"), F.col("id")), F.lit(-1)).alias("id"), F.when(~F.col("malformed"), F.col("v")).alias("v"), "malformed")


@query("SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size, CASE p_partkey % 3 WHEN 0 THEN 'None' WHEN 1 THEN 'NA' ELSE 'a \"b\"' END AS rule FROM part")
def src_tsv(t: Tables) -> DataFrame:
    """SRC11, SNK7: through a TSV, where `None`, `NA` and quotes stay text."""
    path = staged_path(t.spark, "tsv")
    sinks.write_tsv(t.part.select("p_partkey", "p_name", "p_size", _pick(F.col("p_partkey"), "None", "NA", 'a "b"').alias("rule")), path)
    return tables.read_tsv(t.spark, path, "p_partkey bigint, p_size bigint", ("rule",)).select("p_partkey", "p_name", "p_size", "rule")


@query("SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE lower(c_mktsegment) = 'building' GROUP BY 1")
def src_community_lookup(t: Tables) -> DataFrame:
    """SRC8, SNK2: one bucket of a table partitioned by community."""
    rows = t.customer.withColumn("bucket", S.name_bucket(F.col("c_mktsegment")))
    path = staged_path(t.spark, "communities")
    sinks.write_by_community(rows, path, "bucket")
    return A.per_key(tables.of_community(t.spark.read.parquet(path), "Building", "c_mktsegment"), "c_mktsegment").withColumnRenamed("c_mktsegment", "segment")


@query("SELECT path, month FROM (SELECT 'RC_' || strftime(o_orderdate, '%Y-%m') || CASE WHEN o_orderkey % 7 = 0 THEN '.corrupted.zst' ELSE '.zst' END AS path, strftime(o_orderdate, '%Y-%m') AS month, o_orderkey % 7 = 0 AS bad FROM orders) WHERE NOT bad AND month BETWEEN '1995-03' AND '1996-02'")
def src_months(t: Tables) -> DataFrame:
    """SRC9, DAT2."""
    path = F.concat(F.lit("RC_"), F.date_format("o_orderdate", "yyyy-MM"), F.when(F.col("o_orderkey") % 7 == 0, ".corrupted.zst").otherwise(".zst"))
    return tables.between_months(t.orders.select(path.alias("path")), "RC", "1995-03", "1996-02").select("path", "month")


@query("SELECT user_id, event_type, arg_max(trace, event_id) AS trace FROM (SELECT user_id, event_type, event_id, CASE event_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN 't' || event_id ELSE 'r' || event_id END AS trace FROM events) WHERE trim(trace) <> '' GROUP BY ALL")
def src_traces(t: Tables) -> DataFrame:
    """SRC16, STR9: traces from their own column, a completion, or raw content; the last that is not empty."""
    k, own = F.col("event_id") % 4, F.col("event_id").cast("string")
    rows = t.events.select(F.col("user_id").alias("mod_comment_id"), F.col("event_type").alias("thread_type"), F.col("event_id").alias("seq"), F.when(k == 1, F.concat(F.lit(" t"), own)).otherwise("").alias("trace_reasoning"), F.when(k == 2, F.concat(F.lit("r"), own, F.lit("</think> (a)"))).alias("completion"), F.when(k == 3, F.concat(F.lit("x<reasoning>r"), own, F.lit(" </reasoning>y"))).otherwise(" ").alias("raw_content"))
    found = tables.traces(rows)
    return found.select(F.col("mod_comment_id").alias("user_id"), F.col("thread_type").alias("event_type"), S.rationale(F.col("trace_reasoning"), F.col("completion"), F.col("raw_content")).alias("trace"))


@query("SELECT 'm' || o_custkey % 5 AS model, o_orderstatus AS split, o_orderpriority AS context, 'cot' AS phrase, CASE WHEN o_custkey % 2 = 0 THEN 'r1' END AS run_suffix, max('res_' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || '.json') AS file FROM orders GROUP BY ALL")
def src_result_folders(t: Tables) -> DataFrame:
    """SRC17."""
    even = F.col("o_custkey") % 2 == 0
    path = F.concat(F.lit("file:/x/results/m"), (F.col("o_custkey") % 5).cast("string"), F.lit("/"), "o_orderstatus", F.lit("/"), "o_orderpriority", F.lit("/cot/"), F.when(even, "r1/").otherwise(""), F.lit("res_"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit(".json"))
    found = tables.result_folders(t.orders.select(path.alias("path")), "/x/results")
    return found.select("model", "split", "context", "phrase", "run_suffix", F.element_at(F.split("path", "/"), -1).alias("file"))


@query("SELECT lower(p_brand) AS subreddit, arg_max(CASE WHEN p_size % 4 = 0 THEN 'unknown' ELSE p_type END, p_partkey) AS language, arg_max(p_name, p_partkey) AS title, '' AS description, arg_max(p_size % 3, p_partkey)::BIGINT AS rules FROM part WHERE p_size > 1 GROUP BY 1")
def lod_community_maps(t: Tables) -> DataFrame:
    """LOD2."""
    sub = F.struct(F.when(F.col("p_size") > 1, F.col("p_brand")).otherwise("").alias("display_name"), F.when(F.col("p_size") % 4 != 0, F.col("p_type")).alias("lang"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("public_description"))
    entries = t.part.select(sub.alias("subreddit"), F.array_repeat(F.lit("r"), (F.col("p_size") % 3).cast("int")).alias("rules"), F.col("p_partkey").alias("seq"))
    return tables.community_maps(entries).select("subreddit", "language", "title", "description", F.size("rules").cast("bigint").alias("rules"))


@query("SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS keys FROM orders")
def snk_digest(t: Tables) -> DataFrame:
    """SNK6: the digest of a table does not depend on its order: of two copies it is the same."""
    a, b = sinks.with_digest(t.orders), sinks.with_digest(t.orders.repartition(7, "o_custkey"))
    same = a.join(b, ["rows", "xor", "sum"])
    return same.select("rows").crossJoin(F.broadcast(t.orders.agg(F.count_distinct("o_orderkey").alias("keys"))))


@query("SELECT o_custkey, '{\"name\":' || o_custkey || ',\"thread_pairs\":[' || string_agg('{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}', ',' ORDER BY o_orderkey) || ']}' AS document FROM orders GROUP BY o_custkey")
def snk_nested_document(t: Tables) -> DataFrame:
    """SNK3."""
    return sinks.nested_document(t.orders, "o_custkey", "o_orderkey", "o_orderstatus")


# Filters

_AUTHORS = ("alice", "modteam7", "[deleted]", "bob", None, "AutoModerator")


@query(f"SELECT event_id FROM (SELECT event_id, event_id % 4 = 0 AS m, CASE event_id % 3 WHEN 0 THEN 't1_x' WHEN 1 THEN 't3_x' END AS p, lower(coalesce({_pick_sql('event_id', *_AUTHORS)}, '')) AS a FROM events) WHERE m AND coalesce(p LIKE 't1_%', FALSE) AND NOT (a = '' OR a IN ('[deleted]', '[removed]') OR " + " OR ".join(f"contains(a, '{x}')" for x in S.BOT_MARKS) + ")")
def flt_moderator_reply(t: Tables) -> DataFrame:
    """FLT2, FLT3."""
    k = F.col("event_id")
    rows = t.events.select("event_id", F.when(k % 4 == 0, "moderator").alias("distinguished"), _pick(k, "t1_x", "t3_x", None).alias("parent_id"), _pick(k, *_AUTHORS).alias("author"))
    return rows.where(P.moderator_reply() & ~P.by_bot()).select("event_id")


@query("SELECT n.o_custkey AS subreddit, n.rank, row_number() OVER (ORDER BY n.rank) AS sfw_rank FROM (SELECT o_custkey, n, row_number() OVER (ORDER BY n DESC, o_custkey) AS rank FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)) n WHERE n.n >= 5 AND n.o_custkey % 3 = 1")
def flt_safe_communities(t: Tables) -> DataFrame:
    """FLT5, FLT6, WIN4: unknown counts as unsafe."""
    ranks = A.ranked(A.per_key(t.orders.withColumnRenamed("o_custkey", "subreddit"), "subreddit"), "n", "subreddit")
    own = t.orders.select(F.col("o_custkey").alias("subreddit")).distinct()
    over = F.when(F.col("subreddit") % 3 == 1, False).when(F.col("subreddit") % 3 == 2, True)
    return construct.safe_communities(ranks, own.withColumn("over18", over), 5).select("subreddit", "rank", "sfw_rank")


@query("SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE n >= 2")
def flt_enough_rules(t: Tables) -> DataFrame:
    """FLT7."""
    return P.with_rules(t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber")), 2, "l_orderkey")


_TEXTS = ("fine", "was [removed] here", "[deleted]", None, "also fine")


@query(f"SELECT page_id, contains(coalesce(x, ''), '[removed]') OR contains(coalesce(x, ''), '[deleted]') AS gone, d IN ('moderator', 'admin') AS staff, coalesce(try_cast(c AS DOUBLE)::BIGINT, 0) < 1677628800 AS before FROM (SELECT page_id, {_pick_sql('page_id', *_TEXTS)} AS x, {_pick_sql('page_id', 'moderator', 'admin', 'user', '')} AS d, {_pick_sql('page_id', '1677628800', '1677628799', '1.5e9', 'x', None)} AS c FROM pages)")
def flt_submissions(t: Tables) -> DataFrame:
    """FLT9, FLT10, FLT11."""
    k = F.col("page_id")
    rows = t.pages.select("page_id", _pick(k, *_TEXTS).alias("selftext"), F.lit("t").alias("title"), _pick(k, "moderator", "admin", "user", "").alias("distinguished"), _pick(k, "1677628800", "1677628799", "1.5e9", "x", None).alias("created_utc"))
    return rows.select("page_id", P.removed_submission("selftext", "title").alias("gone"), P.by_staff().alias("staff"), P.before_cutoff().alias("before"))


_VERDICTS = ("(a)", "(b)", "A", "both a and b", "", None, "(c)", "a, not c")


@query(f"SELECT event_id, contains(v, 'a') AND NOT contains(v, 'b') AND NOT contains(v, 'c') AS passed FROM (SELECT event_id, lower(coalesce({_pick_sql('event_id', *_VERDICTS)}, '')) AS v FROM events)")
def flt_verdict(t: Tables) -> DataFrame:
    """FLT15."""
    return t.events.select("event_id", _pick(F.col("event_id"), *_VERDICTS).alias("verdict")).select("event_id", P.verified().alias("passed"))


_SHOWN = ("http://x/a.jpg", "http://i.redd.it/q", "http://x/a.html", "http://youtu.be/1", None)


@query(f"SELECT page_id, page_id % 7 = 0 OR page_id % 11 = 0 OR coalesce(u LIKE '%.jpg' OR contains(u, 'i.redd.it') OR contains(u, 'youtu.be'), FALSE) AS media FROM (SELECT page_id, {_pick_sql('page_id', *_SHOWN)} AS u FROM pages)")
def flt_shows_media(t: Tables) -> DataFrame:
    """FLT16."""
    k = F.col("page_id")
    none = F.lit(None).cast("string")
    rows = t.pages.select("page_id", _pick(k, *_SHOWN).alias("url"), (k % 7 == 0).alias("is_video"), F.lit(None).cast("boolean").alias("is_gallery"), F.lit(False).alias("is_reddit_media_domain"), F.when(k % 11 == 0, '{"a": 1}').otherwise("{}").alias("media"), *[none.alias(c) for c in ("media_embed", "media_metadata", "secure_media", "secure_media_embed")], F.lit("self").alias("post_hint"))
    return rows.select("page_id", P.shows_media().alias("media"))


@query("SELECT o_orderkey, o_orderkey % 3 > 0 OR o_orderkey % 5 = 4 AS media, CASE o_orderkey % 4 WHEN 0 THEN TRUE ELSE FALSE END AS shown FROM orders")
def flt_pairs(t: Tables) -> DataFrame:
    """FLT17, FLT18."""
    k = F.col("o_orderkey")
    body = F.when(k % 4 == 0, "words").when(k % 4 == 1, " [hydrate] ").when(k % 4 == 2, F.lit(None).cast("string"))
    empty = F.array().cast("array<struct<body:string>>")
    thread = F.when(k % 4 == 3, empty).otherwise(F.array(F.struct(F.lit("root").alias("body")), F.struct(body.alias("body"))))
    rows = t.orders.select("o_orderkey", F.when(k % 3 > 0, F.array(F.lit("f"))).alias("media_files"), F.when(k % 5 == 4, 2).alias("num_media"), thread.alias("thread"))
    return rows.select("o_orderkey", P.pair_has_media().alias("media"), F.coalesce(P.renderable("thread"), F.lit(False)).alias("shown"))


_CODES = ("en", "en-GB", "EN_us", "de", "", None)


@query(f"SELECT doc_id, lower(split_part(replace(coalesce(x, ''), '_', '-'), '-', 1)) = 'en' AS sampled, coalesce(x, '') = 'en' AS ranked FROM (SELECT doc_id, {_pick_sql('doc_id', *_CODES)} AS x FROM documents)")
def flt_english(t: Tables) -> DataFrame:
    """FLT19."""
    rows = t.documents.select("doc_id", _pick(F.col("doc_id"), *_CODES).alias("lang"))
    return rows.select("doc_id", P.english_root().alias("sampled"), P.english_exactly().alias("ranked"))


_GRID = "SELECT o_orderkey AS combination, o_custkey % 50 AS n_clusters, CASE WHEN o_orderkey % 6 > 0 THEN o_totalprice END AS dbcv, o_orderkey % 10 / 10.0::DOUBLE AS noise_ratio FROM orders"


@query(f"SELECT combination, rank FROM (SELECT combination, row_number() OVER (ORDER BY dbcv DESC, noise_ratio, combination) AS rank FROM ({_GRID}) WHERE dbcv IS NOT NULL AND n_clusters BETWEEN 5 AND 30) WHERE rank <= 10")
def flt_valid_clusterings(t: Tables) -> DataFrame:
    """FLT21, TOP2."""
    grid = t.orders.select(F.col("o_orderkey").alias("combination"), (F.col("o_custkey") % 50).alias("n_clusters"), F.when(F.col("o_orderkey") % 6 > 0, F.col("o_totalprice")).alias("dbcv"), (F.col("o_orderkey") % 10 / F.lit(10.0)).alias("noise_ratio"))
    best = P.valid_clusterings(grid).orderBy(F.desc("dbcv"), "noise_ratio", "combination").limit(10)
    return A.numbered(best, [F.desc("dbcv"), F.asc("noise_ratio"), F.asc("combination")], "rank").select("combination", "rank")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 4 IN (0, 1) AND o_orderkey % 3 > 0")
def flt_answered(t: Tables) -> DataFrame:
    """FLT22."""
    k = F.col("o_orderkey")
    return P.answered(t.orders.select("o_orderkey", _pick(k, "(a)", "(b)", "", None).alias("violating_response"), F.when(k % 3 > 0, "(c)").alias("compliant_response"))).select("o_orderkey")


# Texts


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Violation: ' || p_type || chr(10) ELSE '' END || 'Rule: ' || p_brand || '. ' || CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS rule FROM part")
def str_rule_text(t: Tables) -> DataFrame:
    """STR4: trailing full stops of the name go."""
    return t.part.select("p_partkey", S.rule_text(F.concat("p_brand", F.lit("...")), F.when(F.col("p_size") % 2 == 0, F.col("p_name")), F.when(F.col("p_size") % 3 == 0, F.col("p_type"))).alias("rule"))


_THOUGHTS = ("plain ", "<think>open  ", "<THINK>shut</think> x", "")


@query(f"SELECT event_id, CASE WHEN contains(b, '<think>') AND NOT contains(b, '</think>') AND r <> '' THEN rtrim(r) || chr(10) || '</think>' || chr(10) || chr(10) ELSE r END AS reply FROM (SELECT event_id, r, lower(p || r) AS b FROM (SELECT event_id, {_pick_sql('event_id', *_THOUGHTS)} AS r, CASE WHEN event_id % 3 = 0 THEN '<think>' ELSE '' END AS p FROM events))")
def str_closed_thinking(t: Tables) -> DataFrame:
    """STR8."""
    return t.events.select("event_id", S.closed_thinking(F.when(F.col("event_id") % 3 == 0, "<think>"), _pick(F.col("event_id"), *_THOUGHTS)).alias("reply"))


@query("SELECT c_custkey, regexp_replace(lower(c_name || ' // ' || c_mktsegment), '[^a-z0-9]+', '-', 'g') AS slug, substr(replace(replace(c_name || '|' || c_mktsegment || '/' || repeat('z', 40), '|', '_'), '/', '_'), 1, 50) AS media FROM customer")
def str_run_slug(t: Tables) -> DataFrame:
    """STR10, STR11."""
    return t.customer.select("c_custkey", S.run_slug(F.concat("c_name", F.lit(" // "), "c_mktsegment")).alias("slug"), S.media_id(F.concat("c_name", F.lit("|"), "c_mktsegment", F.lit("/"), F.lit("z" * 40))).alias("media"))


_URLS = ("https://v.redd.it/abc", "https://www.youtube.com/watch?v=1", "https://i.redd.it/a.PNG?x=1", "https://reddit.com/gallery/1", "http://imgur.com/q", "http://site.org/a.b/c", "ftp://host/x.webp#f")


@query(f"SELECT page_id, page_id % 7 IN (0, 1) AS video, page_id % 7 IN (2, 4, 6) AS media, CASE page_id % 7 WHEN 2 THEN 'png' WHEN 6 THEN 'webp' END AS extension FROM pages")
def str_media_urls(t: Tables) -> DataFrame:
    """STR13."""
    u = _pick(F.col("page_id"), *_URLS)
    return t.pages.select("page_id", S.is_video_url(u).alias("video"), S.is_media_url(u).alias("media"), S.url_extension(u).alias("extension"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN b IS NULL THEN a ELSE printf('%.1f (%+.1f)', v, round(v - w, 1)) END AS shown FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, printf('%.1f', l_quantity + 0.2) AS a, round_even(l_quantity + 0.2, 1) AS v, CASE WHEN l_linenumber > 1 THEN l_quantity * 0.5 + 0.2 END AS b, round_even(l_quantity * 0.5 + 0.2, 1) AS w FROM lineitem)")
def str_delta_text(t: Tables) -> DataFrame:
    """STR15."""
    rows = t.lineitem
    before = F.when(F.col("l_linenumber") > 1, F.col("l_quantity") * 0.5 + 0.2)
    return rows.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), S.delta_text(F.col("l_quantity") + 0.2, before).alias("shown"))


@query("SELECT doc_id, lower(trim(c)) AS label FROM (SELECT doc_id, split_part(text, ' ', 1) AS c FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '^[A-Za-z]+ '))")
def str_cluster_label(t: Tables) -> DataFrame:
    """STR18: the first line without its quotes."""
    word = F.split_part("text", F.lit(" "), F.lit(1))
    rows = t.documents.where("text IS NOT NULL AND text RLIKE '^[A-Za-z]+ '")
    return rows.select("doc_id", S.cluster_label(F.concat(F.lit('  "'), word, F.lit('"\nsecond line'))).alias("label"))


_CONTEXTS = ("none", "submission", "submission-media-discussion", "user", "discussion-user", "submission-media-discussion-user")


@query(f"SELECT event_id, contains(c, 'submission') AS include_submission, contains(c, 'media') AS include_media, contains(c, 'discussion') AS include_discussion, contains(c, 'user') AS include_user FROM (SELECT event_id, {_pick_sql('event_id', *_CONTEXTS)} AS c FROM events)")
def str_context_flags(t: Tables) -> DataFrame:
    """STR19."""
    return t.events.select("event_id", S.context_flags(_pick(F.col("event_id"), *_CONTEXTS)).alias("f")).select("event_id", "f.*")


# Numbers and arrays


@query("SELECT doc_id, (quality * 2.0 + toxic * 1.0) / 3.0 AS accuracy FROM labels")
def mth_weighted_accuracy(t: Tables) -> DataFrame:
    """MTH7."""
    return t.labels.select("doc_id", N.weighted_accuracy(F.col("quality"), F.col("toxic"), 2.0, 1.0).alias("accuracy"))


@query("SELECT conv_id, string_agg(CAST(n - 1 - k AS VARCHAR) || ':' || role, ',' ORDER BY k DESC) AS path FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) GROUP BY conv_id")
def arr_leveled(t: Tables) -> DataFrame:
    """ARR2: leaf to root turned over, with levels."""
    turns = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("path"))
    steps = F.transform(N.leveled(F.col("path")), lambda x: F.concat(x["level"].cast("string"), F.lit(":"), x["comment"]["role"]))
    return turns.select("conv_id", F.array_join(steps, ",").alias("path"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '(a)' WHEN 1 THEN '(b)' END AS label FROM part")
def arr_label_of(t: Tables) -> DataFrame:
    """ARR3, ARR4: a rule that is not listed has no label."""
    options = N.labelled_options(F.array(F.col("p_name"), F.col("p_brand"), F.col("p_brand")))
    rule = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).otherwise("absent")
    return t.part.select("p_partkey", N.label_of(options, rule).alias("label"))


@query("SELECT p_partkey, trim(unnest(string_split(lower(p_name || ' , ' || p_brand || ',' || p_type), ','))) AS item FROM part")
def arr_listed(t: Tables) -> DataFrame:
    """ARR6."""
    return N.listed(t.part.withColumn("all", F.concat_ws(",", F.concat("p_name", F.lit(" ")), F.concat(F.lit(" "), "p_brand"), "p_type")), "all", "item").select("p_partkey", "item")


# Joins and sets


@query("SELECT o_custkey, o_orderstatus, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY ALL")
def map_last_wins(t: Tables) -> DataFrame:
    """MAP1."""
    return J.last_by(t.orders.select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice"), ["o_custkey", "o_orderstatus"], "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 IN (0, 1))")
def jon_finished(t: Tables) -> DataFrame:
    """JON4."""
    statuses = t.customer.select(F.col("c_custkey").alias("submission_id"), _pick(F.col("c_custkey"), "complete", "no_media", "failed", "partial").alias("status"))
    return J.of_finished(t.orders.select("o_orderkey", F.col("o_custkey").alias("submission_id")), statuses).select("o_orderkey")


@query("WITH r AS (SELECT p_brand AS subreddit, p_type AS rule, arg_max(p_name, p_partkey) AS text FROM part WHERE p_size > 10 GROUP BY ALL) SELECT p_partkey, coalesce(r.text, p_type) AS rule_comprehensive FROM part LEFT JOIN r ON p_brand = r.subreddit AND p_type = r.rule")
def jon_rule_text(t: Tables) -> DataFrame:
    """JON5."""
    rules = t.part.where("p_size > 10").select(F.col("p_brand").alias("subreddit"), F.col("p_type").alias("short_name_clean"), F.col("p_name").alias("rule_comprehensive"), F.col("p_partkey").alias("rule_index"))
    rows = t.part.select("p_partkey", F.col("p_brand").alias("subreddit"), F.col("p_type").alias("rule"))
    return J.with_rule_text(rows, rules).select("p_partkey", "rule_comprehensive")


@query("SELECT d.doc_id, CAST(l.quality AS DOUBLE) AS score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def jon_aligned(t: Tables) -> DataFrame:
    """JON10."""
    return J.aligned(t.labels.select("doc_id", F.col("quality").cast("double").alias("score")), t.documents.select("doc_id"), "doc_id")


@query("SELECT label, accuracy, pairs FROM (SELECT p_type AS label, avg(p_size) AS accuracy FROM part GROUP BY 1) JOIN (SELECT p_type AS label, count(*) AS pairs FROM part WHERE p_size > 5 GROUP BY 1) USING (label) WHERE lower(label) <> 'economy'")
def jon_size_accuracy(t: Tables) -> DataFrame:
    """JON11: the label `other` is left out."""
    label = F.when(F.col("p_type") == "ECONOMY", "Other").otherwise(F.col("p_type")).alias("label")
    accuracy = t.part.groupBy(label).agg(F.avg("p_size").alias("accuracy"))
    sizes = t.part.where("p_size > 5").groupBy(label).agg(F.count("*").alias("pairs"))
    return reports.size_and_accuracy(accuracy, sizes)


@query("SELECT e.event_id, CASE WHEN e.event_id % 2 = 0 AND e.event_id % 3 > 0 THEN 'trace' || e.event_id END AS trace FROM events e")
def jon_traces(t: Tables) -> DataFrame:
    """JON12: only where key, letter and submission agree."""
    k = F.col("event_id")
    rows = t.events.select("event_id", k.cast("string").alias("mod_comment_id"), F.col("event_type").alias("thread_type"), F.lit("(a)").alias("correct_answer"), F.col("user_id").alias("submission_id"))
    traces = t.events.where(k % 2 == 0).select(k.cast("string").alias("mod_comment_id"), F.col("event_type").alias("thread_type"), F.when(k % 3 > 0, "(a)").otherwise("(b)").alias("letter"), F.col("user_id").alias("submission_id"), F.concat(F.lit("trace"), k.cast("string")).alias("text"))
    return J.with_traces(rows, traces).select("event_id", F.col("trace.text").alias("trace"))


@query("WITH a AS (SELECT o_custkey AS form, o_orderkey AS l, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey AS form, o_orderkey AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders WHERE o_orderstatus = 'O') SELECT coalesce(a.form, b.form) AS form, coalesce(a.place, b.place) AS place, coalesce(l, -1) AS l, coalesce(r, -1) AS r FROM a FULL JOIN b ON a.form = b.form AND a.place = b.place")
def jon_by_position(t: Tables) -> DataFrame:
    """JON13."""
    own = lambda s: t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("form"), "o_orderkey")
    found = J.by_position(own("F"), own("O"), "form", "o_orderkey")
    return found.select("form", F.col("place").cast("bigint").alias("place"), F.coalesce("left.o_orderkey", F.lit(-1)).alias("l"), F.coalesce("right.o_orderkey", F.lit(-1)).alias("r"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1 AND l_returnflag <> 'N')")
def jon_unfinished(t: Tables) -> DataFrame:
    """MOD4: what has no content is done again."""
    done = t.lineitem.where("l_linenumber = 1").select(F.col("l_orderkey").alias("key"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("content"))
    return J.unfinished(t.orders.select(F.col("o_orderkey").alias("key")), done).withColumnRenamed("key", "o_orderkey")


@query("SELECT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer UNION SELECT s_suppkey FROM supplier")
def set_all_ids(t: Tables) -> DataFrame:
    """SET1."""
    return J.all_ids(t.orders.select(F.col("o_custkey").alias("id")), t.customer.select(F.col("c_custkey").alias("id")), t.supplier.select(F.col("s_suppkey").alias("id")))


@query("SELECT split, count(*) AS n FROM (SELECT 'train' AS split FROM orders UNION ALL SELECT 'test' FROM lineitem) GROUP BY split")
def set_tagged(t: Tables) -> DataFrame:
    """SET2."""
    return A.per_key(J.tagged({"train": t.orders.select(F.col("o_orderkey").alias("k")), "test": t.lineitem.select(F.col("l_orderkey").alias("k"))}), "split")


# Aggregates


@query("SELECT user_id AS name, CAST(sum(n) AS BIGINT) AS n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1")
def agg_merged_stats(t: Tables) -> DataFrame:
    """AGG2."""
    return A.merged_stats(t.events.groupBy(F.col("user_id").alias("name"), "event_type").agg(F.count("*").alias("n")))


_STATS = "SELECT source, count(*) AS total, count(*) FILTER (lang = 'en') AS matched, count(*) FILTER (lang = 'de' AND length(text) > 900) AS ambiguous FROM documents GROUP BY 1"


@query(f"SELECT count(*) AS communities, count(*) FILTER (matched > 0) AS with_matches, CAST(sum(total) AS BIGINT) AS total, CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(ambiguous) AS BIGINT) AS ambiguous, round(100.0 * sum(matched) / sum(total), 9) AS match_rate, round(100.0 * sum(ambiguous) / sum(total), 9) AS ambiguous_rate FROM ({_STATS})")
def agg_match_summary(t: Tables) -> DataFrame:
    """AGG3, AGG4."""
    d = t.documents.select(F.col("source").alias("subreddit"), "lang", "text")
    stats = A.match_stats(d, d.where("lang = 'en'"), d.where("lang = 'de' AND length(text) > 900"))
    return A.match_summary(stats).withColumns({c: F.round(c, 9) for c in ("match_rate", "ambiguous_rate")})


@query("SELECT p.l_suppkey, p.rule_index, count(l.l_orderkey) AS n FROM (SELECT DISTINCT s_suppkey AS l_suppkey, k AS rule_index FROM supplier CROSS JOIN (VALUES (1), (2), (9)) v(k)) p LEFT JOIN lineitem l ON l.l_suppkey = p.l_suppkey AND l.l_linenumber = p.rule_index GROUP BY ALL")
def agg_rule_counts(t: Tables) -> DataFrame:
    """AGG3: rules without matches count 0."""
    rules = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(9))).alias("rule_index"))
    return A.rule_counts(rules, t.lineitem.select("l_suppkey", F.col("l_linenumber").alias("rule_index")), "l_suppkey", "rule_index")


@query("SELECT count(*) AS pairs, count(DISTINCT p_brand) AS communities, count(DISTINCT (p_brand, p_name)) AS rules, count(DISTINCT p_type) AS rule_clusters, count(DISTINCT p_size) AS community_clusters FROM part")
def agg_distinct_counts(t: Tables) -> DataFrame:
    """AGG7, AGG9."""
    return A.distinct_counts(t.part.select(F.col("p_brand").alias("subreddit"), F.col("p_name").alias("rule"), F.col("p_type").alias("rule_cluster_label"), F.col("p_size").alias("subreddit_cluster_label")))


@query("SELECT o_orderstatus AS split, count(*) AS pairs, count(DISTINCT o_custkey) AS submissions, count(*) FILTER (o_orderkey % 3 > 0) AS with_media, CAST(sum(o_orderkey % 3) AS BIGINT) AS media, CAST(sum(o_orderkey % 4 + o_orderkey % 5) AS BIGINT) AS comments FROM orders GROUP BY 1")
def agg_split_totals(t: Tables) -> DataFrame:
    """AGG10."""
    some = lambda n: F.array_repeat(F.lit("x"), (F.col("o_orderkey") % n).cast("int"))
    return A.split_totals(t.orders.select(F.col("o_orderstatus").alias("split"), F.col("o_custkey").alias("submission_id"), some(3).alias("media_files"), some(4).alias("violating_thread"), some(5).alias("compliant_thread")))


@query("SELECT CAST(max(len(string_split(text, ' '))) AS BIGINT) AS max_tokens, CAST(max(doc_id % 4) AS BIGINT) AS max_images FROM documents")
def agg_longest_input(t: Tables) -> DataFrame:
    """AGG22."""
    found = A.longest_input(t.documents.select(F.split("text", " ").alias("token_ids"), F.array_repeat(F.lit(1), (F.col("doc_id") % 4).cast("int")).alias("images")))
    return found.select(*[F.col(c).cast("bigint").alias(c) for c in found.columns])


@query("SELECT min(h) AS min_half, round(avg(h), 9) AS avg_half, max(h) AS max_half FROM (SELECT (o_totalprice + 10 - o_orderkey % 7 - (o_totalprice - 3)) / 2 AS h FROM orders)")
def agg_interval_widths(t: Tables) -> DataFrame:
    """AGG23."""
    found = A.interval_widths(t.orders.select((F.col("o_totalprice") - 3).alias("low"), (F.col("o_totalprice") + 10 - F.col("o_orderkey") % 7).alias("high")))
    return found.withColumn("avg_half", F.round("avg_half", 9))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN CAST(row_number() OVER (PARTITION BY lang = 'en' ORDER BY n_chars NULLS LAST, doc_id) AS VARCHAR) END AS rank FROM (SELECT doc_id, any_value(lang) AS lang, any_value(n_chars) AS n_chars FROM documents GROUP BY doc_id)")
def win_rank_english(t: Tables) -> DataFrame:
    """WIN3: others have no rank."""
    return A.ranked_english(t.documents.select("doc_id", F.col("lang").alias("language"), "n_chars"), "n_chars", "doc_id").select("doc_id", F.col("rank").cast("string").alias("rank"))


# Retrieval


@query("""WITH e AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS b FROM embeddings), c AS (SELECT id, b, row_number() OVER (PARTITION BY b ORDER BY md5('drawn:' || id), id) - 1 AS place, count(*) OVER (PARTITION BY b) AS n FROM e),
p AS (SELECT id AS query_id, b, n, unnest(range(0, 29)) AS r FROM c WHERE id % 5 = 0),
d AS (SELECT query_id, b, r, (('0x' || substr(md5(query_id || ':' || CASE WHEN r < 25 THEN r ELSE 0 END), 1, 15))::BIGINT + CASE WHEN r < 25 THEN 0 ELSE r - 25 END) % n AS place FROM p),
f AS (SELECT query_id, b, place, min(r) AS r FROM d GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS step FROM f)
SELECT query_id, candidate_id, rank FROM (SELECT k.query_id, c.id AS candidate_id, row_number() OVER (PARTITION BY k.query_id ORDER BY step) AS rank FROM k JOIN c ON c.b = k.b AND c.place = k.place WHERE step <= 4 AND c.id <> k.query_id) WHERE rank <= 3""")
def rag_random(t: Tables) -> DataFrame:
    """RAG2, random."""
    e = t.embeddings.select(F.col("vec_id").alias("id"), "label")
    return similarity.drawn(e.where("id % 5 = 0"), e, 3, by="label").select("query_id", "candidate_id", "rank")


def _pairs(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    thread = lambda p: F.array(F.struct(F.when(k % p == 0, "[hydrate]").otherwise("body").alias("body")))
    return t.orders.select(F.lit("train").alias("split"), k.cast("string").alias("mod_comment_id"), F.lit("v").alias("violating_comment_id"), F.lit("c").alias("compliant_comment_id"), F.lit("(a)").alias("violating_correct_answer"), F.lit("(b)").alias("compliant_correct_answer"), thread(3).alias("violating_thread"), thread(4).alias("compliant_thread"), F.array().cast("array<string>").alias("media_files"), F.when(k % 5 == 0, 1).otherwise(0).alias("num_media"))


@query("SELECT 'train:' || o_orderkey || ':' || k AS target_key, CASE k WHEN 'violating' THEN '(a)' ELSE '(b)' END AS correct_answer FROM orders CROSS JOIN (VALUES ('violating', 3), ('compliant', 4)) v(k, p) WHERE o_orderkey % 5 > 0 AND o_orderkey % p > 0")
def rag_lookup(t: Tables) -> DataFrame:
    """RAG4, PRJ6, FLT17, FLT18."""
    return similarity.lookup(_pairs(t), True).select("target_key", "correct_answer")


@query("SELECT c_custkey AS id, CAST(count(o_orderkey) AS BIGINT) AS n, string_agg(CAST(o_orderkey AS VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN 't' ELSE '' END, ',' ORDER BY o_orderkey) AS keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 GROUP BY c_custkey")
def rag_prepared(t: Tables) -> DataFrame:
    """RAG3, RAG5: examples in order with their traces; none is an empty array."""
    chosen = t.orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("rank"), F.col("o_orderkey").cast("string").alias("candidate_id"), F.col("o_totalprice").alias("score"))
    traces = t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("target_key"), F.lit("t").alias("trace"))
    found = similarity.prepared(t.customer.select(F.col("c_custkey").alias("id")), chosen, "test", "train", {"query_split": "test", "candidate_split": "train"}, traces)
    keys = F.array_join(F.transform("examples", lambda e: F.concat(e["target_key"], F.coalesce(e["trace"], F.lit("")))), ",")
    return found.select("id", F.size("examples").cast("bigint").alias("n"), F.when(F.size("examples") > 0, keys).alias("keys"))


@query("SELECT c_custkey, 'r/' || c_name || chr(10) || c_mktsegment || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN '[empty]' ELSE 'b' || c_custkey END AS text FROM customer")
def prj_target_text(t: Tables) -> DataFrame:
    """PRJ7."""
    body = F.when(F.col("c_custkey") % 6 == 0, "  ").when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("b"), F.col("c_custkey").cast("string")))
    return t.customer.select("c_custkey", similarity.target_text(F.col("c_name"), F.col("c_mktsegment"), body).alias("text"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || p_brand END AS before, CASE WHEN p_partkey % 2 = 0 THEN p_brand || '<|body|>' || p_type ELSE '' END AS after FROM part")
def prj_around_images(t: Tables) -> DataFrame:
    """PRJ3."""
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(R.MARKER), "p_brand", F.lit(R.MARKER), "p_type")).otherwise(F.concat("p_name", "p_brand"))
    return t.part.select("p_partkey", R.around_images(text).alias("x")).select("p_partkey", "x.before", "x.after")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rule_index, p_name AS short_name_clean, 'Rule: ' || p_name || '. ' || p_type AS rule_comprehensive FROM part")
def prj_clean_rules(t: Tables) -> DataFrame:
    """PRJ5: markup off, index from 1."""
    rules = t.part.select("p_partkey", F.col("p_brand").alias("subreddit"), F.concat(F.lit("**"), "p_name", F.lit("**")).alias("short_name"), F.concat(F.lit(" <b>"), "p_type", F.lit("</b>")).alias("description"), F.lit("").alias("violation_reason"), F.col("p_partkey").alias("seq"))
    return construct.clean_rules(rules).select("p_partkey", "rule_index", "short_name_clean", "rule_comprehensive")


@query("SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) || 'Answer: (' AS prompt FROM conversations GROUP BY conv_id")
def prj_chat(t: Tables) -> DataFrame:
    """MOD5, MOD6."""
    turns = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return turns.select("conv_id", R.chat(F.col("m"), F.lit("Answer: (")).alias("prompt"))


# Models with test doubles


@query("SELECT doc_id, CASE WHEN length(coalesce(text, '')) % 2 = 0 THEN '(a)' ELSE '(b)' END AS verdict, length(coalesce(text, '')) % 2 = 0 AS passed FROM documents")
def mod_judged(t: Tables) -> DataFrame:
    """MOD2, FLT15, with a double that judges by length."""
    return models.judged(t.documents.select("doc_id", F.col("text").alias("prompt"))).select("doc_id", "verdict", "passed")


@query("SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n_tokens FROM documents")
def mod_token_lengths(t: Tables) -> DataFrame:
    """SIM4, with characters as tokens."""
    return models.token_lengths(t.documents.select("doc_id", "text"), lambda: lambda texts: [len(x) for x in texts]).select("doc_id", "n_tokens")


_BODIES = """
SELECT conv_id, '[' || string_agg('{"role":' || CAST(to_json(coalesce(role, 'user')) AS VARCHAR) || ',"content":' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || '}', ',' ORDER BY turn) || ']' AS body
FROM conversations GROUP BY conv_id
"""


@query(_BODIES)
def mod_request_bodies(t: Tables) -> DataFrame:
    """MOD4: whole conversations as a service takes them."""
    turn = F.struct("turn", F.struct("role", F.col("text").alias("content"), F.lit(None).cast("array<struct<type:string,text:string,image:string>>").alias("parts")).alias("m"))
    said = F.transform(F.array_sort(F.collect_list(turn)), lambda x: x["m"]).alias("messages")
    rows = t.conversations.groupBy(F.col("conv_id").alias("id")).agg(said).withColumn("media_files", F.array().cast("array<string>"))
    return calls.request_bodies(rows).withColumnRenamed("id", "conv_id")


_BOTH = """
SELECT a.conv_id, length(a.text) AS violating_length, length(b.text) AS compliant_length
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1
WHERE a.text <> '' AND b.text <> ''
"""


@query(_BOTH)
def mod_complete_pairs(t: Tables) -> DataFrame:
    """MOD4: pairs whose both threads have content, the first turn's and the second's."""
    turns = t.conversations.where("turn IN (0, 1)")
    found = turns.select(F.concat_ws("_", "conv_id", F.when(F.col("turn") == 0, "violating").otherwise("compliant")).alias("id"), F.col("text").alias("content"), F.lit("").alias("reasoning"))
    pairs = calls.complete_pairs(t.conversations.select("conv_id").distinct(), found, "conv_id")
    return pairs.select("conv_id", *[F.length(f"{x}_content").cast("bigint").alias(f"{x}_length") for x in ("violating", "compliant")])


# Media

_TYPES = ("image/jpeg", "IMAGE/PNG; charset=x", "text/html", None, "image/webp")


@query("SELECT page_id, CASE WHEN page_id % 7 = 6 THEN 'Timeout' WHEN page_id % 5 = 2 THEN 'Invalid Content-Type: text/html' WHEN page_id % 5 = 3 THEN 'Invalid Content-Type: ' WHEN page_id % 4 = 3 THEN 'File too large' END AS error, page_id % 7 <> 6 AND page_id % 5 NOT IN (2, 3) AND page_id % 4 <> 3 AS success, CASE WHEN page_id % 7 <> 6 AND page_id % 4 <> 3 THEN CASE page_id % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' WHEN 4 THEN '.webp' END END AS extension FROM pages")
def media_checked(t: Tables) -> DataFrame:
    """SNK12."""
    k = F.col("page_id")
    answers = t.pages.select("page_id", _pick(k, *_TYPES).alias("content_type"), F.when(k % 4 == 3, 50 * 1024 * 1024 + 1).otherwise(50 * 1024 * 1024).alias("file_size"), F.when(k % 7 == 6, "Timeout").alias("error"))
    return M.checked(answers).select("page_id", "error", "success", "extension")


@query("SELECT o_custkey AS submission_id FROM (SELECT o_custkey, count(*) AS have, max(o_custkey % 20) AS num FROM orders GROUP BY 1) WHERE NOT (num > 0 AND have >= num)")
def media_left(t: Tables) -> DataFrame:
    """MEDIA7, SRC13."""
    subs = t.orders.select(F.col("o_custkey").alias("submission_id"), (F.col("o_custkey") % 20).alias("num_media")).distinct()
    files = t.orders.select(F.col("o_custkey").alias("submission_id"), F.col("o_orderkey").cast("string").alias("file"))
    return M.left_to_fetch(subs, files).select("submission_id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'a/b_' || o_orderkey || '.jpg' ELSE '/other/media/a.jpg' END AS path FROM orders")
def media_relative(t: Tables) -> DataFrame:
    """MEDIA7."""
    path = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("/data/media/a/b_"), F.col("o_orderkey").cast("string"), F.lit(".jpg"))).otherwise("/other/media/a.jpg")
    return t.orders.select("o_orderkey", M.relative_path(path, "/data/media/").alias("path"))


# Trees

_FLAGGED = f"""{_DEPTH}, i AS (SELECT event_id AS c, CASE WHEN event_type = 'error' THEN 'removed_or_deleted' WHEN event_id % 17 = 0 THEN 'has_media' WHEN event_id % 19 = 0 THEN 'moderator_in_thread' END AS issue FROM events),
w AS (SELECT c, unnest(path) AS a, generate_subscripts(path, 1) AS k FROM d), f AS (SELECT w.c, arg_max(i.issue, w.k) AS above FROM w JOIN i ON i.c = w.a WHERE w.a <> w.c AND i.issue IS NOT NULL GROUP BY w.c),
m AS (SELECT DISTINCT p AS c FROM e WHERE c % 19 = 0 AND p IS NOT NULL)
SELECT CAST(d.c AS VARCHAR) AS comment_id, coalesce(i.issue, CASE WHEN d.c % 5 = 0 THEN 'edited_comment' END, f.above) AS violating_issue, coalesce(i.issue, CASE WHEN m.c IS NOT NULL THEN 'mod_response' END, f.above) AS compliant_issue, CAST(len(d.path) AS BIGINT) AS length
FROM d JOIN i ON i.c = d.c LEFT JOIN f ON f.c = d.c LEFT JOIN m ON m.c = d.c"""


@query(_FLAGGED)
def tree_issues(t: Tables) -> DataFrame:
    """FLT2, FLT12, TREE4: removed, media, moderators', edited and answered comments, over whole threads."""
    k = F.col("id").cast("bigint")
    rows = _comments(t).withColumns({"distinguished": F.when(k % 19 == 0, "moderator"), "media": F.when(k % 17 == 0, '{"a": 1}'), "edited": F.when(k % 5 == 0, "1500000000.0").otherwise("false")})
    found = trees.threads(rows, trees.depths(trees.edges(rows)))
    return found.select("comment_id", "violating_issue", "compliant_issue", F.col("length").cast("bigint").alias("length"))


# Splits


@query("SELECT o_orderkey, CAST(o_orderkey % 3 AS BIGINT) AS num_media, CASE WHEN o_orderkey % 3 = 2 THEN o_orderkey || '_0_a,' || o_orderkey || '_1_b' WHEN o_orderkey % 3 = 1 THEN o_orderkey || '_0_a' ELSE '' END AS files FROM orders WHERE o_orderstatus <> 'P'")
def spl_assembled(t: Tables) -> DataFrame:
    """SPL2: submissions that are there, media files by name."""
    k = F.col("o_orderkey").cast("string")
    pairs = t.orders.select("o_orderkey", k.alias("submission_id"), k.alias("mod_comment_id"), F.array(F.lit("r1"), F.lit("r2")).alias("rules"), F.lit("r2").alias("rule"))
    some = lambda least, end: t.orders.where(F.col("o_orderkey") % 3 >= least).select(F.concat(k, F.lit(end)).alias("file"))
    found = splits.assembled(pairs, t.orders.where("o_orderstatus <> 'P'").select(k.alias("submission_id")), some(1, "_0_a").union(some(2, "_1_b")))
    right = F.filter("violating_answer_options", lambda o: o["rule"] == "r2")[0]["label"]
    return found.where((F.col("violating_correct_answer") == right) & (F.size("compliant_answer_options") == 3)).select("o_orderkey", F.col("num_media").cast("bigint").alias("num_media"), F.array_join("media_files", ",").alias("files"))


_SPLIT = "CASE WHEN o_orderstatus = 'F' THEN 'train' ELSE 'test' END"


@query(f"SELECT DISTINCT o_orderpriority AS subreddit, {_SPLIT} AS split, l_orderkey AS submission_id, l_linenumber AS node FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def spl_trees(t: Tables) -> DataFrame:
    """SPL2: every line is a node of its order's tree."""
    nodes = t.lineitem.select(F.col("l_orderkey").alias("submission_id"), F.col("l_linenumber").alias("node")).distinct()
    return splits.split_trees(_split_orders(t), nodes)


_DISTRIBUTION = f"""
WITH p AS (SELECT o_orderpriority AS subreddit, {_SPLIT} AS split, l_returnflag AS rule FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
c AS (SELECT subreddit, split, rule, count(*) AS n FROM p GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER w AS q, 1.0::DOUBLE / count(*) OVER w AS u FROM c WINDOW w AS (PARTITION BY subreddit, split))
SELECT subreddit, split, CAST(sum(n) AS BIGINT) AS total_thread_pairs, count(*) AS n_rules, round(0.5 * sum(q * ln(2 * q / (q + u)) + u * ln(2 * u / (q + u))), 9) AS jsd_from_uniform
FROM s GROUP BY subreddit, split
"""


@query(_DISTRIBUTION)
def spl_distribution(t: Tables) -> DataFrame:
    """SPL2: pairs and rules of each community and split."""
    pairs = _split_orders(t).join(t.lineitem.select(F.col("l_orderkey").alias("submission_id"), F.col("l_returnflag").alias("rule")), "submission_id")
    return splits.distribution(pairs).withColumn("jsd_from_uniform", F.round("jsd_from_uniform", 9))


def _split_orders(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderpriority").alias("subreddit"), F.when(F.col("o_orderstatus") == "F", "train").otherwise("test").alias("split"), F.col("o_orderkey").alias("submission_id"))


@query("SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)")
def lod_group_codes(t: Tables) -> DataFrame:
    """LOD5."""
    return splits.group_codes(t.documents, "lang")


# Reports


@query("SELECT o_custkey AS folder, arg_max(name, (ci, name)) AS name FROM (SELECT o_custkey, o_orderkey % 3 = 0 AS ci, 'performance_' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || CASE WHEN o_orderkey % 3 = 0 THEN '_ci.json' ELSE '.json' END AS name FROM orders) GROUP BY 1")
def rep_latest(t: Tables) -> DataFrame:
    """REP1."""
    name = F.concat(F.lit("performance_"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.when(F.col("o_orderkey") % 3 == 0, "_ci.json").otherwise(".json"))
    other = t.orders.select(F.col("o_custkey").alias("folder"), F.lit("zzz.json").alias("name"))
    return reports.latest_performance(t.orders.select(F.col("o_custkey").alias("folder"), name.alias("name")).union(other))


@query("SELECT CASE WHEN p_type = 'ECONOMY' THEN 'other' ELSE p_type END AS label, 100 * round(avg(p_size) / 50, 6) AS accuracy, 100 * round(avg(p_size) / 50, 6) AS low, 100 * round(avg(p_size) / 50, 6) AS high, count(*) AS n FROM part GROUP BY p_type")
def rep_cluster_metrics(t: Tables) -> DataFrame:
    """REP2: without an interval both ends are the accuracy."""
    label = F.when(F.col("p_type") == "ECONOMY", "Other").otherwise(F.col("p_type"))
    rows = t.part.groupBy(label.alias("value")).agg(F.round(F.avg("p_size") / 50, 6).alias("accuracy"), F.count("*").alias("n"))
    rows = rows.withColumns({"grouping": F.lit("rule"), "low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")})
    return reports.cluster_metrics(rows.union(rows.withColumn("grouping", F.lit("x"))), "rule")


@query("SELECT p_type, p_brand AS split, count(DISTINCT p_size) AS members, count(*) AS pairs FROM part GROUP BY GROUPING SETS ((p_brand, p_type), (p_type))")
def rep_sizes(t: Tables) -> DataFrame:
    """REP3."""
    return reports.sizes(t.part.select(F.col("p_brand").alias("split"), "p_type", F.col("p_size").alias("subreddit")), "p_type")


@query("WITH c AS (SELECT lang AS language, count(*) AS n FROM documents GROUP BY 1), a AS (SELECT lang AS language, 'm' || doc_id % 3 AS model, count(*)::DOUBLE AS accuracy FROM documents WHERE lang <> 'de' AND NOT (lang = 'fr' AND doc_id % 3 = 0) GROUP BY ALL) SELECT c.language, m.model, c.n, a.accuracy FROM c CROSS JOIN (SELECT DISTINCT model FROM a) m LEFT JOIN a ON a.language = c.language AND a.model = m.model WHERE c.n >= 10 AND c.language IN (SELECT language FROM a)")
def rep_languages(t: Tables) -> DataFrame:
    """REP4."""
    d = t.documents.select(F.col("lang").alias("language"), (F.col("doc_id") % 3).alias("k"))
    seen = d.where("language <> 'de' AND NOT (language = 'fr' AND k = 0)")
    accuracies = seen.groupBy("language", F.concat(F.lit("m"), F.col("k").cast("string")).alias("model")).agg(F.count("*").cast("double").alias("accuracy"))
    return reports.shown_languages(A.per_key(d, "language"), accuracies)


@query("SELECT o_custkey AS model, coalesce(max(CASE WHEN o_orderpriority = '1-URGENT' THEN n END), 0) AS \"1-URGENT\", coalesce(max(CASE WHEN o_orderpriority = '5-LOW' THEN n END), 0) AS \"5-LOW\" FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1")
def rep_pivot(t: Tables) -> DataFrame:
    """REP5."""
    rows = t.orders.groupBy(F.col("o_custkey").alias("model"), F.col("o_orderpriority").alias("context")).agg(F.count("*").alias("accuracy"))
    return reports.pivoted(rows, ["1-URGENT", "5-LOW"]).fillna(0)


@query("SELECT o_custkey AS form, o_orderkey AS question_id, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS question_index, o_totalprice AS answer FROM orders")
def rep_responses(t: Tables) -> DataFrame:
    """REP7."""
    items = t.orders.select(F.col("o_custkey").alias("form"), F.col("o_orderkey").alias("position"), F.col("o_orderkey").alias("question_id"))
    return reports.responses(items, t.orders.select(F.col("o_custkey").alias("form"), F.col("o_orderkey").alias("question_id"), F.col("o_totalprice").alias("answer"))).select("form", "question_id", "question_index", "answer")


@query("SELECT n_name AS subreddit, CAST(sum(c_custkey) AS BIGINT) AS a, count(*) AS b FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def rep_stage_summary(t: Tables) -> DataFrame:
    """DRV4."""
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("subreddit"), F.col("c_custkey").alias("a"), F.lit(1).cast("bigint").alias("b"))
    return reports.stage_summary(rows, "a", "b")


@query("SELECT grouping, value, accuracy, low, high FROM (SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' ELSE 'overall' END AS grouping, lang AS value, round((sum(quality) + sum(toxic))::DOUBLE / (2 * count(*)), 9) AS accuracy, CASE WHEN lang = 'en' THEN 0.25 ELSE 0.0 END::DOUBLE AS low, CASE WHEN lang = 'en' THEN 0.75 ELSE 0.0 END::DOUBLE AS high FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), ()))")
def rep_with_intervals(t: Tables) -> DataFrame:
    """BST2, REP2: a group without an interval has [0, 0]."""
    rows = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", F.col("quality").alias("violating"), F.col("toxic").alias("compliant")), "doc_id")
    known = t.spark.createDataFrame([("lang", "en", 0.25, 0.75)], "grouping string, value string, low double, high double")
    return splits.with_intervals(A.accuracy(rows, ("lang",)), known).select("grouping", "value", F.round("accuracy", 9).alias("accuracy"), "low", "high")


# Validation


@query("SELECT '1' AS stage, 'CRITICAL' AS severity, 'empty: ' || c_custkey AS message FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def val_empty(t: Tables) -> DataFrame:
    """VAL1, VAL4."""
    n = t.customer.join(A.per_key(t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey"), "c_custkey", "left")
    return V.empty_counts(n, "c_custkey", "n", "1")


@query("SELECT '3' AS stage, 'CRITICAL' AS severity, 'total ' || count(*) || ' is not 7' AS message FROM orders UNION ALL SELECT '3', 'WARNING', 'files of ' || count(DISTINCT o_orderstatus) || ' dates' FROM orders")
def val_sums(t: Tables) -> DataFrame:
    """VAL1, VAL3, VAL5: a total and the dates; a total that agrees says nothing."""
    rows = A.per_key(t.orders, "o_custkey")
    return V.report(V.total_is(rows, "n", 7, "3"), V.one_date(t.orders, "o_orderstatus", "3"), V.total_is(t.region.select(F.lit(1).alias("n")), "n", 5, "3"))


@query("SELECT '7' AS stage, 'CRITICAL' AS severity, count(*) FILTER (c_custkey % 4 < 2) || ' successful, ' || CAST(sum(c_custkey % 3) AS BIGINT) || ' files' AS message FROM customer")
def val_media_totals(t: Tables) -> DataFrame:
    """VAL7."""
    k = F.col("c_custkey")
    return V.media_totals(t.customer.select(_pick(k, "complete", "no_media", "failed", "partial").alias("status"), (k % 3).alias("files_downloaded")), -1, -1)


@query("SELECT '8' AS stage, 'CRITICAL' AS severity, 'missing: f' || n_nationkey AS message FROM nation WHERE n_nationkey % 2 = 1 UNION ALL SELECT '10', 'CRITICAL', 'missing: f' || n_nationkey FROM nation WHERE n_nationkey % 3 > 0")
def val_present(t: Tables) -> DataFrame:
    """VAL8, VAL10."""
    name = F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("file")
    want = t.nation.select(name)
    return V.report(V.present(want, t.nation.where("n_nationkey % 2 = 0").select(name), "file", "8"), V.present(want, t.nation.where("n_nationkey % 3 = 0").select(name), "file", "10"))


@query("SELECT '5' AS stage, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS critical, CAST(0 AS BIGINT) AS warnings, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) > 0 AS failed FROM (SELECT DISTINCT doc_id FROM documents)")
def val_summary(t: Tables) -> DataFrame:
    """VAL5: issues by stage."""
    return V.summary(V.both_ways(t.documents, t.labels, "doc_id", "5", "no labels", "no document"))


# Clusters


@query("SELECT vec_id, CASE WHEN label = 0 THEN -1 ELSE label END::BIGINT AS cluster_id, CASE WHEN label = 0 THEN 'Other' ELSE 'L' || label END AS name FROM embeddings")
def clu_names(t: Tables) -> DataFrame:
    """JON7, AGG18: noise and clusters without a label have one name."""
    rows = t.embeddings.select("vec_id", F.when(F.col("label") == 0, -1).otherwise(F.col("label")).cast("bigint").alias("cluster_id"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("l"))
    return rows.select("vec_id", "cluster_id", J.cluster_name(F.col("cluster_id"), F.col("l")).alias("name"))


@query("SELECT cluster_id, first(vote ORDER BY n DESC, f) AS label FROM (SELECT label AS cluster_id, vec_id % 3 AS v, 'w' || vec_id % 3 AS vote, count(*) AS n, min(vec_id) AS f FROM embeddings GROUP BY ALL) GROUP BY cluster_id")
def clu_voted_labels(t: Tables) -> DataFrame:
    """CLU4, AGG14."""
    votes = t.embeddings.select(F.col("label").alias("cluster_id"), F.concat(F.lit("w"), (F.col("vec_id") % 3).cast("string")).alias("label"), F.col("vec_id").alias("seq"))
    return A.majority(votes, ["cluster_id"], "label", "seq")


_LABELS = "SELECT CASE WHEN source IN ('src1', 'src2') THEN 'c' ELSE 'old' END AS subreddit_cluster_label, CASE WHEN lang = 'de' THEN 'new' ELSE 'old' END AS rule_cluster_label, quality, toxic FROM documents JOIN labels USING (doc_id)"
_RIGHT = "round((sum(quality) + sum(toxic))::DOUBLE / (2 * count(*)), 9) AS accuracy, round(sum(quality)::DOUBLE / count(*), 9) AS violating_accuracy, round(sum(toxic)::DOUBLE / count(*), 9) AS compliant_accuracy"


@query(
    f"""SELECT CASE WHEN grouping(subreddit_cluster_label) = 0 THEN 'subreddit_cluster_label' WHEN grouping(rule_cluster_label) = 0 THEN 'rule_cluster_label' ELSE 'overall' END AS grouping,
coalesce(subreddit_cluster_label, rule_cluster_label) AS value, count(*) AS n, {_RIGHT} FROM ({_LABELS}) GROUP BY GROUPING SETS ((subreddit_cluster_label), (rule_cluster_label), ())"""
)
def rep_relabelled(t: Tables) -> DataFrame:
    """REP6, JON8: accuracies after communities and rules got other labels."""
    own = {"subreddit": "source", "rule": "lang", "violating": "quality", "compliant": "toxic"}
    before = {"subreddit_cluster_id": F.lit(1), "subreddit_cluster_label": F.lit("old"), "rule_cluster_id": F.lit(2), "rule_cluster_label": F.lit("old")}
    results = t.documents.select("doc_id", "source", "lang").join(t.labels, "doc_id").select("doc_id", *[F.col(c).alias(n) for n, c in own.items()]).withColumns(before)
    communities = t.documents.where("source IN ('src1', 'src2')").select(F.col("source").alias("subreddit")).distinct().withColumns({"cluster_id": F.lit(7), "cluster_label": F.lit("c")})
    rules = t.documents.where("lang = 'de'").select(F.col("lang").alias("rule"), F.lit(9).alias("cluster_id"), F.lit("new").alias("cluster_label"), F.col("doc_id").alias("seq"))
    found = evaluate.relabelled_evaluation(results, communities, rules, ("subreddit_cluster_label", "rule_cluster_label"))
    return found.select("grouping", "value", "n", *[F.round(c, 9).alias(c) for c in ("accuracy", "violating_accuracy", "compliant_accuracy")])


@query("SELECT vec_id AS id, CASE WHEN label IN (0, 3) THEN -1 ELSE label END::BIGINT AS cluster_id, CASE WHEN label IN (0, 3) THEN 'Noise' ELSE 'Cluster ' || label END AS cluster_label FROM embeddings")
def clu_applied(t: Tables) -> DataFrame:
    """REP8: the best clustering takes the place of the old one; rows that it lacks, and its noise, are noise."""
    old = t.embeddings.select(F.col("vec_id").alias("id"), F.lit(5).cast("bigint").alias("cluster_id"), F.lit("old").alias("cluster_label"))
    best = t.embeddings.where("label <> 3").select(F.col("vec_id").alias("id"), F.when(F.col("label") == 0, -1).otherwise(F.col("label")).cast("bigint").alias("cluster_id"))
    return clusters.applied(old, best)
