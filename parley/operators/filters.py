"""Predicates over comments, submissions, rules and results (FLT1-FLT23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as S

CUTOFF = 1677628800
SENTINEL = "[hydrate]"
# Fixed values.
MEDIA_HINTS = ("image", "rich:video", "hosted:video", "link")
MEDIA_ENDINGS = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".mp4", ".webm")
MEDIA_HOSTS = ("i.redd.it", "v.redd.it", "imgur.com", "youtube.com", "youtu.be")


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def by_moderator() -> Column:
    """FLT2: distinguished as a moderator's."""
    return _text("distinguished") == "moderator"


def moderator_reply() -> Column:
    """FLT2: a moderator's answer to a comment rather than to a submission."""
    return by_moderator() & F.coalesce(F.col("parent_id").startswith("t1_"), F.lit(False))


def by_bot(column: str = "author") -> Column:
    """FLT3."""
    return S.bot_author(F.col(column))


def at_least(df: DataFrame, column: str, least: int) -> DataFrame:
    """FLT5, FLT20."""
    return df.where(F.col(column) >= least)


def safe_for_work(column: str = "over18") -> Column:
    """FLT6: unknown counts as not safe."""
    return ~F.coalesce(F.col(column), F.lit(True))


def with_rules(rules: DataFrame, least: int = 2, key: str = "subreddit") -> DataFrame:
    """FLT7: rules of communities that have at least so many."""
    enough = rules.groupBy(key).count().where(F.col("count") >= least).select(key)
    return rules.join(enough, key, "left_semi")


def removed(body: str = "body", author: str = "author") -> Column:
    """FLT8: body or author is exactly a removal mark."""
    return _text(body).isin(*S.GONE) | _text(author).isin(*S.GONE)


def removed_submission(*columns: str) -> Column:
    """FLT9: any of the texts holds a removal mark anywhere."""
    return S.any_of([_text(c).contains(m) for c in columns or ("selftext", "title", "author", "selftext_html") for m in S.GONE])


def by_staff() -> Column:
    """FLT10."""
    return _text("distinguished").isin("moderator", "admin")


def before_cutoff(column: str = "created_utc", cutoff: int = CUTOFF) -> Column:
    """FLT11: a missing time is 0 and passes."""
    return S.seconds(F.col(column)) < cutoff


def matched(scores: DataFrame, cuts: DataFrame, keys: tuple[str, ...] = ("subreddit", "comment_id"), score: str = "score", rule: str = "rule_index") -> DataFrame:
    """FLT13, FLT14, WIN5, SIM2: the best rule of each comment that has at most one score over the ambiguous cut and whose best reaches the gold cut.

    cuts: the one row of thresholds. Ties go to the first rule.
    """
    both = scores.join(F.broadcast(cuts))
    best = both.groupBy(*keys).agg(F.max_by(rule, F.struct(score, -F.col(rule))).alias(rule), F.max(score).alias(score), F.count_if(F.col(score) > F.col("ambiguous")).alias("over"), F.first("gold").alias("gold"))
    return best.where((F.col("over") <= 1) & (F.col(score) >= F.col("gold"))).select(*keys, rule, score)


def verified(verdict: str = "verdict") -> Column:
    """FLT15: the judge says (a) and neither other."""
    low = F.lower(_text(verdict))
    return low.contains("a") & ~low.contains("b") & ~low.contains("c")


def shows_media() -> Column:
    """FLT16: any sign of media in a submission."""
    url = _text("url")
    flags = [F.coalesce(F.col(c), F.lit(False)) for c in ("is_video", "is_gallery", "is_reddit_media_domain")]
    filled = [_text(c).isin("", "{}", "null") == False for c in ("media", "media_embed", "media_metadata", "secure_media", "secure_media_embed")]  # noqa: E712
    return S.any_of([*flags, *filled, _text("post_hint").isin(*MEDIA_HINTS), *[url.endswith(e) for e in MEDIA_ENDINGS], *[url.contains(h) for h in MEDIA_HOSTS]])


def pair_has_media() -> Column:
    """FLT17."""
    return (F.coalesce(F.size("media_files"), F.lit(0)) > 0) | (F.coalesce(F.col("num_media"), F.lit(0)) > 0)


def renderable(thread: str, sentinel: str = SENTINEL) -> Column:
    """FLT18: the thread's last comment is there and has its text."""
    body = F.try_element_at(F.col(thread), F.lit(-1))["body"]
    return body.isNotNull() & (F.trim(body) != sentinel)


def english_root(column: str = "lang") -> Column:
    """FLT19, for sampling: English of any region."""
    return F.lower(S.language_root(_text(column))) == "en"


def english_exactly(column: str = "lang") -> Column:
    """FLT19, for ranking."""
    return _text(column) == "en"


def common_languages(rows: DataFrame, least: int = 10, column: str = "language") -> DataFrame:
    """FLT20: rows of languages with at least so many rows over all splits."""
    enough = rows.groupBy(column).count().where(F.col("count") >= least).select(column)
    return rows.join(enough, column, "left_semi")


def valid_clusterings(grid: DataFrame, fewest: int = 5, most: int = 30) -> DataFrame:
    """FLT21."""
    return grid.where(F.col("dbcv").isNotNull() & F.col("n_clusters").between(fewest, most))


def answered(results: DataFrame, violating: str = "violating_response", compliant: str = "compliant_response") -> DataFrame:
    """FLT22: both responses are there."""
    return results.where((_text(violating) != "") & (_text(compliant) != ""))
