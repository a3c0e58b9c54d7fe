"""String, URL and date functions (STR1-STR19, DAT1, FLT16): Column in, Column out."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import text_slices

# Tokens whose presence in a name marks a bot; media hosts and extensions.
BOT_MARKS = ("bot", "automod", "automoderator", "modteam", "-modteam", "removal", "helper", "reminder", "converter", "translator")
GONE = ("[deleted]", "[removed]")
VIDEO_DOMAINS = ("v.redd.it", "youtube.com", "youtu.be", "vimeo.com", "streamable.com", "twitch.tv", "clips.twitch.tv", "tiktok.com", "instagram.com", "dailymotion.com")
BARE_IMAGE_HOSTS = ("imgur.com", "i.imgur.com", "giphy.com", "gfycat.com")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "webp", "bmp")
#: Parts of a prompt's context, and which of them need another.
CONTEXT_FLAGS = ("submission", "media", "discussion", "user")
CONTEXT_NEEDS = {"media": "submission"}
_FLAGS = "struct<" + ",".join(f"include_{f}:boolean" for f in CONTEXT_FLAGS) + ">"
#: Answer formats, the first that matches wins.
ANSWER_FORMS = (
    r"\(([a-z])\)",
    r"\b(?:answer|choice|option)\s*[:\-]\s*\(?([a-z])\)?\b",
    r"\b(?:answer|choice)\s+(?:is\s+)?(?:option\s+)?\(?([a-z])\)?\b",
    r"\boption\s+([a-z])\b",
    r"^\s*([a-z])\)",
    r"^\s*([a-z])\.",
    r"^\s*([a-z])\s*$",
)


def any_of(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def strip_kind(x: Column, kind: str) -> Column:
    """STR1: an id without its kind prefix (`t1_`, `t3_`); empty or null gives null, a bare prefix an empty string."""
    return F.when(x != "", F.regexp_replace(x, f"^{kind}_", ""))


def community_name(x: Column) -> Column:
    """STR2: `r/` off, lower case, trimmed; null gives an empty string."""
    return F.coalesce(F.trim(F.lower(F.regexp_replace(x, "^r/", ""))), F.lit(""))


def _squeezed(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), r"(?U)^\s+|\s+$", "")


def unescape_html() -> Column:
    """An Arrow function for HTML entities, for which there is no built-in."""
    @F.arrow_udf("string")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            for texts in text_slices(part):
                yield pa.array([html.unescape(t) if t and "&" in t else t for t in texts.to_pylist()], pa.string())

    return run


def clean_markup(x: Column, entities: bool = True) -> Column:
    """STR3: text without entities, tags, links, emphasis, headers, code and rule prefixes, in that order.

    entities=False leaves entities as they are and stays in built-in functions.
    """
    t = F.coalesce(x, F.lit(""))
    if entities:
        t = unescape_html()(t)
    for pattern, into in (
        (r"<[^>]+>", ""),
        (r"\[([^\]]+)\]\([^\)]+\)", "$1"),
        (r"(?U)https?://[^\s]+", ""),
        (r"\*\*([^\*]+)\*\*", "$1"),
        (r"\*([^\*]+)\*", "$1"),
        (r"(?mU)^#+\s*", ""),
        (r"```[^`]*```", ""),
        (r"`([^`]+)`", "$1"),
    ):
        t = F.regexp_replace(t, pattern, into)
    cut = F.regexp_replace(t, r"(?iU)^Rule\s*\d+[\.\w]*\s*[:\-\.]\s+", "")
    cut = F.regexp_replace(cut, r"(?iU)^General\s*[:\-\.]\s+", "")
    return _squeezed(F.when(_squeezed(cut) == "", t).otherwise(cut))


def rule_text(name: Column, description: Column, violation: Column) -> Column:
    """STR4: a rule in full; the violation's line only where there is one."""
    has = F.coalesce(violation, F.lit("")) != ""
    body = F.concat(F.lit("Rule: "), F.regexp_replace(F.coalesce(name, F.lit("")), r"\.+$", ""), F.lit(". "), F.coalesce(description, F.lit("")))
    return F.when(has, F.concat(F.lit("Violation: "), violation, F.lit("\n"), body)).otherwise(body)


def language_root(x: Column, unknown: str | None = None) -> Column:
    """STR5: what stands before the first `-` or `_`; an empty code gives unknown, if set."""
    root = F.split_part(F.replace(x, F.lit("_"), F.lit("-")), F.lit("-"), F.lit(1))
    return root if unknown is None else F.when(F.coalesce(x, F.lit("")) == "", F.lit(unknown)).otherwise(root)


def without_mentions(x: Column) -> Column:
    """STR6: `u/name` removed, wherever it stands."""
    return F.regexp_replace(x, r"(?U)u/\w+", "")


def answer_choice(x: Column) -> Column:
    """STR7: `(a)` for the answer a reply names, or an empty string. An unclosed thinking block is no answer."""
    t = F.regexp_replace(F.coalesce(x, F.lit("")), r"(?is)<think>.*?</think>(?U)\s*", "")
    t = F.when(F.lower(t).contains("<think>"), F.lit("")).otherwise(F.lower(F.regexp_replace(t, r"(?U)^\s+|\s+$", "")))
    letter = F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in ANSWER_FORMS], F.lit(""))
    return F.when(letter == "", "").otherwise(F.concat(F.lit("("), letter, F.lit(")")))


def closed_thinking(prompt: Column, reply: Column) -> Column:
    """STR8: the reply with its dangling thinking block closed."""
    both = F.lower(F.concat(F.coalesce(prompt, F.lit("")), reply))
    dangling = both.contains("<think>") & ~both.contains("</think>") & (reply != "")
    return F.when(dangling, F.concat(F.regexp_replace(reply, r"(?U)\s+$", ""), F.lit("\n</think>\n\n"))).otherwise(reply)


def rationale(trace: Column, completion: Column, raw: Column) -> Column:
    """STR9: the first of a trace, the thinking in a completion, the reasoning in raw content, raw content."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    trace, completion, raw = (F.coalesce(c, F.lit("")) for c in (trace, completion, raw))
    inside = F.substring_index(F.regexp_replace(raw, r"(?s)^.*?<reasoning>", ""), "</reasoning>", 1)
    return F.when(strip(trace) != "", strip(trace)).when(completion.contains("</think>"), strip(F.substring_index(completion, "</think>", 1))).when(raw.contains("<reasoning>") & raw.contains("</reasoning>"), strip(inside)).otherwise(strip(raw))


def run_slug(x: Column) -> Column:
    """STR10: lower case, anything but letters and digits as a dash."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-")


def run_suffix(*parts: Column) -> Column:
    return F.concat_ws("-", *[F.nullif(run_slug(p), F.lit("")) for p in parts])


def media_id(x: Column, longest: int = 50) -> Column:
    """STR11: path characters as underscores, cut."""
    return F.substring(F.translate(x, "|/\\", "___"), 1, longest)


def error_category(x: Column) -> Column:
    """STR12: the first that fits; numbers are looked for as written, words in any case."""
    low = F.lower(x)
    return (
        F.when(x.contains("404") | low.contains("not found"), "404_not_found")
        .when(x.contains("403") | low.contains("forbidden"), "403_forbidden")
        .when(x.contains("429") | low.contains("too many"), "429_rate_limited")
        .when(low.contains("timeout"), "timeout")
        .when(low.contains("connection"), "connection_error")
        .when(low.contains("ssl") | low.contains("certificate"), "ssl_error")
        .when(low.contains("content-type"), "invalid_content_type")
        .otherwise("other_error")
    )


def url_host(x: Column) -> Column:
    """STR13: what stands between `://` and the next `/`, `?` or `#`, in lower case."""
    return F.lower(F.regexp_extract(x, r"^[^:/?#]+://([^/?#]*)", 1))


def url_path(x: Column) -> Column:
    return F.lower(F.regexp_extract(x, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1))


def url_extension(x: Column) -> Column:
    """STR13: an image extension, or null."""
    last = F.element_at(F.split(url_path(x), r"\."), -1)
    return F.when(url_path(x).contains(".") & last.isin(*IMAGE_EXTENSIONS), last)


def is_video_url(x: Column) -> Column:
    return any_of([url_host(x).contains(d) for d in VIDEO_DOMAINS])


def is_media_url(x: Column) -> Column:
    host = url_host(x)
    barred = is_video_url(x) | x.contains("reddit.com/gallery/") | (host.contains("reddit.com") & ~host.contains("i.redd.it"))
    return ~barred & (url_extension(x).isNotNull() | any_of([host.contains(h) for h in BARE_IMAGE_HOSTS]))


def plain_ampersands(x: Column) -> Column:
    """STR14."""
    return F.replace(x, F.lit("&amp;"), F.lit("&"))


def delta_text(value: Column, before: Column) -> Column:
    """STR15: `x.x (±d.d)`, the difference being that of the rounded values."""
    a, b = F.bround(value, 1), F.bround(before, 1)
    d = F.bround(a - b, 1)
    sign = F.when(d >= 0, "+").otherwise("")
    return F.when(before.isNull(), F.format_string("%.1f", a)).otherwise(F.concat(F.format_string("%.1f", a), F.lit(" ("), sign, F.format_string("%.1f", d), F.lit(")")))


def name_bucket(x: Column) -> Column:
    """STR16: a name's first letter or digit, in lower case, else an underscore."""
    c = F.lower(F.substring(x, 1, 1))
    return F.when(c.rlike("^[a-z0-9]$"), c).otherwise("_")


def label_overrides(lines: DataFrame, value: str = "value", at: str = "seq") -> DataFrame:
    """STR17: (cluster_id, label) of `ID: LABEL` lines; `#` starts a comment, lines that do not parse are skipped, later lines win."""
    t = F.trim(F.col(value))
    parts = F.split(t, ":", 2)
    rows = lines.where((t != "") & ~t.startswith("#") & t.contains(":")).select(F.expr("try_cast(trim(split(trim(`%s`), ':', 2)[0]) AS INT)" % value).alias("cluster_id"), F.trim(F.get(parts, F.lit(1))).alias("label"), F.col(at).alias("_at"))
    return rows.where("cluster_id IS NOT NULL AND label <> ''").groupBy("cluster_id").agg(F.max_by("label", "_at").alias("label"))


def cluster_label(x: Column) -> Column:
    """STR18: the first line, quotes off, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.trim(F.substring_index(F.trim(x), "\n", 1)), "^[\"']+|[\"']+$", "")))


def bot_author(x: Column) -> Column:
    """FLT3: nobody, or a name with a bot's mark in it."""
    low = F.lower(F.coalesce(x, F.lit("")))
    return (low == "") | low.isin(*GONE) | any_of([low.contains(m) for m in BOT_MARKS])


def posted_at(x: Column) -> Column:
    """DAT1: seconds since the epoch as `Thu, Jan 1, 1970, 12:00AM` in the session's time zone."""
    return F.replace(F.date_format(F.timestamp_seconds(x), "EEE, MMM dd, yyyy, hh:mma"), F.lit(" 0"), F.lit(" "))


def context_flags(x: Column) -> Column:
    """STR19: a struct of one boolean for each of CONTEXT_FLAGS, from names joined by dashes; `none` names none.

    Other names, and one without the flag it depends on, are errors.
    """
    given = F.split(x, "-")
    odd = F.filter(given, lambda f: ~f.isin(*CONTEXT_FLAGS, "none"))
    has = lambda f: F.array_contains(given, f)
    wrong = F.when(F.size(odd) > 0, F.concat(F.lit("invalid context flags: "), F.array_join(odd, ", ")))
    for flag, needed in CONTEXT_NEEDS.items():
        wrong = wrong.when(has(flag) & ~has(needed), F.lit(f"context flag {flag} needs {needed}"))
    return F.when(wrong.isNull(), F.struct(*[has(f).alias(f"include_{f}") for f in CONTEXT_FLAGS])).otherwise(F.raise_error(wrong).cast(_FLAGS))


def in_months(ym: Column, first: str, last: str) -> Column:
    """DAT2: `YYYY-MM` between two, both included."""
    return ym.between(first, last)


def seconds(x: Column) -> Column:
    """A time given as a whole or fractional number or numeric text; anything else is 0."""
    return F.coalesce(x.try_cast("double").cast("bigint"), F.lit(0))
