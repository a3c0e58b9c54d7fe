"""Prompt blocks and authors' names (PRJ1-PRJ3, MOD5-MOD6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as S

MARKER = "<|body|>"


def user_names(submission_author: Column, thread: Column) -> Column:
    """PRJ2: distinct authors in order of appearance, the submission's first."""
    return F.array_distinct(F.concat(F.array(submission_author), F.transform(thread, lambda c: c["author"])))


def user_name(names: Column, author: Column) -> Column:
    """PRJ2: `USER1` for the first author."""
    return F.concat(F.lit("USER"), F.array_position(names, author).cast("string"))


def rules_block(rules: Column) -> Column:
    """PRJ1: numbered rules."""
    return F.array_join(F.transform(rules, lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r)), "\n")


def options_block(options: Column) -> Column:
    """PRJ1: labelled answers, a line each."""
    return F.array_join(F.transform(options, lambda o: F.concat_ws(" ", o["label"], o["rule"])), "\n")


def thread_block(thread: Column, names: Column) -> Column:
    """PRJ1: a thread root to leaf, indented by level, authors by number and mentions out; a comment without text keeps its line."""
    line = lambda c: F.concat(F.repeat(F.lit("  "), c["level"]), F.lit("["), user_name(names, c["author"]), F.lit("]: "), S.without_mentions(F.coalesce(c["body"], F.lit(""))))
    return F.array_join(F.transform(thread, line), "\n")


def submission_block(title: Column, body: Column, author: Column, names: Column, created: Column) -> Column:
    """PRJ1, DAT1: title, author and time, then the body where there is one."""
    head = F.concat_ws("\n", F.concat(F.lit("Title: "), title), F.concat(F.lit("By "), user_name(names, author), F.lit(" on "), S.posted_at(created)))
    return F.when(F.trim(F.coalesce(body, F.lit(""))) == "", head).otherwise(F.concat_ws("\n", head, body))


def community_block(name: Column, title: Column, description: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("r/"), name), F.nullif(F.trim(title), F.lit("")), F.nullif(F.trim(description), F.lit("")))


def prompt(*blocks: Column) -> Column:
    """MOD6: blocks that are there, a blank line between."""
    return F.concat_ws("\n\n", *[F.nullif(b, F.lit("")) for b in blocks])


def few_shot(examples: Column) -> Column:
    """PRJ1: examples (question, answer) before the question."""
    return F.array_join(F.transform(examples, lambda e, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit("\n"), e["question"], F.lit("\nAnswer: "), e["answer"])), "\n\n")


def around_images(text: Column, marker: str = MARKER) -> Column:
    """PRJ3: what stands before and after the first marker; all of it before where there is none."""
    parts = F.split(text, F.lit("\\Q" + marker + "\\E"), 2)
    return F.struct(parts[0].alias("before"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("after"))


def as_request(phrase: Column) -> Column:
    """MOD6: a phrase that thinks aloud as one that asks."""
    return F.regexp_replace(phrase, "^Let's", "Please")


def chat(messages: Column, prefill: Column | None = None) -> Column:
    """MOD5: (role, content) messages in a chat template, with the answer begun where prefill is given."""
    body = F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")
    return F.concat(body, F.lit("<|im_start|>assistant\n"), prefill if prefill is not None else F.lit(""))
