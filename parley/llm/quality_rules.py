"""Quality by weak supervision, in DataFrame functions only.

Rules look at counts of a text and vote good (1) or bad (-1), or abstain (0).
Expectation-maximisation over the patterns of votes (at most 3 to the number of
rules, whatever the input) estimates the share of good texts and how often each
rule, when it votes, calls a bad and a good text bad. The posterior probability that
a text is good then follows from its votes, and replaces a filter that all rules must
pass: a bad vote of a rule that often blames good texts weighs little.

Nothing is held fixed. Several rules look at the same fault from different sides (symbols
to words, symbols to characters, words with symbols, mean length of words), which is
what tells the accuracies from the balance. A pseudo-count of each outcome keeps
the rates off 0 and 1. Of the two classes the one that rules call bad less often, over
all rules, is the good one, whichever way the rounds went.

Cases. Null text: no words, so the base rule fails. Texts without white space are
one word. Empty table: no rows; the rules keep their first accuracies. Repeated
rows: one result each, each counted. A posterior at KEEP_FROM exactly: kept. Null ids are kept as they are. Further
columns of any name are carried untouched by keep_good, and not looked at
otherwise. Windows of words are compared by their 64-bit hashes within one text.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, column, packed, staged, unpacked

#: Counted symbols, ASCII white space as characters, least words and largest repeated share of the base rule.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
#: The posterior from which a document is kept.
KEEP_FROM = 0.5
ROUNDS = 40
#: Rates and a balance that moved by less than this have settled.
SETTLED = 1e-5
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = (*FEATURES, "n_lines", "n_marks", "n_marked")


#: name: (condition of a good vote, condition of a bad vote), in SQL. Between them a rule abstains.
RULES = {
    "length": ("n_words >= 100", "n_words < 20"),
    "symbols": ("n_symbols / greatest(n_words, 1) <= 0.02", "n_symbols / greatest(n_words, 1) > 0.1"),
    "symbol_chars": ("n_symbols / greatest(word_chars, 1) <= 0.002", "n_symbols / greatest(word_chars, 1) > 0.05"),
    "marked_words": ("n_marked / greatest(n_words, 1) <= 0.01", "n_marked / greatest(n_words, 1) > 0.25"),
    "word_length": ("word_chars / greatest(n_words, 1) BETWEEN 4.5 AND 6.5", "word_chars / greatest(n_words, 1) NOT BETWEEN 4.3 AND 7"),
    "repetition": ("n_repeat_words / greatest(n_words, 1) <= 0.05", "n_repeat_words / greatest(n_words, 1) > 0.25"),
    "lines": ("n_dup_lines = 0", "n_dup_lines / greatest(n_lines, 1) > 0.25"),
    "marks": ("n_marks / greatest(n_words, 1) <= 0.02", "n_marks / greatest(n_words, 1) > 0.2"),
}
#: Where the rounds begin: the share of good texts, and how often a rule that votes calls a bad and a good text bad.
BALANCE = 0.8
FIRST = (0.5, 0.05)
#: Added to the count of each of a rule's two votes, and of the two classes.
PSEUDO = 1.0


MARKED = rf"[{SYMBOLS}][^\x20\x09-\x0D]*"


def count_texts(rows: DataFrame, text: str) -> DataFrame:
    """rows with the counts of COUNTS for the text column, in three projections that each use the one before more than once."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, WHITE), "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    kept = [c for c in rows.columns]
    n = F.size("_w")
    less = F.greatest(n - 2, F.lit(0))
    triples = F.arrays_zip(F.slice("_w", 1, less).alias("a"), F.slice("_w", 2, less).alias("b"), F.slice("_w", 3, less).alias("c"))
    without = t
    for c in SYMBOLS:
        without = F.replace(without, F.lit(c), F.lit(""))
    first = rows.select(*kept, words.alias("_w"), lines.alias("_l"))
    second = first.select(
        *kept,
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        (F.length(t) - F.length(without)).cast("bigint").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        F.size("_l").cast("bigint").alias("n_lines"),
        (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).cast("bigint").alias("n_marks"),
        # From a word's first symbol to its end: one hit a word, in one pass.
        F.regexp_count(t, F.lit(MARKED)).cast("bigint").alias("n_marked"),
        F.transform(triples, lambda x: F.xxhash64(x["a"], x["b"], x["c"])).alias("_h"),
    )
    # Where a hash comes twice, hashes are sorted with their places; equal neighbours mark the places of repeated windows.
    by_hash = F.when(F.size("_h") > F.size(F.array_distinct("_h")), F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array())
    names = [*kept, *(c for c in COUNTS if c != "n_repeat_words")]
    third = second.select(*names, by_hash.alias("_s"))
    m = F.size("_s")
    equal = F.zip_with(F.slice("_s", 1, F.greatest(m - 1, F.lit(0))), F.slice("_s", 2, F.greatest(m - 1, F.lit(0))), lambda a, b: a["h"] == b["h"])
    fourth = third.select(*names, "_s", F.concat(F.array(F.lit(False)), equal).alias("_b"), F.concat(equal, F.array(F.lit(False))).alias("_f"))
    places = F.sort_array(F.transform(F.filter(F.arrays_zip(F.col("_s"), F.col("_b"), F.col("_f")), lambda x: (x["_b"] | x["_f"]) & x["_s"].isNotNull()), lambda x: x["_s"]["i"]))
    fifth = fourth.select(*names, places.alias("_p"))
    # A window covers three words, or as many as lie before the next window's first.
    k = F.size("_p")
    steps = F.zip_with(F.slice("_p", 1, F.greatest(k - 1, F.lit(0))), F.slice("_p", 2, F.greatest(k - 1, F.lit(0))), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.when(k > 0, F.aggregate(steps, F.lit(3), lambda x, y: x + y)).otherwise(F.lit(0))
    return fifth.select(*names, covered.cast("bigint").alias("n_repeat_words"))


def vote() -> list[Column]:
    return [F.when(F.expr(bad), F.lit(-1)).when(F.expr(good), F.lit(1)).otherwise(F.lit(0)).cast("tinyint").alias(f"v_{name}") for name, (good, bad) in RULES.items()]


Rates = dict[str, tuple[float, float]]


def posterior(rates: Rates, balance: float) -> Column:
    """Probability that a document is good, given its votes. rates: of bad votes on bad and on good texts, by rule."""
    odds = F.lit(log(balance / (1 - balance)))
    for name, (caught, blamed) in rates.items():
        v = F.col(f"v_{name}")
        odds = odds + F.when(v == -1, F.lit(log(blamed / caught))).when(v == 1, F.lit(log((1 - blamed) / (1 - caught)))).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def _round(patterns: list[tuple[tuple[int, ...], int]], rates: Rates, balance: float) -> tuple[Rates, float]:
    """One round of expectation-maximisation over counted patterns."""
    weights = [(log(blamed / caught), log((1 - blamed) / (1 - caught))) for caught, blamed in rates.values()]
    prior = log(balance / (1 - balance))
    bad, voted = [[0.0, 0.0] for _ in rates], [[0.0, 0.0] for _ in rates]
    total = good = 0.0
    for votes, n in patterns:
        odds = prior + sum(w[0] if v == -1 else w[1] if v == 1 else 0.0 for v, w in zip(votes, weights, strict=True))
        p = 1.0 / (1.0 + exp(-odds))
        total, good = total + n, good + n * p
        for i, v in enumerate(votes):
            if v:
                for k, share in enumerate((1 - p, p)):
                    voted[i][k] += n * share
                    bad[i][k] += n * share if v == -1 else 0.0
    rate = lambda part, whole: (part + PSEUDO) / (whole + 2 * PSEUDO)
    return {name: (rate(b[0], a[0]), rate(b[1], a[1])) for name, b, a in zip(rates, bad, voted, strict=True)}, rate(good, total)


def fit_rates(votes: DataFrame, rounds: int = ROUNDS, first: tuple[float, float] = FIRST, balance: float = BALANCE) -> tuple[Rates, float]:
    """How often each rule, when it votes, calls a bad and a good text bad, and the share of good texts, by expectation-maximisation over counted patterns.

    votes: columns v_<rule>, any rules. Spark counts the patterns in one aggregate; the driver gets these counts alone, 3 to the number of rules at most.
    """
    names = [c.removeprefix("v_") for c in votes.columns if c.startswith("v_")]
    counted = votes.groupBy(*[f"v_{n}" for n in names]).agg(F.count("*").alias("_n")).collect()
    patterns = sorted((tuple(r[f"v_{n}"] for n in names), r["_n"]) for r in counted)
    rates = dict.fromkeys(names, first)
    for _ in range(rounds):
        new, share = _round(patterns, rates, balance)
        moved = max([abs(share - balance), *(abs(x - y) for n in names for x, y in zip(new[n], rates[n], strict=True))])
        rates, balance = new, share
        if moved < SETTLED:
            break
    if sum(caught - blamed for caught, blamed in rates.values()) < 0:
        rates, balance = {n: (blamed, caught) for n, (caught, blamed) in rates.items()}, 1 - balance
    return rates, balance


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def _judged(rows: DataFrame, name: str) -> DataFrame:
    """rows staged with counts and votes, then judged: texts are gone through once."""
    table = staged(rows.select("*", *vote()), name)
    p = posterior(*fit_rates(table.select(*[f"v_{n}" for n in RULES])))
    return table.select("*", p.alias("posterior"), base_failed().alias("base_failed")).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP_FROM))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and posterior of every document."""
    rows = packed(docs)
    rows = rows.select(column(rows, "doc_id", "bigint").alias("doc_id"), column(rows, "text", "string").alias("_text"))
    counted = count_texts(rows, "_text").select("doc_id", *COUNTS)
    return _judged(counted, "quality").select("doc_id", *FEATURES, "base_failed", "kept", F.round("posterior", 9).alias("posterior"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept; their columns as they were."""
    rows = packed(docs)
    rows = rows.select("_row", column(rows, "text", "string").alias("_text"))
    counted = count_texts(rows, "_text").select("_row", *COUNTS)
    return unpacked(_judged(counted, "quality").where("kept"))


def oracle() -> str:
    """The same in DuckDB's SQL, rounds unrolled; a round after the rates have settled keeps them."""
    steps = [
        r"""
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
k AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
c AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM k) WHERE n > 1) GROUP BY r),
f AS MATERIALIZED (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(l) AS BIGINT) AS n_lines, CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_marks, CAST(len(regexp_extract_all(t, '[#*$%&|<>][^\x20\x09-\x0D]*')) AS BIGINT) AS n_marked, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN c ON w.r = c.r)""",
        "v AS MATERIALIZED (SELECT *, " + ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v_{n}" for n, (good, bad) in RULES.items()) + " FROM f)",
        "p AS MATERIALIZED (SELECT " + ", ".join(f"v_{n}" for n in RULES) + ", count(*) AS n FROM v GROUP BY ALL)",
        "r0 AS MATERIALIZED (SELECT " + ", ".join(f"{FIRST[0]}::DOUBLE AS b_{n}, {FIRST[1]}::DOUBLE AS g_{n}" for n in RULES) + f", {BALANCE}::DOUBLE AS balance, FALSE AS done)",
    ]
    odds = "ln(balance / (1 - balance))" + "".join(f" + CASE v_{n} WHEN -1 THEN ln(g_{n} / b_{n}) WHEN 1 THEN ln((1 - g_{n}) / (1 - b_{n})) ELSE 0 END" for n in RULES)
    every = [*(f"{k}_{n}" for n in RULES for k in "bg"), "balance"]
    share = lambda part, whole: f"((coalesce({part}, 0) + {PSEUDO}) / (coalesce({whole}, 0) + {2 * PSEUDO}))::DOUBLE"
    for i in range(ROUNDS):
        steps.append(f"s{i} AS MATERIALIZED (SELECT p.*, r.*, 1 / (1 + exp(-({odds}))) AS q FROM p, r{i} r)")
        fresh = [share("sum(n * q)", "sum(n)") + " AS balance"]
        for n in RULES:
            for k, weight in {"b": "(1 - q)", "g": "q"}.items():
                fresh.append(share(f"sum(n * {weight}) FILTER (v_{n} = -1)", f"sum(n * {weight}) FILTER (v_{n} <> 0)") + f" AS {k}_{n}")
        steps.append(f"n{i} AS MATERIALIZED (SELECT {', '.join(fresh)} FROM s{i})")
        kept = ", ".join(f"CASE WHEN r.done THEN r.{c} ELSE n.{c} END AS {c}" for c in every)
        moved = ", ".join(f"abs(r.{c} - n.{c})" for c in every)
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT {kept}, r.done OR greatest({moved}) < {SETTLED} AS done FROM r{i} r, n{i} n)")
    swapped = " + ".join(f"b_{n} - g_{n}" for n in RULES) + " < 0"
    steps.append(f"fitted AS MATERIALIZED (SELECT {swapped} AS swapped, * FROM r{ROUNDS})")
    failed = f"(n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words)"
    judged = f"SELECT v.*, CASE WHEN swapped THEN 1 / (1 + exp({odds})) ELSE 1 / (1 + exp(-({odds}))) END AS q FROM v, fitted"
    return f"WITH {', '.join(steps)} SELECT doc_id, {', '.join(FEATURES)}, {failed} AS base_failed, NOT {failed} AND q >= {KEEP_FROM} AS kept, round(q, 9) AS posterior FROM ({judged})"
