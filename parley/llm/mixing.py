"""Mixing sources to target weights: raking, then sampling by calibrated probabilities.

Tokens are counted in cells of source, language and topic. Iterative proportional
fitting finds a factor for each source, language and topic such that the weighted
tokens meet the targets of all three marginals; a document's weight is the product of
its factors. Probabilities are proportional to weights, with those that would exceed
one held there and the others raised, so that the expected tokens meet the budget; a
digest of the id decides.

Targets default to tempered shares: a marginal's token shares to a power. Of a marginal
for which some targets are given, the categories left out share what the given ones
leave, by their tempered shares: nothing, where the given ones sum to 1 (they then get
weight 0), and they may not sum to more. Where all categories are given, or those left
out hold no tokens, the given ones are scaled to sum to 1; given ones that no token has
are left out first. Cells are held as one row for each source with its languages and
topics, whose number MAX_CATEGORIES bounds; factors of sources are never collected.

Targets that cells without tokens make impossible cannot be met. The largest difference
between a marginal's share and its target after the last round is returned with the
factors, and a warning is given where it is over TOLERANCE.

Cases. Null source or language: a category of its own, `(none)`. Null text: no tokens,
topic `short`. A null id is decided by the text. Repeated rows: decided alike, each
counted. Categories without tokens: weight 1. Empty table: no rows. Further columns of
any name are carried untouched by mix, and not looked at otherwise.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, column, packed, staged, unpacked

#: Powers of the marginals' token shares that targets default to, and the share of all tokens that is sampled.
TEMPER = {"source": 0.7, "lang": 0.5, "topic": 0.8}
BUDGET = 0.5
ROUNDS = 10
CALIBRATIONS = 8
MAX_CATEGORIES = 4096
#: A difference between a share and its target that is not warned of.
TOLERANCE = 1e-3
NONE = "(none)"


def topic_of(text: Column, n_tokens: Column) -> Column:
    """The default topic: a coarse kind of text."""
    low = F.lower(text)
    return F.when(low.contains("license") | low.contains("all rights reserved"), "notice").when(text.contains(" | "), "listing").when(n_tokens < 100, "short").when(n_tokens >= 1000, "long").otherwise("prose")


def with_cells(rows: DataFrame, text: str, source: Column, lang: Column) -> DataFrame:
    """rows with n_tokens (words), source, lang and topic as _n, _s, _l and _t."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.size(F.array_remove(F.split(t, WHITE), "")).cast("bigint")
    counted = rows.select("*", n.alias("_n"), F.coalesce(source, F.lit(NONE)).alias("_s"), F.coalesce(lang, F.lit(NONE)).alias("_l"))
    return counted.withColumn("_t", topic_of(t, F.col("_n")))


def _lookup(factors: dict[str, float], key: str) -> Column:
    if not factors:
        return F.lit(1.0)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in factors.items() for x in kv]), F.col(key)), F.lit(1.0))


def _shares(sums: dict[str, float], power: float) -> dict[str, float]:
    raised = {k: v**power for k, v in sums.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def goals(sums: dict[str, float], power: float, given: dict[str, float] | None) -> dict[str, float]:
    """The target of each category with tokens, by those given and tempered shares."""
    given = {k: v for k, v in (given or {}).items() if sums.get(k, 0) > 0}
    if sum(given.values()) > 1 + 1e-9 or any(v < 0 for v in given.values()):
        raise ValueError("given targets may not be negative nor sum to more than 1")
    rest = _shares({k: v for k, v in sums.items() if k not in given}, power)
    left = 1 - sum(given.values())
    if not rest:
        return {k: v / sum(given.values()) for k, v in given.items()}
    return given | {k: v * max(0.0, left) for k, v in rest.items()}


def _source_goals(by_source: DataFrame, power: float, given: dict[str, float] | None) -> Column:
    """goals() as a column over a row for each source: sources are not collected."""
    given = given or {}
    held = F.col("_s").isin(list(given)) if given else F.lit(False)
    raised = F.pow(F.col("own"), F.lit(power))
    row = by_source.agg(F.sum(F.when(~held, raised)).alias("rest"), F.collect_set(F.when(held, F.col("_s"))).alias("held")).first()
    given = {k: v for k, v in given.items() if k in set(row["held"])}
    total = sum(given.values())
    if total > 1 + 1e-9 or any(v < 0 for v in given.values()):
        raise ValueError("given targets may not be negative nor sum to more than 1")
    if not row["rest"]:
        return _lookup({k: v / total for k, v in given.items()}, "_s")
    rest = raised / F.lit(float(row["rest"])) * F.lit(max(0.0, 1 - total)) if given else raised / F.lit(float(row["rest"]))
    return F.when(held, _lookup(given, "_s")).otherwise(rest) if given else rest


def rake(cells: DataFrame, temper: dict[str, float] = TEMPER, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, budget: float = BUDGET) -> tuple[DataFrame, dict[str, float], dict[str, float], float, float]:
    """cells (_s, _l, _t, _n): factors of sources as a table (_s, _a), of languages, of topics, the calibration, and the residual.

    targets: shares by category for `source`, `lang` and `topic`, each whole or in part.
    """
    targets = targets or {}
    by_source = cells.groupBy("_s").agg(F.collect_list(F.struct("_l", "_t", "_n")).alias("cells"), F.sum("_n").alias("own"))
    by_source = staged(by_source.where("own > 0"), "mix-cells")
    total = by_source.agg(F.sum("own")).first()
    if not total[0]:
        return by_source.select("_s", F.lit(1.0).alias("_a")), {}, {}, 1.0, 0.0
    flat = by_source.select("_s", "own", F.inline("cells"))

    def sums(rows: DataFrame, key: str) -> dict[str, float]:
        found = rows.groupBy(key).agg(F.sum("x").alias("x")).limit(MAX_CATEGORIES + 1).collect()
        if len(found) > MAX_CATEGORIES:
            raise ValueError(f"more than {MAX_CATEGORIES} categories")
        return {r[key]: float(r["x"]) for r in found}

    goal = {k: goals(sums(flat.withColumn("x", F.col("_n").cast("double")), c), temper[k], targets.get(k)) for k, c in (("lang", "_l"), ("topic", "_t"))}
    of_source = _source_goals(by_source, temper["source"], targets.get("source"))
    lang, topic = dict.fromkeys(goal["lang"], 1.0), dict.fromkeys(goal["topic"], 1.0)

    def sources(lang: dict, topic: dict) -> DataFrame:
        """Each source's factor that meets its target, the others as given."""
        by_lang, by_topic = (F.create_map(*[F.lit(x) for kv in f.items() for x in kv]) for f in (lang, topic))
        part = F.aggregate("cells", F.lit(0.0), lambda s, c: s + c["_n"] * F.coalesce(F.try_element_at(by_lang, c["_l"]), F.lit(1.0)) * F.coalesce(F.try_element_at(by_topic, c["_t"]), F.lit(1.0)))
        return by_source.select("_s", "cells", F.coalesce(F.try_divide(of_source, part), F.lit(0.0)).alias("_a"))

    for _ in range(rounds):
        weighed = sources(lang, topic).select("_a", F.inline("cells"))
        found = sums(weighed.withColumn("x", F.col("_a") * F.col("_n") * _lookup(lang, "_l") * _lookup(topic, "_t")), "_l")
        new = {k: f * goal["lang"].get(k, 0.0) / found[k] if found.get(k) else f for k, f in lang.items()}
        found = sums(weighed.withColumn("x", F.col("_a") * F.col("_n") * _lookup(new, "_l") * _lookup(topic, "_t")), "_t")
        lang, topic = new, {k: f * goal["topic"].get(k, 0.0) / found[k] if found.get(k) else f for k, f in topic.items()}
    last = sources(lang, topic)
    # Sources were met last: the residual is that of languages and topics.
    weighed = last.select("_a", F.inline("cells")).withColumn("x", F.col("_a") * F.col("_n") * _lookup(lang, "_l") * _lookup(topic, "_t"))
    residual = 0.0
    for key, wanted in (("_l", goal["lang"]), ("_t", goal["topic"])):
        got = sums(weighed, key)
        residual = max([residual, *(abs(got.get(k, 0.0) - v) for k, v in wanted.items())])
    if residual > TOLERANCE:
        warnings.warn(f"mixing: shares differ from their targets by up to {residual:.4f}", stacklevel=2)
    # Weights are relative to the corpus: 1 leaves a cell at its share.
    weighed = last.select("_a", F.inline("cells")).select("_n", (F.col("_a") * _lookup(lang, "_l") * _lookup(topic, "_t") * F.lit(float(total[0]))).alias("w"))
    scale, want = budget, budget * total[0]
    for _ in range(CALIBRATIONS):
        over = F.col("w") * F.lit(scale) >= 1
        row = weighed.agg(F.sum(F.when(over, F.col("_n"))), F.sum(F.when(~over, F.col("_n") * F.col("w")))).first()
        new = (want - (row[0] or 0)) / row[1] if row[1] else scale
        done = abs(new - scale) <= 1e-12 * scale
        scale = new
        if done:
            break
    return last.select("_s", (F.col("_a") * F.lit(float(total[0]))).alias("_a")), lang, topic, scale, residual


def _weighed(rows: DataFrame, factors: tuple[DataFrame, dict, dict, float, float], key: Column) -> DataFrame:
    """rows of with_cells with weight, probability and selected as _w, _p and _in. The join is a broadcast where the sources' size allows."""
    table, lang, topic, scale, _ = factors
    rows = rows.join(table.withColumnRenamed("_s", "_source"), F.col("_s") == F.col("_source"), "left").drop("_source")
    w = F.coalesce(F.col("_a"), F.lit(1.0)) * _lookup(lang, "_l") * _lookup(topic, "_t")
    u = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rows = rows.withColumn("_w", w).drop("_a")
    return rows.withColumn("_p", F.least(F.lit(1.0), F.col("_w") * F.lit(scale))).withColumn("_in", u < F.col("_p"))


def _cells(rows: DataFrame) -> DataFrame:
    return rows.groupBy("_s", "_l", "_t").agg(F.sum("_n").alias("_n"))


def _key(doc_id: Column, text: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), text, F.lit(""))


def mixing_weights(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability and selected of every document."""
    rows = packed(docs)
    rows = rows.select(column(rows, "doc_id", "bigint").alias("doc_id"), column(rows, "text", "string").alias("_text"), column(rows, "source", "string").alias("_src"), column(rows, "lang", "string").alias("_lng"))
    counted = with_cells(rows, "_text", F.col("_src"), F.col("_lng"))
    # A digest of the id, or of the text where there is none, stands for the text from here on.
    table = staged(counted.select("doc_id", "_s", "_l", "_t", "_n", F.when(F.col("doc_id").isNull(), F.col("_text")).alias("_text")), "mix-documents")
    found = _weighed(table, rake(_cells(table), **parameters), _key(F.col("doc_id"), F.col("_text")))
    return found.select("doc_id", F.col("_s").alias("source"), F.col("_l").alias("lang"), F.col("_t").alias("topic"), F.col("_n").alias("n_tokens"), F.round("_w", 6).alias("weight"), F.round("_p", 9).alias("probability"), F.col("_in").alias("selected"))


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """The sampled documents; their columns as they were."""
    rows = packed(docs)
    text, doc_id = column(rows, "text", "string"), column(rows, "doc_id", "string")
    counted = with_cells(rows.select("_row", text.alias("_text")), "_text", column(rows, "source", "string"), column(rows, "lang", "string"))
    return unpacked(_weighed(counted, rake(_cells(counted), **parameters), _key(doc_id, F.col("_text"))).where("_in"))


def oracle() -> str:
    """The same in DuckDB's SQL, rounds unrolled, for the default targets."""
    steps = [r"""
d AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '(none)') AS s, coalesce(lang, '(none)') AS l, n,
         CASE WHEN contains(lower(t), 'license') OR contains(lower(t), 'all rights reserved') THEN 'notice' WHEN contains(t, ' | ') THEN 'listing'
              WHEN n < 100 THEN 'short' WHEN n >= 1000 THEN 'long' ELSE 'prose' END AS t,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM (SELECT *, coalesce(text, '') AS t, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n FROM documents)),
total AS MATERIALIZED (SELECT sum(n)::DOUBLE AS n FROM d)""",
        "c0 AS MATERIALIZED (SELECT s, l, t, sum(n)::DOUBLE AS n, sum(n)::DOUBLE AS w FROM d GROUP BY ALL HAVING sum(n) > 0)"]
    for k, power in zip("slt", TEMPER.values(), strict=True):
        steps.append(f"g_{k} AS MATERIALIZED (SELECT {k}, pow(n, {power}) / sum(pow(n, {power})) OVER () AS g FROM (SELECT {k}, sum(n) AS n FROM c0 GROUP BY {k}))")
    now = 0
    for k in [*("slt" * ROUNDS), "s"]:
        steps.append(f"c{now + 1} AS MATERIALIZED (SELECT s, l, t, n, w * g / sum(w) OVER (PARTITION BY {k}) AS w FROM c{now} JOIN g_{k} USING ({k}))")
        now += 1
    steps.append(f"m AS MATERIALIZED (SELECT s, l, t, c.n, w / c.n * total.n AS w FROM c{now} c, total)")
    steps.append(f"k0 AS MATERIALIZED (SELECT {BUDGET}::DOUBLE AS k)")
    for i in range(CALIBRATIONS):
        steps.append(f"k{i + 1} AS MATERIALIZED (SELECT ({BUDGET} * (SELECT n FROM total) - coalesce(sum(n) FILTER (w * k >= 1), 0)) / sum(n * w) FILTER (w * k < 1) AS k FROM m, k{i})")
    return f"WITH {', '.join(steps)} SELECT doc_id, s AS source, l AS lang, t AS topic, d.n AS n_tokens, round(coalesce(w, 1), 6) AS weight, round(least(1.0, coalesce(w, 1) * k), 9) AS probability, u < least(1.0, coalesce(w, 1) * k) AS selected FROM d LEFT JOIN m USING (s, l, t), k{CALIBRATIONS}"
