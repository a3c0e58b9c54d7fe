"""Model calls behind interfaces (MOD1-MOD4, SIM4, SNK12): what a model or a service returns is a table like any other.

Each takes a factory, called once in each Python worker, so that a model is loaded once.
Test doubles are deterministic and need no model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.batches import text_slices


#: Fixed value: what a second model goes on from.
ANSWER_PHRASE = "\n\nFinal Choice:"


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Judge(Protocol):
    def judge(self, prompts: list[str]) -> list[str]: ...


class Generator(Protocol):
    def generate(self, prompts: list[str], max_tokens: int) -> list[str]: ...


class Fetcher(Protocol):
    def fetch(self, urls: list[str]) -> list[tuple[bool, str | None]]: ...


class HashEmbedder:
    """Feature hashing of words to a vector of length one."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        import zlib

        import numpy as np

        out = np.zeros((len(texts), self.size))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % self.size] += 1 if h & 0x80000000 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()


class LengthJudge:
    """(a) for texts of even length: a test double."""

    def judge(self, prompts: list[str]) -> list[str]:
        return ["(a)" if len(p) % 2 == 0 else "(b)" for p in prompts]


class EchoGenerator:
    """The prompt's last line: a test double."""

    def generate(self, prompts: list[str], max_tokens: int) -> list[str]:
        return [p.rsplit("\n", 1)[-1][: 4 * max_tokens] for p in prompts]


class NoFetcher:
    """Every item is missing: what an offline run sees."""

    def fetch(self, urls: list[str]) -> list[tuple[bool, str | None]]:
        return [(False, "404 not found")] * len(urls)


def _mapped(rows: DataFrame, column: str, into: str, kind: str, factory: Callable[[], object], call: Callable[[object, list], list]) -> DataFrame:
    into_kind = to_arrow_type(T._parse_datatype_string(kind))

    @F.arrow_udf(kind)
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = factory()
        for part in parts:
            for texts in text_slices(part):
                yield pa.array(call(model, texts.fill_null("").to_pylist()), into_kind)

    return rows.withColumn(into, run(F.col(column)))


def embedded(rows: DataFrame, factory: Callable[[], Embedder] = HashEmbedder, column: str = "text", into: str = "embedding") -> DataFrame:
    """MOD1: vectors of length one, float."""
    return _mapped(rows, column, into, "array<float>", factory, lambda m, t: m.embed(t))


def judged(rows: DataFrame, factory: Callable[[], Judge] = LengthJudge, column: str = "prompt") -> DataFrame:
    """MOD2: verdicts and whether they pass; keep those that do with a semi-join, and communities left empty vanish."""
    from .filters import verified

    return _mapped(rows, column, "verdict", "string", factory, lambda m, t: m.judge(t)).withColumn("passed", verified())


def generated(rows: DataFrame, factory: Callable[[], Generator] = EchoGenerator, column: str = "prompt", tokens: int = 4096, answer_tokens: int = 10) -> DataFrame:
    """MOD3: reasoning, then an answer begun after it, then the choice it names."""
    from ..functions.text import answer_choice, closed_thinking

    first = _mapped(rows, column, "reasoning", "string", factory, lambda m, t: m.generate(t, tokens))
    first = first.withColumn("_prefilled", F.concat(F.col(column), closed_thinking(F.col(column), F.col("reasoning")), F.lit("\nAnswer: (")))
    second = _mapped(first, "_prefilled", "answer", "string", factory, lambda m, t: m.generate(t, answer_tokens))
    return second.withColumn("prediction", answer_choice(F.concat(F.lit("("), F.col("answer")))).drop("_prefilled")


def extracted(rows: DataFrame, factory: Callable[[], Generator] = EchoGenerator, prompt: str = "prompt", content: str = "content", tokens: int = 10) -> DataFrame:
    """MOD4: a second model's short answer after a service's content, which may have left its thinking open, and the choice it names."""
    from ..functions.text import answer_choice, closed_thinking

    first = rows.withColumn("_prefilled", F.concat(F.col(prompt), closed_thinking(F.col(prompt), F.col(content)), F.lit(ANSWER_PHRASE)))
    second = _mapped(first, "_prefilled", "answer", "string", factory, lambda m, t: m.generate(t, tokens))
    return second.withColumn("prediction", answer_choice(F.col("answer"))).drop("_prefilled")


def fetched(plan: DataFrame, factory: Callable[[], Fetcher] = NoFetcher) -> DataFrame:
    """SNK12: success and error of each item of a media plan."""
    rows = _mapped(plan, "url", "_r", "array<string>", factory, lambda m, u: [[str(a), b] for a, b in m.fetch(u)])
    return rows.withColumns({"success": F.col("_r")[0].cast("boolean"), "error": F.col("_r")[1]}).drop("_r")


def token_lengths(rows: DataFrame, factory: Callable[[], Callable[[list[str]], list[int]]], column: str = "text") -> DataFrame:
    """SIM4: lengths only; the factory gives a function from texts to lengths."""
    return _mapped(rows, column, "n_tokens", "long", factory, lambda m, t: m(t))
