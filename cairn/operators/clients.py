"""Model clients: batches of rows to a callable that reaches a model, with retries, counts that must fit, and a memo.

The engine has no network of its own: a caller gives a callable (an HTTP client, an ONNX session, a stub in tests) that can
be sent to the workers. Texts of a partition go to it in batches; a call that raises is repeated after a pause that doubles,
and an answer of the wrong length is an error. A worker asks for each distinct text once.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

#: Texts in a call, attempts, and the first pause and the longest in seconds.
BATCH, ATTEMPTS, PAUSE, LONGEST = 5, 5, 0.2, 10.0
#: Answers that a worker remembers.
MEMO = 10_000


def parts(items: list, size: int) -> list[list]:
    """The items in order, size at a time."""
    return [items[i : i + size] for i in range(0, len(items), size)]


def persistent(call: Callable, *args: object, attempts: int = ATTEMPTS, pause: float = PAUSE, wait: Callable[[float], None] = time.sleep) -> object:
    """What call gives, tried again after pauses that double; the last error if no attempt succeeds."""
    for attempt in range(1, attempts + 1):
        try:
            return call(*args)
        except Exception:
            if attempt == attempts:
                raise
            wait(min(pause * 2 ** (attempt - 1), LONGEST))
    raise ValueError("no attempt was allowed")


def answers(call: Callable[[list[str]], list], texts: list[str], known: dict, size: int = BATCH, **retry: object) -> list:
    """One answer a text, in order; texts that known has are not asked again."""
    new = [t for t in dict.fromkeys(texts) if t not in known]
    if len(known) + len(new) > MEMO:
        for t in [t for t in known if t not in set(texts)]:
            del known[t]
    for batch in parts(new, size):
        got = persistent(call, batch, **retry)
        if len(got) != len(batch):
            raise ValueError(f"{len(got)} answers to {len(batch)} texts")
        known.update(zip(batch, got, strict=True))
    return [known[t] for t in texts]


def embedder(call: Callable[[list[str]], list[list[float]]], size: int = BATCH, **retry: object) -> Callable[[DataFrame, str, str], DataFrame]:
    """An embedder for the library: adds a vector column from the callable. Null texts are empty ones."""

    def embed(rows: DataFrame, text: str, to: str) -> DataFrame:
        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known: dict = {}
            for batch in batches:
                batch[to] = [[float(x) for x in v] for v in answers(call, batch[text].fillna("").tolist(), known, size, **retry)]
                yield batch

        return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField(to, ArrayType(FloatType()))]))

    return embed


def judged(rows: DataFrame, call: Callable[[str, list[str]], list[tuple[int, float]]], query: str = "query", passage: str = "content", to: str = "model_score", per: str = "query_id", **retry: object) -> DataFrame:
    """rows with a model's score of their passage for their query: one call a query, of at most the over-fetch of rows.

    The callable returns (place of the passage, score). Passages that it leaves out score 0; where it fails to the end,
    all rows of the query have null, which rerank.stage takes as a sign to fall back on the search.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        try:
            said = dict(persistent(call, str(group[query].iloc[0]), group[passage].fillna("").tolist(), **retry))
            group[to] = [float(said.get(i, 0.0)) for i in range(len(group))]
        except Exception:
            group[to] = pd.Series([None] * len(group), dtype="object", index=group.index)
        return group

    return rows.groupBy(per).applyInPandas(run, StructType([*rows.schema.fields, StructField(to, DoubleType())]))


def streamed(lines: Iterable[str]) -> dict:
    """A chat completion from the lines of its event stream: content, tool calls by their number, and why it ended."""
    content, calls, finish = [], {}, None
    for line in lines:
        if not line.startswith("data:"):
            continue
        body = line[5:].strip()
        if body == "[DONE]":
            break
        try:
            choices = json.loads(body).get("choices") or []
        except ValueError:
            continue
        for choice in choices:
            delta = choice.get("delta") or {}
            content.append(delta.get("content") or "")
            finish = choice.get("finish_reason") or finish
            for part in delta.get("tool_calls") or []:
                call = calls.setdefault(part.get("index", len(calls)), {"id": "", "name": "", "arguments": ""})
                said = part.get("function") or {}
                call["id"] = part.get("id") or call["id"]
                call["name"] += said.get("name") or ""
                call["arguments"] += said.get("arguments") or ""
    return {"content": "".join(content), "calls": [calls[i] for i in sorted(calls)], "finish": finish}


def tool_counts(steps: DataFrame) -> DataFrame:
    """Per tool of the steps (tool, success): how often it ran and how often it failed."""
    return steps.groupBy("tool").agg(F.count("*").alias("runs"), F.sum((~F.col("success")).cast("int")).alias("failures"))
