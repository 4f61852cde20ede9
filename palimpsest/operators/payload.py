"""Chat and response payloads (JSON strings): their texts as rows, and payloads with new texts.

A payload's texts become rows (payload key, path, text), go through the column operators like any other text, and come back as
one map for each payload. Texts at fixed places are read by expressions over VARIANT; only the descriptions of tools, at any
depth, and the rewriting, which keeps the order of fields and the form of numbers, are in Python, in Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .variants import at, items, let, string_at

TEXT = "array<struct<path:string,text:string>>"


def _descriptions(node: Any, path: str) -> Iterator[tuple[str, str]]:
    if isinstance(node, dict):
        for k, v in node.items():
            if k == "description" and isinstance(v, str):
                yield f"{path}/{k}", v
            else:
                yield from _descriptions(v, f"{path}/{k}")
    elif isinstance(node, list):
        for i, v in enumerate(node):
            yield from _descriptions(v, f"{path}/{i}")


def _read(body: str | None) -> dict:
    try:
        found = json.loads(body or "")
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def _tool_texts(tools: Column) -> Column:
    @F.pandas_udf(TEXT)
    def tool_texts(trees: pd.Series) -> pd.Series:
        return trees.map(lambda t: [{"path": p, "text": x} for p, x in _descriptions(json.loads(t), "/tools")] if t else [])

    return tool_texts(tools)


def _one(path: Column, node: Column, way: str) -> Column:
    """An array of the string at a way below a node, or none."""
    return F.filter(F.array(F.struct(path.alias("path"), string_at(node, way).alias("text"))), lambda x: x["text"].isNotNull()).cast(TEXT)


def _message_texts(m: Column, i: Column) -> Column:
    here = F.concat(F.lit("/messages/"), i.cast("string"))
    calls = F.transform(items(m, "$.tool_calls"), lambda c, j: _one(F.concat(here, F.lit("/tool_calls/"), j.cast("string"), F.lit("/function/arguments")), c, "$.function.arguments"))
    return F.concat(_one(F.concat(here, F.lit("/content")), m, "$.content"), _one(F.concat(here, F.lit("/function_call/arguments")), m, "$.function_call.arguments"), F.flatten(calls))


def _input_texts(m: Column, i: Column) -> Column:
    here = F.concat(F.lit("/input/"), i.cast("string"), F.lit("/content/"))
    return F.flatten(F.transform(items(m, "$.content"), lambda b, j: F.filter(_one(F.concat(here, j.cast("string"), F.lit("/text")), b, "$.text"), lambda _: F.coalesce(string_at(b, "$.type") == "input_text", F.lit(False)))))


def texts_of(body: Column, kind: str) -> Column:
    """array<struct<path, text>> of a payload, in the order in which a proxy reads them; empty for what is no JSON object."""

    def read(v: Column) -> Column:
        if kind == "chat":
            return F.flatten(F.transform(items(v, "$.messages"), _message_texts))
        return F.concat(_one(F.lit("/input"), v, "$.input"), F.flatten(F.transform(items(v, "$.input"), _input_texts)), _one(F.lit("/instructions"), v, "$.instructions"))

    parsed = F.try_parse_json(body)
    return F.concat(F.coalesce(let(parsed, read), F.array().cast(TEXT)), _tool_texts(F.to_json(at(parsed, "$.tools"))))


def with_texts(body: Column, new: Column) -> Column:
    """The payload with the texts of a map from paths."""

    @F.pandas_udf("string")
    def run(bodies: pd.Series, maps: pd.Series) -> pd.Series:
        return pd.Series([_replaced(b, dict(m) if m is not None else {}) for b, m in zip(bodies, maps)])

    return run(body, new)


def _replaced(body: str | None, new: dict[str, str]) -> str | None:
    payload = _read(body)
    if not payload:
        return body
    for path, text in new.items():
        *way, last = path.strip("/").split("/")
        node: Any = payload
        for step in way:
            node = node[int(step)] if isinstance(node, list) else node[step]
        node[int(last) if isinstance(node, list) else last] = text
    return json.dumps(payload, ensure_ascii=False, separators=(",", ":"))


def rewrite_payloads(df: DataFrame, key: str, body: str, kind: str, rewrite: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with sanitized_body. rewrite: takes (key, ord, path, text), adds sanitized_text, such as sanitize() or tokenize()."""
    rows = df.select(key, F.posexplode(texts_of(F.col(body), kind)).alias("ord", "t")).select(key, "ord", "t.path", "t.text")
    new = rewrite(rows).groupBy(F.col(key).alias("_key")).agg(F.map_from_entries(F.collect_list(F.struct("path", "sanitized_text"))).alias("_new"))
    met = df.join(new, F.col(key) == F.col("_key"), "left")
    return met.withColumn("sanitized_body", with_texts(F.col(body), F.col("_new"))).drop("_key", "_new")
