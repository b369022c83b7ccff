"""JSON texts made readable; the only place where a value needs Python to be printed as the source would."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from tracewell.functions import text as X


def _pretty(s: str | None) -> str | None:
    try:
        return None if s is None else json.dumps(json.loads(s), indent=2, ensure_ascii=False)
    except ValueError:
        return s


def _output(s: str | None) -> str | None:
    """The texts of a JSON list of blocks, a JSON value made readable, or the text itself."""
    try:
        value = json.loads(s)
    except (ValueError, TypeError):
        return s
    if isinstance(value, list) and value and all(isinstance(b, dict) and isinstance(b.get("text"), str) for b in value):
        return _output("\n".join(b["text"] for b in value))
    return json.dumps(value, indent=2, ensure_ascii=False) if isinstance(value, dict | list) else s


@F.pandas_udf(T.StringType())
def pretty_json(s: pd.Series) -> pd.Series:
    return s.map(_pretty, na_action="ignore")


@F.pandas_udf(T.StringType())
def output_text(s: pd.Series) -> pd.Series:
    return s.map(_output, na_action="ignore")


def input_preview(input_json: Column) -> Column:
    return X.truncate(pretty_json(input_json), 100)


def result_preview(content: Column) -> Column:
    return X.truncate(output_text(content), 200)


def block_text(blocks: Column, thinking: bool = False) -> Column:
    """All that blocks say: texts, tool calls by name and input, results (their own text blocks too), and a mark for images."""
    kinds = ["text", "tool_use", "tool_result", "image"] + (["thinking"] if thinking else [])
    nested = lambda c: F.coalesce(F.array_join(F.transform(F.from_json(c, "array<struct<type:string,text:string>>"), lambda x: x["text"]), "\n"), F.lit(""))
    one = lambda b: (
        F.when(b["type"] == "text", b["text"]).when(b["type"] == "thinking", b["thinking"]).when(b["type"] == "image", F.lit("[Image]"))
        .when(b["type"] == "tool_use", F.concat(F.lit("Tool: "), b["name"], F.lit("\nInput: "), F.coalesce(b["input_json"], F.lit("{}"))))
        .when(b["type"] == "tool_result", F.when(b["content_json"].startswith("["), nested(b["content_json"])).otherwise(b["content_json"]))
    )
    return F.array_join(F.filter(F.transform(F.filter(blocks, lambda b: b["type"].isin(*kinds)), one), lambda s: s.isNotNull() & (s != "")), "\n")
