"""The text that markdown shows, as segments, and where a query occurs in it."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_FENCE = re.compile(r"^ {0,3}(```+|~~~+)")
_HEAD = re.compile(r"^ {0,3}#{1,6}\s+(.*?)\s*#*\s*$")
_ITEM = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+(.*)$")
_QUOTE = re.compile(r"^\s*>\s?(.*)$")
_RULE = re.compile(r"^ {0,3}(?:(?:-\s*){3,}|(?:\*\s*){3,}|(?:_\s*){3,})$")
_TABLE_RULE = re.compile(r"^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)*\|?\s*$")
_INLINE = [
    (re.compile(r"!\[[^\]]*\]\([^)]*\)"), ""), (re.compile(r"\[([^\]]*)\]\([^)]*\)"), r"\1"), (re.compile(r"<[^>\n]+>"), ""), (re.compile(r"`+([^`]*)`+"), r"\1"),
    (re.compile(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1"), r"\2"), (re.compile(r"(?<![\w*])[*_](?=\S)(.+?)(?<=\S)[*_](?![\w*])"), r"\1"), (re.compile(r"~~(.+?)~~"), r"\1"),
]


def _plain(line: str) -> str:
    for pattern, to in _INLINE:
        line = pattern.sub(to, line)
    return line.strip()


def segments(markdown: str) -> list[str]:
    """Shown text of each heading, paragraph, list item, quote, table cell and code block; raw HTML is left out."""
    out: list[str] = []
    paragraph: list[str] = []
    code: list[str] | None = None
    fence = ""

    def close():
        if paragraph:
            out.append(_plain(" ".join(paragraph)))
            paragraph.clear()

    for line in (markdown or "").split("\n"):
        if code is not None:
            if line.strip().startswith(fence):
                out.append("\n".join(code))
                code = None
            else:
                code.append(line)
            continue
        m = _FENCE.match(line)
        if m:
            close()
            code, fence = [], m[1]
        elif not line.strip() or _RULE.match(line) or _TABLE_RULE.match(line):
            close()
        elif m := _HEAD.match(line) or _ITEM.match(line) or _QUOTE.match(line):
            close()
            out.append(_plain(m[1]))
        elif line.strip().startswith("|"):
            close()
            out += [_plain(c) for c in line.strip().strip("|").split("|")]
        else:
            paragraph.append(line.strip())
    if code is not None:
        out.append("\n".join(code))
    close()
    return [s for s in out if s]


def count_matches(rows: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """(key, segments, matches): occurrences of a query in the shown text, none across segments."""
    kind, q = rows.schema[key].dataType.simpleString(), query.lower()

    def run(batches):
        for batch in batches:
            found = [segments(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array([sum(x.lower().count(q) for x in s) if q else 0 for s in found], pa.int64())], ["key", "segments", "matches"])

    return rows.select(F.col(key).alias("key"), F.col(text)).mapInArrow(run, f"key {kind}, segments long, matches long").withColumnRenamed("key", key)
