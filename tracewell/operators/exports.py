"""Sessions as plain text or Markdown, in parts that are written in order.

A part is some lines of one session: its head, a chunk's rule or heading, a block of a
reply, a tool with its result. Parts are ordered by their place, and an export is its
parts joined by line ends; so no session is gathered in one array, and a long one is
sorted and written by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.functions import formats, pretty
from tracewell.functions import text as X

# Fixed values, as all labels of the head and of the parts below: rules, and the length at which results are cut.
DOUBLE, SINGLE = "═" * 60, "─" * 40
RESULT_LENGTH = {"plaintext": 500, "markdown": 2000}
#: What a header takes: (label, column) of a session's sums.
METRICS = (("Total Tokens", "total_tokens"), ("Input Tokens", "input_tokens"), ("Output Tokens", "output_tokens"), ("Cache Read", "cache_read_tokens"), ("Cache Created", "cache_creation_tokens"), ("Messages", "message_count"))


def _lines(*parts: Column | str) -> Column:
    """Lines of one part; null lines are left out."""
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _part(df: DataFrame, by: list[str], place: list, text: Column) -> DataFrame:
    """place is (section, pos, step, line, block)."""
    order = F.struct(*[(F.lit(p) if isinstance(p, int) else p).cast("long").alias(f"p{i}") for i, p in enumerate(place)])
    return df.select(*by, order.alias("place"), text.alias("text"))


def _head(sessions: DataFrame, by: list[str], style: str) -> DataFrame:
    date = F.date_format("created", "yyyy-MM-dd HH:mm:ss 'UTC'")
    name = F.col(by[-1]).cast("string")
    values = [("Duration", formats.format_duration_whole(F.col("duration_ms"))), *[(label, F.format_number(c, 0)) for label, c in METRICS], ("Cost", F.lit("N/A"))]
    if style == "plaintext":
        own = [("Session:  ", name), ("Project:  ", F.col("project")), ("Branch:   ", F.nullif("branch", F.lit(""))), ("Date:     ", date)]
        sums = [F.concat(F.lit(f"{label}:".ljust(16)), v) for label, v in values]
        text = _lines(DOUBLE, "SESSION EXPORT", DOUBLE, *[F.concat(F.lit(label), v) for label, v in own], "", SINGLE, "METRICS", SINGLE, *sums, "", DOUBLE, "CONVERSATION", DOUBLE, "")
    else:
        tick = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
        own = [("Session", tick(name)), ("Project", tick(F.col("project"))), ("Branch", tick(F.nullif("branch", F.lit("")))), ("Date", date)]
        row = lambda label, v: F.concat(F.lit(f"| {label} | "), v, F.lit(" |"))
        rows = lambda pairs: [row(label, v) for label, v in pairs]
        text = _lines("# Session Export", "", "| Property | Value |", "|----------|-------|", *rows(own), "", "## Metrics", "", "| Metric | Value |", "|--------|-------|", *rows(values), "", "## Conversation", "")
    return _part(sessions, by, [0, 0, 0, 0, 0], text)


def _blocks(responses: DataFrame, by: list[str]) -> DataFrame:
    """(.., pos, line_no, block_no, kind, text, is_first, is_last) of what a reply says: thinking, and the texts of its other blocks in order.

    A call is its name and readable input, a result its text or its own text blocks, an
    image a mark. A reply whose only text is empty says nothing.
    """
    each = responses.where("content_kind = 'array'").select(*by, "pos", "line_no", F.posexplode("blocks").alias("block_no", "b"))
    nested = F.array_join(F.transform(F.from_json("b.content_json", "array<struct<type:string,text:string>>"), lambda x: x["text"]), "\n")
    result = F.when(F.col("b.content_json").startswith("["), F.nullif(nested, F.lit(""))).otherwise(F.col("b.content_json"))
    call = F.concat(F.lit("Tool: "), F.col("b.name"), F.lit("\nInput: "), pretty.pretty_json(F.coalesce("b.input_json", F.lit("{}"))))
    kind = F.col("b.type")
    text = F.when(kind == "thinking", F.col("b.thinking")).when(kind == "text", F.col("b.text")).when(kind == "tool_use", call).when(kind == "tool_result", result).when(kind == "image", F.lit("[Image]"))
    said = each.select(*by, "pos", "line_no", "block_no", F.when(kind == "thinking", "thinking").otherwise("text").alias("kind"), text.alias("text")).where("text is not null")
    one = Window.partitionBy(*by, "pos", "line_no", "kind").orderBy("block_no")
    whole = Window.partitionBy(*by, "pos", "line_no", "kind")
    ranked = said.withColumn("is_first", F.row_number().over(one) == 1).withColumn("_n", F.count("*").over(whole)).withColumn("is_last", F.lead("block_no").over(one).isNull())
    blocks = ranked.where((F.col("kind") == "thinking") | (F.col("_n") > 1) | (F.col("text") != "")).drop("_n")
    plain = responses.where("content_kind = 'string'").select(*by, "pos", "line_no", F.lit(0).alias("block_no"), F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("is_first"), F.lit(True).alias("is_last"))
    return blocks.unionByName(plain)


def _tool(style: str) -> Column:
    name, given = F.col("name"), F.coalesce("input", F.lit("{}"))
    result = X.truncate(F.coalesce("result", F.lit("")), RESULT_LENGTH[style])
    if style == "plaintext":
        head = F.when(F.col("is_error"), F.lit("  [ERROR] Result: ")).otherwise(F.lit("  Result: "))
        return _lines(F.concat(F.lit("  TOOL: "), name), F.concat(F.lit("  Input: "), given), F.when(F.col("is_orphan"), F.lit("  [No result]")).otherwise(F.concat(head, result)))
    head = F.when(F.col("is_error"), F.lit("**Error:**")).otherwise(F.lit("**Result:**"))
    shown = F.when(~F.col("is_orphan"), _lines(head, "", "```", result, "```"))
    return _lines(F.concat(F.lit("**Tool:** `"), name, F.lit("`")), "", "```json", pretty.pretty_json(given), "```", "", shown, "")


def export_parts(sessions: DataFrame, chunks: DataFrame, responses: DataFrame, tools: DataFrame, by: list[str], style: str = "plaintext") -> DataFrame:
    """(.., place, text): the parts of each session's export, in the order of place.

    sessions (.., project, branch, created, duration_ms and the sums of METRICS), chunks
    (.., pos, kind, text) with kind user, ai, system or compact, responses (.., pos,
    line_no, content_kind, text, blocks) of ai chunks, and their tools (.., pos, tool_no,
    name, input, is_orphan, is_error, result). Turns count all chunks.
    """
    plain, kind = style == "plaintext", F.col("kind")
    said = F.coalesce("text", F.lit(""))
    if plain:
        own = F.when(kind == "user", F.concat(F.lit("USER: "), said)).when(kind == "system", F.concat(F.lit("SYSTEM: "), said)).when(kind == "compact", F.lit("[Context compacted]"))
        parts = [_part(chunks, by, [1, F.col("pos"), 0, 0, 0], _lines(SINGLE, own)), _part(chunks, by, [1, F.col("pos"), 3, 0, 0], F.lit(""))]
    else:
        turn = F.row_number().over(Window.partitionBy(*by).orderBy("pos")).cast("string")
        title = lambda who: F.concat(F.lit(f"### {who} (Turn "), F.col("_turn"), F.lit(")"))
        own = F.when(kind == "user", _lines(title("User"), "", said, "")).when(kind == "ai", _lines(title("Assistant"), "")).when(kind == "system", _lines(title("System"), "", said, "")).when(kind == "compact", _lines("---", "", "*Context compacted*", ""))
        parts = [_part(chunks.withColumn("_turn", turn), by, [1, F.col("pos"), 0, 0, 0], own)]
    blocks = _blocks(responses, by)
    thought = F.col("kind") == "thinking"
    if plain:
        text = F.when(thought, F.concat(F.lit("THINKING: "), "text")).when(F.col("is_first"), F.concat(F.lit("ASSISTANT: "), "text")).otherwise(F.col("text"))
    else:
        quoted = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("> "), x)), "\n")
        text = F.when(thought, _lines("> *Thinking:*", quoted, "")).when(F.col("is_last"), _lines(F.col("text"), "")).otherwise(F.col("text"))
    # A reply's thinking comes before what it says.
    parts.append(_part(blocks, by, [1, F.col("pos"), 1, F.col("line_no"), F.col("block_no") + F.when(thought, 0).otherwise(1_000_000)], text))
    parts.append(_part(tools, by, [1, F.col("pos"), 2, F.col("tool_no"), 0], _tool(style)))
    out = _head(sessions, by, style)
    for p in parts:
        out = out.unionByName(p)
    return out


def numbered(parts: DataFrame, by: list[str]) -> DataFrame:
    """(.., part, text), counted from 0."""
    return parts.select(*by, (F.row_number().over(Window.partitionBy(*by).orderBy("place")) - 1).alias("part"), "text")


def write_parts(parts: DataFrame, path: str, by: list[str]) -> None:
    """Writes each session's export to a folder of its own (by=value/..), in files whose names sort in the order of the text.

    Parts are dealt by range, so the parts of a long session stand in several files, each
    after the other, and no task holds a session.
    """
    names = [F.col(c).alias(c) for c in by]
    dealt = parts.repartitionByRange(*by, "place").sortWithinPartitions(*by, "place")
    dealt.select(*names, F.col("text").alias("value")).write.partitionBy(*by).option("lineSep", "\n").text(path)
