"""Rows for showing a session: steps, summaries, timelines and text exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.functions import formats
from tracewell.functions import text as X


def steps(messages: DataFrame) -> DataFrame:
    """A row for each content block that is a step: thinking, tool_call, tool_result, output or interruption, in order; messages as read_messages gives them."""
    as_text = F.array(F.struct(F.lit("text").alias("type"), F.col("text")))
    each = messages.select("session", "line_no", "uuid", "ts", "type", F.posexplode("blocks").alias("block_no", "b"))
    plain = messages.where("content_kind = 'string' and type = 'assistant'").select("session", "line_no", "uuid", "ts", F.explode(as_text).alias("b"))
    kind = F.when((F.col("b.type") == "text") & F.col("b.text").startswith(X.INTERRUPTED), "interruption").when((F.col("type") == "assistant") & (F.col("b.type") == "thinking"), "thinking").when(F.col("b.type") == "tool_use", "tool_call").when(F.col("b.type") == "tool_result", "tool_result").when((F.col("type") == "assistant") & (F.col("b.type") == "text"), "output")
    body = F.coalesce("b.text", "b.thinking", "b.content_json", "b.input_json")
    rows = each.select("session", "line_no", "block_no", "uuid", "ts", kind.alias("step"), F.coalesce("b.id", "b.tool_use_id").alias("tool_id"), F.col("b.name").alias("tool"), body.alias("body"), F.coalesce("b.is_error", F.lit(False)).alias("is_error")).where("step is not null")
    more = plain.select("session", "line_no", F.lit(0).alias("block_no"), "uuid", "ts", F.lit("output").alias("step"), F.lit(None).cast("string").alias("tool_id"), F.lit(None).cast("string").alias("tool"), F.col("b.text").alias("body"), F.lit(False).alias("is_error"))
    tokens = F.when(F.col("step") == "tool_call", X.call_tokens(F.col("tool"), F.col("body"))).otherwise(X.estimate_tokens(F.col("body")))
    return rows.unionByName(more).withColumn("tokens", tokens)


def group_status(rows: DataFrame, by: list[str]) -> DataFrame:
    """error, interrupted, in_progress or complete of each group of steps; needs step, is_error and has_end."""
    a = rows.groupBy(*by).agg(F.bool_or(F.col("step") == "interruption").alias("i"), F.bool_or(F.col("is_error")).alias("e"), F.bool_or(~F.col("has_end")).alias("o"))
    return a.select(*by, F.when(F.col("i"), "interrupted").when(F.col("e"), "error").when(F.col("o"), "in_progress").otherwise("complete").alias("status"))


def _counted(n: Column, one: str, many: str) -> Column:
    return F.when(n > 0, F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many)))


def summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """"2 thinking, 1 tool call, ..." of each group of items; needs item. Subagents with a member (of a team) count once for each name, as teammates."""
    count = lambda k: F.count_if(F.col("item") == k)
    counts = {k: count(k) for k in ("thinking", "tool", "output", "subagent", "slash", "teammate_message", "compact_boundary")}
    if "member" in rows.columns:
        of_team = (F.col("item") == "subagent") & F.col("member").isNotNull()
        counts |= {"teammate": F.count_distinct(F.when(of_team, F.col("member"))), "subagent": F.count_if((F.col("item") == "subagent") & F.col("member").isNull())}
    names = (("thinking", "thinking", "thinking"), ("tool", "tool call", "tool calls"), ("output", "message", "messages"), ("teammate", "teammate", "teammates"), ("subagent", "subagent", "subagents"), ("slash", "slash", "slashes"), ("teammate_message", "teammate message", "teammate messages"), ("compact_boundary", "compaction", "compactions"))
    text = F.concat_ws(", ", *[_counted(counts[k], a, b) for k, a, b in names if k in counts])
    return rows.groupBy(*by).agg(F.when(text == "", "No items").otherwise(text).alias("summary"))


def main_model(rows: DataFrame, by: list[str], model: str, pos: str) -> DataFrame:
    """The most frequent model of each group; ties go to the one seen first."""
    per = rows.where(F.col(model).isNotNull()).groupBy(*by, model).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    return per.groupBy(*by).agg(F.max_by(model, F.struct("n", -F.col("first"))).alias("main_model"), F.max("n").alias("n"))


def last_output(rows: DataFrame, by: list[str], pos: str) -> DataFrame:
    """What a group ends with: an interruption, that it is ongoing, a plan (no later output or result), else the last text, else the last result; needs step, tool, body and is_ongoing."""
    at = lambda cond: F.max(F.when(cond, F.col(pos)))
    body = lambda cond: F.max_by(F.when(cond, F.col("body")), F.when(cond, F.col(pos)))
    said = (F.col("step") == "output") & (F.col("body") != "")
    result = (F.col("step") == "tool_result") & (F.col("body") != "")
    plan = (F.col("step") == "tool_call") & (F.col("tool") == "ExitPlanMode")
    a = rows.groupBy(*by).agg(at(F.col("step") == "interruption").alias("i"), F.bool_or("is_ongoing").alias("o"), at(plan).alias("p"), at(said | result).alias("later"), body(said).alias("said"), body(result).alias("result"), body(plan).alias("plan"))
    kind = F.when(F.col("i").isNotNull(), "interruption").when(F.col("o"), "ongoing").when(F.col("p").isNotNull() & (F.col("later").isNull() | (F.col("later") < F.col("p"))), "plan_exit").when(F.col("said").isNotNull(), "text").when(F.col("result").isNotNull(), "tool_result")
    b = a.withColumn("kind", kind)
    return b.select(*by, "kind", F.when(F.col("kind") == "plan_exit", F.col("plan")).when(F.col("kind") == "text", F.col("said")).when(F.col("kind") == "tool_result", F.col("result")).alias("text"))


def last_usage(rows: DataFrame, by: list[str], pos: str, usage: str) -> DataFrame:
    there = F.col(usage).isNotNull()
    return rows.groupBy(*by).agg(F.max_by(F.when(there, F.col(usage)), F.when(there, F.col(pos))).alias("last_usage"), F.count(usage).alias("turns"))


def waterfall(chunks: DataFrame, tools: DataFrame, subagents: DataFrame, by: list[str]) -> DataFrame:
    """Bars of a timeline: chunks at level 0, their tools and subagents at level 1, other subagents at level 0; each is (.., id, parent, start, end), with the whole's start and length."""
    bar = lambda df, kind, level: df.select(*by, F.lit(kind).alias("kind"), "id", "parent", level.alias("level"), "start", "end")
    known = chunks.select(*by, F.col("id").alias("parent")).distinct().withColumn("_k", F.lit(1))
    placed = subagents.join(known, [*by, "parent"], "left").withColumn("_level", F.coalesce("_k", F.lit(0)))
    every = bar(chunks, "chunk", F.lit(0)).unionByName(bar(tools, "tool", F.lit(1))).unionByName(bar(placed, "subagent", F.col("_level")))
    whole = Window.partitionBy(*by)
    return every.withColumn("offset", F.col("start") - F.min("start").over(whole)).withColumn("total", F.max("end").over(whole) - F.min("start").over(whole))


def export_text(rows: DataFrame, by: list[str], pos: str) -> DataFrame:
    """A session as plain text, its turns in order; needs kind and text. One session's lines are gathered, as its file holds them."""
    heads = {"user": "USER: ", "ai": "ASSISTANT: ", "system": "SYSTEM: ", "compact": "[COMPACTED] "}
    line = F.coalesce(*[F.when(F.col("kind") == k, F.concat(F.lit(h), F.col("text"))) for k, h in heads.items()], F.col("text"))
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), line.alias("t")))), lambda x: x["t"]), "\n\n").alias("export"))


def export_markdown(rows: DataFrame, by: list[str], pos: str) -> DataFrame:
    """A session as markdown with a heading for each turn and a table of its sums; needs kind, text and tokens."""
    heads = {"user": "## User", "ai": "## Assistant", "system": "## System", "compact": "---\n\n*Context compacted*"}
    head = F.coalesce(*[F.when(F.col("kind") == k, h) for k, h in heads.items()], F.lit("## Other"))
    part = F.concat(head, F.lit("\n\n"), F.coalesce("text", F.lit("")))
    a = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), part.alias("t")))), lambda x: x["t"]), "\n\n").alias("body"))
    return a.select(*by, F.concat(F.lit("# Session\n\n| Messages | Tokens |\n| --- | --- |\n| "), F.col("n").cast("string"), F.lit(" | "), formats.format_tokens(F.col("tokens")), F.lit(" |\n\n"), F.col("body")).alias("export"))


def write_export(exports: DataFrame, path: str, by: list[str]) -> None:
    exports.select(*by, F.col("export").alias("value")).write.partitionBy(*by).option("lineSep", "\n").text(path)


def export_json(rows: DataFrame, by: list[str], pos: str) -> DataFrame:
    """A session as JSON: its turns in order, with their kind, text and tokens."""
    turn = F.struct(F.col(pos).alias("pos"), "kind", "text", "tokens")
    return rows.groupBy(*by).agg(F.to_json(F.array_sort(F.collect_list(turn))).alias("export"))


def highlights(marks: DataFrame, key: str = "tool_use_id") -> DataFrame:
    """(key, color): the latest colour of each marked call; marks (key, color, pos)."""
    return marks.groupBy(key).agg(F.max_by("color", "pos").alias("color"))
