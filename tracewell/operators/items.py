"""What is shown of a subagent's messages: one ordered list of its input, thinking, texts, tools, messages of teammates, compactions, commands and own subagents.

Messages are those of sources.jsonl.read_messages. Kinds of items are branches of one
scan, calls meet results in one aggregation by call, and what an item needs from its
neighbours (sizes around a compaction, the message that a teammate answers) comes from
running values; so a session is never one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.functions import text as X

# Fixed value: how the text begins that a skill puts into the session.
SKILL_START = "Base directory for this skill:"
#: Columns of every item beside its keys and place.
ITEM = "kind string, id string, content string, name string, tokens long, ts timestamp, end_ts timestamp, is_orphan boolean, is_error boolean, result string, extra string, phase long, before long, after long"
_COLUMNS = [(c.split()[0], c.split()[1]) for c in ITEM.split(", ")]


def _texts(m: DataFrame, between: str) -> Column:
    blocks = F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit("")))
    return F.when(m["content_kind"] == "string", m["text"]).otherwise(F.array_join(blocks, between))


def _item(df: DataFrame, by: list[str], kind: str, order: list[Column], **values: Column) -> DataFrame:
    """Rows as items; order is (rank, line, block) of equal times."""
    given = values | {"kind": F.lit(kind)}
    columns = [given.get(c, F.lit(None)).cast(k).alias(c) for c, k in _COLUMNS]
    return df.select(*by, F.struct(*[o.cast("long").alias(f"o{i}") for i, o in enumerate(order)]).alias("_order"), *columns)


def _compactions(m: DataFrame, by: list[str], pos: str) -> DataFrame:
    """Rows with the size of the last reply before them and of the first after them, and the phase that they open."""
    size = F.col("usage.input") + F.col("usage.cache_read") + F.col("usage.cache_creation")
    read = F.when((F.col("type") == "assistant") & F.col("has_usage") & ~F.col("model").eqNullSafe(F.lit("<synthetic>")), size)
    upto = Window.partitionBy(*by).orderBy(pos)
    # The first after a row is the last before it in the opposite order: a frame that ends at the end of all would be gone through anew for each row.
    back = Window.partitionBy(*by).orderBy(F.desc(pos))
    earlier = lambda w: F.coalesce(F.last(read, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = m.withColumn("_before", earlier(upto)).withColumn("_after", earlier(back)).withColumn("_phase", F.sum(F.col("is_compact").cast("int")).over(upto) + 1)
    return marked.where("is_compact")


def _calls(m: DataFrame, by: list[str], pos: str) -> tuple[DataFrame, DataFrame]:
    """Tool calls, one for each id (the last, at the place of the first), and results (the last of each call)."""
    each = m.select(*by, pos, "uuid", "ts", "type", "is_meta", "model", "_shown", F.posexplode("blocks").alias("block_no", "b"))
    calls = each.where("type = 'assistant' and b.type = 'tool_use' and b.id <> '' and b.name <> ''")
    place = F.struct(pos, "block_no")
    call = F.struct(F.col("b.name").alias("name"), F.col("b.input_json").alias("input"), "ts", F.col("model"))
    calls = calls.groupBy(*by, F.col("b.id").alias("id")).agg(F.max_by(call, place).alias("c"), F.min(place).alias("at"))
    results = each.where("type = 'user' and not _shown and b.type = 'tool_result' and b.tool_use_id <> ''")
    result = F.struct(F.coalesce("b.content_json", F.lit("")).alias("content"), F.coalesce("b.is_error", F.lit(False)).alias("is_error"), "ts")
    return calls, results.groupBy(*by, F.col("b.tool_use_id").alias("id")).agg(F.max_by(result, place).alias("r"))


def _skills(m: DataFrame, by: list[str], pos: str) -> DataFrame:
    """(.., id, skill): the last instructions that a skill call put into the session."""
    each = m.where("type = 'user' and not _shown and source_tool_use_id is not null").select(*by, pos, F.col("source_tool_use_id").alias("id"), F.posexplode("blocks").alias("block_no", "b"))
    return each.where((F.col("b.type") == "text") & F.col("b.text").startswith(SKILL_START)).groupBy(*by, "id").agg(F.max_by("b.text", F.struct(pos, "block_no")).alias("skill"))


def _slashes(m: DataFrame, by: list[str], pos: str) -> DataFrame:
    """Commands that users typed, with the text that the meta message below them holds (the last such message, its first text)."""
    typed = m.where((F.col("type") == "user") & (F.col("content_kind") == "string") & X.is_command(F.col("text"))).withColumn("name", X.slash_name(F.col("text"))).where("name is not null")
    first = F.element_at(F.filter("blocks", lambda b: (b["type"] == "text") & (b["text"] != "")), 1)["text"]
    below = m.where("type = 'user' and is_meta and parent_uuid is not null and source_tool_use_id is null and content_kind = 'array'").where(F.exists("blocks", lambda b: (b["type"] == "text") & (b["text"] != "")))
    below = below.groupBy(*by, F.col("parent_uuid").alias("uuid")).agg(F.max_by(first, pos).alias("below"))
    return typed.join(below, [*by, "uuid"], "left")


def subagent_items(messages: DataFrame, subagents: DataFrame | None = None, by: tuple[str, ...] = ("session",), pos: str = "line_no") -> DataFrame:
    """(.., index, kind, id, content, name, tokens, ts, end_ts, is_orphan, is_error, result, extra, phase, before, after, reply_to, reply_summary), in order of time.

    Kinds: compact_boundary (content, the phase it opens, tokens before and after, the
    two only if there were any before), teammate_message (name who; extra their summary),
    subagent_input (a user's text that holds no result), thinking, output, tool (content
    the input, result and its error; extra a skill's instructions), subagent, slash (extra
    what follows). A message is taken once: as a compaction, else as teammates', else as
    input, else for its blocks. A Task call that a subagent (.., id, parent_task, ts) runs
    isn't shown beside it. Equal times keep the order messages, tools, subagents, commands.
    A teammate's message names the latest SendMessage before it that went to them or to all.
    """
    by = list(by)
    m = messages.withColumn("_whole", _texts(messages, ""))
    plain_user = (F.col("type") == "user") & ~F.col("is_meta") & ~F.col("is_compact")
    m = m.withColumn("_mates", F.when(plain_user, X.teammate_messages(F.col("_whole"))))
    has_result = F.exists("blocks", lambda b: b["type"] == "tool_result")
    is_mates, trimmed = F.coalesce(F.size("_mates") > 0, F.lit(False)), X.js_trim(F.col("_whole"))
    is_input = plain_user & ~is_mates & (F.length(trimmed) > 0) & ~F.coalesce(has_result, F.lit(False))
    m = m.withColumn("_is_input", F.coalesce(is_input, F.lit(False))).withColumn("_shown", F.col("is_compact") | is_mates | F.col("_is_input"))
    none = F.lit(0)
    at = lambda block: [F.lit(0), F.col(pos), block]

    c = _compactions(m, by, pos)
    known = F.col("_before") > 0
    parts = [_item(c, by, "compact_boundary", at(none), content=_texts(c, "\n\n"), ts=F.col("ts"), phase=F.col("_phase"), before=F.when(known, F.col("_before")), after=F.when(known, F.col("_after")))]
    mates = m.where(is_mates).select(*by, pos, "uuid", "ts", F.posexplode("_mates").alias("block_no", "t"))
    parts.append(_item(mates, by, "teammate_message", at(F.col("block_no")), id=F.concat_ws("-", "uuid", "t.teammate_id", "block_no"), content=F.col("t.content"), name=F.col("t.teammate_id"), extra=F.col("t.summary"), tokens=X.estimate_tokens(F.col("t.content")), ts=F.col("ts")))
    parts.append(_item(m.where("_is_input"), by, "subagent_input", at(none), content=trimmed, tokens=X.estimate_tokens(F.col("_whole")), ts=F.col("ts")))
    said = m.where("type = 'assistant' and content_kind = 'array' and not is_compact").select(*by, pos, "ts", F.posexplode("blocks").alias("block_no", "b"))
    for block, field, kind in (("thinking", "thinking", "thinking"), ("text", "text", "output")):
        own = said.where((F.col("b.type") == block) & (F.col(f"b.{field}") != ""))
        parts.append(_item(own, by, kind, at(F.col("block_no")), content=F.col(f"b.{field}"), tokens=X.estimate_tokens(F.col(f"b.{field}")), ts=F.col("ts")))

    calls, results = _calls(m.where("not is_compact"), by, pos)
    linked = calls.join(results, [*by, "id"], "left").join(_skills(m, by, pos), [*by, "id"], "left")
    if subagents is not None:
        run = subagents.where("parent_task is not null").select(*by, F.col("parent_task").alias("id"), F.lit("Task").alias("_task")).distinct()
        linked = linked.join(run, [*by, "id"], "left").where(F.col("_task").isNull() | (F.col("c.name") != F.col("_task")))
        parts.append(_item(subagents, by, "subagent", [F.lit(2), none, none], id=F.col("id"), ts=F.col("ts")))
    skill = F.when(F.col("c.name") == "Skill", F.col("skill"))
    parts.append(
        _item(
            linked, by, "tool", [F.lit(1), F.col(f"at.{pos}"), F.col("at.block_no")], id=F.col("id"), name=F.col("c.name"), content=F.col("c.input"), ts=F.col("c.ts"), end_ts=F.col("r.ts"),
            is_orphan=F.col("r").isNull(), is_error=F.col("r.is_error"), result=F.col("r.content"), extra=skill, tokens=X.call_tokens(F.col("c.name"), F.col("c.input")),
        )
    )
    slash = _slashes(m, by, pos)
    parts.append(_item(slash, by, "slash", [F.lit(3), F.col(pos), none], id=F.concat(F.lit("slash-"), F.col("uuid")), name=F.col("name"), content=X.slash_args(F.col("text")), extra=F.col("below"), tokens=X.estimate_tokens(F.col("below")), ts=F.col("ts")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    order = Window.partitionBy(*by).orderBy("ts", "_order", "id")
    every = every.withColumn("index", F.row_number().over(order) - 1)
    return with_replies(every, by).select(*by, "index", *[c for c, _ in _COLUMNS], "reply_to", "reply_summary")


def with_replies(items: DataFrame, by: list[str]) -> DataFrame:
    """items (.., index, kind, id, name, content) with what a teammate's message answers: the id and summary of the latest SendMessage before it to that teammate, or to all.

    Two running values decide, one over the messages to a teammate and one over those to
    all; the later one counts.
    """
    get = lambda k: F.get_json_object("content", f"$.{k}")
    is_send = (F.col("kind") == "tool") & (F.col("name") == "SendMessage")
    kind = F.when(is_send, get("type"))
    sent = F.struct("index", F.col("id").alias("id"), F.coalesce(F.nullif(get("summary"), F.lit("")), F.lit("message")).alias("summary"))
    who = F.when(kind == "message", get("recipient")).when(F.col("kind") == "teammate_message", F.col("name"))
    marked = items.withColumn("_who", who).withColumn("_one", F.when(kind == "message", sent)).withColumn("_all", F.when(kind == "broadcast", sent))
    everyone = Window.partitionBy(*by).orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy(*by, "_who").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    seen = marked.withColumn("_last_all", F.last("_all", True).over(everyone)).withColumn("_last_one", F.last("_one", True).over(own))
    later = F.when(F.col("_last_one").isNull() | (F.col("_last_all.index") > F.col("_last_one.index")), F.col("_last_all")).otherwise(F.col("_last_one"))
    found = seen.withColumn("_reply", F.when(F.col("kind") == "teammate_message", later))
    return found.select(*items.columns, F.col("_reply.id").alias("reply_to"), F.col("_reply.summary").alias("reply_summary"))
