"""Details of sessions and their subagents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tracewell.functions import text as X
from tracewell.operators.context import COORDINATION
from tracewell.operators.links import in_interval


def totals(rows: DataFrame, by: list[str]) -> DataFrame:
    """Sums over chunks or subagents (.., start, end, input, output, messages): here the total leaves the cache out."""
    return rows.groupBy(*by).agg((F.max("end") - F.min("start")).alias("duration"), F.sum("messages").alias("messages"), F.sum("input").alias("input"), F.sum("output").alias("output"), F.sum(F.col("input") + F.col("output")).alias("total"))


def step_tokens(steps: DataFrame, usage: DataFrame, by: list[str], pos: str) -> DataFrame:
    """Tokens of each group of steps (input, output, cached, step): their sums, or the usage (input, output, cached, pos) of the first message that has one."""
    sums = steps.groupBy(*by).agg(*[F.sum(c).alias(f"_{c}") for c in ("input", "output", "cached")], F.sum(F.when(F.col("step") == "thinking", F.col("output")).otherwise(0)).alias("thinking"))
    first = usage.groupBy(*by).agg(F.min_by(F.struct("input", "output", "cached"), pos).alias("u"))
    return sums.join(first, by, "left").select(*by, *[F.coalesce(f"u.{c}", f"_{c}").alias(c) for c in ("input", "output", "cached")], "thinking")


def step_groups(steps: DataFrame, by: list[str], pos: str) -> DataFrame:
    """Steps (message, step, tool, is_error, start, duration) of one message as a group with a label; steps without a message are one group."""
    n = lambda k: F.count_if(F.col("step") == k)
    a = steps.groupBy(*by, "message").agg(
        F.count("*").alias("n"), n("thinking").alias("_t"), n("output").alias("_o"), n("tool_call").alias("_c"), F.min_by(F.struct("step", "tool", "is_error", "start"), pos).alias("f"), F.max(F.col("start") + F.col("duration")).alias("end"), F.sum("duration").alias("duration")
    )
    alone = (
        F.when(F.col("f.step") == "thinking", "Thinking").when(F.col("f.step") == "tool_call", F.concat(F.lit("Tool: "), F.coalesce("f.tool", F.lit("Unknown")))).when(F.col("f.step") == "tool_result", F.when(F.col("f.is_error"), "Result: Error").otherwise("Result: Success"))
        .when(F.col("f.step") == "subagent", F.coalesce("f.tool", F.lit("Subagent"))).when(F.col("f.step") == "output", "Output").otherwise("Interruption")
    )
    many = F.when(F.col("_c") > 0, F.concat(F.lit("Tools ("), F.col("_c"), F.lit(")"))).when((F.col("_t") > 0) & (F.col("_o") > 0), "Assistant Response").when(F.col("_t") > 0, "Thinking").when(F.col("_o") > 0, "Output").otherwise(F.concat(F.lit("Response ("), F.col("n"), F.lit(" steps)")))
    return a.select(*by, "message", F.when(F.col("n") == 1, alone).otherwise(many).alias("label"), "n", (F.col("message").isNotNull() & (F.col("n") > 1)).alias("is_grouped"), F.col("f.start").alias("start"), "end", "duration")


def step_context(steps: DataFrame, messages: DataFrame, by: list[str]) -> DataFrame:
    """accumulated_context of each step (message, input, cached): the context of its message (message, context), else its own tokens."""
    return steps.join(messages.select(*by, "message", "context"), [*by, "message"], "left").withColumn("accumulated_context", F.coalesce("context", F.coalesce("input", F.lit(0)) + F.coalesce("cached", F.lit(0)))).drop("context")


def subagent_compactions(rows: DataFrame, by: list[str], pos: str) -> DataFrame:
    """Of each compaction of a subagent: the input before and after, the difference if there was any before, and the phase that begins; needs ctx (null: no reading) and compact."""
    w = Window.partitionBy(*by).orderBy(pos)
    pre = F.coalesce(F.last("ctx", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    post = F.coalesce(F.first("ctx", True).over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    out = rows.withColumn("pre", pre).withColumn("post", post).withColumn("phase", F.sum(F.col("compact").cast("int")).over(w) + 1).where("compact")
    return out.select(*by, pos, "phase", "pre", "post", F.when(F.col("pre") > 0, F.col("post") - F.col("pre")).alias("delta"))


def subagent_cards(messages: DataFrame, by: list[str], pos: str) -> DataFrame:
    """Last usage, turns, thinking tokens and whether a subagent did nothing but agree to shut down; needs type, usage_total (null: none), thinking, and tools and tool_types as arrays."""
    assistant = F.col("type") == "assistant"
    one = F.count_if(assistant)
    shut = F.max(F.when(assistant, (F.size("tools") == 1) & (F.get("tools", F.lit(0)) == "SendMessage") & (F.get("tool_types", F.lit(0)) == "shutdown_response")).otherwise(F.lit(False)))
    used = assistant & F.col("usage_total").isNotNull()
    return messages.groupBy(*by).agg(F.max_by(F.when(used, F.col("usage_total")), F.when(used, F.col(pos))).alias("last_usage"), F.count_if(used).alias("turns"), F.sum(X.estimate_tokens(F.col("thinking"))).alias("thinking_tokens"), F.coalesce((one == 1) & shut, F.lit(False)).alias("is_shutdown_only"))


def spread_teams(agents: DataFrame, hops: int = 11) -> DataFrame:
    """agents (session, agent_id, first_parent, last_uuid, team): a subagent without a team has that of the nearest one it continues, hops up at most.

    One join for each hop while any is open; each keeps one row for a subagent.
    """
    known = agents.select("session", F.col("last_uuid").alias("_at"), F.col("team").alias("_team"), F.col("first_parent").alias("_next")).where("_at is not null").dropDuplicates(["session", "_at"])
    out = agents.withColumn("_at", F.when(F.col("team").isNull(), F.col("first_parent")))
    for _ in range(hops):
        out = out.join(known, ["session", "_at"], "left").withColumn("team", F.coalesce("team", "_team")).withColumn("_at", F.when(F.col("team").isNull(), F.col("_next"))).drop("_team", "_next")
    return out.drop("_at")


def link_processes(chunks: DataFrame, processes: DataFrame, by: list[str]) -> DataFrame:
    """processes (.., process, task, start) with the chunk (.., chunk, tasks, start, end) that called their task; those without a task go to the chunk whose time holds their start, ends included."""
    called = chunks.select(*by, "chunk", F.explode("tasks").alias("task"))
    named = processes.join(called, [*by, "task"]).select(*by, "process", "chunk")
    points = processes.where("task is null").select(*by, "process", F.col("start").alias("ts"))
    timed = in_interval(points, chunks.select(*by, "chunk", "start", "end").where("end is not null"), by, "both").select(*by, "process", "chunk")
    return named.unionByName(timed)


def split_tasks(calls: DataFrame, agents: DataFrame, by: list[str]) -> DataFrame:
    """calls (.., id, is_task) with kind: task where a subagent (.., task) runs it, else tool."""
    owned = agents.select(*by, F.col("task").alias("id")).distinct().withColumn("_own", F.lit(True))
    return calls.join(owned, [*by, "id"], "left").withColumn("kind", F.when(F.col("is_task") & F.coalesce("_own", F.lit(False)), "task").otherwise("tool")).drop("_own")


def main_impact(agents: DataFrame, calls: DataFrame, by: list[str]) -> DataFrame:
    """Tokens that a subagent (.., agent, task) costs its main session: the call's and the result's (.., id, call_tokens, result_tokens)."""
    own = calls.select(*by, F.col("id").alias("task"), "call_tokens", "result_tokens")
    return agents.join(own, [*by, "task"], "left").withColumn("impact", F.coalesce("call_tokens", F.lit(0)) + F.coalesce("result_tokens", F.lit(0)))


def coordination(injections: DataFrame, teammates: DataFrame, by: list[str]) -> DataFrame:
    """(.., turn, tokens, n) of what coordination puts into each turn: its tools, as tool_injections gives them, and teammates' messages (.., turn, tokens)."""
    tools = injections.where("category = 'task-coordination'").select(*by, "turn", "tokens", "n")
    said = teammates.where("tokens > 0").select(*by, "turn", "tokens", F.lit(1).cast("long").alias("n"))
    return tools.unionByName(said).groupBy(*by, "turn").agg(F.sum("tokens").alias("tokens"), F.sum("n").alias("n"))


def tool_injections(tools: DataFrame, by: list[str]) -> DataFrame:
    """Tokens of each turn's tools (.., turn, tool, call_tokens, result_tokens, skill_tokens), tasks and messages of teams apart; turns without any drop out."""
    tokens = F.coalesce("call_tokens", F.lit(0)) + F.coalesce("result_tokens", F.lit(0)) + F.coalesce("skill_tokens", F.lit(0))
    rows = tools.withColumn("tokens", tokens).where("tokens > 0").withColumn("category", F.when(F.col("tool").isin(*COORDINATION), "task-coordination").otherwise("tool-output"))
    name = F.when(F.col("tool") == "Task", "Task (Subagent)").otherwise(F.col("tool"))
    return rows.groupBy(*by, "turn", "category").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(name)), ",").alias("tools"))


def user_injections(turns: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    tokens, c = X.estimate_tokens(F.col(text)), F.col(text)
    return turns.withColumn("tokens", tokens).where("tokens > 0").select(*by, "turn", "tokens", F.when(F.length(c) > 80, F.concat(F.substring(c, 1, 80), F.lit("…"))).otherwise(c).alias("preview"))


def thinking_injections(items: DataFrame, by: list[str]) -> DataFrame:
    """Thinking and text tokens of each turn (.., turn, item, tokens)."""
    part = lambda k: F.sum(F.when(F.col("item") == k, F.col("tokens")).otherwise(0))
    return items.groupBy(*by, "turn").agg(part("thinking").alias("thinking_tokens"), part("output").alias("text_tokens")).where("thinking_tokens + text_tokens > 0")


def find_sessions(sessions: DataFrame, fragment: str, most: int = 50) -> DataFrame:
    """Sessions (session, created) whose id holds a fragment, case ignored, the newest first."""
    return sessions.where(F.lower("session").contains(fragment.lower())).orderBy(F.desc("created"), "session").limit(most)


def find_repositories(repositories: DataFrame, text: str, most: int = 10) -> DataFrame:
    """Repositories (name, path, recent) whose name or path holds a text."""
    t = text.lower()
    return repositories.where(F.lower("name").contains(t) | F.lower("path").contains(t)).orderBy(F.desc("recent"), "name").limit(most)


def total_count(page_rows: int, has_more: bool, counted: int | None, include: bool, prefilter: bool) -> int:
    """What a page says about the whole: a lower bound, unless all rows were filtered and counted."""
    return page_rows + int(has_more) if not include else (counted or 0) if prefilter else 0


def ranked_injections(rows: DataFrame, by: list[str]) -> DataFrame:
    """Injections (.., id, tokens) with their rank inside a session, the largest first."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("tokens"), "id")))


def running_index(rows: DataFrame, by: list[str], kind: str, pos: str) -> DataFrame:
    """index: how many rows of the same kind stand before a row."""
    return rows.withColumn("index", F.row_number().over(Window.partitionBy(*by, kind).orderBy(pos)) - 1)


def mark_ongoing(groups: DataFrame, by: list[str], pos: str) -> DataFrame:
    """The last group of an ongoing session is in progress, unless it was interrupted; needs status and is_ongoing."""
    last = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(pos))) == 1
    return groups.withColumn("_last", last).withColumn("status", F.when(F.col("_last") & F.col("is_ongoing") & (F.col("status") != "interrupted"), "in_progress").otherwise(F.col("status"))).drop("_last")


def subagent_models(rows: DataFrame, main: DataFrame, by: list[str], pos: str) -> DataFrame:
    """The distinct first models of a session's subagents (.., agent, model) that aren't its main model."""
    first = rows.where("model is not null").groupBy(*by, "agent").agg(F.min_by("model", pos).alias("model"))
    return first.select(*by, "model").distinct().join(main.select(*by, F.col("main_model").alias("model")), [*by, "model"], "left_anti")


def slash_follow_ups(slashes: DataFrame, rows: DataFrame, by: list[str], pos: str) -> DataFrame:
    """slashes (.., uuid, name) with the instructions that follow: the last meta row (.., parent_uuid, is_meta, source_tool_use_id, text) below each that no tool wrote."""
    below = rows.where("is_meta and source_tool_use_id is null and text is not null").groupBy(*by, F.col("parent_uuid").alias("uuid")).agg(F.max_by("text", pos).alias("instructions"))
    return slashes.join(below, [*by, "uuid"], "left").withColumn("instruction_tokens", X.estimate_tokens(F.col("instructions")))


def team_colors(agents: DataFrame, spawned: DataFrame, by: list[str]) -> DataFrame:
    """agents (.., agent_id, task) with team, member and color of the last spawn result (.., task, team, member, color, pos) of their task."""
    last = spawned.groupBy(*by, "task").agg(F.max_by(F.struct("team", "member", "color"), "pos").alias("t"))
    return agents.join(last, [*by, "task"], "left").select(*agents.columns, "t.team", "t.member", "t.color")


def display_items(steps: DataFrame, last: DataFrame, slashes: DataFrame, teammates: DataFrame, by: list[str]) -> DataFrame:
    """What a group shows, in order of time: steps (.., step_id, kind, ts, pos) but for the one that is its last output (.., step_id), results apart from their calls, slashes and teammates (.., ts, pos)."""
    shown = steps.join(last.select(*by, "step_id"), [*by, "step_id"], "left_anti").where("kind <> 'tool_result'")
    item = lambda df, kind: df.select(*by, kind.alias("item"), "ts", "pos")
    every = item(shown, F.when(F.col("kind") == "tool_call", "tool").otherwise(F.col("kind"))).unionByName(item(slashes, F.lit("slash"))).unionByName(item(teammates, F.lit("teammate_message")))
    return every.withColumn("index", F.row_number().over(Window.partitionBy(*by).orderBy("ts", "pos", "item")) - 1)


def with_stale_guard(sessions: DataFrame, as_of, minutes: int = 5) -> DataFrame:
    """is_ongoing only where the file (modified) was touched in the minutes before as_of."""
    return sessions.withColumn("is_ongoing", F.col("is_ongoing") & (F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("modified").cast("timestamp")) <= minutes * 60))


def by_ids(sessions: DataFrame, ids: list[str], most: int = 50) -> DataFrame:
    """The asked sessions, those with a valid id, most at most."""
    import re

    from tracewell.functions.guards import ID

    valid = [i for i in dict.fromkeys(ids) if re.fullmatch(ID, i)][:most]
    return sessions.where(F.col("session").isin(valid))


def first_project_of(sessions: DataFrame, session: str) -> DataFrame:
    """The first project that holds a session."""
    return sessions.where(F.col("session") == session).orderBy("project").limit(1)


def tool_status(tools: DataFrame) -> DataFrame:
    """status of linked tools (is_orphan, result_is_error): orphaned, error or ok."""
    return tools.withColumn("status", F.when(F.col("is_orphan"), "orphaned").when(F.col("result_is_error"), "error").otherwise("ok"))
