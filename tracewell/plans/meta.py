"""Queries over the fixture tables for metadata of sessions, sums of groups, rules by field, and tool lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracewell.functions import formats, paths
from tracewell.functions import text as X
from tracewell.operators import metadata, rules
from tracewell.plans.catalog import MS, Tables, query

#: What stands for the blocks of a transcript: the kind by turn, in Spark and in SQL.
_BLOCK = """CASE WHEN role = 'assistant' THEN CASE turn % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'thinking' ELSE 'tool_use' END ELSE CASE turn % 3 WHEN 0 THEN 'text' ELSE 'tool_result' END END"""
_NAME = """CASE turn % 5 WHEN 2 THEN 'ExitPlanMode' WHEN 3 THEN 'SendMessage' ELSE 'Read' END"""
_SHUTS = "role = 'assistant' AND turn % 5 = 3 AND conv_id % 3 = 0"
_ENDS = f"""CASE WHEN role = 'assistant' THEN CASE WHEN turn % 5 = 0 THEN LENGTH(TRIM(text)) > 0 WHEN turn % 5 = 1 THEN false WHEN turn % 5 = 2 THEN true ELSE {_SHUTS} END
    WHEN turn % 3 = 0 THEN false ELSE conv_id % 7 = 0 OR EXISTS (SELECT 1 FROM conversations s WHERE s.conv_id = c.conv_id AND s.turn // 4 = c.turn // 4 AND s.role = 'assistant' AND s.turn % 5 = 3 AND s.conv_id % 3 = 0) END"""
_ACTS = f"""CASE WHEN role = 'assistant' THEN CASE WHEN turn % 5 = 0 THEN false WHEN turn % 5 = 1 THEN LENGTH(text) > 0 WHEN turn % 5 = 2 THEN false ELSE NOT ({_SHUTS}) END ELSE turn % 3 <> 0 AND NOT ({_ENDS}) END"""


def _blocks(t: Tables) -> DataFrame:
    c = t.conversations.where("role in ('assistant', 'user')")
    shuts = F.when(F.col("conv_id") % 3 == 0, '{"type":"shutdown_response","approve":true}').otherwise('{"type":"shutdown_response","approve":false}')
    return c.select(
        F.col("conv_id").alias("session"), F.col("turn").alias("order_no"), F.col("role").alias("type"), F.expr(_BLOCK).alias("kind"), "text",
        F.expr(_NAME).alias("name"), shuts.alias("input"), F.floor(F.col("turn") / 4).cast("string").alias("tool_id"), (F.col("conv_id") % 7 == 0).alias("rejected"),
    )


@query(f"SELECT conv_id AS session, turn AS order_no, {_ENDS} AS is_ending, {_ACTS} AS is_activity FROM conversations c WHERE role IN ('assistant', 'user')")
def activity(t: Tables) -> DataFrame:
    """What each block says about whether its session goes on."""
    return metadata.block_activity(_blocks(t)).select("session", "order_no", "is_ending", "is_activity")


@query(f"""
    WITH b AS (SELECT conv_id, MAX(CASE WHEN {_ENDS} THEN turn END) AS e, MAX(CASE WHEN {_ACTS} THEN turn END) AS a FROM conversations c WHERE role IN ('assistant', 'user') GROUP BY conv_id),
    m AS (SELECT *, CASE WHEN turn % 4 = 0 THEN '<command-name>/run-' || turn || '</command-name>' WHEN turn % 4 = 2 THEN '[Request interrupted by user]' ELSE text END AS said FROM conversations),
    f AS (SELECT conv_id, SUBSTR(COALESCE(arg_min(TRIM(said), turn) FILTER (role = 'user' AND turn % 2 = 1 AND LENGTH(TRIM(said)) > 0), arg_min('/run-' || turn, turn) FILTER (role = 'user' AND turn % 4 = 0)), 1, 500) AS first_message,
        arg_min('branch' || turn, turn) FILTER (turn > 0) AS git_branch, COUNT(CASE WHEN role = 'user' THEN 1 END) > 1 AS has_displayable, COUNT(*) AS turns FROM m GROUP BY conv_id)
    SELECT conv_id AS session, first_message, git_branch, has_displayable, COALESCE(a > e, a IS NOT NULL AND e IS NULL, false) AS is_ongoing, turns FROM f LEFT JOIN b USING (conv_id)""")
def file_metadata(t: Tables) -> DataFrame:
    """The row of each session in a listing, from one aggregation of its rows and one of its blocks."""
    c, turn = t.conversations, F.col("turn")
    users = F.count_if(F.col("role") == "user")
    many = c.groupBy("conv_id").agg((users > 1).alias("is_displayable"))
    command = F.concat(F.lit("<command-name>/run-"), turn, F.lit("</command-name>"))
    said = F.when(turn % 4 == 0, command).when(turn % 4 == 2, X.INTERRUPTED + "]").otherwise(F.col("text"))
    branch = F.when(turn > 0, F.concat(F.lit("branch"), turn)).otherwise("")
    rows = c.join(many, "conv_id").select(F.col("conv_id").alias("session"), turn.alias("pos"), F.col("role").alias("type"), F.lit(False).alias("is_meta"), said.alias("text"), branch.alias("git_branch"), "is_displayable")
    turns = c.groupBy(F.col("conv_id").alias("session")).agg(F.count("*").alias("turns"))
    phases = c.select(F.col("conv_id").alias("session")).distinct()
    return metadata.file_metadata(rows, metadata.block_activity(_blocks(t)), turns, phases)


@query(f"""
    WITH e AS (SELECT *, CASE event_type WHEN 'view' THEN 'thinking' WHEN 'click' THEN 'tool_call' WHEN 'purchase' THEN 'output' ELSE 'subagent' END AS step, repeat(props || ' ', 12) AS body, event_id // 50 AS g FROM events),
    f AS (SELECT user_id, g, arg_min(body, event_id) FILTER (step = 'thinking') AS b FROM e GROUP BY 1, 2)
    SELECT e.user_id AS session, e.g AS grp, ANY_VALUE(CASE WHEN LENGTH(b) > 100 THEN SUBSTR(b, 1, 100) || '...' ELSE b END) AS thinking_preview, COUNT(CASE WHEN step = 'tool_call' THEN 1 END) AS tool_calls, COUNT(CASE WHEN step = 'output' THEN 1 END) AS outputs,
        COUNT(CASE WHEN step = 'subagent' THEN 1 END) AS subagents, CAST(SUM(FLOOR(value)) AS BIGINT) AS duration, CAST(SUM(FLOOR(value) + event_id % 9) AS BIGINT) AS total_tokens, CAST(SUM(event_id % 9) AS BIGINT) AS output_tokens,
        CAST(SUM(CASE WHEN event_id % 2 = 0 THEN 7 ELSE 0 END) AS BIGINT) AS cached_tokens
    FROM e JOIN f USING (user_id, g) GROUP BY 1, 2""")
def group_summary(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "thinking").when(F.col("event_type") == "click", "tool_call").when(F.col("event_type") == "purchase", "output").otherwise("subagent")
    steps = t.stream().select(
        "session", F.floor(F.col("pos") / 50).alias("grp"), "pos", kind.alias("step"), F.repeat(F.concat("props", F.lit(" ")), 12).alias("text"), F.col("n").alias("duration"),
        F.col("n").alias("input"), (F.col("pos") % 9).alias("output"), F.when(F.col("pos") % 2 == 0, F.lit(7)).alias("cached"),
    )
    return metadata.group_summary(steps, ["session", "grp"])


@query(f"""
    WITH g AS (SELECT user_id, event_id // 50 AS grp, MIN(CASE WHEN event_type = 'click' THEN {MS} END) AS s, MAX({MS}) AS e FROM events GROUP BY 1, 2)
    SELECT user_id AS session, grp, s AS start_ms, GREATEST(s, e) AS end_ms, GREATEST(s, e) - s AS duration_ms FROM g WHERE s IS NOT NULL""")
def group_timing(t: Tables) -> DataFrame:
    rows = t.stream().select("session", F.floor(F.col("pos") / 50).alias("grp"), (F.col("event_type") == "click").alias("is_user"), "ts_ms")
    return metadata.group_timing(rows, ["session", "grp"])


@query("""
    SELECT c_custkey AS session, COALESCE(MIN(o_orderdate), DATE '1990-01-01') AS created FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def sessions_by_creation(t: Tables) -> DataFrame:
    first = t.orders.groupBy(F.col("o_custkey").alias("session")).agg(F.min("o_orderdate").alias("first_user_ts"))
    made = F.lit("1990-01-01").cast(t.orders.schema["o_orderdate"].dataType)
    all_ = t.customer.select(F.col("c_custkey").alias("session"), made.alias("file_ts")).join(first, "session", "left")
    return metadata.by_creation(all_).select("session", "created")


@query("SELECT o_custkey AS session, l_partkey AS id, MIN(o_orderkey) AS grp FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey % 3 = 0 GROUP BY 1, 2")
def group_of_member(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("group")).agg(F.collect_set("l_partkey").alias("members"))
    groups = lines.join(t.orders.select(F.col("o_orderkey").alias("group"), F.col("o_custkey").alias("session")), "group")
    wanted = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).where("l_partkey % 3 = 0").select(F.col("o_custkey").alias("session"), F.col("l_partkey").alias("id"))
    return metadata.holding(groups, "members", wanted, ["session"]).withColumnRenamed("group", "grp")


@query("SELECT event_id AS pos FROM events WHERE ts BETWEEN (SELECT MIN(ts) + INTERVAL 1 DAY FROM events) AND (SELECT MIN(ts) + INTERVAL 2 DAY FROM events)")
def messages_in_range(t: Tables) -> DataFrame:
    first = t.events.agg(F.min("ts").alias("t")).head().t
    rows = t.events.select(F.col("event_id").alias("pos"), "ts")
    day = F.expr("INTERVAL 1 DAY")
    return metadata.in_range(rows, F.lit(first) + day, F.lit(first) + day + day).select("pos")


@query("""
    WITH p AS (SELECT l_suppkey, l_orderkey, COUNT(*) AS n, CAST(SUM(FLOOR(l_quantity)) AS BIGINT) AS tokens FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY 1, 2)
    SELECT l_suppkey AS session, MAX(l_orderkey) AS grp, arg_max(n, l_orderkey) AS n, arg_max(tokens, l_orderkey) AS tokens FROM p GROUP BY 1""")
def phase_injections(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_suppkey").alias("session"), (F.col("l_orderkey") % 2 + 1).alias("phase"), F.col("l_orderkey").alias("group"), F.col("l_partkey").alias("id"), F.floor("l_quantity").cast("long").alias("tokens"))
    return metadata.phase_injections(rows, ["session"], 2).withColumnRenamed("group", "grp")


@query("""
    SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN '/reg/' || c_custkey WHEN 1 THEN '/hint/' || c_custkey WHEN 2 THEN '/cwd/' || c_custkey ELSE '/home/me/x' END AS path FROM customer""")
def project_paths(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    only = lambda n, prefix: F.when(k % 4 == n, F.concat(F.lit(prefix), k))
    hint = F.coalesce(only(1, "/hint/"), F.concat(F.lit("relative/"), k))
    return t.customer.select(k.alias("id"), metadata.project_path(only(0, "/reg/"), hint, only(2, "/cwd/"), paths.decode_path(F.lit("-home-me-x"))).alias("path"))


@query("SELECT DISTINCT o_custkey AS session FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber > 5 AND l_quantity >= 20")
def sessions_with_subagents(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", F.when(F.col("l_linenumber") > 5, F.col("l_linenumber")).alias("agent"), F.when(F.col("l_quantity") >= 20, 1).otherwise(0).alias("size"))
    return metadata.with_subagents(lines.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("session")), "l_orderkey"))


@query("""
    WITH d AS (SELECT event_id, CAST(FLOOR(value * 997) AS BIGINT) AS ms FROM events)
    SELECT event_id AS pos, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN CAST(CAST(ROUND(CAST(ms AS DECIMAL(30, 6)) / 1000, 1) AS DECIMAL(30, 1)) AS VARCHAR) || 's' WHEN ms // 1000 % 60 = 0 THEN ms // 60000 || 'm' ELSE ms // 60000 || 'm ' || ms // 1000 % 60 || 's' END AS short,
        CAST(CAST(ROUND(CAST(ms AS DECIMAL(30, 6)) / 1000, 1) AS DECIMAL(30, 1)) AS VARCHAR) || 's' AS seconds FROM d""")
def short_durations(t: Tables) -> DataFrame:
    ms = F.floor(F.col("value") * 997).cast("long")
    return t.events.select(F.col("event_id").alias("pos"), formats.format_duration_short(ms).alias("short"), formats.format_seconds(ms).alias("seconds"))


_FIELD_RULES = [
    rules.Rule("f1", "command", "tool_use", tool="click", pattern="^[0-4]$", field="k"),
    rules.Rule("f2", "any field", "tool_use", pattern="7", ignore=["17", "27"]),
    rules.Rule("f3", "in a repository", "tool_use", pattern="3", field="k", repositories=["r1"]),
    rules.Rule("f4", "no such field", "tool_use", pattern=".", field="other"),
    rules.Rule("f5", "large", "token_threshold", threshold=100, ignore=["^view"]),
]


@query("""
    WITH e AS (SELECT *, json_extract_string(props, '$.k') AS k FROM events)
    SELECT event_id AS message, 'f1' AS rule_id FROM e WHERE event_type = 'click' AND regexp_matches(k, '^[0-4]$') UNION ALL SELECT event_id, 'f2' FROM e WHERE regexp_matches(props, '7') AND NOT regexp_matches(props, '17|27')
    UNION ALL SELECT event_id, 'f3' FROM e WHERE user_id % 5 = 1 AND regexp_matches(k, '3')""")
def triggers_field(t: Tables) -> DataFrame:
    """Rules that look at one field of a call's input, or are meant for some repositories only."""
    e = t.events
    repository = F.when(e.user_id % 5 < 4, F.concat(F.lit("r"), e.user_id % 5))
    calls = e.select(F.col("user_id").cast("string").alias("project"), repository.alias("repository"), F.col("event_id").alias("message"), F.lit(0).alias("pos"), F.col("event_type").alias("tool"), F.col("props").alias("input"))
    return rules.match_uses(calls, rules.rule_table(t.spark, _FIELD_RULES)).select("message", "rule_id")


@query("SELECT event_id AS message, CAST(FLOOR(value) AS BIGINT) AS tokens FROM events WHERE FLOOR(value) > 100 AND event_type <> 'view'")
def triggers_tokens_ignored(t: Tables) -> DataFrame:
    calls = t.events.select(
        F.col("user_id").cast("string").alias("project"), F.col("event_id").alias("message"), F.col("event_type").alias("tool"), F.floor("value").cast("long").alias("input_tokens"),
        F.lit(0).cast("long").alias("output_tokens"), F.col("props").alias("input"),
    )
    return rules.match_tokens(calls, rules.rule_table(t.spark, _FIELD_RULES)).select("message", "tokens")


@query("""
    SELECT event_id AS pos, CASE event_id % 6 WHEN 0 THEN 'oops' WHEN 1 THEN 'err ' || event_id WHEN 2 THEN 'content' WHEN 3 THEN 'said' ELSE '' END AS content,
        CASE event_id % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'one' || chr(10) || event_id ELSE 'Unknown error' END AS error FROM events""")
def rich_results(t: Tables) -> DataFrame:
    """The text of enriched results and of errors."""
    k = F.col("event_id")
    enriched = (
        F.when(k % 6 == 0, '{"error":"oops","stderr":"no"}').when(k % 6 == 1, F.concat(F.lit('{"error":{"a":1},"stderr":"err '), k, F.lit('","content":"no"}')))
        .when(k % 6 == 2, '{"stderr":"  ","content":"content"}').when(k % 6 == 3, '{"content":["x"],"message":"said"}').otherwise('{"content":5}')
    )
    blocks = F.concat(F.lit('[{"type":"text","text":"one"},{"type":"image"},{"type":"text","text":"'), k, F.lit('"}]'))
    content = F.when(k % 3 == 0, '" plain "').when(k % 3 == 1, blocks).otherwise('"  "')
    return t.events.select(k.alias("pos"), rules.enriched_text(enriched).alias("content"), rules.error_text(content).alias("error"))


@query("SELECT event_id AS id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 40")
def alert_page(t: Tables) -> DataFrame:
    return rules.page_of(t.events.select(F.col("event_id").alias("id"), "ts"), offset=40).select("id")


@query("""
    SELECT event_id AS id, CASE WHEN event_type = 'click' THEN true ELSE value > 50 END AS is_read FROM events WHERE event_type <> 'error'""")
def alerts_by_rule(t: Tables) -> DataFrame:
    """Alerts after those of one rule were cleared and those of another marked as read."""
    rows = t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("rule_name"), (F.col("value") > 50).alias("is_read"))
    return rules.mark_rule_read(rules.clear(rows, "error"), "click").select("id", "is_read")


@query("""
    WITH f AS (SELECT COUNT(*) AS n FROM events WHERE regexp_matches(props, '1')), r AS (SELECT event_id FROM events WHERE regexp_matches(props, '1') ORDER BY event_id DESC LIMIT 50)
    SELECT event_id AS message, LEAST(n, 10000) AS total, n > 10000 AS truncated FROM r, f""")
def rule_trial(t: Tables) -> DataFrame:
    """What a rule would have found so far: the newest 50, and how many in all."""
    calls = t.events.select(F.lit("p").alias("project"), F.col("event_id").alias("message"), F.lit(0).alias("pos"), F.col("event_type").alias("tool"), F.col("props").alias("input"))
    rule = rules.Rule("t", "trial", "tool_use", pattern="1")
    return rules.trial(rules.match_uses(calls, rules.rule_table(t.spark, [rule])), F.desc("message")).select("message", "total", "truncated")


@query("""
    SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN CASE WHEN l_orderkey % 2 = 0 THEN 'a.py - 2 lines' ELSE 'a.py - 1 -> 2 lines' END WHEN 2 THEN 'b.py - lines ' || l_orderkey || '-' || (l_orderkey + 9) WHEN 3 THEN '"x" in src'
        WHEN 4 THEN CASE l_orderkey % 3 WHEN 1 THEN '1 item' WHEN 2 THEN '2 items' ELSE '0 items' END WHEN 5 THEN '#' || l_orderkey || ' done -> me' WHEN 6 THEN 'To bob: hi' ELSE 'insert - n.ipynb' END AS line FROM lineitem""")
def tool_lines(t: Tables) -> DataFrame:
    """The longer line about a call: counts of lines, ranges, places and recipients."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    name = F.element_at(F.array(*map(F.lit, ("Edit", "Read", "Grep", "TodoWrite", "TaskUpdate", "SendMessage", "NotebookEdit"))), n)
    edit = F.when(k % 2 == 0, '{"file_path":"/x/a.py","old_string":"1\\n2","new_string":"3\\n4"}').otherwise('{"file_path":"/x/a.py","old_string":"1","new_string":"3\\n4"}')
    todos = F.when(k % 3 == 1, '{"todos":[1]}').when(k % 3 == 2, '{"todos":[1,2]}').otherwise('{"todos":[]}')
    input_ = (
        F.when(n == 1, edit).when(n == 2, F.concat(F.lit('{"file_path":"b.py","limit":10,"offset":'), k, F.lit("}"))).when(n == 3, '{"pattern":"x","path":"/a/src"}').when(n == 4, todos)
        .when(n == 5, F.concat(F.lit('{"taskId":"'), k, F.lit('","status":"done","owner":"me"}'))).when(n == 6, '{"type":"message","recipient":"bob","summary":"hi"}').otherwise('{"notebook_path":"/x/n.ipynb","edit_mode":"insert"}')
    )
    return t.lineitem.select("l_orderkey", "l_linenumber", X.tool_line(name, input_).alias("line"))


@query("""
    WITH c AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'assistant' THEN CASE turn % 3 WHEN 0 THEN 'thinking' WHEN 1 THEN 'tool_call' ELSE 'output' END WHEN turn % 2 = 0 THEN 'tool_result' ELSE 'interruption' END AS step FROM conversations WHERE role IN ('assistant', 'user'))
    SELECT conv_id AS session, turn AS line_no, step, CASE WHEN step = 'tool_call' THEN CAST(CEIL((LENGTH(text) + 4) / 4.0) AS BIGINT) WHEN step = 'interruption' THEN 7 ELSE CAST(CEIL(LENGTH(text) / 4.0) AS BIGINT) END AS tokens FROM c""")
def block_steps(t: Tables) -> DataFrame:
    """Steps of message rows with content blocks of every kind."""
    from tracewell.operators import views

    c, turn = t.conversations.where("role in ('assistant', 'user')"), F.col("turn")
    assistant, none = F.col("role") == "assistant", F.lit(None).cast("string")
    kind = F.when(assistant, F.when(turn % 3 == 0, "thinking").when(turn % 3 == 1, "tool_use").otherwise("text")).when(turn % 2 == 0, "tool_result").otherwise("text")
    pick = lambda k: F.when(kind == k, F.col("text"))
    said = F.when(assistant, pick("text")).otherwise(F.when(kind == "text", X.INTERRUPTED))
    block = F.struct(
        kind.alias("type"), said.alias("text"), pick("thinking").alias("thinking"), pick("tool_result").alias("content_json"), pick("tool_use").alias("input_json"),
        none.alias("id"), none.alias("tool_use_id"), F.when(kind == "tool_use", "Bash").alias("name"), F.lit(False).alias("is_error"),
    )
    rows = c.select(F.col("conv_id").alias("session"), turn.alias("line_no"), none.alias("uuid"), none.alias("ts"), F.col("role").alias("type"), F.lit("array").alias("content_kind"), "text", F.array(block).alias("blocks"))
    return views.steps(rows).select("session", "line_no", "step", "tokens")
