"""Queries over the fixture tables for the state of a context and for the items of subagents.

Events stand in for chat items: signups are users' turns, errors compactions, the rest ai groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracewell.functions import worktrees as W
from tracewell.operators import context_state as S, exports, items as I
from tracewell.plans.catalog import Tables, query

BY = ["session"]
_SIZES = {"enterprise": None, "user": 120, "project": 0, "project-alt": 30, "project-rules": 45, "project-local": 0, "user-rules": None, "auto-memory": 77}


def _groups(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "user").when(F.col("event_type") == "error", "compact").otherwise("ai")
    e = t.stream().select("session", "pos", kind.alias("item"), "event_type", F.col("n").alias("input"), F.when(F.col("event_type") == "click", F.col("n")).alias("first_total"), F.when(F.col("event_type") != "purchase", F.col("n") + 1).alias("last_total"))
    return S.ai_groups(e, BY)


def _injections(t: Tables, groups: DataFrame) -> DataFrame:
    s = t.stream()
    null = F.lit(None).cast("string")
    row = lambda where, category, what, tokens, n, order: s.where(where).select("session", "pos", F.lit(category).alias("category"), what.alias("what"), tokens.cast("long").alias("tokens"), n.cast("long").alias("n"), F.lit(order).cast("long").alias("order_no"))
    pos, one = F.col("pos"), F.lit(1)
    file = F.concat(F.lit("/r/f"), pos % 5)
    on_users = row("event_type = 'signup'", "user-message", null, 1 + pos % 50, one, 1).unionByName(row("event_type = 'signup'", "mentioned-file", file, 10 + pos % 5, one, 2))
    note = F.concat(F.lit("/r/d"), pos % 6, F.lit("/NOTE.md"))
    on_groups = row("event_type = 'click'", "claude-md", note, F.lit(500), one, 0).unionByName(row("event_type = 'view'", "mentioned-file", file, 10 + pos % 5, one, 3)).unionByName(row("event_type = 'purchase'", "tool-output", null, pos % 97, 1 + pos % 3, 4))
    sources = F.array(*[F.struct(F.lit(k).alias("source"), F.lit(f"/g/{k}").alias("path"), F.lit(v).cast("long").alias("tokens")) for k, v in _SIZES.items()])
    everywhere = S.global_notes(s.select("session").distinct().select("session", F.inline(sources)), BY)
    return S.injections(groups, BY, on_groups, on_users, everywhere)


_VALUES = ", ".join(f"('/g/{k}', CAST({500 if v is None else v} AS BIGINT), CAST({n - len(_SIZES)} AS BIGINT))" for n, (k, v) in enumerate(_SIZES.items()) if v != 0)
_SQL = f"""
    WITH e AS (SELECT user_id AS session, event_id AS pos, event_type AS t, CASE event_type WHEN 'signup' THEN 'user' WHEN 'error' THEN 'compact' ELSE 'ai' END AS item, CAST(FLOOR(value) AS BIGINT) AS v FROM events),
    m AS (SELECT *, CAST(1 + SUM(CASE WHEN item = 'compact' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS phase, MAX(CASE WHEN item = 'compact' THEN pos END) OVER w AS compact_pos,
        MAX(CASE WHEN item = 'user' THEN pos END) OVER p AS lu, MAX(CASE WHEN item <> 'user' THEN pos END) OVER p AS lo, MAX(CASE WHEN item = 'ai' THEN pos END) OVER p AS previous_group
        FROM e WINDOW w AS (PARTITION BY session ORDER BY pos), p AS (PARTITION BY session ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    g AS (SELECT session, pos AS grp, phase, CAST(ROW_NUMBER() OVER x AS BIGINT) AS place, LEAD(pos) OVER x IS NULL AS is_last, CASE WHEN lo IS NULL OR lu > lo THEN lu END AS user_pos, compact_pos, previous_group, t, v
        FROM m WHERE item = 'ai' WINDOW x AS (PARTITION BY session, phase ORDER BY pos)),
    i AS (SELECT session, phase, grp, place, 'claude-md' AS category, what, tokens, CAST(1 AS BIGINT) AS n, o FROM g, (VALUES {_VALUES}) z(what, tokens, o) WHERE place = 1
        UNION ALL SELECT session, phase, grp, place, 'claude-md', '/r/d' || grp % 6 || '/NOTE.md', 500, 1, 0 FROM g WHERE t = 'click'
        UNION ALL SELECT session, phase, grp, place, 'mentioned-file', '/r/f' || grp % 5, 10 + grp % 5, 1, 3 FROM g WHERE t = 'view'
        UNION ALL SELECT session, phase, grp, place, 'tool-output', NULL, grp % 97, 1 + grp % 3, 4 FROM g WHERE t = 'purchase'
        UNION ALL SELECT session, phase, grp, place, 'user-message', NULL, 1 + user_pos % 50, 1, 1 FROM g WHERE user_pos IS NOT NULL
        UNION ALL SELECT session, phase, grp, place, 'mentioned-file', '/r/f' || user_pos % 5, 10 + user_pos % 5, 1, 2 FROM g WHERE user_pos IS NOT NULL),
    f AS (SELECT * FROM i WHERE what IS NULL UNION ALL (SELECT * FROM i WHERE what IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY session, phase, what ORDER BY place, o, category) = 1))"""


@query(f"""{_SQL},
    s AS (SELECT session, grp, SUM(CASE WHEN category = 'claude-md' THEN tokens ELSE 0 END) AS notes, SUM(CASE WHEN category = 'mentioned-file' THEN tokens ELSE 0 END) AS files, SUM(CASE WHEN category = 'tool-output' THEN n ELSE 0 END) AS tools, SUM(tokens) AS every FROM f GROUP BY session, grp)
    SELECT g.session, g.grp, g.phase, g.place, g.is_last, g.user_pos, CAST(COALESCE(notes, 0) AS BIGINT) AS new_notes, CAST(SUM(COALESCE(notes, 0)) OVER x AS BIGINT) AS notes, CAST(SUM(COALESCE(files, 0)) OVER x AS BIGINT) AS files,
        CAST(SUM(COALESCE(tools, 0)) OVER x AS BIGINT) AS n_tools, CAST(SUM(COALESCE(every, 0)) OVER x AS BIGINT) AS total_tokens
    FROM g LEFT JOIN s ON s.session = g.session AND s.grp = g.grp WINDOW x AS (PARTITION BY g.session, g.phase ORDER BY g.place)""")
def context_groups(t: Tables) -> DataFrame:
    """What each ai group's context holds."""
    groups = _groups(t)
    stats = S.group_stats(groups, _injections(t, groups), BY)
    of = lambda m, c, name: F.col(m)[c].alias(name)
    return stats.select("session", F.col("group").alias("grp"), "phase", "place", "is_last", "user_pos", of("new_tokens", "claude-md", "new_notes"), of("tokens", "claude-md", "notes"), of("tokens", "mentioned-file", "files"), of("count", "tool-output", "n_tools"), "total_tokens")


@query(f"{_SQL} SELECT f.session, f.phase, g.grp AS held_by, f.grp, category, what, tokens FROM f JOIN g ON g.session = f.session AND g.phase = f.phase AND g.is_last")
def context_lists(t: Tables) -> DataFrame:
    """The whole list of each phase's last group."""
    groups = _groups(t)
    return S.last_lists(_injections(t, groups), groups, BY).select("session", "phase", "held_by", F.col("group").alias("grp"), "category", "what", "tokens")


@query(f"{_SQL} SELECT g.session, g.grp AS held_by, COUNT(*) AS n, CAST(SUM(tokens) AS BIGINT) AS tokens FROM f JOIN g ON g.session = f.session AND g.phase = f.phase AND f.place <= g.place WHERE g.place % 3 = 2 GROUP BY g.session, g.grp")
def context_held(t: Tables) -> DataFrame:
    """How much every third group holds, looked up in the spans."""
    groups = _groups(t)
    return S.held_at(_injections(t, groups), groups.where("place % 3 = 2"), BY).groupBy("session", "held_by").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


@query(f"""{_SQL},
    p AS (SELECT session, phase, MIN(grp) AS first_group, MAX(grp) AS last_group, MIN(compact_pos) AS compact_pos, arg_min(previous_group, grp) FILTER (place = 1) AS prev, ANY_VALUE(CASE WHEN place = 1 AND t = 'click' THEN v END) AS reading FROM g GROUP BY session, phase),
    d AS (SELECT p.*, CASE WHEN g.t <> 'purchase' THEN g.v + 1 END AS pre FROM p LEFT JOIN g ON g.session = p.session AND g.grp = p.prev)
    SELECT session, phase, first_group, last_group, compact_pos, CASE WHEN compact_pos IS NOT NULL AND reading IS NOT NULL THEN pre END AS before, CASE WHEN compact_pos IS NOT NULL AND pre IS NOT NULL THEN reading END AS after, CASE WHEN compact_pos IS NOT NULL THEN reading - pre END AS delta FROM d""")
def context_phases(t: Tables) -> DataFrame:
    return S.phases(_groups(t), BY)


@query(f"""{_SQL},
    c AS (SELECT '/r/d' || n_nationkey % 6 || '/NOTE.md' AS what, arg_max(CASE WHEN n_nationkey % 6 = 5 THEN -1 ELSE n_nationkey * 10 END, n_nationkey) AS tokens FROM nation WHERE n_nationkey % 6 <> 4 GROUP BY 1),
    n AS (SELECT f.session, f.grp, COUNT(*) AS k, SUM(f.tokens) AS x, COUNT(CASE WHEN COALESCE(c.tokens, f.tokens) > 0 THEN 1 END) AS ka, SUM(GREATEST(COALESCE(c.tokens, f.tokens), 0)) AS xa FROM f LEFT JOIN c ON c.what = f.what WHERE category = 'claude-md' GROUP BY f.session, f.grp),
    r AS (SELECT g.session, g.grp, v, COALESCE(k, 0) AS new_count, COALESCE(ka, 0) AS new_count_after, SUM(COALESCE(k, 0)) OVER w AS count, SUM(COALESCE(x, 0)) OVER w AS tokens, SUM(COALESCE(ka, 0)) OVER w AS count_after, SUM(COALESCE(xa, 0)) OVER w AS tokens_after
        FROM g LEFT JOIN n ON n.session = g.session AND n.grp = g.grp WINDOW w AS (PARTITION BY g.session, g.phase ORDER BY g.place))
    SELECT session, grp, new_count, CAST(count AS BIGINT) AS count, CAST(tokens AS BIGINT) AS tokens, CASE WHEN v > 0 THEN CAST(tokens AS DOUBLE) / v * 100 ELSE 0.0 END AS percent,
        new_count_after, CAST(count_after AS BIGINT) AS count_after, CAST(tokens_after AS BIGINT) AS tokens_after, CASE WHEN v > 0 THEN CAST(tokens_after AS DOUBLE) / v * 100 ELSE 0.0 END AS percent_after FROM r""")
def note_corrections(t: Tables) -> DataFrame:
    """Notes in each group's context by their estimates, and once their real sizes are known."""
    groups, k = _groups(t), F.col("n_nationkey")
    readings = t.nation.where(k % 6 != 4).select(F.concat(F.lit("/r/d"), k % 6, F.lit("/NOTE.md")).alias("what"), F.when(k % 6 != 5, k * 10).cast("long").alias("tokens"), k.alias("at"))
    return S.note_tracker(groups, _injections(t, groups), BY, readings).withColumnRenamed("group", "grp")


def _messages(t: Tables) -> DataFrame:
    """Conversations as messages of a subagent: replies think, speak and call, users answer, bring results or a teammate's words, system rows are compactions."""
    turn, role = F.col("turn"), F.col("role")
    block = lambda **v: F.struct(*[v.get(k, F.lit(False) if k == "is_error" else F.lit(None).cast("string")).alias(k) for k in ("type", "text", "thinking", "id", "name", "input_json", "tool_use_id", "content_json", "is_error")])
    call = F.concat(F.lit("t"), turn)
    name = F.when(turn % 3 == 0, "SendMessage").when(turn % 3 == 1, "Task").otherwise("Read")
    given = F.when(turn % 3 == 0, F.concat(F.lit('{"type":"'), F.when(turn % 2 == 0, "broadcast").otherwise("message"), F.lit('","recipient":"bob","summary":"s'), turn, F.lit('"}'))).otherwise("{}")
    spoken = F.array(block(type=F.lit("thinking"), thinking=F.when(turn % 2 == 1, F.substring("text", 1, 10)).otherwise("")), block(type=F.lit("text"), text=F.col("text")), block(type=F.lit("tool_use"), id=call, name=name, input_json=given))
    brought = F.array(block(type=F.lit("tool_result"), tool_use_id=F.concat(F.lit("t"), turn - 1), content_json=F.concat(F.lit('"r'), turn, F.lit('"')), is_error=turn % 2 == 0))
    array = (role == "assistant") | ((role == "user") & (turn % 3 == 2))
    said = F.when((role == "user") & (turn % 6 == 4), F.concat(F.lit('<teammate-message teammate_id="bob" summary="hey">'), F.col("conv_id"), F.lit("</teammate-message>"))).otherwise(F.col("text"))
    none = F.array().cast("array<struct<type:string,text:string,thinking:string,id:string,name:string,input_json:string,tool_use_id:string,content_json:string,is_error:boolean>>")
    size = F.struct((turn * 10).alias("input"), F.lit(1).cast("long").alias("output"), turn.alias("cache_read"), F.lit(5).cast("long").alias("cache_creation"))
    return t.conversations.select(
        F.col("conv_id").alias("session"), turn.alias("line_no"), F.concat(F.lit("u"), turn).alias("uuid"), F.lit(None).cast("string").alias("parent_uuid"), F.lit(None).cast("string").alias("source_tool_use_id"), F.timestamp_seconds(turn * 60).alias("ts"),
        F.when(role == "system", "user").otherwise(role).alias("type"), F.lit(False).alias("is_meta"), (role == "system").alias("is_compact"), F.lit("m").alias("model"), (role == "assistant").alias("has_usage"), size.alias("usage"),
        F.when(array, "array").otherwise("string").alias("content_kind"), F.when(~array, said).alias("text"), F.when(role == "assistant", spoken).when(array, brought).otherwise(none).alias("blocks"),
    )


_TOKENS = "CAST(CEIL(LENGTH({}) / 4.0) AS BIGINT)"


@query(f"""
    WITH c AS (SELECT conv_id AS session, turn, role, text, LAST_VALUE(CASE WHEN role = 'assistant' THEN turn * 11 + 5 END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pre,
        FIRST_VALUE(CASE WHEN role = 'assistant' THEN turn * 11 + 5 END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS post,
        1 + SUM(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS phase FROM conversations),
    w AS (SELECT *, trim(text) AS said, '{{"type":"' || CASE WHEN turn % 2 = 0 THEN 'broadcast' ELSE 'message' END || '","recipient":"bob","summary":"s' || turn || '"}}' AS send, CASE turn % 3 WHEN 0 THEN 'SendMessage' WHEN 1 THEN 'Task' ELSE 'Read' END AS tool FROM c),
    i AS (SELECT session, 'compact_boundary' AS kind, NULL AS id, NULL AS name, NULL AS tokens, CAST(NULL AS BOOLEAN) AS is_orphan, turn * 60 AS s, 0 AS rank, turn AS line, 0 AS block, CAST(phase AS BIGINT) AS phase, CASE WHEN pre > 0 THEN pre END AS before, CASE WHEN pre > 0 THEN COALESCE(post, 0) END AS after FROM w WHERE role = 'system'
        UNION ALL SELECT session, 'teammate_message', 'u' || turn || '-bob-0', 'bob', {_TOKENS.format("CAST(session AS VARCHAR)")}, NULL, turn * 60, 0, turn, 0, NULL, NULL, NULL FROM w WHERE role = 'user' AND turn % 6 = 4
        UNION ALL SELECT session, 'subagent_input', NULL, NULL, {_TOKENS.format("text")}, NULL, turn * 60, 0, turn, 0, NULL, NULL, NULL FROM w WHERE role = 'user' AND turn % 6 <> 4 AND turn % 3 <> 2 AND said <> ''
        UNION ALL SELECT session, 'thinking', NULL, NULL, {_TOKENS.format("SUBSTR(text, 1, 10)")}, NULL, turn * 60, 0, turn, 0, NULL, NULL, NULL FROM w WHERE role = 'assistant' AND turn % 2 = 1 AND text <> ''
        UNION ALL SELECT session, 'output', NULL, NULL, {_TOKENS.format("text")}, NULL, turn * 60, 0, turn, 1, NULL, NULL, NULL FROM w WHERE role = 'assistant' AND text <> ''
        UNION ALL SELECT w.session, 'tool', 't' || w.turn, tool, {_TOKENS.format("tool || CASE WHEN w.turn % 3 = 0 THEN send ELSE '{}' END")}, r.turn IS NULL, w.turn * 60, 1, w.turn, 2, NULL, NULL, NULL FROM w LEFT JOIN conversations r ON r.conv_id = w.session AND r.turn = w.turn + 1 AND r.role = 'user' AND r.turn % 3 = 2
            WHERE w.role = 'assistant' AND NOT (w.session % 2 = 0 AND w.turn = 1)
        UNION ALL SELECT DISTINCT session, 'subagent', 'a' || session, NULL, NULL, CAST(NULL AS BOOLEAN), 90, 2, 0, 0, NULL, NULL, NULL FROM w WHERE session % 2 = 0),
    o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session ORDER BY s, rank, line, block, id) - 1 AS "index" FROM i),
    b AS (SELECT *, CASE WHEN kind = 'teammate_message' THEN LAST_VALUE(CASE WHEN name = 'SendMessage' THEN id END IGNORE NULLS) OVER (PARTITION BY session ORDER BY "index" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS reply_to FROM o)
    SELECT session, CAST("index" AS INTEGER) AS "index", kind, id, name, tokens, is_orphan, phase, before, after, reply_to FROM b""")
def subagent_items(t: Tables) -> DataFrame:
    agents = t.conversations.where("conv_id % 2 = 0").select(F.col("conv_id").alias("session"), F.concat(F.lit("a"), "conv_id").alias("id"), F.lit("t1").alias("parent_task"), F.timestamp_seconds(F.lit(90)).alias("ts")).distinct()
    return I.subagent_items(_messages(t), agents).select("session", "index", "kind", "id", "name", "tokens", "is_orphan", "phase", "before", "after", "reply_to")


def _export(t: Tables, style: str) -> DataFrame:
    m = _messages(t)
    kind = F.when(F.col("is_compact"), "compact").when((F.col("type") == "user") & (F.col("content_kind") == "string"), "user").otherwise("ai")
    chunks = m.select("session", F.col("line_no").alias("pos"), kind.alias("kind"), "text")
    replies = m.where(kind == "ai").select("session", F.col("line_no").alias("pos"), "line_no", "content_kind", "text", "blocks")
    calls = replies.where("get(blocks, 2).type = 'tool_use'").select("session", "pos", F.lit(0).alias("tool_no"), F.get("blocks", F.lit(2))["name"].alias("name"), F.get("blocks", F.lit(2))["input_json"].alias("input"))
    came = replies.where("get(blocks, 0).type = 'tool_result'").select("session", (F.col("pos") - 1).alias("pos"), F.repeat(F.get("blocks", F.lit(0))["content_json"], 1000).alias("result"), F.get("blocks", F.lit(0))["is_error"].alias("is_error"))
    tools = calls.join(came, ["session", "pos"], "left").withColumn("is_orphan", F.col("result").isNull())
    sums = t.conversations.groupBy(F.col("conv_id").alias("session")).agg(F.count("*").alias("message_count"), F.sum(F.length("text")).alias("total_tokens"), F.max("turn").alias("input_tokens"))
    sessions = sums.select(
        "session", F.concat(F.lit("/p/"), "session").alias("project"), F.when(F.col("session") % 2 == 0, "dev").alias("branch"), F.timestamp_seconds(F.col("session") * 100_000).alias("created"), (F.col("session") * 7_001).alias("duration_ms"),
        "total_tokens", "input_tokens", F.lit(0).alias("output_tokens"), (F.col("total_tokens") * 1000).alias("cache_read_tokens"), F.lit(1).alias("cache_creation_tokens"), "message_count",
    )
    return exports.numbered(exports.export_parts(sessions, chunks, replies, tools, BY, style), BY)


def _export_sql(style: str) -> str:
    plain = style == "plaintext"
    nl, double, single = "chr(10)", "repeat('═', 60)", "repeat('─', 40)"
    lines = lambda *xs: f"concat_ws({nl}, {', '.join(xs)})"
    group = lambda c: f"format('{{:,}}', CAST({c} AS BIGINT))"
    seconds = "(conv_id * 7001 // 1000)"
    duration = f"CASE WHEN conv_id * 7001 < 1000 THEN (conv_id * 7001) || 'ms' WHEN {seconds} < 60 THEN {seconds} || 's' ELSE ({seconds} // 60) || 'm ' || ({seconds} % 60) || 's' END"
    date = "strftime(make_timestamp(conv_id * 100000 * 1000000), '%Y-%m-%d %H:%M:%S') || ' UTC'"
    sums = [("Duration", duration), ("Total Tokens", group("total")), ("Input Tokens", group("top")), ("Output Tokens", "'0'"), ("Cache Read", group("total * 1000")), ("Cache Created", "'1'"), ("Messages", group("n")), ("Cost", "'N/A'")]
    if plain:
        head = lines(double, "'SESSION EXPORT'", double, "'Session:  ' || conv_id", "'Project:  /p/' || conv_id", "CASE WHEN conv_id % 2 = 0 THEN 'Branch:   dev' END", f"'Date:     ' || {date}", "''", single, "'METRICS'", single, *[f"'{(k + ':').ljust(16)}' || {v}" for k, v in sums], "''", double, "'CONVERSATION'", double, "''")
        chunk = lines(single, "CASE kind WHEN 'user' THEN 'USER: ' || said WHEN 'compact' THEN '[Context compacted]' END")
        thought, text, first = "'THINKING: ' || t", "t", "'ASSISTANT: ' || t"
        tool = lines("'  TOOL: ' || name", "'  Input: ' || given", "COALESCE(CASE WHEN bad THEN '  [ERROR] Result: ' ELSE '  Result: ' END || SUBSTR(result, 1, 500) || '...', '  [No result]')")
    else:
        row = lambda k, v: f"'| {k} | ' || {v} || ' |'"
        head = lines("'# Session Export'", "''", "'| Property | Value |'", "'|----------|-------|'", "'| Session | `' || conv_id || '` |'", "'| Project | `/p/' || conv_id || '` |'", "CASE WHEN conv_id % 2 = 0 THEN '| Branch | `dev` |' END", row("Date", date), "''", "'## Metrics'", "''", "'| Metric | Value |'", "'|--------|-------|'", *[row(k, v) for k, v in sums], "''", "'## Conversation'", "''")
        title = lambda who: f"'### {who} (Turn ' || no || ')'"
        chunk = f"CASE kind WHEN 'user' THEN {lines(title('User'), chr(39) * 2, 'said', chr(39) * 2)} WHEN 'ai' THEN {lines(title('Assistant'), chr(39) * 2)} ELSE {lines(chr(39) + '---' + chr(39), chr(39) * 2, chr(39) + '*Context compacted*' + chr(39), chr(39) * 2)} END"
        thought, text, first = f"'> *Thinking:*' || {nl} || '> ' || REPLACE(t, {nl}, {nl} || '> ') || {nl}", f"t || CASE WHEN last THEN {nl} ELSE '' END", f"t || CASE WHEN last THEN {nl} ELSE '' END"
        tool = lines("'**Tool:** `' || name || '`'", "''", "'```json'", "readable", "'```'", "''", f"CASE WHEN bad THEN '**Error:**' ELSE '**Result:**' END || {nl} || {nl} || '```' || {nl} || SUBSTR(result, 1, 2000) || '...' || {nl} || '```'", "''")
    tail = "UNION ALL SELECT conv_id, 1, turn, 3, 0, 0, '' FROM c" if plain else ""
    send = "CASE WHEN turn % 3 = 0 THEN '{\"type\":\"' || CASE WHEN turn % 2 = 0 THEN 'broadcast' ELSE 'message' END || '\",\"recipient\":\"bob\",\"summary\":\"s' || turn || '\"}' ELSE '{}' END"
    return f"""
    WITH c AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) AS no, CASE WHEN role = 'system' THEN 'compact' WHEN role = 'user' AND turn % 3 <> 2 THEN 'user' ELSE 'ai' END AS kind,
        CASE WHEN role = 'user' AND turn % 6 = 4 THEN '<teammate-message teammate_id="bob" summary="hey">' || conv_id || '</teammate-message>' ELSE text END AS said, CASE turn % 3 WHEN 0 THEN 'SendMessage' WHEN 1 THEN 'Task' ELSE 'Read' END AS name, {send} AS given FROM conversations),
    e AS (SELECT *, CASE WHEN given = '{{}}' THEN given ELSE REPLACE(REPLACE(REPLACE(REPLACE(given, '{{', '{{' || {nl} || '  '), '}}', {nl} || '}}'), ',', ',' || {nl} || '  '), ':', ': ') END AS readable FROM c),
    b AS (SELECT conv_id, turn, 0 AS block, true AS thinking, CASE WHEN turn % 2 = 1 THEN SUBSTR(text, 1, 10) ELSE '' END AS t, false AS first, false AS last FROM e WHERE role = 'assistant'
        UNION ALL SELECT conv_id, turn, 1000001, false, text, true, false FROM e WHERE role = 'assistant'
        UNION ALL SELECT conv_id, turn, 1000002, false, 'Tool: ' || name || {nl} || 'Input: ' || readable, false, true FROM e WHERE role = 'assistant'
        UNION ALL SELECT conv_id, turn, 1000000, false, '"r' || turn || '"', true, true FROM e WHERE role = 'user' AND turn % 3 = 2),
    x AS (SELECT e.*, repeat('"r' || r.turn || '"', 1000) AS result, r.turn % 2 = 0 AS bad FROM e LEFT JOIN conversations r ON r.conv_id = e.conv_id AND r.turn = e.turn + 1 AND r.role = 'user' AND r.turn % 3 = 2 WHERE e.role = 'assistant'),
    s AS (SELECT conv_id, COUNT(*) AS n, SUM(LENGTH(text)) AS total, MAX(turn) AS top FROM conversations GROUP BY conv_id),
    p AS (SELECT conv_id, 0 AS section, 0 AS pos, 0 AS step, 0 AS line, 0 AS block, {head} AS text FROM s
        UNION ALL SELECT conv_id, 1, turn, 0, 0, 0, {chunk} FROM c
        UNION ALL SELECT conv_id, 1, turn, 1, turn, block, CASE WHEN thinking THEN {thought} WHEN first THEN {first} ELSE {text} END FROM b
        UNION ALL SELECT conv_id, 1, turn, 2, 0, 0, {tool} FROM x {tail})
    SELECT conv_id AS session, CAST(ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY section, pos, step, line, block) - 1 AS INTEGER) AS part, text FROM p"""


@query(_export_sql("plaintext"))
def export_plain_parts(t: Tables) -> DataFrame:
    """Sessions as plain text, part by part."""
    return _export(t, "plaintext")


@query(_export_sql("markdown"))
def export_markdown_parts(t: Tables) -> DataFrame:
    """Sessions as Markdown, part by part."""
    return _export(t, "markdown")


_PATHS = "CASE c_custkey % 9 WHEN 0 THEN '/home/u/.cursor/worktrees/' || c_mktsegment || '/w1' WHEN 1 THEN '/tmp/vibe-kanban/worktrees/' || c_custkey || '-x/' || c_mktsegment WHEN 2 THEN '/u/conductor/workspaces/' || c_mktsegment || '/n' || c_nationkey WHEN 3 THEN '/u/' || c_mktsegment || '/.auto-claude/worktrees/tasks/00' || c_nationkey WHEN 4 THEN '/u/' || c_mktsegment || '/.21st/worktrees/id/name [' || c_custkey || ']' WHEN 5 THEN '/u/.claude-worktrees/' || c_mktsegment || '/n' || c_nationkey WHEN 6 THEN '/u/.ccswitch/worktrees/' || c_mktsegment || '/n' || c_nationkey WHEN 7 THEN '/u/work/' || c_mktsegment ELSE '/' END"


@query(rf"""
    WITH p AS (SELECT c_custkey, {_PATHS} AS path, CASE WHEN c_custkey % 4 = 0 THEN 'b' || c_nationkey END AS branch, c_custkey % 3 = 0 AS is_main FROM customer),
    l AS (SELECT *, NULLIF(regexp_extract(path, '([^/]+)/*$', 1), '') AS last FROM p)
    SELECT c_custkey, COALESCE(NULLIF(regexp_extract(path, '/\.cursor/worktrees/([^/]+)', 1), ''), CASE WHEN path LIKE '%/vibe-kanban/worktrees/%' THEN last END, NULLIF(regexp_extract(path, '/conductor/workspaces/([^/]+)', 1), ''), NULLIF(regexp_extract(path, '/([^/]+)/\.(auto-claude|21st)/worktrees/', 1), ''),
        NULLIF(regexp_extract(path, '/\.claude-worktrees/([^/]+)', 1), ''), NULLIF(regexp_extract(path, '/\.ccswitch/worktrees/([^/]+)', 1), ''), last) AS repository,
        CASE WHEN path LIKE '%/vibe-kanban/%' THEN 'vibe-kanban' WHEN path LIKE '%/conductor/%' THEN 'conductor' WHEN path LIKE '%/.auto-claude/%' THEN 'auto-claude' WHEN path LIKE '%/.21st/%' THEN '21st' WHEN path LIKE '%/.claude-worktrees/%' THEN 'claude-desktop' WHEN path LIKE '%/.ccswitch/%' THEN 'ccswitch' ELSE 'git' END AS tool,
        regexp_matches(path, '/worktrees/|/workspaces/|-worktrees/') AS is_worktree,
        COALESCE(NULLIF(regexp_extract(path, '/vibe-kanban/worktrees/([^/]+)', 1), ''), NULLIF(regexp_extract(path, '/tasks/([^/]+)', 1), ''), NULLIF(regexp_extract(path, '\[([^\]]+)\]$', 1), ''), NULLIF(regexp_extract(path, '/(?:workspaces|\.claude-worktrees|\.ccswitch/worktrees)/[^/]+/([^/]+)', 1), ''), CASE WHEN is_main THEN COALESCE(branch, 'main') ELSE COALESCE(branch, last) END, 'unknown') AS label FROM l""")
def worktrees(t: Tables) -> DataFrame:
    """Repositories, tools and names of working copies, by their paths."""
    path, branch = F.expr(_PATHS), F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("b"), "c_nationkey"))
    return t.customer.select("c_custkey", W.repository_name(path).alias("repository"), W.worktree_tool(path).alias("tool"), W.is_worktree_path(path).alias("is_worktree"), W.worktree_label(path, branch, F.col("c_custkey") % 3 == 0).alias("label"))
