"""Queries over transcript lines that Spark builds from conversations: parsing, kinds of messages, what is worth showing.

A user's turn is, by its number, a text, a command's output, a result, a reminder, an
interruption or a teammate's words; a reply speaks and calls a tool, and every fifth is
made up by the client; system rows are summaries of compactions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracewell.functions import paths, text as X
from tracewell.operators import classify as C, details, links, listing, search, sessions, views
from tracewell.plans.catalog import Tables, query
from tracewell.sources import jsonl

_KIND = "CASE WHEN role = 'system' THEN 'compact' WHEN role = 'assistant' THEN CASE WHEN turn % 5 = 4 THEN 'synthetic' ELSE 'reply' END ELSE CASE turn % 6 WHEN 0 THEN 'text' WHEN 1 THEN 'stdout' WHEN 2 THEN 'result' WHEN 3 THEN 'reminder' WHEN 4 THEN 'interruption' ELSE 'teammate' END END"


def lines(t: Tables) -> DataFrame:
    """(file, line_no, line, modified, size) as sources.jsonl.read_lines gives them, with a broken line and one of an unknown kind for each conversation."""
    c = t.conversations.withColumn("kind", F.expr(_KIND))
    json = lambda **fields: F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    kind, turn = F.col("kind"), F.col("turn")
    name = F.when(turn % 3 == 1, "Task").otherwise("Read")
    call = json(type=F.lit("tool_use"), id=F.concat(F.lit("t"), turn), name=name, input=F.struct(F.concat(F.lit("part "), turn).alias("description"), F.lit("Explore").alias("subagent_type")))
    brought = json(type=F.lit("tool_result"), tool_use_id=F.concat(F.lit("t"), turn - 1), content=F.concat(F.lit("out "), "conv_id"), is_error=turn % 4 == 0)
    spoken = json(type=F.lit("text"), text=F.when(kind == "interruption", "[Request interrupted by user]").otherwise(F.col("text")))
    string = (
        F.when(kind == "stdout", "<local-command-stdout>out</local-command-stdout>").when(kind == "reminder", "<system-reminder>x</system-reminder>")
        .when(kind == "teammate", '<teammate-message teammate_id="bob">hi</teammate-message>').otherwise(F.col("text"))
    )
    blocks = F.when(kind.isin("reply", "synthetic"), F.concat(F.lit("["), spoken, F.lit(","), call, F.lit("]"))).when(kind == "result", F.concat(F.lit("["), brought, F.lit("]"))).when(kind == "interruption", F.concat(F.lit("["), spoken, F.lit("]")))
    content = F.coalesce(blocks, F.get_json_object(json(v=string), "$"))
    content = F.when(blocks.isNull(), F.regexp_extract(json(v=string), r'(?s)^\{"v":(.*)\}$', 1)).otherwise(content)
    usage = F.when(kind == "reply", F.concat(F.lit(',"model":"m","usage":{"input_tokens":'), turn * 10, F.lit(',"output_tokens":1}'))).when(kind == "synthetic", ',"model":"<synthetic>"').otherwise("")
    role = F.when(F.col("role") == "assistant", "assistant").otherwise("user")
    flags = F.concat(F.when(kind == "compact", ',"isCompactSummary":true').otherwise(""), F.when(kind == "result", ',"isMeta":true').otherwise(""))
    line = F.concat(F.lit('{"uuid":"u'), turn, F.lit('","type":"'), role, F.lit('","timestamp":"2026-01-01T10:0'), turn % 10, F.lit(':00.000Z","message":{"role":"'), role, F.lit('","content":'), content, usage, F.lit("}"), flags, F.lit("}"))
    broken = F.explode(F.array(F.lit('{"uuid":"broken","type":"user"'), F.lit('{"uuid":"x","type":"unknown"}')))
    file = F.concat(F.lit("/projects/p/"), "conv_id", F.lit(".jsonl")).alias("file")
    every = c.select(file, turn.cast("long").alias("line_no"), line.alias("line")).unionByName(c.where("turn = 0").select(file, F.lit(1000).cast("long").alias("line_no"), broken.alias("line")))
    return every.withColumn("modified", F.lit(None).cast("timestamp")).withColumn("size", F.lit(None).cast("long"))


def _messages(t: Tables) -> DataFrame:
    return jsonl.parse_messages(lines(t))


_SQL = f"WITH k AS (SELECT *, CAST(conv_id AS VARCHAR) AS session, {_KIND} AS kind FROM conversations)"


@query(f"""{_SQL}
    SELECT session, turn AS line_no, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS type, CASE WHEN kind IN ('reply', 'synthetic', 'result', 'interruption') THEN 'array' ELSE 'string' END AS content_kind,
        CAST(CASE kind WHEN 'reply' THEN 2 WHEN 'synthetic' THEN 2 WHEN 'result' THEN 1 WHEN 'interruption' THEN 1 ELSE 0 END AS INTEGER) AS n_blocks, CAST(CASE WHEN kind = 'reply' THEN turn * 10 ELSE 0 END AS BIGINT) AS input, kind = 'reply' AS has_usage,
        CASE WHEN kind IN ('text', 'compact') THEN CAST(LENGTH(text) AS INTEGER) WHEN kind = 'stdout' THEN 48 WHEN kind = 'reminder' THEN 36 WHEN kind = 'teammate' THEN 57 END AS n_chars, kind = 'result' AS is_meta, kind = 'compact' AS is_compact FROM k""")
def parsed_messages(t: Tables) -> DataFrame:
    """Messages as their lines say; broken lines and unknown kinds give none."""
    return _messages(t).select("session", "line_no", "type", "content_kind", F.size("blocks").alias("n_blocks"), F.col("usage.input").alias("input"), "has_usage", F.length("text").alias("n_chars"), "is_meta", "is_compact")


@query(f"{_SQL} SELECT session, turn AS line_no, 't' || turn AS id, CASE WHEN turn % 3 = 1 THEN 'Task' ELSE 'Read' END AS name, turn % 3 = 1 AS is_task, CASE WHEN turn % 3 = 1 THEN 'part ' || turn END AS task_description FROM k WHERE role = 'assistant'")
def parsed_calls(t: Tables) -> DataFrame:
    return jsonl.tool_calls(_messages(t)).select("session", "line_no", "id", "name", "is_task", "task_description")


@query(f"{_SQL} SELECT session, turn AS line_no, 't' || (turn - 1) AS tool_use_id, 'out ' || conv_id AS content, turn % 4 = 0 AS is_error FROM k WHERE kind = 'result'")
def parsed_results(t: Tables) -> DataFrame:
    return jsonl.tool_results(_messages(t)).select("session", "line_no", "tool_use_id", "content", "is_error")


@query(f"""{_SQL}
    SELECT session, turn AS line_no, CASE WHEN kind IN ('synthetic', 'reminder', 'interruption') THEN 'hardNoise' WHEN kind = 'compact' THEN 'compact' WHEN kind = 'stdout' THEN 'system' WHEN kind = 'text' THEN 'user' ELSE 'ai' END AS category,
        kind = 'teammate' AS is_teammate, kind = 'stdout' AS is_command_output, kind IN ('text', 'compact') AS is_user_input, kind <> 'reminder' AND kind <> 'synthetic' AS is_displayable FROM k""")
def message_kinds(t: Tables) -> DataFrame:
    """What each message is, by all of the tests on messages."""
    m = _messages(t)
    return m.select("session", "line_no", C.category(m).alias("category"), C.is_teammate(m).alias("is_teammate"), C.is_command_output(m).alias("is_command_output"), C.is_user_input(m).alias("is_user_input"), C.is_displayable(m).alias("is_displayable"))


@query(f"""{_SQL}
    SELECT session, COUNT(CASE WHEN role <> 'assistant' THEN 1 END) AS users, COUNT(CASE WHEN role <> 'assistant' AND kind <> 'result' THEN 1 END) AS real_users, COUNT(CASE WHEN kind = 'result' THEN 1 END) AS internal_users, COUNT(CASE WHEN role = 'assistant' THEN 1 END) AS assistants FROM k GROUP BY session""")
def message_counts(t: Tables) -> DataFrame:
    return C.type_counts(_messages(t)).select("session", "users", "real_users", "internal_users", "assistants")


@query(f"{_SQL} SELECT DISTINCT session FROM k WHERE kind <> 'reminder' AND kind <> 'synthetic' AND turn > 1")
def sessions_to_show(t: Tables) -> DataFrame:
    """Sessions with anything to show after their first two turns."""
    return C.displayable_sessions(_messages(t).where("line_no > 1"))


@query(f"""{_SQL},
    c AS (SELECT *, CASE WHEN kind IN ('synthetic', 'reminder', 'interruption') THEN 'hardNoise' WHEN kind = 'compact' THEN 'compact' WHEN kind = 'stdout' THEN 'system' WHEN kind = 'text' THEN 'user' ELSE 'ai' END AS category FROM k),
    b AS (SELECT *, CASE WHEN category <> 'ai' OR COALESCE(LAG(category) OVER w, '') <> 'ai' THEN 1 ELSE 0 END AS starts FROM c WHERE category <> 'hardNoise' WINDOW w AS (PARTITION BY session ORDER BY turn)),
    r AS (SELECT *, SUM(starts) OVER (PARTITION BY session ORDER BY turn) AS run FROM b)
    SELECT session, CAST(run AS BIGINT) AS run, MIN(category) AS kind, COUNT(*) AS n_messages, MIN(turn) AS first_pos, TIMESTAMP '2026-01-01 10:00:00' + CAST(arg_min(turn, turn) % 10 AS INTEGER) * INTERVAL 1 MINUTE AS start_ts, TIMESTAMP '2026-01-01 10:00:00' + CAST(MAX(turn % 10) AS INTEGER) * INTERVAL 1 MINUTE AS end_ts FROM r GROUP BY session, run""")
def message_chunks(t: Tables) -> DataFrame:
    """Runs of messages with their times, noise left out."""
    m = _messages(t)
    rows = m.select("session", F.col("line_no").alias("pos"), C.category(m).alias("category"), F.col("uuid").alias("id"), F.lit(1).alias("tokens"), "ts")
    found = sessions.chunks(rows)
    return found.select("session", F.col("run").cast("long").alias("run"), "kind", "n_messages", "first_pos", F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), F.col("end_ts").cast("timestamp_ntz").alias("end_ts"))


@query("""
    WITH i AS (SELECT conv_id, turn, role, LAST_VALUE(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER p AS u, LAST_VALUE(CASE WHEN role = 'assistant' THEN turn END IGNORE NULLS) OVER p AS a FROM conversations WINDOW p AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT conv_id AS session, turn AS pos, u AS user_pos, 'run-' || u AS name, CAST(conv_id AS VARCHAR) AS args FROM i WHERE role = 'assistant' AND u IS NOT NULL AND (a IS NULL OR u > a) AND u % 4 = 0""")
def command_before(t: Tables) -> DataFrame:
    """The command that a reply follows at once."""
    command = F.concat(F.lit("<command-name>/run-"), "turn", F.lit("</command-name><command-args> "), "conv_id", F.lit(" </command-args>"))
    item = F.when(F.col("role") == "user", "user").when(F.col("role") == "assistant", "ai").otherwise("compact")
    items = t.conversations.select(F.col("conv_id").alias("session"), F.col("turn").alias("pos"), item.alias("item"), F.when(F.col("turn") % 4 == 0, command).otherwise(F.col("text")).alias("text"))
    return search.preceding_command(items)


@query("""
    WITH d AS (SELECT source, doc_id, string_split(LOWER(text), 'e ') AS parts FROM documents WHERE contains(LOWER(text), 'e ')),
    m AS (SELECT source, doc_id, UNNEST(range(0, len(parts) - 1)) AS match_no, parts FROM d),
    o AS (SELECT source, doc_id, match_no, ROW_NUMBER() OVER (PARTITION BY source ORDER BY doc_id, match_no) - 1 AS "index", COUNT(*) OVER (PARTITION BY source) > 500 AS is_capped FROM m)
    SELECT source AS session, doc_id, CAST(match_no AS INTEGER) AS match_no, CAST("index" AS INTEGER) AS "index", is_capped FROM o WHERE "index" < 500""")
def capped_search(t: Tables) -> DataFrame:
    """The first 500 places of a query that ends in a space, for each source."""
    found = search.hits(t.documents.select(F.col("source").alias("session"), "doc_id", "text"), "e ", trim=False)
    return search.capped(found, ["doc_id", "match_no"]).select("session", "doc_id", "match_no", "index", "is_capped")


@query("""
    WITH c AS (SELECT DISTINCT p_name AS source, list_concat(list_transform(string_split(p_name, ''), lambda x: CAST(unicode(x) AS BIGINT)), [CAST(55357 AS BIGINT), CAST(56832 AS BIGINT)]) AS codes FROM part),
    h AS (SELECT source, list_reduce(codes, lambda h, x: ((h * 31 + x + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648, CAST(0 AS BIGINT)) AS h FROM c)
    SELECT source, printf('%x', CAST(ABS(h) AS BIGINT)) AS id FROM h""")
def hash_ids(t: Tables) -> DataFrame:
    """Ids of names that end in a character of two UTF-16 units."""
    return t.part.select(F.col("p_name").alias("source")).distinct().select("source", X.hash_id(F.concat("source", F.lit("😀"))).alias("id"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def hidden_sessions(t: Tables) -> DataFrame:
    """What is left of a list once hidden entries are taken away."""
    return listing.without_hidden(t.customer.select("c_custkey", "c_name"), t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""
    WITH c AS (SELECT user_id, COUNT(CASE WHEN event_type = 'click' THEN 1 END) AS c, COUNT(DISTINCT CASE WHEN event_type = 'signup' AND event_id % 3 > 0 THEN event_id % 7 END) AS m, COUNT(CASE WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 1 END) AS s FROM events GROUP BY user_id)
    SELECT user_id AS session, COALESCE(NULLIF(concat_ws(', ', CASE WHEN c > 0 THEN c || CASE WHEN c = 1 THEN ' tool call' ELSE ' tool calls' END END, CASE WHEN m > 0 THEN m || CASE WHEN m = 1 THEN ' teammate' ELSE ' teammates' END END, CASE WHEN s > 0 THEN s || CASE WHEN s = 1 THEN ' subagent' ELSE ' subagents' END END), ''), 'No items') AS summary FROM c""")
def team_summary(t: Tables) -> DataFrame:
    """Members of a team count once each, other subagents each."""
    item = F.when(F.col("event_type") == "click", "tool").when(F.col("event_type") == "signup", "subagent").otherwise("subagent_input")
    return views.summary(t.stream().select("session", item.alias("item"), F.when(F.col("pos") % 3 > 0, (F.col("pos") % 7).cast("string")).alias("member")), ["session"])


@query("""
    WITH r AS (SELECT user_id AS session, event_id AS line_no, 0 AS rank, 't' || event_id % 40 AS tool_use_id, props AS content, event_type = 'error' AS is_error FROM events
        UNION ALL SELECT user_id, event_id, 1, 't' || event_id % 25, 'rich ' || event_id, event_id % 2 = 0 FROM events WHERE event_type = 'view')
    SELECT session, tool_use_id, arg_max(content, line_no * 10 + rank) AS content, arg_max(is_error, line_no * 10 + rank) AS is_error FROM r GROUP BY session, tool_use_id""")
def result_map(t: Tables) -> DataFrame:
    """The result that counts of each call, enriched ones included."""
    s = t.stream().withColumn("line_no", F.col("pos"))
    plain = s.select("session", "line_no", F.lit(0).alias("block_no"), F.concat(F.lit("t"), F.col("pos") % 40).alias("tool_use_id"), F.col("props").alias("content"), (F.col("event_type") == "error").alias("is_error"))
    rich = s.where("event_type = 'view'").select("session", "line_no", F.concat(F.lit("t"), F.col("pos") % 25).alias("source_tool_use_id"), F.concat(F.lit("rich "), "pos").alias("content"), (F.col("pos") % 2 == 0).alias("is_error"))
    return links.result_map(plain, rich)


_PATH = "'/home/u' || c_nationkey || '/' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '/a/rather/long/folder/name' ELSE '' END || '/f' || c_custkey"


@query(rf"""
    WITH p AS (SELECT c_custkey, {_PATH} AS path, '/home/u' || c_nationkey AS root FROM customer), q AS (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN SUBSTR(path, LENGTH(root) + 2) ELSE '~' || SUBSTR(path, LENGTH(root) + 1) END AS shown FROM p)
    SELECT c_custkey, CASE WHEN LENGTH(shown) <= 24 OR len(string_split(shown, '/')) - CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END <= 3 THEN shown ELSE regexp_extract(shown, '^(~/)?[^/]+') || '/…/' || regexp_extract(shown, '[^/]+/[^/]+$') END AS short,
        '/home/u' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '/deep' END || '/x' || c_custkey AS resolved, 'f' || c_custkey AS project FROM q""")
def path_names(t: Tables) -> DataFrame:
    """Paths as they are shown, mentions resolved, and names of projects."""
    c = F.col("c_custkey")
    path, root = F.expr(_PATH), F.concat(F.lit("/home/u"), "c_nationkey")
    up = F.when(c % 2 == 0, "@../").otherwise("./")
    return t.customer.select("c_custkey", paths.shorten_path(path, F.when(c % 3 == 0, root), 24).alias("short"), paths.resolve_mention(F.lit("/home/u/deep"), F.concat(up, F.lit("x"), c)).alias("resolved"), paths.project_name(F.lit("-a-b"), path).alias("project"))


@query("""
    WITH x AS (SELECT l_orderkey, CASE l_linenumber % 3 WHEN 0 THEN 'SendMessage' ELSE 'Read' END AS tool, CAST(FLOOR(l_quantity) AS BIGINT) AS tokens FROM lineitem),
    u AS (SELECT l_orderkey, tokens FROM x WHERE tool = 'SendMessage' AND tokens > 0 UNION ALL SELECT o_orderkey, o_orderkey % 5 FROM orders WHERE o_orderkey % 5 > 0)
    SELECT l_orderkey AS turn, CAST(SUM(tokens) AS BIGINT) AS tokens, COUNT(*) AS n FROM u GROUP BY l_orderkey""")
def coordination(t: Tables) -> DataFrame:
    """What coordination puts into each turn: its tools and teammates' messages."""
    k = F.col("l_orderkey")
    tools = t.lineitem.select(F.lit("s").alias("session"), k.alias("turn"), F.when(F.col("l_linenumber") % 3 == 0, "SendMessage").otherwise("Read").alias("tool"), F.floor("l_quantity").cast("long").alias("call_tokens"), F.lit(0).cast("long").alias("result_tokens"), F.lit(0).cast("long").alias("skill_tokens"))
    mates = t.orders.select(F.lit("s").alias("session"), F.col("o_orderkey").alias("turn"), (F.col("o_orderkey") % 5).alias("tokens"))
    return details.coordination(details.tool_injections(tools, ["session"]), mates, ["session"]).drop("session")
