"""More queries over the fixture tables: details of sessions, subagents and context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tracewell.functions import guards, markdown, paths
from tracewell.functions import text as X
from tracewell.operators import details, rules, search, sessions
from tracewell.plans.catalog import MS, PHASES, TOKENS, Tables, query


@query("""
    SELECT o_custkey AS session, CAST(epoch(MAX(o_orderdate)) - epoch(MIN(o_orderdate)) AS BIGINT) AS duration, COUNT(*) AS messages, CAST(SUM(FLOOR(o_totalprice)) AS BIGINT) AS input, CAST(SUM(o_orderkey % 100) AS BIGINT) AS output, CAST(SUM(FLOOR(o_totalprice) + o_orderkey % 100) AS BIGINT) AS total FROM orders GROUP BY o_custkey""")
def subagent_totals(t: Tables) -> DataFrame:
    at = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return details.totals(t.orders.select(F.col("o_custkey").alias("session"), at.alias("start"), at.alias("end"), F.floor("o_totalprice").cast("long").alias("input"), (F.col("o_orderkey") % 100).alias("output"), F.lit(1).alias("messages")), ["session"])


@query("""
    WITH u AS (SELECT user_id, arg_min(CAST(FLOOR(value) AS BIGINT), event_id) AS u FROM events WHERE event_type = 'signup' GROUP BY user_id)
    SELECT e.user_id AS session, CAST(COALESCE(MIN(u.u), SUM(FLOOR(value))) AS BIGINT) AS input, CAST(COALESCE(MIN(u.u) * 0 + 1, COUNT(*)) AS BIGINT) AS output, CAST(SUM(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS thinking FROM events e LEFT JOIN u USING (user_id) GROUP BY e.user_id""")
def step_tokens(t: Tables) -> DataFrame:
    s = t.stream()
    rows = s.select("session", F.col("n").alias("input"), F.lit(1).cast("long").alias("output"), F.lit(0).cast("long").alias("cached"), F.when(F.col("event_type") == "view", "thinking").otherwise("output").alias("step"))
    usage = s.where("event_type = 'signup'").select("session", "pos", F.col("n").alias("input"), F.lit(1).cast("long").alias("output"), F.lit(0).cast("long").alias("cached"))
    return details.step_tokens(rows, usage, ["session"], "pos").drop("cached")


def _steps(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "thinking").when(F.col("event_type") == "click", "tool_call").when(F.col("event_type") == "purchase", "output").when(F.col("event_type") == "signup", "tool_result").otherwise("subagent")
    message = F.when(F.col("event_type") != "signup", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd"))
    return t.stream().select("session", "pos", message.alias("message"), kind.alias("step"), F.when(kind == "tool_call", "Bash").alias("tool"), (F.col("value") > 100).alias("is_error"), F.col("ts_ms").alias("start"), F.col("n").alias("duration"))


@query(f"""
    WITH e AS (SELECT *, CASE WHEN event_type <> 'signup' THEN strftime(ts, '%Y-%m-%d') END AS message, CASE event_type WHEN 'view' THEN 'thinking' WHEN 'click' THEN 'tool_call' WHEN 'purchase' THEN 'output' WHEN 'signup' THEN 'tool_result' ELSE 'subagent' END AS step, {MS} AS start, CAST(FLOOR(value) AS BIGINT) AS d FROM events),
    g AS (SELECT user_id, message, COUNT(*) AS n, COUNT(CASE WHEN step = 'thinking' THEN 1 END) AS t, COUNT(CASE WHEN step = 'output' THEN 1 END) AS o, COUNT(CASE WHEN step = 'tool_call' THEN 1 END) AS c, arg_min(step, event_id) AS f, arg_min(value > 100, event_id) AS bad, arg_min(start, event_id) AS start, MAX(start + d) AS last, CAST(SUM(d) AS BIGINT) AS duration FROM e GROUP BY user_id, message)
    SELECT user_id AS session, message, CASE WHEN n = 1 THEN CASE f WHEN 'thinking' THEN 'Thinking' WHEN 'tool_call' THEN 'Tool: Bash' WHEN 'tool_result' THEN CASE WHEN bad THEN 'Result: Error' ELSE 'Result: Success' END WHEN 'subagent' THEN 'Subagent' ELSE 'Output' END
        WHEN c > 0 THEN 'Tools (' || c || ')' WHEN t > 0 AND o > 0 THEN 'Assistant Response' WHEN t > 0 THEN 'Thinking' WHEN o > 0 THEN 'Output' ELSE 'Response (' || n || ' steps)' END AS label,
        n, message IS NOT NULL AND n > 1 AS is_grouped, start, last AS end_ms, duration FROM g""")
def step_groups(t: Tables) -> DataFrame:
    return details.step_groups(_steps(t), ["session"], "pos").withColumnRenamed("end", "end_ms")


@query("""
    SELECT user_id AS session, event_id AS pos, CASE WHEN event_type = 'click' THEN CAST(FLOOR(value) AS BIGINT) ELSE user_id + 1 END AS accumulated_context FROM events""")
def step_context(t: Tables) -> DataFrame:
    s = t.stream()
    steps = s.select("session", "pos", F.col("pos").alias("message"), F.col("session").alias("input"), F.lit(1).cast("long").alias("cached"))
    messages = s.where("event_type = 'click'").select("session", F.col("pos").alias("message"), F.col("n").alias("context"))
    return details.step_context(steps, messages, ["session"]).select("session", "pos", "accumulated_context")


@query("""
    WITH e AS (SELECT user_id, event_id, event_type = 'error' AS compact, CASE WHEN event_type = 'click' THEN CAST(FLOOR(value) AS BIGINT) END AS ctx FROM events),
    w AS (SELECT *, CAST(1 + SUM(CASE WHEN compact THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS phase, COALESCE(LAST_VALUE(ctx IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre,
        COALESCE(FIRST_VALUE(ctx IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS post FROM e)
    SELECT user_id AS session, event_id AS pos, phase, pre, post, CASE WHEN pre > 0 THEN post - pre END AS delta FROM w WHERE compact""")
def subagent_compactions(t: Tables) -> DataFrame:
    rows = t.stream().select("session", "pos", (F.col("event_type") == "error").alias("compact"), F.when(F.col("event_type") == "click", F.col("n")).alias("ctx"))
    return details.subagent_compactions(rows, ["session"], "pos")


@query(f"{PHASES.replace('AND post = 0 THEN 0', 'AND false THEN 0')} SELECT session, CAST(SUM(contribution) AS BIGINT) AS consumption FROM r GROUP BY session")
def subagent_phases(t: Tables) -> DataFrame:
    rows = t.stream().select("session", "pos", (F.col("event_type") == "error").alias("compact"), F.col("n").alias("ctx"))
    return sessions.compaction_phases(rows, guard=False).groupBy("session").agg(F.sum("contribution").alias("consumption"))


@query(f"""
    SELECT conv_id AS session, arg_max({TOKENS}, turn) FILTER (role = 'assistant') AS last_usage, COUNT(CASE WHEN role = 'assistant' THEN 1 END) AS turns, CAST(SUM({TOKENS}) AS BIGINT) AS thinking_tokens,
        COUNT(CASE WHEN role = 'assistant' THEN 1 END) = 1 AND COUNT(CASE WHEN role = 'assistant' AND LENGTH(text) < 200 THEN 1 END) = 1 AS is_shutdown_only FROM conversations GROUP BY conv_id""")
def subagent_cards(t: Tables) -> DataFrame:
    ai = F.col("category") == "ai"
    short = F.length("text") < 200
    rows = t.transcript().select("session", "pos", F.when(ai, "assistant").otherwise("user").alias("type"), F.when(ai, F.col("tokens")).alias("usage_total"), F.col("text").alias("thinking"), F.when(short, F.array(F.lit("SendMessage"))).otherwise(F.array(F.lit("Bash"))).alias("tools"), F.array(F.lit("shutdown_response")).alias("tool_types"))
    return details.subagent_cards(rows, ["session"], "pos")


@query("""
    WITH RECURSIVE a AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 = 0 THEN 'team' || s_nationkey END AS team FROM supplier),
    r AS (SELECT id, team, id AS at, 0 AS hops FROM a UNION ALL SELECT r.id, a.team, a.id, hops + 1 FROM r JOIN a ON a.id = r.at - 1 WHERE r.team IS NULL AND hops < 11)
    SELECT id AS agent_id, MAX(team) AS team FROM r GROUP BY id""")
def team_spread(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    agents = t.supplier.select(F.lit("s").alias("session"), k.alias("agent_id"), (k - 1).alias("first_parent"), k.alias("last_uuid"), F.when(k % 7 == 0, F.concat(F.lit("team"), "s_nationkey")).alias("team"))
    return details.spread_teams(agents).select("agent_id", "team")


@query(f"""
    WITH c AS (SELECT user_id, event_id AS chunk, {MS} AS s, {MS} + 7200000 AS e FROM events WHERE event_type = 'purchase'), p AS (SELECT user_id, event_id AS process, CASE WHEN event_id % 2 = 0 THEN event_id // 10 END AS task, {MS} AS t FROM events WHERE event_type = 'signup')
    SELECT p.user_id AS session, process, chunk FROM p JOIN c ON p.user_id = c.user_id AND c.chunk // 10 = p.task UNION ALL SELECT p.user_id, process, chunk FROM p JOIN c ON p.user_id = c.user_id AND task IS NULL AND t BETWEEN s AND e""")
def process_link(t: Tables) -> DataFrame:
    s = t.stream()
    chunks = s.where("event_type = 'purchase'").select("session", F.col("pos").alias("chunk"), F.array(F.floor(F.col("pos") / 10)).alias("tasks"), F.col("ts_ms").alias("start"), (F.col("ts_ms") + 7_200_000).alias("end"))
    processes = s.where("event_type = 'signup'").select("session", F.col("pos").alias("process"), F.when(F.col("pos") % 2 == 0, F.floor(F.col("pos") / 10)).alias("task"), F.col("ts_ms").alias("start"))
    return details.link_processes(chunks, processes, ["session"])


@query("""
    SELECT o_custkey AS session, o_orderkey AS id, CASE WHEN o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40) THEN 'task' ELSE 'tool' END AS kind FROM orders""")
def task_split(t: Tables) -> DataFrame:
    calls = t.orders.select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("is_task"))
    agents = t.lineitem.where("l_quantity > 40").select(F.col("l_orderkey").alias("task")).join(t.orders.select(F.col("o_orderkey").alias("task"), F.col("o_custkey").alias("session")), "task")
    return details.split_tasks(calls, agents, ["session"]).select("session", "id", "kind")


@query("""
    SELECT s_suppkey AS agent, s_suppkey * 3 AS task, COALESCE(CAST(FLOOR(p_retailprice) AS BIGINT) + p_size, 0) AS impact FROM supplier LEFT JOIN part ON p_partkey = s_suppkey * 3 AND p_size > 10""")
def main_impact(t: Tables) -> DataFrame:
    agents = t.supplier.select(F.lit("s").alias("session"), F.col("s_suppkey").alias("agent"), (F.col("s_suppkey") * 3).alias("task"))
    calls = t.part.where("p_size > 10").select(F.lit("s").alias("session"), F.col("p_partkey").alias("id"), F.floor("p_retailprice").cast("long").alias("call_tokens"), F.col("p_size").cast("long").alias("result_tokens"))
    return details.main_impact(agents, calls, ["session"]).select("agent", "task", "impact")


@query("""
    WITH x AS (SELECT l_orderkey, CASE l_linenumber % 4 WHEN 0 THEN 'SendMessage' WHEN 1 THEN 'Task' WHEN 2 THEN 'Read' ELSE 'Bash' END AS tool, CAST(FLOOR(l_quantity) AS BIGINT) - 10 AS tokens FROM lineitem),
    y AS (SELECT *, CASE WHEN tool = 'SendMessage' THEN 'task-coordination' ELSE 'tool-output' END AS category, CASE WHEN tool = 'Task' THEN 'Task (Subagent)' ELSE tool END AS name FROM x WHERE tokens > 0)
    SELECT l_orderkey AS turn, category, CAST(SUM(tokens) AS BIGINT) AS tokens, COUNT(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS tools FROM y GROUP BY 1, 2""")
def tool_injections(t: Tables) -> DataFrame:
    k = F.col("l_linenumber") % 4
    rows = t.lineitem.select(F.lit("s").alias("session"), F.col("l_orderkey").alias("turn"), F.when(k == 0, "SendMessage").when(k == 1, "Task").when(k == 2, "Read").otherwise("Bash").alias("tool"), F.floor("l_quantity").cast("long").alias("call_tokens"), F.lit(-10).cast("long").alias("result_tokens"), F.lit(None).cast("long").alias("skill_tokens"))
    return details.tool_injections(rows, ["session"]).drop("session")


@query(f"""
    SELECT conv_id AS session, turn, {TOKENS} AS tokens, CASE WHEN LENGTH(text) > 80 THEN SUBSTR(text, 1, 80) || '…' ELSE text END AS preview FROM conversations WHERE role = 'user' AND LENGTH(text) > 0""")
def user_injections(t: Tables) -> DataFrame:
    return details.user_injections(t.transcript().where("category = 'user'").withColumnRenamed("pos", "turn").drop("tokens"), ["session"])


@query(f"""
    SELECT conv_id AS session, turn // 2 AS turn, CAST(SUM(CASE WHEN role = 'user' THEN {TOKENS} ELSE 0 END) AS BIGINT) AS thinking_tokens, CAST(SUM(CASE WHEN role = 'assistant' THEN {TOKENS} ELSE 0 END) AS BIGINT) AS text_tokens FROM conversations GROUP BY 1, 2
    HAVING SUM(CASE WHEN role IN ('user', 'assistant') THEN {TOKENS} ELSE 0 END) > 0""")
def thinking_injections(t: Tables) -> DataFrame:
    item = F.when(F.col("category") == "user", "thinking").when(F.col("category") == "ai", "output").otherwise("other")
    return details.thinking_injections(t.transcript().select("session", F.floor(F.col("pos") / 2).alias("turn"), item.alias("item"), "tokens"), ["session"])


@query("SELECT c_name AS session, c_custkey AS created FROM customer WHERE contains(lower(c_name), 'r#00000001') ORDER BY c_custkey DESC LIMIT 50")
def find_sessions(t: Tables) -> DataFrame:
    return details.find_sessions(t.customer.select(F.col("c_name").alias("session"), F.col("c_custkey").alias("created")), "R#00000001")


@query("SELECT p_name AS name, p_type AS path, p_partkey AS recent FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring') ORDER BY p_partkey DESC LIMIT 10")
def find_repositories(t: Tables) -> DataFrame:
    return details.find_repositories(t.part.select(F.col("p_name").alias("name"), F.col("p_type").alias("path"), F.col("p_partkey").alias("recent")), "Ring")


@query(f"SELECT conv_id AS session, turn AS id, {TOKENS} AS tokens, CAST(ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY {TOKENS} DESC, turn) AS INTEGER) AS rank FROM conversations")
def ranked_injections(t: Tables) -> DataFrame:
    return details.ranked_injections(t.transcript().select("session", F.col("pos").alias("id"), "tokens"), ["session"])


@query("SELECT user_id AS session, event_id AS pos, event_type, CAST(ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS INTEGER) AS index FROM events")
def running_index(t: Tables) -> DataFrame:
    return details.running_index(t.stream().select("session", "pos", "event_type"), ["session"], "event_type", "pos")


@query("""
    WITH s AS (SELECT *, CASE WHEN event_type = 'error' THEN 'interrupted' ELSE 'complete' END AS st, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)
    SELECT user_id AS session, event_id AS pos, CASE WHEN rn = 1 AND user_id % 2 = 0 AND st <> 'interrupted' THEN 'in_progress' ELSE st END AS status FROM s""")
def ongoing_marks(t: Tables) -> DataFrame:
    rows = t.stream().select("session", "pos", F.when(F.col("event_type") == "error", "interrupted").otherwise("complete").alias("status"), (F.col("session") % 2 == 0).alias("is_ongoing"))
    return details.mark_ongoing(rows, ["session"], "pos").select("session", "pos", "status")


@query("""
    WITH f AS (SELECT o_custkey, o_orderkey % 5 AS agent, arg_min(o_orderpriority, o_orderkey) AS model FROM orders GROUP BY 1, 2), m AS (SELECT o_custkey, o_orderpriority, COUNT(*) AS n, MIN(o_orderkey) AS k FROM orders GROUP BY 1, 2),
    t AS (SELECT o_custkey, o_orderpriority FROM m QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY n DESC, k) = 1)
    SELECT DISTINCT o_custkey AS session, model FROM f WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.o_custkey = f.o_custkey AND t.o_orderpriority = f.model)""")
def subagent_models(t: Tables) -> DataFrame:
    from tracewell.operators import views

    rows = t.orders.select(F.col("o_custkey").alias("session"), (F.col("o_orderkey") % 5).alias("agent"), F.col("o_orderpriority").alias("model"), F.col("o_orderkey").alias("pos"))
    return details.subagent_models(rows, views.main_model(rows, ["session"], "model", "pos"), ["session"], "pos")


@query("""
    SELECT doc_id, regexp_matches(source, '^[a-zA-Z0-9][a-zA-Z0-9._-]{0,127}$') AS is_id, true AS is_encoded, doc_id % 2 = 0 AS is_project FROM documents""")
def id_guards(t: Tables) -> DataFrame:
    encoded = F.concat(F.lit("-home-"), "source")
    part = F.when(F.col("doc_id") % 2 == 0, F.substr(F.sha2("source", 256), F.lit(1), F.lit(8))).otherwise("xyz")
    return t.documents.select("doc_id", guards.is_id(F.col("source")).alias("is_id"), guards.is_encoded_path(encoded).alias("is_encoded"), guards.is_project_id(F.concat(encoded, F.lit("::"), part)).alias("is_project"))


@query()
def markdown_matches(t: Tables) -> DataFrame:
    """Occurrences in the shown text of each document, taken as markdown."""
    return markdown.count_matches(t.documents, "doc_id", "text", "the")


@query("""
    WITH w AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '^[a-z]+:/(/[^?#]+)', 1), '/'), lambda x: x <> '') AS p FROM pages)
    SELECT page_id, '/' || array_to_string(list_concat(p[1:len(p) - 1], ['x.md']), '/') AS joined FROM w""")
def path_joins(t: Tables) -> DataFrame:
    path = F.regexp_extract("url", "^[a-z]+:/(/[^?#]+)", 1)
    return t.pages.select("page_id", paths.join_path(path, F.lit("../a/.././x.md")).alias("joined"))


@query("""
    SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'dockerfile' WHEN 3 THEN 'env' WHEN 4 THEN 'zsh' WHEN 5 THEN 'hpp' WHEN 6 THEN 'javascript' WHEN 7 THEN 'gitignore' ELSE 'text' END AS language FROM documents""")
def languages(t: Tables) -> DataFrame:
    names = ["main.PY", "a.b.ts", "Dockerfile", ".env.local", "x.zsh", "y.HPP", "z.mjs", ".gitignore", "notes.cs"]
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % 9 + 1).cast("int"))
    return t.documents.select("doc_id", paths.language_of(F.concat(F.lit("/src/"), name)).alias("language"))


@query("SELECT doc_id, source AS name, lang AS args FROM documents")
def slash_commands(t: Tables) -> DataFrame:
    c = F.concat(F.lit("first line\n/"), "source", F.lit(" "), "lang")
    return t.documents.select("doc_id", F.explode(X.slash_commands(c)).alias("m")).select("doc_id", "m.name", "m.args")


@query("""
    WITH RECURSIVE h AS (SELECT DISTINCT p_name AS source, 1 AS i, CAST(0 AS BIGINT) AS h FROM part
        UNION ALL SELECT source, i + 1, ((h * 31 + ascii(SUBSTR(source, i, 1)) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 FROM h WHERE i <= LENGTH(source))
    SELECT source, h AS hash FROM h WHERE i = LENGTH(source) + 1""")
def string_hashes(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_name").alias("source")).distinct().select("source", X.string_hash(F.col("source")).alias("hash"))


@query(f"""
    SELECT conv_id AS session, turn AS pos, CAST((LENGTH(text) - LENGTH(REPLACE(LOWER(text), 'on', ''))) // 2 AS BIGINT) AS n FROM conversations WHERE contains(LOWER(text), 'on')""")
def in_session_search(t: Tables) -> DataFrame:
    return search.hits(t.transcript(), "on").groupBy("session", "pos").agg(F.count("*").alias("n"))


@query("SELECT conv_id AS session, SUBSTR(arg_min(text, turn), 1, 100) AS title FROM conversations WHERE role = 'user' GROUP BY conv_id")
def session_titles(t: Tables) -> DataFrame:
    return search.titles(search.searchable(t.transcript()))


@query("SELECT event_id AS id, value > 50 OR event_id % 10 = 0 AS is_read FROM events")
def mark_read(t: Tables) -> DataFrame:
    rows = t.stream().select(F.col("pos").alias("id"), (F.col("value") > 50).alias("is_read"))
    return rules.mark_read(rows, rows.where("id % 10 = 0")).select("id", "is_read")


@query("""
    WITH c AS (SELECT user_id, event_id, value, CASE WHEN COALESCE(LAG(event_type) OVER w, '') <> event_type THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), r AS (SELECT *, SUM(s) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM c)
    SELECT user_id AS session, CAST(run AS BIGINT) AS run, COUNT(*) AS n, CAST(SUM(FLOOR(value)) AS BIGINT) AS tokens FROM r GROUP BY 1, 2""")
def type_runs(t: Tables) -> DataFrame:
    """Runs of equal kinds, as tool rows of one kind are folded together."""
    return sessions.kind_runs(t.stream(), "event_type").groupBy("session", "run").agg(F.count("*").alias("n"), F.sum("n").alias("tokens"))


@query("SELECT CAST(user_id AS VARCHAR) AS project, COUNT(*) AS total, COUNT(CASE WHEN event_type <> 'click' THEN 1 END) AS unread FROM events WHERE event_type <> 'error' GROUP BY 1")
def cleared_stats(t: Tables) -> DataFrame:
    """Alerts that stay after those of one rule were cleared, and those of another read."""
    rows = t.stream().select(F.col("session").cast("string").alias("project"), F.col("event_type").alias("rule_name"), F.lit(False).alias("is_read"))
    return rules.alert_stats(rules.mark_rule_read(rules.clear(rows, "error"), "click"), "project")
