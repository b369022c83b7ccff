"""Queries over the fixture tables for anchored windows, suppression of alerts, threads and answers by order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tracewell.operators import links, rules, sessions
from tracewell.plans.catalog import MS, Tables, query


@query(f"""
    WITH RECURSIVE o AS (SELECT user_id, event_id, {MS} AS ms, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY {MS}, event_id) AS rn FROM events),
    g AS (SELECT user_id, event_id, ms, rn, ms AS anchor FROM o WHERE rn = 1
        UNION ALL SELECT o.user_id, o.event_id, o.ms, o.rn, CASE WHEN o.ms - g.anchor <= 3600000 THEN g.anchor ELSE o.ms END FROM g JOIN o ON o.user_id = g.user_id AND o.rn = g.rn + 1)
    SELECT user_id AS session, event_id AS pos, COUNT(*) OVER (PARTITION BY user_id, anchor) > 1 AS is_parallel FROM g""")
def parallel_marks(t: Tables) -> DataFrame:
    """Each start, and whether others lie in its window of an hour."""
    return sessions.mark_parallel(t.stream().select("session", "pos", "ts_ms"), window_ms=3_600_000).drop("ts_ms")


_HELD = f"""
    CASE WHEN {MS} < 1704412800000 THEN 'snoozed' WHEN user_id % 7 = 3 THEN 'repository' WHEN event_type LIKE 'pur%' OR event_type = 'view' AND user_id % 5 = 0 THEN 'pattern' END"""


@query(f"""
    WITH RECURSIVE h AS (SELECT event_id, user_id, CASE WHEN user_id % 5 = 0 THEN event_type || '!' ELSE event_type END AS message, {MS} AS ms, {_HELD} AS held FROM events),
    o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, message ORDER BY ms, event_id) AS rn FROM h WHERE held IS NULL),
    g AS (SELECT event_id, user_id, message, ms, rn, ms AS anchor, true AS shown FROM o WHERE rn = 1
        UNION ALL SELECT o.event_id, o.user_id, o.message, o.ms, o.rn, CASE WHEN o.ms - g.anchor >= 86400000 THEN o.ms ELSE g.anchor END, o.ms - g.anchor >= 86400000 FROM g JOIN o ON o.user_id = g.user_id AND o.message = g.message AND o.rn = g.rn + 1)
    SELECT h.event_id AS id, COALESCE(held, CASE WHEN NOT shown THEN 'throttled' END) AS suppressed_by FROM h LEFT JOIN g ON g.event_id = h.event_id""")
def alert_suppression(t: Tables) -> DataFrame:
    """Which alerts aren't shown, and why; a broken pattern is passed over."""
    message = F.when(F.col("session") % 5 == 0, F.concat("event_type", F.lit("!"))).otherwise(F.col("event_type"))
    alerts = t.stream().select(F.col("pos").alias("id"), F.col("session").alias("project"), message.alias("message"), "ts_ms", F.concat(F.lit("repo"), F.col("session") % 7).alias("repository"))
    settings = rules.Notifications(snoozed_until_ms=1_704_412_800_000, ignored_repositories=["repo3"], ignored_patterns=["^PUR", "view!", "(open"], throttle_ms=86_400_000)
    return rules.suppressed(alerts, settings).select("id", "suppressed_by")


@query("""
    SELECT conv_id AS session, user_pos, turn AS pos FROM (SELECT *, LAST_VALUE(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS user_pos FROM conversations)
    WHERE role = 'assistant' AND user_pos IS NOT NULL""")
def answers(t: Tables) -> DataFrame:
    """Assistant rows with the user row before them, by the order of the rows."""
    return links.responses_in_order(t.conversations.select(F.col("conv_id").alias("session"), F.col("turn").alias("pos"), F.col("role").alias("type")))


def _heap(t: Tables) -> DataFrame:
    """Each session's events as a tree: the n-th answers the one at n / 2, and every 16th stands alone."""
    n = F.row_number().over(Window.partitionBy("session").orderBy("pos"))
    return t.stream().select("session", "pos", n.cast("long").alias("node")).select("session", "node", F.when((F.col("node") > 1) & (F.col("node") % 16 != 0), F.floor(F.col("node") / 2)).alias("parent"))


_SQL_HEAP = """
    WITH RECURSIVE n AS (SELECT user_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS node FROM events),
    p AS (SELECT user_id, node, CASE WHEN node > 1 AND node % 16 <> 0 THEN node // 2 END AS parent FROM n),
    a AS (SELECT user_id, node, node AS up, CAST(0 AS BIGINT) AS steps FROM p
        UNION ALL SELECT a.user_id, a.node, p.parent, a.steps + 1 FROM a JOIN p ON p.user_id = a.user_id AND p.node = a.up WHERE p.parent IS NOT NULL)"""


@query(f"""{_SQL_HEAP},
    r AS (SELECT user_id, node, arg_max(up, steps) AS root, MAX(steps) AS depth FROM a GROUP BY user_id, node),
    b AS (SELECT user_id, up AS node, COUNT(*) - 1 AS below FROM a GROUP BY user_id, up)
    SELECT r.user_id AS session, r.node, root, depth, below FROM r JOIN b ON b.user_id = r.user_id AND b.node = r.node""")
def thread_places(t: Tables) -> DataFrame:
    """Root, depth and number of descendants of each row, from its place in the tour."""
    tree = links.thread_tree(_heap(t), ["session"])
    return tree.select("session", "node", "root", "depth", F.expr("(last - first - 1) div 2").alias("below"))


@query(f"""{_SQL_HEAP},
    d AS (SELECT user_id, node, MAX(steps) AS depth FROM a GROUP BY user_id, node)
    SELECT a.user_id AS session, a.node AS "of", a.up AS node, CASE WHEN a.steps = 0 THEN 'self' ELSE 'ancestor' END AS relation, d.depth FROM a JOIN d ON d.user_id = a.user_id AND d.node = a.up WHERE a.node % 5 = 2
    UNION ALL SELECT a.user_id, a.up, a.node, 'descendant', d.depth FROM a JOIN d ON d.user_id = a.user_id AND d.node = a.node WHERE a.up % 5 = 2 AND a.steps > 0""")
def thread_members(t: Tables) -> DataFrame:
    """The threads of every fifth row."""
    rows = _heap(t)
    return links.thread_members(links.thread_tree(rows, ["session"]), rows.where("node % 5 = 2"), ["session"])
