"""Joins between calls, results, subagents, turns and groups.

Interval joins meet in time buckets of a session, not in the session as a whole.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

from tracewell.operators import tours
from tracewell.store import keep


def link_tools(calls: DataFrame, results: DataFrame, by: tuple[str, ...] = ("session",), last: bool = False) -> DataFrame:
    """calls (.., id) left joined with one result (.., tool_use_id, pos) each: the first by pos, or the last; is_orphan where there is none."""
    pick = F.max_by if last else F.min_by
    rest = [c for c in results.columns if c not in (*by, "tool_use_id")]
    one = results.groupBy(*by, F.col("tool_use_id").alias("id")).agg(pick(F.struct(*rest), "pos").alias("r"))
    kept = [c for c in rest if c != "pos"]
    return calls.join(one, [*by, "id"], "left").select(*calls.columns, *[F.col(f"r.{c}").alias(f"result_{c}") for c in kept], F.col("r").isNull().alias("is_orphan"))


def with_skills(linked: DataFrame, instructions: DataFrame, by: tuple[str, ...] = ("session",), name: str = "name") -> DataFrame:
    """linked calls (.., id, name) with skill: the last instructions (.., source_tool_use_id, pos, text) that a Skill call put into the session; null for others."""
    last = instructions.groupBy(*by, F.col("source_tool_use_id").alias("id")).agg(F.max_by("text", "pos").alias("_skill"))
    return linked.join(last, [*by, "id"], "left").withColumn("skill", F.when(F.col(name) == "Skill", F.col("_skill"))).drop("_skill")


def result_map(results: DataFrame, enriched: DataFrame, by: tuple[str, ...] = ("session",)) -> DataFrame:
    """(.., tool_use_id, content, is_error): of each call the last result, where an enriched one counts as the last of its message.

    results (.., line_no, block_no, tool_use_id, content, is_error) come from blocks;
    enriched (.., line_no, source_tool_use_id, content, is_error) from the messages'
    toolUseResult, where they name their call.
    """
    plain = results.select(*by, "tool_use_id", F.struct("line_no", F.lit(0).alias("rank"), "block_no").alias("at"), "content", "is_error")
    more = enriched.where("source_tool_use_id is not null").select(*by, F.col("source_tool_use_id").alias("tool_use_id"), F.struct("line_no", F.lit(1).alias("rank"), F.lit(0).alias("block_no")).alias("at"), "content", "is_error")
    last = plain.unionByName(more).groupBy(*by, "tool_use_id").agg(F.max_by(F.struct("content", "is_error"), "at").alias("r"))
    return last.select(*by, "tool_use_id", "r.*")


def unclaimed(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows that no row of the other side claims."""
    return left.join(right.select(*on), on, "left_anti")


def positional(left: DataFrame, right: DataFrame, left_order: list, right_order: list, by: list[str]) -> DataFrame:
    """The n-th of the left with the n-th of the right inside each group; the rest of either side has no partner."""
    rank = lambda df, order: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return rank(left, left_order).join(rank(right, right_order), [*by, "rank"])


def subagent_tasks(subagents: DataFrame, tasks: DataFrame, claims: DataFrame) -> DataFrame:
    """(session, agent_id, task_id, phase): which task call started a subagent.

    subagents (session, agent_id, start_ts, summary), tasks (session, task_id, order,
    description, is_team), claims (session, agent_id, task_id, pos). First the
    results that name their agent, the last one counting; then teams by equal
    description and summary, earliest first; then what stays over by position, where
    tasks of teams take no part.
    """
    named = claims.groupBy("session", "agent_id").agg(F.max_by("task_id", "pos").alias("task_id")).join(tasks.select("session", "task_id"), ["session", "task_id"]).select("session", "agent_id", "task_id", F.lit(1).alias("phase"))
    named = keep(named, "named")
    left = lambda done: (subagents.join(done, ["session", "agent_id"], "left_anti"), tasks.join(done, ["session", "task_id"], "left_anti"))
    agents, open_ = left(named)
    team = positional(agents.withColumnRenamed("summary", "key"), open_.where("is_team").withColumnRenamed("description", "key"), ["start_ts", "agent_id"], ["order"], ["session", "key"]).where("key is not null")
    both = keep(named.unionByName(team.select("session", "agent_id", "task_id", F.lit(2).alias("phase"))), "teams")
    agents, open_ = left(both)
    rest = positional(agents, open_.where("not is_team"), ["start_ts", "agent_id"], ["order"], ["session"])
    return both.unionByName(rest.select("session", "agent_id", "task_id", F.lit(3).alias("phase")))


def turns(rows: DataFrame, by: tuple[str, ...] = ("session",), pos: str = "pos") -> DataFrame:
    """(.., turn, user_pos, user_ts, next_ts) for each user row; needs is_user and ts. turn counts from 0."""
    w = Window.partitionBy(*by).orderBy("ts", pos)
    return rows.where("is_user").select(*by, (F.row_number().over(w) - 1).alias("turn"), F.col(pos).alias("user_pos"), F.col("ts").alias("user_ts"), F.lead("ts").over(w).alias("next_ts"))


def responses(rows: DataFrame, by: tuple[str, ...] = ("session",), pos: str = "pos") -> DataFrame:
    """Rows that answer a turn: later than its user row and before the next one, both ends open; needs is_response too.

    Turns don't overlap, so the latest user row at or before a response decides: it is
    its turn unless both have the same time. A running value over the session's rows
    finds it; nothing is joined.
    """
    first = Window.partitionBy(*by).orderBy("ts", F.when(F.col("is_user"), 0).otherwise(1), pos)
    number = F.sum(F.col("is_user").cast("int")).over(first.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    user = F.struct(F.col(pos).alias("pos"), F.col("ts").alias("ts"))
    latest = F.last(F.when(F.col("is_user"), user), True).over(first.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    back = Window.partitionBy(*by).orderBy(F.desc("ts"), F.when(F.col("is_user"), 1).otherwise(0), F.desc(pos))
    following = F.last(F.when(F.col("is_user"), F.col("ts")), True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    seen = rows.where("ts is not null").withColumn("_turn", number.cast("int")).withColumn("_user", latest).withColumn("_next", following)
    found = seen.where(F.col("is_response") & (F.col("_user.ts") < F.col("ts")))
    return found.select(*by, F.col("_turn").alias("turn"), F.col("_user.pos").alias("user_pos"), F.col("_user.ts").alias("user_ts"), F.col("_next").alias("next_ts"), F.col(pos), F.col("ts"))


def responses_in_order(rows: DataFrame, by: tuple[str, ...] = ("session",), pos: str = "pos") -> DataFrame:
    """(.., user_pos, pos) of assistant rows after a user row and before the next one in the order of the rows, whatever their times; needs type."""
    before = Window.partitionBy(*by).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    user = F.last(F.when(F.col("type") == "user", F.col(pos)), True).over(before)
    return rows.select(*by, user.alias("user_pos"), F.col(pos), "type").where("type = 'assistant' and user_pos is not null").drop("type")


def _ticks(df: DataFrame, name: str) -> Column:
    """A time as a long that keeps the order: microseconds of a timestamp, the whole part of a number."""
    kind = df.schema[name].dataType
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp"))
    return F.floor(name).cast("long")


def in_interval(points: DataFrame, spans: DataFrame, by: list[str], closed: str) -> DataFrame:
    """points (.., ts) inside spans (.., start, end): closed is "both", "left" or "neither"; a null end is open.

    Spans of about one length (within a factor of four) share a grid of buckets that are
    longer than they, so each stands in two buckets at most, and a point looks into one
    bucket for each length that occurs (at most 32; they and the latest time, with which
    open spans end, come from two small queries beforehand). So the join is on session,
    length and bucket: what meets lies close together in time, the work follows the
    result, and a long session is spread over many tasks. Spans may overlap; rows without a time or start
    are in no pair.
    """
    ts, start, end = F.col("ts"), F.col("start"), F.col("end")
    p = points.withColumn("_t", _ticks(points, "ts")).where("_t is not null")
    s = spans.withColumn("_a", _ticks(spans, "start")).withColumn("_b", _ticks(spans, "end")).where("_a is not null")
    latest = F.lit(p.agg(F.max("_t")).first()[0]).cast("long")
    s = s.withColumn("_b", F.coalesce("_b", F.greatest(latest, "_a"))).where("_b >= _a")
    s = s.withColumn("_k", F.expr("cast(2 * ((length(bin(_b - _a)) + 1) div 2) as int)"))
    grids = sorted(r[0] for r in s.select("_k").distinct().collect())
    if not grids:
        grids = [2]
    grid = lambda k: F.struct(F.lit(k).alias("_k"), F.shiftright(F.col("_t"), k).alias("_bucket"))
    p = p.select(*points.columns, F.explode(F.array(*map(grid, grids))).alias("_g")).select(*points.columns, "_g.*")
    s = s.withColumn("_bucket", F.explode(F.expr("sequence(shiftright(_a, _k), shiftright(_b, _k))"))).drop("_a", "_b")
    low = ts > start if closed == "neither" else ts >= start
    high = ts <= end if closed == "both" else ts < end
    return p.join(s, [*by, "_k", "_bucket"]).where(low & (end.isNull() | high)).drop("_k", "_bucket")


def nearest(points: DataFrame, groups: DataFrame, by: list[str], point_id: str, group_id: str) -> DataFrame:
    """Each point with one group of its session: the first that contains ts, else the one with an end nearest to it, ties to the earlier.

    groups has (start, end) as numbers, which must not overlap; so only four can
    win: the last that starts at or before the point, the next one, and for each end
    the same. They come from running values over points and groups in one order,
    not from a join of all with all.
    """
    cols = "struct<start:bigint,end:bigint,id:bigint>"
    g = groups.select(*by, F.col("start").cast("long").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("p"), F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col(group_id).cast("long").alias("id")).alias("g"))
    p = points.select(*by, F.col("ts").cast("long").alias("t"), F.lit(1).alias("kind"), F.col(point_id).cast("long").alias("p"), F.lit(None).cast(cols).alias("g"))
    both = g.unionByName(p)
    w, back = Window.partitionBy(*by).orderBy("t", "kind"), Window.partitionBy(*by).orderBy(F.desc("t"), F.desc("kind"))
    seen = both.withColumn("a", F.last("g", True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("b", F.last("g", True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    t = F.col("t")
    gap = lambda x: F.when((t >= F.col(f"{x}.start")) & (t <= F.col(f"{x}.end")), F.lit(-1)).otherwise(F.least(F.abs(t - F.col(f"{x}.start")), F.abs(t - F.col(f"{x}.end"))))
    best = F.when(F.col("a").isNull() | (F.col("b").isNotNull() & (gap("b") < gap("a"))), F.col("b.id")).otherwise(F.col("a.id"))
    return seen.where("kind = 1").select(*by, F.col("p").alias(point_id), best.alias(group_id))


def last_before(rows: DataFrame, by: list[str], what: str, when: str, order: str) -> DataFrame:
    """rows with found: the value of what in the latest earlier row where when holds."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("found", F.last(F.when(F.col(when), F.col(what)), True).over(w))


def threads(rows: DataFrame, by: list[str], node: str = "node", parent: str = "parent") -> DataFrame:
    """(.., node, root, depth): the top of each row's chain of parents, and its distance, by pointer doubling.

    Each round doubles the distance that a pointer spans, so a chain of n rows takes
    log2(n) joins. Parents that are missing end a chain; rows on a cycle have no top
    and get none.
    """
    known = rows.select(*by, F.col(node).alias("up"))
    jump = rows.select(*by, F.col(node).alias("node"), F.col(parent).alias("up")).join(known.withColumn("_there", F.lit(True)), [*by, "up"], "left")
    jump = jump.select(*by, "node", F.when(F.col("_there"), F.col("up")).alias("up"), F.when(F.col("_there"), 1).otherwise(0).cast("long").alias("depth"), F.when(F.col("_there"), F.col("up")).otherwise(F.col("node")).alias("root"))
    total = None
    jump = keep(jump, "threads")
    while True:
        open_ = jump.where("up is not null").count()
        if not open_:
            break
        total = jump.count() if total is None else total
        step = jump.select(*by, F.col("node").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("root").alias("_root"))
        joined = jump.join(step, [*by, "up"], "left")
        jump = keep(joined.select(*by, "node", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.coalesce("_root", "root").alias("root")), "threads")
        # A chain can't be longer than the table: what is still open then runs in a circle.
        jump = jump.where(F.col("depth") <= total)
    return jump.select(*by, F.col("node").alias(node), "root", "depth")


#: Rows of a session up to which one task solves its threads.
LOCAL_ROWS = 1 << 16


def thread_tree(rows: DataFrame, by: list[str], node: str = "node", parent: str = "parent", order: str | None = None, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(.., node, root, depth, first, last, on_cycle): each row's place in its thread, as an interval.

    A tour enters a node, visits its children by order and leaves the node; first and
    last number its two visits (backwards from -1, the end of the root's tour). So y is below
    x, in any depth, exactly if x and y have the same root and y.first lies between
    x.first and x.last. A parent that isn't there makes a row a root; of rows that
    repeat a node the last by order counts; rows on a cycle, and those below one, have no
    root and are marked.

    Sessions of at most local_rows rows move once, to a task that solves many of them at a
    time (tours.local_trees). Longer ones are never gathered: their tour is a linked list
    of two visits for each row, and places, depths and roots come from pointer doubling,
    log2(2 n) joins for any shape of tree.
    """
    kind = rows.schema[node].dataType
    above = F.col(parent) if rows.schema[parent].dataType == kind else F.col(parent).try_cast(kind)
    at = [F.col(order).alias("at")] if order else []
    given = keep(rows.where(F.col(node).isNotNull()).select(*by, F.col(node).alias("node"), above.alias("parent"), *at), "thread-rows")
    sort = ["at", "node"] if order else ["node"]
    # At most one in local_rows rows names a long session.
    long = keep(given.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > local_rows).select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)]), "long-sessions")
    if not long.take(1):
        out = tours.local_trees(given, by, sort)
    else:
        same = functools.reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(by)], F.lit(True))
        short = tours.local_trees(given.join(F.broadcast(long), same, "left_anti"), by, sort)
        out = short.unionByName(_joined_trees(given.join(F.broadcast(long), same, "left_semi"), by))
    return out.withColumnRenamed("node", node)


def _joined_trees(rows: DataFrame, by: list[str]) -> DataFrame:
    """What thread_tree says of rows (by, node, parent, and at if there is an order), for sessions of any length."""
    by_order = F.col("at" if "at" in rows.columns else "node")
    one = rows.groupBy(*by, "node").agg(F.max_by(F.struct("parent", by_order.alias("at")), F.struct(by_order)).alias("r")).select(*by, "node", "r.*")
    one = keep(one, "thread-nodes")
    there = one.select(*by, F.col("node").alias("parent"), F.lit(True).alias("_there"))
    tree = one.join(there, [*by, "parent"], "left").select(*by, "node", "at", F.when(F.col("_there"), F.col("parent")).alias("parent"))
    siblings = Window.partitionBy(*by, "parent").orderBy("at", "node")
    tree = tree.withColumn("following", F.when(F.col("parent").isNotNull(), F.lead("node").over(siblings)))
    child = tree.where("parent is not null").groupBy(*by, F.col("parent").alias("node")).agg(F.min_by("node", F.struct("at", "node")).alias("child"))
    tree = tree.join(child, [*by, "node"], "left")
    visit = lambda leaves, to, to_leaves, step: F.struct(F.lit(leaves).alias("leaves"), to.alias("to"), to_leaves.alias("to_leaves"), F.lit(step).cast("long").alias("net"))
    enter = visit(False, F.coalesce("child", "node"), F.col("child").isNull(), 1)
    leave = visit(True, F.coalesce("following", "parent"), F.col("following").isNull(), -1)
    tour = tree.select(*by, "node", F.explode(F.array(enter, leave)).alias("v")).select(*by, "node", "v.*", F.lit(1).cast("long").alias("steps"), F.col("node").alias("end"))
    tour = keep(tour, "tour")
    rounds = max(1, tour.count()).bit_length() + 1
    for _ in range(rounds):
        if not tour.where("to is not null").take(1):
            break
        step = tour.select(*by, F.col("node").alias("to"), F.col("leaves").alias("to_leaves"), F.col("to").alias("_to"), F.col("to_leaves").alias("_leaves"), F.col("net").alias("_net"), F.col("steps").alias("_steps"), F.col("end").alias("_end"))
        joined = tour.join(step.hint("merge"), [*by, "to", "to_leaves"], "left")
        add = lambda c: (F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c)
        tour = keep(joined.select(*by, "node", "leaves", F.col("_to").alias("to"), F.col("_leaves").alias("to_leaves"), add("net"), add("steps"), F.coalesce("_end", "end").alias("end")), "tour")
    place = lambda leaves: F.max(F.when(F.col("leaves") == F.lit(leaves), -F.col("steps")))
    # After so many rounds every list has ended; what still points on runs in a circle.
    ring = F.max(F.col("to").isNotNull())
    depth = F.max(F.when(~F.col("leaves"), -F.col("net")))
    out = tour.groupBy(*by, "node").agg(F.max("end").alias("root"), depth.alias("depth"), place(False).alias("first"), place(True).alias("last"), ring.alias("on_cycle"))
    clear = lambda c: F.when(~F.col("on_cycle"), F.col(c)).alias(c)
    return out.select(*by, "node", clear("root"), clear("depth"), clear("first"), clear("last"), "on_cycle")


def thread_members(tree: DataFrame, chosen: DataFrame, by: list[str], node: str = "node") -> DataFrame:
    """(.., of, node, relation, depth): for each chosen (.., node) its ancestors, itself and its descendants in a tree of thread_tree.

    Both are interval joins over the places of the tour, so their work follows the result.
    Places are rows much alike: millions of them make a small file, so Spark would broadcast them.
    """
    placed = keep(tree.where("not on_cycle"), "thread-places")
    x = keep(placed.join(chosen.select(*by, node).distinct().hint("merge"), [*by, node], "left_semi"), "chosen-places")
    group = [*by, "root"]
    point = lambda df, name: df.select(*group, F.col("first").alias("ts"), F.col(node).alias(name), F.col("depth").alias(f"{name}_depth"))
    span = lambda df, name: df.select(*group, F.col("first").alias("start"), F.col("last").alias("end"), F.col(node).alias(name), F.col("depth").alias(f"{name}_depth")).hint("merge")
    below = in_interval(point(placed, "y"), span(x, "x"), group, "neither").select(*by, F.col("x").alias("of"), F.col("y").alias(node), F.lit("descendant").alias("relation"), F.col("y_depth").alias("depth"))
    above = in_interval(point(x, "x"), span(placed, "y"), group, "neither").select(*by, F.col("x").alias("of"), F.col("y").alias(node), F.lit("ancestor").alias("relation"), F.col("y_depth").alias("depth"))
    own = x.select(*by, F.col(node).alias("of"), F.col(node), F.lit("self").alias("relation"), "depth")
    return above.unionByName(own).unionByName(below)
