"""Details that no fixture query covers."""

from pyspark.sql import functions as F

from tracewell.operators import details


def test_slash_follow_ups(spark):
    slashes = spark.createDataFrame([("s", "u1", "model"), ("s", "u2", "clear")], "session string, uuid string, name string")
    rows = spark.createDataFrame([("s", "u1", True, None, "old", 1), ("s", "u1", True, None, "new text", 2), ("s", "u1", True, "t1", "by a tool", 3), ("s", "u2", False, None, "not meta", 4)], "session string, parent_uuid string, is_meta boolean, source_tool_use_id string, text string, pos int")
    assert {r.name: (r.instructions, r.instruction_tokens) for r in details.slash_follow_ups(slashes, rows, ["session"], "pos").collect()} == {"model": ("new text", 2), "clear": (None, 0)}


def test_team_colors(spark):
    agents = spark.createDataFrame([("s", "a", "t1"), ("s", "b", None)], "session string, agent_id string, task string")
    spawned = spark.createDataFrame([("s", "t1", "x", "m", "red", 1), ("s", "t1", "x", "m", "blue", 2)], "session string, task string, team string, member string, color string, pos int")
    assert {r.agent_id: (r.team, r.color) for r in details.team_colors(agents, spawned, ["session"]).collect()} == {"a": ("x", "blue"), "b": (None, None)}


def test_display_items(spark):
    steps = spark.createDataFrame([("g", 1, "thinking", 1, 1), ("g", 2, "tool_call", 2, 2), ("g", 3, "tool_result", 3, 3), ("g", 4, "output", 4, 4), ("g", 5, "output", 6, 5)], "grp string, step_id int, kind string, ts int, pos int")
    more = spark.createDataFrame([("g", 5, 9)], "grp string, ts int, pos int")
    got = details.display_items(steps, steps.where("step_id = 5"), more, more.limit(0), ["grp"]).orderBy("index").collect()
    assert [r.item for r in got] == ["thinking", "tool", "output", "slash"]


def test_lists(spark):
    s = spark.createDataFrame([("p2", "s1", "2026-01-01 10:00:00", True), ("p1", "s1", "2026-01-01 10:09:00", True)], "project string, session string, modified string, is_ongoing boolean").withColumn("modified", F.col("modified").cast("timestamp"))
    assert {r.project: r.is_ongoing for r in details.with_stale_guard(s, F.lit("2026-01-01 10:10:00")).collect()} == {"p2": False, "p1": True}
    assert details.by_ids(s, ["s1", "../x", "s1"]).count() == 2 and details.first_project_of(s, "s1").first().project == "p1"
    tools = spark.createDataFrame([(True, None), (False, True), (False, False)], "is_orphan boolean, result_is_error boolean")
    assert [r.status for r in details.tool_status(tools).collect()] == ["orphaned", "error", "ok"]


def test_alerts_without_a_call_do_not_meet_in_one_task(spark):
    from pyspark.sql import functions as F

    from tracewell.operators import rules

    made = spark.range(0, 400, 1, 4).select("id", F.when(F.col("id") % 10 == 0, F.concat(F.lit("t"), F.col("id") % 40)).alias("tool_use_id"), (F.col("id") % 3 == 0).alias("from_subagent"), F.col("id").alias("arrival"))
    got = rules.upsert_alerts(made).withColumn("task", F.spark_partition_id()).collect()
    calls = {r.tool_use_id: r.id for r in got if r.tool_use_id}
    assert calls == {"t0": 0, "t10": 90, "t20": 60, "t30": 30}
    alone = [r for r in got if r.tool_use_id is None]
    assert len(alone) == 360 and len({r.task for r in alone}) == 4
