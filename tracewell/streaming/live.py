"""Live transcripts: alerts and runs of growing files, with keyed state between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewell.functions import text as X
from tracewell.operators import classify as C, rules as R
from tracewell.sources import jsonl
from tracewell.streaming import state


def messages_of(lines: DataFrame) -> DataFrame:
    """Messages from the lines of the tail source; line_no is the byte offset, which orders lines as well."""
    now = F.lit(None).cast("timestamp")
    return jsonl.parse_messages(lines.select("file", F.col("offset").alias("line_no"), "line", now.alias("modified"), F.lit(None).cast("long").alias("size")))


def alerts_of(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """Alerts of all rules: results with the tool that was called for them, uses, and sizes. Ids are hashes of what raised an alert."""
    project = F.regexp_extract("file", r"([^/]+)/[^/]+\.jsonl$", 1)
    m = messages.withColumn("project", project)
    named = m.select("session", "uuid", "project", "agent_id").dropDuplicates(["session", "uuid"])
    calls = jsonl.tool_calls(messages).join(named, ["session", "uuid"])
    results = jsonl.tool_results(messages).join(named, ["session", "uuid"])
    tools = calls.select("session", F.col("id").alias("tool_use_id"), F.col("name").alias("tool")).dropDuplicates(["session", "tool_use_id"])
    results = results.join(tools, ["session", "tool_use_id"], "left")
    at = F.struct("line_no", "block_no").alias("pos")
    keys = ["project", F.col("uuid").alias("message"), at, "tool", "session", "ts", (F.col("agent_id").isNotNull()).alias("from_subagent")]
    by_result = R.match_results(results.select(*keys, "tool_use_id", "content", "is_error"), rules)
    by_use = R.match_uses(calls.withColumnsRenamed({"name": "tool", "id": "tool_use_id"}).select(*keys, "tool_use_id", F.col("input_json").alias("input")), rules)
    out_tokens = results.groupBy("session", "tool_use_id").agg(F.max(F.ceil(F.length("content") / 4)).cast("long").alias("output_tokens"))
    sized = calls.withColumnsRenamed({"name": "tool", "id": "tool_use_id"}).join(out_tokens, ["session", "tool_use_id"], "left")
    by_size = R.match_tokens(sized.select(*keys, "tool_use_id", F.ceil(F.length(F.concat("tool", "input_json")) / 4).cast("long").alias("input_tokens"), F.coalesce("output_tokens", F.lit(0)).alias("output_tokens")), rules)
    cols = ["project", "session", "message", "rule_id", "rule_name", "tool_use_id", "from_subagent", "ts"]
    every = by_result.select(*cols).unionByName(by_use.select(*cols)).unionByName(by_size.select(*cols))
    return every.withColumn("id", F.sha2(F.concat_ws("|", "session", "message", "rule_id", "tool_use_id"), 256)).dropDuplicates(["id"])


def calls_and_results(messages: DataFrame) -> DataFrame:
    """The tool calls and results of messages as rows of state.BLOCKS: content is a call's input or a result's text, tokens its size."""
    project = F.regexp_extract("file", r"([^/]+)/[^/]+\.jsonl$", 1)
    each = messages.select("session", project.alias("project"), F.col("uuid").alias("message"), "line_no", "ts", F.col("agent_id").isNotNull().alias("from_subagent"), F.posexplode("blocks").alias("block_no", "b"))
    call = (F.col("b.type") == "tool_use") & (F.col("b.id") != "") & (F.col("b.name") != "")
    result = (F.col("b.type") == "tool_result") & (F.col("b.tool_use_id") != "")
    content = F.when(call, F.col("b.input_json")).otherwise(F.coalesce("b.content_json", F.lit("")))
    size = F.ceil(F.length(F.when(call, F.concat("b.name", "b.input_json")).otherwise(content)) / 4).cast("long")
    return each.where(call | result).select(
        "session", F.when(call, F.col("b.id")).otherwise(F.col("b.tool_use_id")).alias("tool_use_id"), F.when(call, "call").otherwise("result").alias("kind"), "project", "message", F.col("line_no").cast("long").alias("line_no"), "block_no",
        F.when(call, F.col("b.name")).alias("tool"), F.unix_micros("ts").alias("ts_us"), "from_subagent", content.alias("content"), F.coalesce("b.is_error", F.lit(False)).alias("is_error"), F.coalesce(size, F.lit(0)).alias("tokens"),
    )


def alerts_of_linked(linked: DataFrame, rules: DataFrame) -> DataFrame:
    """The alerts that rows of state.LINKED raise and that what was known before didn't."""
    at = F.struct("line_no", "block_no").alias("pos")
    keys = ["project", "message", at, "session", "ts", "from_subagent", "tool_use_id"]
    cols = ["project", "session", "message", "rule_id", "rule_name", "tool_use_id", "from_subagent", "ts"]
    named = lambda df: df.select(*cols).withColumn("id", F.sha2(F.concat_ws("|", "session", "message", "rule_id", "tool_use_id"), 256))
    results = linked.where("kind = 'result'")
    by_result = named(R.match_results(results.select(*keys, "tool", "content", "is_error"), rules))
    known = named(R.match_results(results.where("not is_new").select(*keys, F.col("tool_before").alias("tool"), "content", "is_error"), rules))
    by_use = named(R.match_uses(linked.where("kind = 'call'").select(*keys, "tool", F.col("content").alias("input")), rules))
    sizes = linked.where("kind in ('call', 'size')")
    by_size = named(R.match_tokens(sizes.select(*keys, "tool", F.col("tokens").alias("input_tokens"), "output_tokens"), rules))
    # A call that came in this batch has no size before it; one of an earlier batch has the size before this one's results.
    before = sizes.where("not is_new").select(*keys, "tool", F.col("tokens").alias("input_tokens"), F.col("output_before").alias("output_tokens"))
    fresh = linked.where("kind = 'call'").select("session", "tool_use_id")
    known_size = named(R.match_tokens(before.join(fresh, ["session", "tool_use_id"], "left_anti"), rules))
    raised = by_result.join(known, "id", "left_anti").unionByName(by_use).unionByName(by_size.join(known_size, "id", "left_anti"))
    return raised.dropDuplicates(["id"])


def follow(spark: SparkSession, lines: DataFrame, table: str, rules: list[R.Rule], checkpoint: str, trigger: dict | None = None, ttl_ms: int | None = None):
    """Starts a stream that keeps table/alerts: each batch writes the alerts that its lines raise.

    Calls and results meet in keyed state (state.LinkProcessor), so a result is linked
    to a call of any earlier batch, and no batch reads earlier messages. The batch
    number names the version: a batch that is run again writes the same rows to the
    same place. ttl_ms drops calls and results that have waited so long.
    """
    linked = state.link(calls_and_results(messages_of(lines)), ttl_ms)

    def batch(new: DataFrame, number: int) -> None:
        s = new.sparkSession
        rows = new.persist()  # seven looks at what one batch brought
        alerts_of_linked(rows, R.rule_table(s, rules)).write.mode("overwrite").parquet(f"{table}/alerts/batch={number}")
        rows.unpersist()

    writer = linked.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def follow_chunks(lines: DataFrame, table: str, checkpoint: str, trigger: dict | None = None):
    """Starts a stream that keeps table/chunks: the runs that each batch made or changed. current_chunks of it gives the runs as they are."""
    m = messages_of(lines)
    rows = m.select("session", F.col("line_no").alias("pos"), C.category(m).alias("category"), F.col("uuid").alias("id"), X.estimate_tokens(F.coalesce("text", F.lit(""))).alias("tokens"), "ts")

    def batch(new: DataFrame, number: int) -> None:
        new.write.mode("overwrite").parquet(f"{table}/chunks/batch={number}")

    writer = state.live_chunks(rows).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def current_alerts(spark: SparkSession, table: str, cap: int = 100) -> DataFrame:
    """The newest alerts, one for each call; the subagent's own if both files hold it."""
    every = spark.read.parquet(f"{table}/alerts")
    first = every.groupBy("id").agg(F.min_by(F.struct(*[c for c in every.columns if c != "id"]), "batch").alias("r")).select("id", "r.*")
    return R.newest(R.upsert_alerts(first.withColumn("arrival", F.struct("batch", "ts", "id"))).drop("arrival"), cap)
