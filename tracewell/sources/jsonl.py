"""Session transcripts: one JSON object per line, one file per session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Kinds of entries that are messages; others are dropped.
KINDS = ("user", "assistant", "system", "summary", "file-history-snapshot", "queue-operation")
BLOCK = "array<struct<type:string,text:string,thinking:string,id:string,name:string,input_json:string,tool_use_id:string,content_json:string,is_error:boolean>>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line, modified, size) of each line that isn't blank; line_no counts from 0 over all lines of the file."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    rows = whole.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("size"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    return rows.where(F.trim("line") != "")


def _blocks(line: Column) -> Column:
    """The content blocks as structs; their inputs and results as JSON text in the order of the source."""
    parts = F.from_json(F.get_json_object(line, "$.message.content"), "array<string>")
    get = lambda b, k: F.get_json_object(b, f"$.{k}")
    return F.transform(
        parts,
        lambda b: F.struct(
            get(b, "type").alias("type"), get(b, "text").alias("text"), get(b, "thinking").alias("thinking"), get(b, "id").alias("id"), get(b, "name").alias("name"), get(b, "input").alias("input_json"),
            get(b, "tool_use_id").alias("tool_use_id"), get(b, "content").alias("content_json"), F.coalesce(get(b, "is_error") == "true", F.lit(False)).alias("is_error"),
        ),
    ).cast(BLOCK)


def parse_messages(lines: DataFrame) -> DataFrame:
    """A message row for each valid line with a uuid and a known type; malformed lines are dropped.

    content is text (content_kind "string") or blocks ("array"): the two are told
    apart by the variant's own kind, as a text may begin with a bracket. Missing
    timestamps stay null. Numbers of usage are 0 where missing.
    """
    entry = F.try_parse_json("line")
    v = lines.withColumn("_v", entry).where("_v is not null")
    get = lambda path, kind="string": F.try_variant_get("_v", path, kind)
    content = F.try_variant_get("_v", "$.message.content", "variant")
    kind = F.when(content.isNull(), "string").when(F.schema_of_variant(content) == "STRING", "string").when(F.schema_of_variant(content).startswith("ARRAY"), "array").otherwise("string")
    conversational = F.col("type").isin("user", "assistant", "system")
    usage = lambda k: F.coalesce(get(f"$.message.usage.{k}", "long"), F.lit(0))
    out = v.select(
        "file", "line_no", "modified", "size", "line",
        get("$.uuid").alias("uuid"), get("$.type").alias("type"), get("$.timestamp").alias("_ts"), get("$.parentUuid").alias("parent_uuid"), get("$.sessionId").alias("session_id"),
        get("$.cwd").alias("cwd"), get("$.gitBranch").alias("git_branch"), get("$.agentId").alias("agent_id"), get("$.requestId").alias("request_id"),
        F.coalesce(get("$.isSidechain", "boolean"), F.lit(False)).alias("is_sidechain"), F.coalesce(get("$.isMeta", "boolean"), F.lit(False)).alias("is_meta"), F.coalesce(get("$.isCompactSummary", "boolean"), F.lit(False)).alias("is_compact"),
        get("$.message.role").alias("role"), get("$.message.model").alias("model"), get("$.sourceToolUseID").alias("source_tool_use_id"), F.get_json_object("line", "$.toolUseResult").alias("tool_use_result"),
        F.struct(usage("input_tokens").alias("input"), usage("output_tokens").alias("output"), usage("cache_read_input_tokens").alias("cache_read"), usage("cache_creation_input_tokens").alias("cache_creation")).alias("usage"),
        get("$.message.usage.input_tokens", "long").isNotNull().alias("has_usage"),
        kind.alias("content_kind"), F.when(kind == "string", F.coalesce(F.try_variant_get("_v", "$.message.content", "string"), F.lit(""))).alias("text"),
        F.when(kind == "array", _blocks(F.col("line"))).otherwise(F.expr(f"cast(array() as {BLOCK})")).alias("blocks"),
    ).where(F.col("uuid").isNotNull() & (F.col("uuid") != "") & F.col("type").isin(*KINDS))
    out = out.withColumn("ts", F.try_to_timestamp("_ts").cast("timestamp")).withColumn("session", F.regexp_extract("file", r"([^/]+)\.jsonl$", 1))
    return out.withColumn("is_meta", conversational & F.col("is_meta")).drop("_ts", "line")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return parse_messages(read_lines(spark, path))


def tool_calls(messages: DataFrame) -> DataFrame:
    """(session, line_no, block_no, uuid, ts, id, name, input_json, is_task, ...) of each tool call with an id and a name."""
    each = messages.select("session", "line_no", "uuid", "ts", F.posexplode("blocks").alias("block_no", "b")).where("b.type = 'tool_use' and b.id <> '' and b.name <> ''")
    task = F.col("b.name") == "Task"
    only = lambda k: F.when(task, F.get_json_object("b.input_json", f"$.{k}"))
    return each.select("session", "line_no", "block_no", "uuid", "ts", "b.id", "b.name", "b.input_json", task.alias("is_task"), only("description").alias("task_description"), only("subagent_type").alias("task_subagent_type"))


def tool_results(messages: DataFrame) -> DataFrame:
    """(session, line_no, block_no, uuid, ts, tool_use_id, content, is_error) of each tool result."""
    each = messages.select("session", "line_no", "uuid", "ts", "source_tool_use_id", F.posexplode("blocks").alias("block_no", "b")).where("b.type = 'tool_result' and b.tool_use_id <> ''")
    return each.select("session", "line_no", "block_no", "uuid", "ts", "source_tool_use_id", "b.tool_use_id", F.coalesce("b.content_json", F.lit("")).alias("content"), "b.is_error")


def session_files(spark: SparkSession, projects: str) -> DataFrame:
    """(project, session, file, modified, size) of the session files under a projects folder, without subagents' files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(projects)
    part = F.regexp_extract("path", r"([^/]+)/([^/]+)\.jsonl$", 1)
    name = F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)
    return found.select(part.alias("project"), name.alias("session"), F.col("path").alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("size")).where((F.col("project") != "subagents") & ~F.col("session").startswith("agent-"))


def subagent_files(spark: SparkSession, projects: str) -> DataFrame:
    """(project, session, agent_id, file): files under session/subagents, and old ones beside the sessions, which belong to the session on their first line."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "agent-*.jsonl").load(projects).select(F.col("path").alias("file"))
    agent = F.regexp_extract("file", r"agent-([^/]+)\.jsonl$", 1)
    new = found.where(F.col("file").contains("/subagents/")).select(F.regexp_extract("file", r"([^/]+)/[^/]+/subagents/[^/]+$", 1).alias("project"), F.regexp_extract("file", r"([^/]+)/subagents/[^/]+$", 1).alias("session"), agent.alias("agent_id"), "file")
    old = found.where(~F.col("file").contains("/subagents/"))
    first = read_lines(spark, projects).where(F.col("file").rlike(r"/agent-[^/]+\.jsonl$")).groupBy("file").agg(F.min_by(F.get_json_object("line", "$.sessionId"), "line_no").alias("session"))
    old = old.join(first, "file").select(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("project"), "session", agent.alias("agent_id"), "file")
    return new.unionByName(old)


def first_cwd(messages: DataFrame) -> DataFrame:
    """(session, cwd): the first working folder that is named in a session."""
    return messages.where("cwd <> ''").groupBy("session").agg(F.min_by("cwd", "line_no").alias("cwd"))


def working_folder(lines: DataFrame) -> DataFrame:
    """(file, cwd): the first folder that a line of a file names, with its drive letter in upper case; none where a broken line comes before it."""
    from tracewell.functions.paths import drive_upper

    parsed = lines.select("file", "line_no", F.try_parse_json("line").isNull().alias("broken"), F.get_json_object("line", "$.cwd").alias("cwd"))
    named = F.col("cwd").isNotNull() & (F.col("cwd") != "") & ~F.col("broken")
    first = parsed.groupBy("file").agg(F.min(F.when(F.col("broken"), F.col("line_no"))).alias("_b"), F.min(F.when(named, F.struct("line_no", "cwd"))).alias("_c"))
    return first.where("_c is not null and (_b is null or _b > _c.line_no)").select("file", drive_upper(F.col("_c.cwd")).alias("cwd"))


def with_line_numbers(messages: DataFrame) -> DataFrame:
    """messages with message_no: the place among the messages of their session, from 1; lines that give no message don't count."""
    from pyspark.sql import Window

    return messages.withColumn("message_no", F.row_number().over(Window.partitionBy("session").orderBy("line_no")))
