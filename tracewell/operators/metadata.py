"""What a listing says about a session file: first message, turns, branch, whether it goes on; and sums of groups.

Every function here is one aggregation by session or group, with partial sums
before the shuffle; nothing is ordered in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.functions import text as X

# Fixed values of the transcript format.
SYNTHETIC_MODEL = "<synthetic>"
REJECTED = "User rejected tool use"
#: Characters of a group's first thinking that are shown, and of a session's first message.
PREVIEW, FIRST = 100, 500


def block_activity(blocks: DataFrame, by: tuple[str, ...] = ("session",)) -> DataFrame:
    """blocks with is_activity and is_ending, by which a session is seen to go on or to have ended.

    Needs type (of the row: assistant or user), kind (of the block), text, name, input
    (JSON), tool_id (the call's id, at calls and results) and rejected (the row's
    result says that the user refused). A plan's end, an approved shutdown and its
    result, text, an interruption and a refusal end; thinking, other calls and other
    results are activity; the rest is neither.
    """
    said = F.coalesce(F.col("text"), F.lit(""))
    assistant = F.col("type") == "assistant"
    call = assistant & (F.col("kind") == "tool_use") & (F.coalesce(F.col("tool_id"), F.lit("")) != "")
    shuts = (F.get_json_object("input", "$.type") == "shutdown_response") & (F.get_json_object("input", "$.approve") == "true")
    shutdown = call & (F.col("name") == "SendMessage") & F.coalesce(shuts, F.lit(False))
    closing = blocks.where(shutdown).select(*by, "tool_id").distinct().withColumn("closes", F.lit(True))
    rows = blocks.join(closing, [*by, "tool_id"], "left")
    result = (F.col("type") == "user") & (F.col("kind") == "tool_result") & (F.coalesce(F.col("tool_id"), F.lit("")) != "")
    refused = result & (F.coalesce("closes", F.lit(False)) | F.coalesce("rejected", F.lit(False)))
    text = F.col("kind") == "text"
    spoken = assistant & text & (F.length(X.js_trim(said)) > 0)
    stopped = (F.col("type") == "user") & text & said.startswith(X.INTERRUPTED)
    ending = (call & (F.col("name") == "ExitPlanMode")) | shutdown | spoken | refused | stopped
    thought = assistant & (F.col("kind") == "thinking") & (F.length(said) > 0)
    activity = (thought | call | result) & ~ending
    false = F.lit(False)
    return rows.withColumn("is_ending", F.coalesce(ending, false)).withColumn("is_activity", F.coalesce(activity, false)).drop("closes")


def first_text(c: Column) -> Column:
    """What of a user row's text can be a session's first message; null for command output, commands, interruptions and metadata only."""
    shown = X.sanitize(c)
    skipped = X.is_command_output(c) | c.startswith(X.INTERRUPTED) | c.startswith("<command-name>")
    return F.when(~skipped & (F.length(shown) > 0), shown)


def first_command(c: Column) -> Column:
    """A command's name with its slash, /command if it has none; null where a text isn't a command."""
    name = F.regexp_extract(c, "<command-name>/([^<]+)</command-name>", 1)
    return F.when(c.startswith("<command-name>"), F.when(name != "", F.concat(F.lit("/"), name)).otherwise("/command"))


def file_metadata(rows: DataFrame, blocks: DataFrame, turns: DataFrame, phases: DataFrame, by: tuple[str, ...] = ("session",), pos: str = "pos") -> DataFrame:
    """One row for each session: first message, turns, branch, whether it goes on, and context use.

    rows needs type, is_meta, text, git_branch and is_displayable; blocks is what
    block_activity() gave, with an order_no that rises through the session; turns and
    phases are those of sessions.turn_count() and sessions.context_consumption().
    """
    asked = (F.col("type") == "user") & ~F.coalesce("is_meta", F.lit(False))
    shown, command = (F.when(asked, f(F.col("text"))) for f in (first_text, first_command))
    first = lambda value: F.min_by(value, F.when(value.isNotNull(), F.col(pos)))
    branch = F.nullif("git_branch", F.lit(""))
    files = rows.groupBy(*by).agg(
        F.substring(F.coalesce(first(shown), first(command)), 1, FIRST).alias("first_message"),
        first(branch).alias("git_branch"),
        F.coalesce(F.bool_or("is_displayable"), F.lit(False)).alias("has_displayable"),
    )
    last = lambda c: F.max(F.when(F.col(c), F.col("order_no")))
    open_ = F.coalesce(last("is_activity") > last("is_ending"), last("is_activity").isNotNull() & last("is_ending").isNull())
    going = blocks.groupBy(*by).agg(open_.alias("is_ongoing"))
    out = files.join(going, [*by], "left").join(turns, [*by], "left").join(phases, [*by], "left")
    return out.withColumn("is_ongoing", F.coalesce("is_ongoing", F.lit(False)))


def group_summary(steps: DataFrame, by: list[str], pos: str = "pos") -> DataFrame:
    """Counts and sums of each group of steps, and the beginning of its first thinking; needs step, text, duration, input, output and cached."""
    count = lambda kind: F.count_if(F.col("step") == kind)
    thinks = (F.col("step") == "thinking") & (F.length("text") > 0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return steps.groupBy(*by).agg(
        X.truncate(F.min_by(F.when(thinks, F.col("text")), F.when(thinks, F.col(pos))), PREVIEW).alias("thinking_preview"),
        count("tool_call").alias("tool_calls"),
        count("output").alias("outputs"),
        count("subagent").alias("subagents"),
        total("duration").alias("duration"),
        total(F.coalesce("input", F.lit(0)) + F.coalesce("output", F.lit(0))).alias("total_tokens"),
        total("output").alias("output_tokens"),
        total("cached").alias("cached_tokens"),
    )


def group_timing(rows: DataFrame, by: list[str]) -> DataFrame:
    """start, end and duration of each group: from its user row to the latest of its rows, never before the start; needs is_user and ts_ms."""
    start = F.min(F.when(F.col("is_user"), F.col("ts_ms")))
    end = F.greatest(start, F.max("ts_ms"))
    return rows.groupBy(*by).agg(start.alias("start_ms"), end.alias("end_ms"), (end - start).alias("duration_ms")).where("start_ms is not null")


def by_creation(sessions: DataFrame, first_user: str = "first_user_ts", made: str = "file_ts") -> DataFrame:
    """Sessions, the newest first: created is the first user row's time, else the file's; ties by session."""
    return sessions.withColumn("created", F.coalesce(first_user, made)).orderBy(F.desc("created"), "session")


def holding(groups: DataFrame, members: str, wanted: DataFrame, by: list[str]) -> DataFrame:
    """(.., id, first group) that holds each wanted (.., id) in its array of members; needs group."""
    each = groups.select(*by, "group", F.explode(members).alias("id"))
    return each.join(wanted.select(*by, "id").distinct(), [*by, "id"]).groupBy(*by, "id").agg(F.min("group").alias("group"))


def in_range(rows: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    """Rows from start to end, both included."""
    return rows.where(F.col(ts).between(start, end))


def phase_injections(injections: DataFrame, by: list[str], phase: int | None = None) -> DataFrame:
    """What each session's context held at the last group of a phase (of all, without one), and its tokens; needs phase, group, id and tokens, each group with all that is accumulated."""
    chosen = injections if phase is None else injections.where(F.col("phase") == phase)
    per = chosen.groupBy(*by, "group").agg(F.count("*").alias("n"), F.sum("tokens").cast("long").alias("tokens"))
    last = per.groupBy(*by).agg(F.max_by(F.struct("group", "n", "tokens"), "group").alias("x"))
    return last.select(*by, "x.*")


def project_path(registered: Column, hint: Column, first_cwd: Column, decoded: Column) -> Column:
    """A project's folder: as registered, else the hint if it is absolute, else that of its first session, else its decoded name."""
    whole = F.when(hint.startswith("/") | hint.rlike(r"^[A-Za-z]:[/\\]"), hint)
    return F.coalesce(F.nullif(registered, F.lit("")), whole, F.nullif(first_cwd, F.lit("")), decoded)


def with_subagents(files: DataFrame) -> DataFrame:
    """Sessions that have an agent file with something in it; needs session, agent and size of files."""
    return files.where("agent is not null and size > 0").select("session").distinct()
