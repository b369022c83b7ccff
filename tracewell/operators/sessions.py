"""Sums, runs and phases of a session.

Rows are messages with a session and a position (pos) in it; each window is
partitioned by the session, and each function says which other columns it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tracewell.operators.ordered import with_anchor


def _order(*by: str, pos: str = "pos"):
    return Window.partitionBy(*by).orderBy(pos)


def dedup_last(rows: DataFrame, by: tuple[str, ...] = ("session",), request: str = "request_id", pos: str = "pos") -> DataFrame:
    """Of rows with one request the last; rows without a request all stay."""
    last = F.row_number().over(Window.partitionBy(*by, request).orderBy(F.desc(pos)))
    return rows.withColumn("_rank", last).where((F.col("_rank") == 1) | F.col(request).isNull() | (F.col(request) == "")).drop("_rank")


def session_metrics(rows: DataFrame, by: tuple[str, ...] = ("session",), request: str = "request_id", pos: str = "pos") -> DataFrame:
    """duration_ms and message_count over all rows, token sums over the last row of each request; needs ts and input, output, cache_read, cache_creation.

    One aggregation by request first, so a session of any length is summed in parts.
    """
    no_request = F.col(request).isNull() | (F.col(request) == "")
    key = F.when(no_request, F.concat(F.lit("row:"), F.col(pos).cast("string"))).otherwise(F.concat(F.lit("request:"), F.col(request)))
    tokens = ["input", "output", "cache_read", "cache_creation"]
    last = rows.withColumn("_key", key).groupBy(*by, "_key").agg(
        F.max_by(F.struct(*[F.coalesce(t, F.lit(0)).alias(t) for t in tokens]), pos).alias("u"), F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )
    out = last.groupBy(*by).agg(
        (F.unix_millis(F.max("last").cast("timestamp")) - F.unix_millis(F.min("first").cast("timestamp"))).alias("duration_ms"),
        F.sum("n").alias("message_count"), *[F.sum(f"u.{t}").cast("long").alias(f"{t}_tokens") for t in tokens],
    )
    return out.withColumn("total_tokens", F.expr(" + ".join(f"{t}_tokens" for t in tokens)))


def mark_runs(rows: DataFrame, category: str = "category", by: tuple[str, ...] = ("session",), pos: str = "pos") -> DataFrame:
    """Rows without noise, with run: each user, system or compact row is a run of its own, and ai rows between them are one; noise doesn't break a run."""
    kept = rows.where(F.col(category) != "hardNoise")
    before = F.lag(category).over(_order(*by, pos=pos))
    starts = F.when((F.col(category) != "ai") | before.isNull() | (before != "ai"), 1).otherwise(0)
    return kept.withColumn("_starts", starts).withColumn("run", F.sum("_starts").over(_order(*by, pos=pos))).drop("_starts")


def kind_runs(rows: DataFrame, kind: str, by: tuple[str, ...] = ("session",), pos: str = "pos") -> DataFrame:
    """rows with run: one more wherever the kind differs from the row before."""
    w = _order(*by, pos=pos)
    starts = F.when(F.lag(kind).over(w).eqNullSafe(F.col(kind)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("_starts", starts).withColumn("run", F.sum("_starts").over(w)).drop("_starts")


def chunks(rows: DataFrame, by: tuple[str, ...] = ("session",), pos: str = "pos") -> DataFrame:
    """A row for each run: kind, first and last position, rows, tokens, and for ts the first row's start and the latest end; needs tokens, id and ts."""
    runs = mark_runs(rows, by=by, pos=pos)
    has_ts = "ts" in rows.columns
    times = [F.min_by("ts", pos).alias("start_ts"), F.max("ts").alias("end_ts")] if has_ts else []
    out = runs.groupBy(*by, "run").agg(F.first("category").alias("kind"), F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos"), F.count("*").alias("n_messages"), F.sum("tokens").alias("tokens"), F.min_by("id", pos).alias("_id"), *times)
    return out.withColumn("chunk_id", F.concat_ws("-", "kind", "_id")).drop("_id")


def turn_count(rows: DataFrame, by: tuple[str, ...] = ("session",), pos: str = "pos") -> DataFrame:
    """User rows, plus one for the first assistant row after each; needs is_user and is_assistant."""
    island = rows.withColumn("island", F.sum(F.col("is_user").cast("int")).over(_order(*by, pos=pos)))
    per = island.groupBy(*by, "island").agg(F.max(F.col("is_assistant").cast("int")).alias("answered"), F.count_if("is_user").alias("users"))
    return per.groupBy(*by).agg((F.sum("users") + F.sum(F.when(F.col("island") > 0, F.col("answered")).otherwise(0))).cast("long").alias("turns"))


def first_user_message(rows: DataFrame, by: tuple[str, ...] = ("session",), pos: str = "pos") -> DataFrame:
    """The first shown text, else the first command; needs shown and command, null where a row is none."""
    return rows.groupBy(*by).agg(F.coalesce(F.min_by("shown", F.when(F.col("shown").isNotNull(), F.col(pos))), F.min_by("command", F.when(F.col("command").isNotNull(), F.col(pos)))).substr(1, 500).alias("first_message"))


def compaction_phases(rows: DataFrame, by: tuple[str, ...] = ("session",), pos: str = "pos", guard: bool = True) -> DataFrame:
    """(.., phase, contribution, peak, post): token use of a context between compactions; needs ctx (null or 0: no reading) and compact.

    Island i holds the rows after compaction i. A compaction's pre is the last
    reading before it, its post the first reading in its island, else 0. A phase
    contributes its pre less the post before; the last one, from the last reading,
    only if that post is above 0 (guard). Sessions without any reading give no row.
    """
    ctx = F.when(F.col("ctx") > 0, F.col("ctx"))
    island = rows.withColumn("_c", F.when(F.col("compact"), None).otherwise(ctx).cast("long")).withColumn("island", F.coalesce(F.sum(F.col("compact").cast("int")).over(_order(*by, pos=pos)), F.lit(0)))
    per = island.groupBy(*by, "island").agg(F.min_by("_c", F.when(F.col("_c").isNotNull(), F.col(pos))).alias("first_ctx"), F.max_by("_c", F.when(F.col("_c").isNotNull(), F.col(pos))).alias("last_ctx"))
    # A session that begins with a compaction has an empty first island.
    own = F.struct("island", "first_ctx", "last_ctx")
    none = F.struct(F.lit(0).cast("long").alias("island"), F.lit(None).cast("long").alias("first_ctx"), F.lit(None).cast("long").alias("last_ctx"))
    per = per.withColumn("_least", F.min("island").over(Window.partitionBy(*by))).select(*by, F.explode(F.when((F.col("island") == 1) & (F.col("_least") == 1), F.array(none, own)).otherwise(F.array(own))).alias("_i")).select(*by, "_i.*")
    w = Window.partitionBy(*by).orderBy("island")
    so_far = F.last("last_ctx", True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    per = per.withColumn("peak", F.coalesce(so_far, F.lit(0))).withColumn("_last", F.row_number().over(w.orderBy(F.desc("island"))) == 1).withColumn("_any", F.max("last_ctx").over(Window.partitionBy(*by)))
    start = F.when(F.col("island") == 0, F.lit(0)).otherwise(F.coalesce("first_ctx", F.lit(0)))
    per = per.withColumn("_start", start).where("_any is not null")
    part = F.col("peak") - F.col("_start")
    final = F.when((F.col("island") == 0) | (F.col("_start") > 0) | F.lit(not guard), part).otherwise(F.lit(0))
    return per.select(*by, (F.col("island") + 1).alias("phase"), F.when(F.col("_last"), final).otherwise(part).alias("contribution"), "peak", F.col("_start").alias("post"))


def context_consumption(rows: DataFrame, by: tuple[str, ...] = ("session",), pos: str = "pos") -> DataFrame:
    return compaction_phases(rows, by, pos).groupBy(*by).agg(F.sum("contribution").alias("consumption"), (F.count("*") - 1).alias("compactions"))


def ongoing(rows: DataFrame, by: tuple[str, ...] = ("session",), pos: str = "pos") -> DataFrame:
    """Whether activity follows the last ending, or there is any and no ending; needs is_activity and is_ending."""
    last = lambda c: F.max(F.when(F.col(c), F.col(pos)))
    return rows.groupBy(*by).agg(F.coalesce(last("is_activity") > last("is_ending"), last("is_activity").isNotNull() & last("is_ending").isNull(), F.lit(False)).alias("is_ongoing"))


def gap_filled(rows: DataFrame, by: tuple[str, ...] = ("session",), pos: str = "pos", least_ms: int = 100) -> DataFrame:
    """Steps with effective_end_ms: the first later step least_ms after or more, else the end of all; needs ts_ms.

    Where rows have is_subagent and duration_ms, a subagent longer than least_ms keeps its
    own end. The next start comes from a running value over starts and, least_ms after
    each of them, marks, in falling order; a frame up to the end of the session would be
    gone through anew for each row.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    both = rows.select(*by, row.alias("_row"), F.explode(F.array(F.struct(F.col("ts_ms").alias("t"), F.lit(0).alias("mark")), F.struct((F.col("ts_ms") + least_ms).alias("t"), F.lit(1).alias("mark")))).alias("_e"))
    start = F.when(F.col("_e.mark") == 0, F.col("_e.t"))
    falling = Window.partitionBy(*by).orderBy(F.desc("_e.t"), "_e.mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = both.withColumn("_next", F.last(start, True).over(falling)).withColumn("_last", F.max(start).over(Window.partitionBy(*by)))
    marks = placed.where("_e.mark = 1").select("_row.*", "_next", "_last")
    end = F.coalesce("_next", "_last")
    if "is_subagent" in rows.columns:
        end = F.when(F.col("is_subagent") & (F.col("duration_ms") > least_ms), F.col("ts_ms") + F.col("duration_ms")).otherwise(end)
    return marks.withColumn("effective_end_ms", end).select(*rows.columns, "effective_end_ms")


def context_deltas(rows: DataFrame, by: tuple[str, ...] = ("session",), pos: str = "pos") -> DataFrame:
    """For each compaction: the next total less the last one before it, and its phase; needs total (null: no reading) and compact."""
    w, back = Window.partitionBy(*by).orderBy(pos), Window.partitionBy(*by).orderBy(F.desc(pos))
    latest = lambda order: F.last("total", True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    phase = F.sum(F.col("compact").cast("int")).over(w) + 1
    return rows.withColumn("phase", phase).withColumn("before", latest(w)).withColumn("after", latest(back)).where("compact").select(*by, pos, "phase", "before", "after", (F.col("after") - F.col("before")).alias("delta"))


def parallel_groups(rows: DataFrame, by: tuple[str, ...] = ("session",), window_ms: int = 100) -> DataFrame:
    """(.., anchor_ms, members, n) of starts at most window_ms after the first of their group; needs ts_ms and id.

    A group's end depends on its first member and not on neighbours, so the anchors come
    from a pass over the sorted distinct starts of a session (ordered.anchored). Only the
    members of one group, which lie in one window, are gathered. Starts without a time
    belong to no group.
    """
    placed = with_anchor(rows.where("ts_ms is not null"), list(by), "ts_ms", window_ms + 1)
    members = F.array_sort(F.collect_list(F.struct(F.col("ts_ms").cast("long").alias("ts_ms"), F.col("id").cast("string").alias("id"))))
    groups = placed.groupBy(*by, F.col("anchor").alias("anchor_ms")).agg(members.alias("_m"))
    return groups.select(*by, "anchor_ms", F.array_join(F.transform("_m", lambda m: m["id"]), ",").alias("members"), F.size("_m").alias("n"))


def mark_parallel(rows: DataFrame, by: tuple[str, ...] = ("session",), window_ms: int = 100) -> DataFrame:
    """rows with is_parallel: whether another start of the session lies in the same group; one without a time is alone."""
    placed = with_anchor(rows, list(by), "ts_ms", window_ms + 1).alias("r")
    sizes = placed.where("anchor is not null").groupBy(*by, "anchor").agg(F.count("*").alias("_n")).alias("s")
    same = F.col("r.anchor") == F.col("s.anchor")
    for c in by:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}"))
    return placed.join(sizes, same, "left").select(*[F.col(f"r.{c}") for c in rows.columns], F.coalesce(F.col("_n") > 1, F.lit(False)).alias("is_parallel"))
