"""Keyed state for live transcripts: open calls, the tail of a session, and what was shown last."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewell.operators import rules as R

#: Calls and results on their way through LinkProcessor.
BLOCKS = (
    "session string, tool_use_id string, kind string, project string, message string, line_no long, block_no int, tool string, ts_us long, from_subagent boolean, "
    "content string, is_error boolean, tokens long"
)
#: What comes out: a row of BLOCKS, its call's sizes, and what was known of it before.
LINKED = BLOCKS + ", output_tokens long, tool_before string, output_before long, is_new boolean"
_FIELDS = [f.split()[0] for f in BLOCKS.split(", ")]


def use_state_store(spark: SparkSession) -> None:
    """Keyed state of this kind needs the RocksDB store; it is chosen if nobody chose another."""
    key, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    if "RocksDB" not in spark.conf.get(key, ""):
        spark.conf.set(key, provider)


class LinkProcessor(StatefulProcessor):
    """Links results to their calls by (session, tool_use_id), whichever comes first and however many batches later.

    A call comes out as it is seen, and again as kind size whenever a result makes its
    output larger; a result comes out at once, and once more when its call, which
    came later, gives it a tool. State is a call's own columns, the largest output, and
    results that still wait for a call; it expires ttl_ms after its last change.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.call = handle.getValueState("call", BLOCKS, self.ttl_ms)
        self.output = handle.getValueState("output", "tokens long", self.ttl_ms)
        self.waiting = handle.getListState("waiting", BLOCKS, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        call = Row(*_FIELDS)(*self.call.get()) if self.call.exists() else None
        output = self.output.get()[0] if self.output.exists() else 0
        was = output
        for row in sorted(rows, key=lambda r: (r["line_no"], r["block_no"], r["kind"])):
            own = [row[f] for f in _FIELDS]
            if row["kind"] == "call":
                if call is not None:
                    continue  # a line that was written twice
                call = Row(*_FIELDS)(*own)
                self.call.update(tuple(own[: _FIELDS.index("content")] + [None] + own[_FIELDS.index("content") + 1 :]))
                yield self._out(own, "call", call, output, 0, True)
                for early in self.waiting.get() if self.waiting.exists() else ():
                    yield self._out(list(early), "result", call, output, output, False)
                self.waiting.clear()
                if output:
                    yield self._out(own, "size", call, output, 0, False)
            else:
                if call is None:
                    self.waiting.appendValue(tuple(own))
                yield self._out(own, "result", call, output, output, True)
                if row["tokens"] > output:
                    if call is not None:
                        yield self._out([call[f] for f in _FIELDS], "size", call, row["tokens"], output, False)
                    output = row["tokens"]
        if output != was:
            self.output.update((output,))

    @staticmethod
    def _out(own: list, kind: str, call, output: int, before: int, is_new: bool) -> Row:
        values = dict(zip(_FIELDS, own, strict=True)) | {"kind": kind, "tool": None if call is None else call["tool"]}
        return Row(**values, output_tokens=output, tool_before=None, output_before=before, is_new=is_new)

    def close(self) -> None:
        pass


def link(blocks: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A stream of BLOCKS as a stream of LINKED, with ts as a timestamp. State holds times as microseconds, which no time zone changes."""
    use_state_store(blocks.sparkSession)
    mode = "None" if ttl_ms is None else "ProcessingTime"
    linked = blocks.groupBy("session", "tool_use_id").transformWithState(LinkProcessor(ttl_ms), LINKED, "Append", mode)
    return linked.withColumn("ts", F.timestamp_micros("ts_us")).drop("ts_us")


CHUNKS = "session string, run long, kind string, first_pos long, last_pos long, n_messages long, tokens long, start_us long, end_us long, chunk_id string"


class ChunkProcessor(StatefulProcessor):
    """The runs of a session (sessions.chunks) as its rows come: only the last run can still change, so it is all that is kept."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getValueState("tail", CHUNKS)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        names = [f.split()[0] for f in CHUNKS.split(", ")]
        tail = dict(zip(names, self.tail.get(), strict=True)) if self.tail.exists() else None
        changed = False
        for row in sorted(rows, key=lambda r: r["pos"]):
            kind = row["category"]
            if kind is None or kind == "hardNoise" or (tail and row["pos"] <= tail["last_pos"]):
                continue  # noise doesn't break a run; a row that is read again is known
            tokens, ts = row["tokens"], row["ts_us"]
            if tail and kind == "ai" and tail["kind"] == "ai":
                tail["last_pos"], tail["n_messages"] = row["pos"], tail["n_messages"] + 1
                tail["tokens"] = tail["tokens"] if tokens is None else (tail["tokens"] or 0) + tokens
                tail["end_us"] = max((t for t in (tail["end_us"], ts) if t is not None), default=None)
            else:
                if tail and changed:
                    yield Row(**tail)
                run = tail["run"] + 1 if tail else 1
                tail = dict(zip(names, (key[0], run, kind, row["pos"], row["pos"], 1, tokens, ts, ts, f"{kind}-{row['id']}"), strict=True))
            changed = True
        if changed:
            self.tail.update(tuple(tail[n] for n in names))
            yield Row(**tail)

    def close(self) -> None:
        pass


def live_chunks(rows: DataFrame) -> DataFrame:
    """A stream of rows (session, pos, category, id, tokens, ts) as a stream of their runs: each batch gives the runs that it made or changed."""
    use_state_store(rows.sparkSession)
    own = rows.select("session", F.col("pos").cast("long").alias("pos"), "category", F.col("id").cast("string").alias("id"), F.col("tokens").cast("long").alias("tokens"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))
    runs = own.groupBy("session").transformWithState(ChunkProcessor(), CHUNKS, "Update", "None")
    return runs.withColumn("start_ts", F.timestamp_micros("start_us")).withColumn("end_ts", F.timestamp_micros("end_us")).drop("start_us", "end_us")


def current_chunks(versions: DataFrame) -> DataFrame:
    """Of all versions of a run the one that reaches furthest."""
    rest = [c for c in versions.columns if c not in ("session", "run")]
    return versions.groupBy("session", "run").agg(F.max_by(F.struct(*rest), "last_pos").alias("r")).select("session", "run", "r.*")


class ToastProcessor(StatefulProcessor):
    """Marks what is shown of a (project, message): nothing within throttle_ms of the last one shown.

    The only state is that time. An event-time timer drops it once the watermark has
    passed its reach, so keys that fell silent cost nothing.
    """

    def __init__(self, throttle_ms: int):
        self.throttle_ms = throttle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts_ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = self.last.get()[0] if self.last.exists() else None
        was = last
        for row in sorted(rows, key=lambda r: (r["ts_ms"], r["id"])):
            reason = row["held"]
            if reason is None:
                if last is not None and row["ts_ms"] - last < self.throttle_ms:
                    reason = "throttled"
                else:
                    last = row["ts_ms"]
            yield Row(id=row["id"], project=key[0], message=key[1], ts_ms=row["ts_ms"], suppressed_by=reason)
        if last != was:
            if was is not None:
                self.handle.deleteTimer(was + self.throttle_ms)
            self.last.update((last,))
            self.handle.registerTimer(last + self.throttle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def live_suppression(alerts: DataFrame, settings: R.Notifications, delay: str = "10 seconds") -> DataFrame:
    """rules.suppressed over a stream of alerts (id string, project, message, ts, ..): (id, project, message, ts_ms, suppressed_by).

    Alerts may come up to delay late; within one batch they are taken by time. The
    result is that of the batch function if batches come in the order of time.
    """
    use_state_store(alerts.sparkSession)
    timed = alerts.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("ts_ms", F.unix_millis("ts")).withWatermark("ts", delay)
    own = timed.select(F.col("id").cast("string").alias("id"), "project", F.col("message").cast("string").alias("message"), "ts", "ts_ms", R.silence(timed, settings).alias("held"))
    out = "id string, project string, message string, ts_ms long, suppressed_by string"
    return own.groupBy("project", "message").transformWithState(ToastProcessor(settings.throttle_ms), out, "Append", "EventTime")
