"""Growing files: whole lines only, once each, and the same alerts as in one go."""

import json

from tests.test_transcripts import entry
from tracewell.operators.rules import Rule
from tracewell.sources import jsonl, tail
from tracewell.streaming import live


def test_tail_gives_whole_lines_once(spark, tmp_path):
    folder, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()
    file = folder / "a.jsonl"

    def run():
        lines = tail.read_tail(spark, str(folder))
        lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.offset, r.line) for r in spark.read.schema("offset long, line string").parquet(out).collect())

    file.write_text("one\ntwo\npart")
    assert run() == [(0, "one"), (4, "two")]
    with file.open("a") as f:
        f.write("ial\n")
    assert run() == [(0, "one"), (4, "two"), (8, "partial")]
    (folder / "b.jsonl").write_text("\nother\n")
    assert run() == [(0, "one"), (1, "other"), (4, "two"), (8, "partial")]


def test_last_line_without_an_end(spark, tmp_path):
    """A whole object without its line end comes once, also when the file grows behind it; half of one waits, and a cut file starts anew."""
    folder, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()
    file = folder / "a.jsonl"

    def run():
        lines = tail.read_tail(spark, str(folder))
        lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.offset, r.line) for r in spark.read.schema("offset long, line string").parquet(out).collect())

    file.write_text('{"a": 1}\n{"b": "x}')
    assert run() == [(0, '{"a": 1}')]
    with file.open("a") as f:
        f.write('"}')
    assert run() == [(0, '{"a": 1}'), (9, '{"b": "x}"}')]
    assert len(run()) == 2
    with file.open("a") as f:
        f.write('\n\n{"c"')
    assert len(run()) == 2
    with file.open("a") as f:
        f.write(': 3}\r\n[1]')
    third = [(0, '{"a": 1}'), (9, '{"b": "x}"}'), (22, '{"c": 3}\r')]
    assert run() == third  # a list without an end isn't a whole object
    file.write_text('{"new": 1}')
    assert run() == sorted([*third, (0, '{"new": 1}')])


def test_is_whole():
    assert tail.is_whole(b' {"a": {"b": 1}} ') and not any(map(tail.is_whole, (b"", b"{", b'{"a": 1}{"b": 2}', b"[1]", b"1", b'"x"', b"{bad}")))


def test_alerts_of_a_stream_are_those_of_the_whole(spark, tmp_path):
    folder, table = tmp_path / "p", str(tmp_path / "table")
    (folder / "proj").mkdir(parents=True)
    rules = [Rule("use", "env", "tool_use", pattern="/.env"), Rule("err", "errors", "tool_result", require_error=True), Rule("text", "text", "tool_result", tool="Bash", pattern="oops")]
    call = lambda n, command: entry(n, "assistant", [{"type": "tool_use", "id": f"t{n}", "name": "Bash", "input": {"command": command}}])
    result = lambda n, of, text, bad: entry(n, content=[{"type": "tool_result", "tool_use_id": f"t{of}", "content": text, "is_error": bad}])
    parts = [[call(1, "cat /.env"), call(2, "ls")], [result(3, 1, "oops", False), result(4, 2, "failed", True)]]
    file = folder / "proj" / "s.jsonl"
    for part in parts:
        with file.open("a") as f:
            f.write("".join(json.dumps(e) + "\n" for e in part))
        live.follow(spark, tail.read_tail(spark, str(folder)), table, rules, str(tmp_path / "check")).awaitTermination()
    got = {(r.rule_id, r.tool_use_id) for r in spark.read.parquet(f"{table}/alerts").collect()}
    from tracewell.operators.rules import rule_table

    whole = {(r.rule_id, r.tool_use_id) for r in live.alerts_of(jsonl.read_messages(spark, str(folder)), rule_table(spark, rules)).collect()}
    assert got == whole == {("use", "t1"), ("err", "t2"), ("text", "t1")}
    assert {r.tool_use_id for r in live.current_alerts(spark, table).collect()} == {"t1", "t2"}


def _run(stream, batch, check):
    stream.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()


def test_calls_and_results_meet_over_three_batches(spark, tmp_path):
    """A call and its result in different batches, in either order, raise one alert; it is that of one go."""
    folder, table = tmp_path / "p", str(tmp_path / "table")
    (folder / "proj").mkdir(parents=True)
    rules = [
        Rule("use", "env", "tool_use", pattern="/.env"),
        Rule("err", "errors", "tool_result", require_error=True),
        Rule("text", "text", "tool_result", tool="Bash", pattern="oops"),
        Rule("size", "size", "token_threshold", threshold=60),
        Rule("out", "out", "token_threshold", token_kind="output", threshold=20),
    ]
    call = lambda n, command: entry(n, "assistant", [{"type": "tool_use", "id": f"t{n}", "name": "Bash", "input": {"command": command}}])
    result = lambda n, of, text, bad=False: entry(n, content=[{"type": "tool_result", "tool_use_id": f"t{of}", "content": text, "is_error": bad}])
    parts = [
        [call(1, "cat /.env"), call(2, "ls"), call(3, "y" * 300), result(4, 9, "oops early")],
        [result(5, 1, "oops"), result(6, 2, "failed", True), result(7, 3, "z" * 200)],
        [call(9, "late"), result(10, 2, "oops " * 40), result(11, 3, "z" * 400), result(12, 77, "oops without a call", True), call(1, "cat /.env")],
    ]
    file, seen = folder / "proj" / "s.jsonl", []
    for part in parts:
        with file.open("a") as f:
            f.write("".join(json.dumps(e) + "\n" for e in part))
        live.follow(spark, tail.read_tail(spark, str(folder)), table, rules, str(tmp_path / "check")).awaitTermination()
        seen.append(spark.read.parquet(f"{table}/alerts").count())
    got = [r.id for r in spark.read.parquet(f"{table}/alerts").collect()]
    from tracewell.operators.rules import rule_table

    whole = {r.id: (r.rule_id, r.tool_use_id) for r in live.alerts_of(jsonl.read_messages(spark, str(folder)), rule_table(spark, rules)).collect()}
    assert set(got) == set(whole) and len(got) == len(set(got)) and seen[0] < seen[1] < seen[2]
    assert ("text", "t9") in whole.values() and ("out", "t2") in whole.values()
    assert not (tmp_path / "table" / "messages").exists()


def test_runs_of_a_growing_session_are_those_of_the_whole(spark, tmp_path):
    folder, table = tmp_path / "p", str(tmp_path / "table")
    (folder / "proj").mkdir(parents=True)
    said = lambda n, kind, text: entry(n, kind, text if kind == "user" else [{"type": "text", "text": text}])
    parts = [
        [said(1, "user", "hello"), said(2, "assistant", "one"), said(3, "assistant", "two")],
        [said(4, "assistant", "three"), said(5, "user", "<local-command-stdout>out</local-command-stdout>"), said(6, "assistant", "four")],
        [said(7, "assistant", "five"), said(8, "user", "more"), said(9, "user", "again"), said(10, "assistant", "six")],
    ]
    for part in parts:
        for name in ("s", "q"):
            with (folder / "proj" / f"{name}.jsonl").open("a") as f:
                f.write("".join(json.dumps(e) + "\n" for e in part))
        live.follow_chunks(tail.read_tail(spark, str(folder)), table, str(tmp_path / "check")).awaitTermination()
    from tracewell.functions import text as X
    from tracewell.operators import classify, sessions
    from tracewell.streaming import state

    versions = spark.read.parquet(f"{table}/chunks").drop("batch")
    columns = ["session", "run", "kind", "n_messages", "tokens", "start_ts", "end_ts", "chunk_id"]
    got = sorted(map(tuple, state.current_chunks(versions).select(*columns).collect()))
    m = jsonl.read_messages(spark, str(folder))
    rows = m.select("session", m["line_no"].alias("pos"), classify.category(m).alias("category"), m["uuid"].alias("id"), X.estimate_tokens(m["text"]).alias("tokens"), "ts")
    rows = rows.na.fill(0, ["tokens"])
    assert got == sorted(map(tuple, sessions.chunks(rows).select(*columns).collect()))
    # A run is written anew only while it is the last one.
    assert versions.count() < 3 * len(got)


def test_live_suppression_is_that_of_the_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from tracewell.operators import rules as R
    from tracewell.streaming import state

    folder, out, check = str(tmp_path / "in"), [], str(tmp_path / "check")
    schema = "id string, project string, message string, ts timestamp, repository string"
    settings = R.Notifications(snoozed_until_ms=3_000, ignored_repositories=["r"], ignored_patterns=["^quiet"], throttle_ms=5_000)
    at = lambda i, message, ms, repository=None, project="p": (f"{i:02d}", project, message, ms, repository)
    parts = [
        [at(0, "m", 1_000), at(1, "m", 3_000), at(2, "m", 7_999), at(3, "quiet x", 4_000), at(4, "n", 4_000, "r")],
        [at(5, "m", 8_000), at(6, "n", 8_100), at(7, "m", 12_000, project="q"), at(8, "m", 12_999)],
        [at(9, "m", 13_000), at(10, "n", 100_000), at(11, "m", 90_000), at(12, "m", 94_999)],
        [at(13, "m", 95_000), at(14, "n", 104_999), at(15, "n", 105_000)],
    ]
    for part in parts:
        df = spark.createDataFrame(part, "id string, project string, message string, ms long, repository string").withColumn("ts", F.timestamp_millis("ms")).drop("ms")
        df.select("id", "project", "message", "ts", "repository").coalesce(1).write.mode("append").json(folder)
        stream = state.live_suppression(spark.readStream.schema(schema).json(folder), settings, "20 seconds")
        stream.writeStream.outputMode("append").foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    rows = [r for p in parts for r in p]
    alerts = spark.createDataFrame([(*r[:3], r[3], r[4]) for r in rows], "id string, project string, message string, ts_ms long, repository string")
    want = {r.id: r.suppressed_by for r in R.suppressed(alerts, settings).collect()}
    assert {r.id: r.suppressed_by for r in out} == want and len(out) == len(rows)
    assert set(want.values()) == {None, "snoozed", "repository", "pattern", "throttled"}
