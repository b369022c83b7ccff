"""Items of subagents from transcript lines, and notes from files on disk."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_transcripts import entry, write
from tracewell.operators import context_state as S, items as I
from tracewell.sources import jsonl, notes


def call(i, name, **given):
    return {"type": "tool_use", "id": i, "name": name, "input": given}


def result(of, content, bad=False):
    return {"type": "tool_result", "tool_use_id": of, "content": content, "is_error": bad}


@pytest.fixture(scope="module")
def shown(spark, tmp_path_factory):
    f = tmp_path_factory.mktemp("agents")
    usage = {"input_tokens": 10, "output_tokens": 1, "cache_read_input_tokens": 5, "cache_creation_input_tokens": 2}
    mate = '<teammate-message teammate_id="{}" color="red" summary="{}">hi</teammate-message>'
    write(
        f, "p", "agent",
        [
            entry(1, content="  do this  "),
            entry(2, "assistant", [{"type": "thinking", "thinking": "hm"}, call("a", "Bash", command="ls"), {"type": "text", "text": "said"}], usage=usage, model="m"),
            entry(3, content=[result("a", "first"), {"type": "text", "text": "not input: a result is here"}]),
            entry(4, content=[result("a", "again", True)]),
            entry(5, "assistant", "a plain string shows nothing", usage={"input_tokens": 90}, model="<synthetic>"),
            entry(6, content="summary so far", isCompactSummary=True),
            entry(7, "assistant", [call("s", "SendMessage", type="message", recipient="bob", summary="ask bob"), call("b", "SendMessage", type="broadcast"), call("x", "SendMessage", type="shutdown_request", recipient="bob")], usage={"input_tokens": 3}, model="m"),
            entry(8, content=mate.format("bob", "one") + mate.format("eve", "two")),
            entry(9, "assistant", [call("k", "Skill", skill="pdf"), call("t", "Task"), call("u", "Task")]),
            entry(10, content=[{"type": "text", "text": "Base directory for this skill: /x"}], isMeta=True, sourceToolUseID="k"),
            entry(11, content="<command-name>/model</command-name><command-args>big</command-args>"),
            entry(12, content=[{"type": "text", "text": "set to big"}], isMeta=True, parentUuid="u11"),
            entry(13, "assistant", [call("a", "Bash", command="ls -l")]),
        ],
    )
    agents = spark.createDataFrame([("agent", "sub", "t", None)], "session string, id string, parent_task string, at string").select("session", "id", "parent_task", F.to_timestamp(F.lit("2026-01-01T10:09:30Z")).alias("ts"))
    rows = I.subagent_items(jsonl.read_messages(spark, str(f)), agents).orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(len(rows)))
    return rows


def test_kinds_in_order_of_time(shown):
    assert [(r.kind, r.id or r.content) for r in shown] == [
        ("subagent_input", "do this"), ("thinking", "hm"), ("output", "said"), ("compact_boundary", "summary so far"), ("tool", "s"), ("tool", "b"), ("tool", "x"),
        ("teammate_message", "u8-bob-0"), ("teammate_message", "u8-eve-1"), ("tool", "k"), ("tool", "u"), ("subagent", "sub"),
        ("subagent_input", "<command-name>/model</command-name><command-args>big</command-args>"), ("slash", "slash-u11"), ("tool", "a"),
    ]


def test_calls_results_and_skills(shown):
    by = {r.id: r for r in shown if r.kind == "tool"}
    # The last result counts, and of a call that came twice the last; its place in time is that one's.
    assert json.loads(by["a"].content) == {"command": "ls -l"} and by["a"].is_error and not by["a"].is_orphan and "again" in by["a"].result
    assert by["k"].extra == "Base directory for this skill: /x" and by["u"].is_orphan and "t" not in by
    slash = next(r for r in shown if r.kind == "slash")
    assert (slash.name, slash.content, slash.extra, slash.tokens) == ("model", "big", "set to big", 3)


def test_compaction_and_replies(shown):
    c = next(r for r in shown if r.kind == "compact_boundary")
    assert (c.phase, c.before, c.after) == (2, 17, 3)
    mates = {r.name: r for r in shown if r.kind == "teammate_message"}
    # To bob went a message and then one to all, which is the later; a shutdown is none.
    assert (mates["bob"].reply_to, mates["bob"].reply_summary) == ("b", "message") == (mates["eve"].reply_to, mates["eve"].reply_summary)
    assert mates["bob"].extra == "one" and mates["bob"].tokens == 1


def test_the_eight_notes_of_a_project(spark, tmp_path):
    base, root = tmp_path / "base", tmp_path / "work" / "one"
    (root / ".claude" / "rules" / "deep").mkdir(parents=True)
    memory = base / "projects" / str(root).replace("/", "-") / "memory"
    memory.mkdir(parents=True)
    (base / "CLAUDE.md").write_text("x" * 9)
    (root / "CLAUDE.md").write_text("")
    (root / ".claude" / "rules" / "a.md").write_text("12345")
    (root / ".claude" / "rules" / "deep" / "b.md").write_text("678")
    (root / ".claude" / "rules" / "c.txt").write_text("not a rule")
    (memory / "MEMORY.md").write_text("\n".join(["line"] * 300))
    texts = notes.read_texts(spark, str(tmp_path), "*").unionByName(notes.read_texts(spark, str(root / ".claude"), "*")).select("path", "text")
    projects = spark.createDataFrame([("p", str(root)), ("q", "/none")], "project string, root string")
    got = {(r.project, r.source): (r.exists, r.chars, r.tokens) for r in S.global_sources(projects, texts, str(base), "/etc/none.md").collect()}
    assert len(got) == 16
    assert got["p", "user"] == got["q", "user"] == (True, 9, 3)
    # Spark's reader gives no row for an empty file; it would take no tokens either.
    assert got["p", "project"] == got["p", "enterprise"] == (False, 0, 0) == got["q", "project"]
    assert got["p", "project-rules"] == (True, 8, 3)  # 5 + 3 letters and a line end between them
    assert got["p", "auto-memory"] == (True, 999, 250) and got["q", "auto-memory"][0] is False
    asked = S.global_sources(projects, texts, str(base), "/etc/none.md").withColumn("tokens", F.when(F.col("source") != "user-rules", F.col("tokens")))
    entered = {(r.project, r.what.removeprefix(str(tmp_path))): (r.tokens, r.order_no) for r in S.global_notes(asked, ["project"]).collect()}
    ours = {("/base/CLAUDE.md"): (3, -7), ("/base/rules"): (500, -2)}
    assert {k[1]: v for k, v in entered.items() if k[0] == "q"} == ours
    assert {k[1]: v for k, v in entered.items() if k[0] == "p"} == ours | {"/work/one/.claude/rules": (3, -4), str(memory / "MEMORY.md").removeprefix(str(tmp_path)): (250, -1)}
