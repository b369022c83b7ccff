"""Exports by parts against a plain writer, files in order, and names of working copies."""

import glob

from pyspark.sql import functions as F

from tests.test_transcripts import entry, write
from tracewell.functions import worktrees as W
from tracewell.operators import exports
from tracewell.sources import jsonl

HEAD = "sid string, project string, branch string, created timestamp, duration_ms long, total_tokens long, input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long, message_count long"


def tables(spark, tmp_path):
    blocks = [{"type": "text", "text": "one"}, {"type": "thinking", "thinking": "a\nb"}, {"type": "tool_use", "id": "t", "name": "Bash", "input": {"command": "ls", "n": 1}}, {"type": "image", "source": {}}]
    write(
        tmp_path, "p", "s",
        [
            entry(1, content="hi"),
            entry(2, "assistant", blocks),
            entry(3, content=[{"type": "tool_result", "tool_use_id": "t", "content": [{"type": "text", "text": "x"}, {"type": "text", "text": "y"}]}]),
            entry(4, "assistant", [{"type": "text", "text": ""}]),
            entry(5, "assistant", "plain"),
            entry(6, content="done", isCompactSummary=True),
            entry(7, content="out"),
        ],
    )
    m = jsonl.read_messages(spark, str(tmp_path))
    kinds = {0: "user", 1: "ai", 5: "compact", 6: "system"}
    chunks = spark.createDataFrame([("s", k, v, {0: "hi", 6: "out"}.get(k)) for k, v in kinds.items()], "sid string, pos long, kind string, text string")
    replies = m.where("line_no between 1 and 4").select(F.col("session").alias("sid"), F.lit(1).cast("long").alias("pos"), "line_no", "content_kind", "text", "blocks")
    tools = spark.createDataFrame([("s", 1, 0, "Bash", '{"command":"ls","n":1}', False, True, "r" * 600), ("s", 1, 1, "Read", None, True, False, None)], "sid string, pos long, tool_no int, name string, input string, is_orphan boolean, is_error boolean, result string")
    created = F.to_timestamp(F.lit("2026-01-01T10:00:05.250Z"))
    sessions = spark.createDataFrame([("s", "/p/one", "", None, 65_900, 1234567, 1, 2, 3, 4, 7)], HEAD).withColumn("created", created)
    return sessions, chunks, replies, tools


def test_plain_text(spark, tmp_path):
    parts = exports.export_parts(*tables(spark, tmp_path), ["sid"])
    rows = exports.numbered(parts, ["sid"]).orderBy("part").collect()
    assert [r.part for r in rows] == list(range(len(rows)))
    double, single = "═" * 60, "─" * 40
    head = [double, "SESSION EXPORT", double, "Session:  s", "Project:  /p/one", "Date:     2026-01-01 10:00:05 UTC", "", single, "METRICS", single, "Duration:       1m 5s", "Total Tokens:   1,234,567", "Input Tokens:   1", "Output Tokens:  2", "Cache Read:     3", "Cache Created:  4", "Messages:       7", "Cost:           N/A", "", double, "CONVERSATION", double, ""]
    body = [
        single, "USER: hi", "", single, "THINKING: a", "b", "ASSISTANT: one", "Tool: Bash", "Input: {", '  "command": "ls",', '  "n": 1', "}", "[Image]", "ASSISTANT: x", "y", "ASSISTANT: plain",
        "  TOOL: Bash", '  Input: {"command":"ls","n":1}', "  [ERROR] Result: " + "r" * 500 + "...", "  TOOL: Read", "  Input: {}", "  [No result]", "", single, "[Context compacted]", "", single, "SYSTEM: out", "",
    ]
    assert "\n".join(r.text for r in rows).split("\n") == head + body


def test_markdown_in_files_in_order(spark, tmp_path):
    out = str(tmp_path / "out")
    parts = exports.export_parts(*tables(spark, tmp_path / "in"), ["sid"], "markdown")
    more = spark.range(200).select(F.lit("long").alias("sid"), F.struct(*[F.lit(1).cast("long").alias("p0"), F.col("id").alias("p1"), *[F.lit(0).cast("long").alias(f"p{i}") for i in (2, 3, 4)]]).alias("place"), F.concat(F.lit("part "), "id").alias("text"))
    exports.write_parts(parts.unionByName(more), out, ["sid"])
    read = lambda s: "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{out}/sid={s}/*.txt")))
    assert read("long") == "".join(f"part {i}\n" for i in range(200))
    text = read("s")
    assert text == "\n".join(r.text for r in exports.numbered(parts, ["sid"]).orderBy("part").collect()) + "\n"
    assert "### User (Turn 1)\n\nhi\n\n### Assistant (Turn 2)\n\n> *Thinking:*\n> a\n> b\n\none\nTool: Bash\n" in text
    assert "**Tool:** `Bash`\n\n```json\n{\n" in text and "```\n\n**Error:**\n\n```\n" + "r" * 600 + "\n```\n\n**Tool:** `Read`" in text
    assert "---\n\n*Context compacted*\n\n### System (Turn 4)\n\nout\n" in text and "| Branch |" not in text


def test_worktree_names(spark):
    cases = [  # path, repository, tool, is a copy, label without a branch
        ("/u/.cursor/worktrees/app/x1", "app", "git", True, "x1"),
        ("/u/.cursor/worktrees", "worktrees", "git", True, "worktrees"),
        ("/tmp/vibe-kanban/worktrees/92a6-x/app", "app", "vibe-kanban", True, "92a6-x"),
        ("/u/conductor/workspaces/app/san-francisco", "app", "conductor", True, "san-francisco"),
        ("/u/conductor/workspaces/app", "app", "conductor", False, "app"),
        ("/u/app/.auto-claude/worktrees/tasks/002-h", "app", "auto-claude", True, "002-h"),
        ("/.auto-claude/worktrees/x", "x", "auto-claude", True, "x"),
        ("/u/app/.21st/worktrees/id/ab 3b [colonial-fish]", "app", "21st", True, "colonial-fish"),
        ("/u/app/.21st/worktrees/id/none []", "app", "21st", True, "none []"),
        ("/u/.claude-worktrees/app/keen", "app", "claude-desktop", True, "keen"),
        ("/u/.claude-worktrees/app", "app", "claude-desktop", True, "app"),
        ("/worktrees/u/.ccswitch/worktrees/app/just", "app", "ccswitch", True, "just"),
        ("/u/code/app/", "app", "git", False, "app"),
        ("/", None, "git", False, "unknown"),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "path string").withColumn("b", F.lit(None).cast("string"))
    p = F.col("path")
    got = df.select("path", W.repository_name(p), W.worktree_tool(p), W.is_worktree_path(p), W.worktree_label(p, F.col("b"), F.lit(False))).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, cases))
    main = df.limit(1).select(W.worktree_label(F.lit("/u/app"), F.col("b"), F.lit(True)), W.worktree_label(F.lit("/u/app"), F.lit("dev"), F.lit(True)), W.worktree_label(F.lit("/u/app"), F.lit("dev"), F.lit(False), F.lit("own")))
    assert tuple(main.first()) == ("main", "dev", "own")
