"""Transcript files end to end, with the odd lines that occur in them."""

import json

import pytest

from tracewell.api import Transcripts
from tracewell.operators import classify, context, links, rules, sessions
from tracewell.sources import jsonl


def entry(n, kind="user", content="hello", **more):
    usage = more.pop("usage", None)
    model = more.pop("model", None)
    message = {"role": kind, "content": content} | ({"usage": usage} if usage else {}) | ({"model": model} if model else {})
    return {"uuid": f"u{n}", "type": kind, "timestamp": f"2026-01-01T10:{n:02d}:00.000Z", "message": message} | more


def write(folder, project, session, entries):
    (folder / project).mkdir(parents=True, exist_ok=True)
    (folder / project / f"{session}.jsonl").write_text("".join((e if isinstance(e, str) else json.dumps(e)) + "\n" for e in entries))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    f = tmp_path_factory.mktemp("projects")
    call = {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "ls [x]", "description": "List"}}
    task = {"type": "tool_use", "id": "t2", "name": "Task", "input": {"description": "Look", "subagent_type": "Explore"}}
    result = {"type": "tool_result", "tool_use_id": "t1", "content": "no such file", "is_error": True}
    usage = {"input_tokens": 100, "output_tokens": 50, "cache_read_input_tokens": 25, "cache_creation_input_tokens": 10}
    write(
        f, "-home-me-one", "s1",
        [
            "", "{not json", json.dumps({"type": "user", "message": {"content": "no uuid"}}), json.dumps({"uuid": "x", "type": "unknown"}),
            entry(1, content="alpha intro alpha", cwd="/home/me/one", gitBranch="main"),
            entry(2, "assistant", [{"type": "text", "text": "older alpha"}], requestId="r1", usage={"input_tokens": 1, "output_tokens": 1}, model="m"),
            entry(3, "assistant", [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "Alpha and ALPHA"}, call, task], requestId="r1", usage=usage, model="m"),
            entry(4, content=[result], isMeta=True, sourceToolUseID="t1"),
            entry(5, content="<system-reminder>x</system-reminder>"),
            entry(6, content="<local-command-stdout>out</local-command-stdout>"),
            entry(7, content="[starts like a list"),
            entry(8, content=[{"type": "text", "text": "[Request interrupted by user]"}]),
            entry(9, content="summary", isCompactSummary=True),
            entry(10, "assistant", "plain string", usage={"input_tokens": 7, "output_tokens": 2}, model="m"),
            entry(11, "assistant", "no", model="<synthetic>"),
            entry(12, content='<teammate-message teammate_id="bob" color="red">hi</teammate-message>'),
            entry(13, "system", ""),
        ],
    )
    write(f, "-home-me-one", "s2", [entry(1, cwd="/home/me/one/sub")])
    write(f, "-home-me-two", "s3", [entry(1), entry(2, cwd="/home/me/two")])
    return f


@pytest.fixture(scope="module")
def t(spark, folder):
    return Transcripts(spark, str(folder))


def test_categories(t):
    got = {r.uuid: r.category for r in t.messages().where("session = 's1'").collect()}
    assert got == {
        "u1": "user", "u2": "ai", "u3": "ai", "u4": "ai", "u5": "hardNoise", "u6": "system", "u7": "user", "u8": "hardNoise", "u9": "compact", "u10": "ai", "u11": "hardNoise", "u12": "ai", "u13": "hardNoise",
    }


def test_content_kinds_and_positions(t):
    got = {r.uuid: (r.content_kind, r.line_no, r.text) for r in t.messages().where("session = 's1'").collect()}
    assert got["u1"] == ("string", 4, "alpha intro alpha") and got["u7"][2] == "[starts like a list" and got["u4"][0] == "array"


def test_metrics(t):
    got = {r.session: r for r in t.metrics().collect()}
    # u3 replaces u2, which has the same request.
    assert (got["s1"].input_tokens, got["s1"].output_tokens, got["s1"].total_tokens, got["s1"].message_count, got["s1"].duration_ms) == (107, 52, 194, 13, 720_000)


def test_chunks(t):
    got = [(r.kind, r.n_messages, r.chunk_id) for r in t.chunks().where("session = 's1'").orderBy("run").collect()]
    assert got == [("user", 1, "user-u1"), ("ai", 3, "ai-u2"), ("system", 1, "system-u6"), ("user", 1, "user-u7"), ("compact", 1, "compact-u9"), ("ai", 2, "ai-u10")]


def test_turns_and_phases(t):
    assert {r.session: r.turns for r in t.turn_counts().collect()} == {"s1": 5, "s2": 1, "s3": 2}
    assert [(r.phase, r.contribution, r.peak, r.post) for r in t.phases().where("session = 's1'").orderBy("phase").collect()] == [(1, 135, 135, 0), (2, 0, 7, 7)]


def test_tools_and_steps(t):
    got = {r.id: r for r in t.tools().collect()}
    assert got["t1"].result_content == "no such file" and got["t1"].result_is_error and not got["t1"].is_orphan
    assert got["t2"].is_orphan and got["t2"].is_task and got["t2"].task_subagent_type == "Explore"
    assert [r.step for r in t.steps().where("session = 's1'").orderBy("line_no", "block_no").collect()] == ["output", "thinking", "output", "tool_call", "tool_call", "tool_result", "interruption", "output", "output"]


def test_search(t):
    got = [(r.kind, r.match_no, r.offset, r.matched) for r in t.search(" Alpha ").orderBy("pos", "match_no").collect()]
    # The older answer's text is not found: the run's last text counts.
    assert got == [("user", 0, 0, "alpha"), ("user", 1, 12, "alpha"), ("ai", 0, 0, "Alpha"), ("ai", 1, 10, "ALPHA")]
    assert t.search("nothing of the kind").count() == 0


def test_projects_and_pages(t):
    got = {r.project_id: (r.name, r.sessions) for r in t.projects().collect()}
    assert got["-home-me-two"] == ("two", 1)
    assert sorted(v for k, v in got.items() if k.startswith("-home-me-one::")) == [("one", 1), ("one (sub)", 1)]
    assert t.sessions(size=2).count() == 3


def test_export_by_parts(t):
    from tracewell.operators import exports

    rows = exports.numbered(t.export_parts().where("session = 's1'"), ["session"]).orderBy("part").collect()
    text = "\n".join(r.text for r in rows)
    assert "Project:  /home/me/one\nBranch:   main\nDate:     2026-01-01 10:01:00 UTC" in text and "Messages:       13" in text
    assert "USER: alpha intro alpha" in text and "THINKING: hm\nASSISTANT: Alpha and ALPHA\nTool: Bash\nInput: {" in text
    assert '  TOOL: Bash\n  Input: {"command":"ls [x]","description":"List"}\n  [ERROR] Result: no such file\n  TOOL: Task\n' in text and "[No result]" in text and "[Context compacted]" in text
    assert text.index("older alpha") < text.index("TOOL: Bash") < text.index("SYSTEM: ") < text.index("ASSISTANT: plain string")


def test_threads_and_subagents(spark, tmp_path):
    write(tmp_path, "p", "s", [entry(1), entry(2, parentUuid="u1"), entry(3, parentUuid="u2"), entry(4, parentUuid="u1"), entry(5, parentUuid="gone")])
    write(tmp_path, "p", "agent-a1", [entry(1, content="do it"), entry(2, "assistant", [{"type": "text", "text": "done"}])])
    own = Transcripts(spark, str(tmp_path))
    tree = own.threads()
    got = {r.node: (r.root, r.depth) for r in tree.where("session = 's'").collect()}
    assert got == {"u1": ("u1", 0), "u2": ("u1", 1), "u3": ("u1", 2), "u4": ("u1", 1), "u5": ("u5", 0)}
    members = links.thread_members(tree, spark.createDataFrame([("s", "u2")], "session string, node string"), ["session"])
    assert {(r.node, r.relation) for r in members.collect()} == {("u1", "ancestor"), ("u2", "self"), ("u3", "descendant")}
    assert [(r.session, r.kind, r.content) for r in own.subagent_items().orderBy("index").collect()] == [("agent-a1", "subagent_input", "do it"), ("agent-a1", "output", "done")]


def test_exports(t):
    text = t.export().where("session = 's1'").first().export
    assert text.startswith("USER: alpha intro alpha\n\nASSISTANT: older alpha") and "[COMPACTED] summary" in text
    assert t.export("markdown").where("session = 's3'").first().export.startswith("# Session\n\n| Messages | Tokens |")


def test_type_counts(t):
    got = classify.type_counts(t.messages().where("session = 's1'")).first()
    assert (got.users, got.assistants, got.systems, got.internal_users) == (8, 4, 1, 1)


def test_long_chain(spark):
    """A thousand rows, each the child of the one before, and a circle that has no top."""
    rows = [("s", i, i - 1) for i in range(1000)] + [("s", 2000, 2001), ("s", 2001, 2000)]
    got = {r.node: (r.root, r.depth) for r in links.threads(spark.createDataFrame(rows, "session string, node long, parent long"), ["session"]).collect()}
    assert got == {i: (0, i) for i in range(1000)}


def test_parallel_groups_are_anchored(spark):
    rows = spark.createDataFrame([("s", 0, "a"), ("s", 80, "b"), ("s", 150, "c"), ("q", 5, "d")], "session string, ts_ms long, id string")
    assert {(r.session, r.anchor_ms, r.members) for r in sessions.parallel_groups(rows).collect()} == {("s", 0, "a,b"), ("s", 150, "c"), ("q", 5, "d")}


def test_phases_like_a_loop(spark):
    """Against the loop over rows, with compactions in a row."""
    import random

    rng = random.Random(1)
    for _ in range(5):
        rows = [("s", i, rng.random() < 0.3, rng.choice([None, 0, rng.randint(1, 500)])) for i in range(40)]
        last, parts = 0, []
        waiting = False
        for _, _, compact, ctx in rows:
            if compact:
                parts.append([last, 0])
                waiting = True
            elif ctx:
                if waiting:
                    parts[-1][1], waiting = ctx, False
                last = ctx
        want = []
        if last:
            want = [pre - (parts[i - 1][1] if i else 0) for i, (pre, _) in enumerate(parts)]
            want.append(last if not parts else last - parts[-1][1] if parts[-1][1] > 0 else 0)
        got = sessions.compaction_phases(spark.createDataFrame(rows, "session string, pos int, compact boolean, ctx long")).orderBy("phase").collect()
        assert [r.contribution for r in got] == want


def test_subagents_by_phases(spark):
    agents = spark.createDataFrame([("s", "a1", 1, None), ("s", "a2", 2, "Build"), ("s", "a3", 3, "Build"), ("s", "a4", 4, None)], "session string, agent_id string, start_ts int, summary string")
    tasks = spark.createDataFrame([("s", "t1", 1, "x", False), ("s", "t2", 2, "Build", True), ("s", "t3", 3, "y", False), ("s", "t4", 4, "z", False)], "session string, task_id string, order int, description string, is_team boolean")
    claims = spark.createDataFrame([("s", "a1", "t9", 1), ("s", "a1", "t3", 2)], "session string, agent_id string, task_id string, pos int")
    got = {r.agent_id: (r.task_id, r.phase) for r in links.subagent_tasks(agents, tasks, claims).collect()}
    assert got == {"a1": ("t3", 1), "a2": ("t2", 2), "a3": ("t1", 3), "a4": ("t4", 3)}


def test_patterns():
    assert rules.is_safe_pattern("/.env") and not rules.is_safe_pattern("(a+)+$") and not rules.is_safe_pattern("(") and not rules.is_safe_pattern("x" * 101)


def test_folder_notes(spark):
    reads = spark.createDataFrame([("s", 1, 1, "/p/a/b/f.py", "/p"), ("s", 1, 2, "/p/a/g.py", "/p"), ("s", 2, 3, "/p/a/g.py", "/p"), ("s", 1, 4, "/q/z.py", "/p")], "session string, phase int, pos int, path string, root string")
    assert {(r.phase, r.pos, r.folder_note) for r in context.folder_notes(reads).collect()} == {(1, 1, "/p/a/CLAUDE.md"), (1, 1, "/p/a/b/CLAUDE.md"), (2, 3, "/p/a/CLAUDE.md")}


def test_subagent_files(spark, tmp_path):
    write(tmp_path, "p/s1/subagents", "agent-a", [entry(1)])
    write(tmp_path, "p", "agent-b", [entry(1, sessionId="s2")])
    got = {(r.project, r.session, r.agent_id) for r in jsonl.subagent_files(spark, str(tmp_path)).collect()}
    assert got == {("p", "s1", "a"), ("p", "s2", "b")}


def test_safe_patterns():
    safe = ["hello", "error", "[a-z]+", r"foo\.bar", r"\d+\.\d+", "^test$", "a" * 100, "a+", "a*b+", r"\d{1,3}", "(abc)", "[a-z]", "((a)(b))", r"\(abc\)", r"\[test\]", "[(]", r"[\]]", "/.env"]
    unsafe = ["", "a" * 101, "(a+)+", "(a*)+", "(a+)*", "(a|a)+", r"(.)\1+", "(abc", "[abc", "*invalid", "a{2,1}", "(a|a)+$", "(x{1,}){2}+", r"(\w)\1+", "a{2}+", "a)(", "([)]", "[aaaaaaaaaaaaaaaaaaaa]+"]
    assert [p for p in safe if not rules.is_safe_pattern(p)] == []
    assert [p for p in unsafe if rules.is_safe_pattern(p)] == []


def test_rules_without_any_match(spark):
    rows = spark.createDataFrame([("p", 1, 0, "Bash", "x")], "project string, message long, pos int, tool string, input string")
    none = rules.rule_table(spark, [])
    some = rules.rule_table(spark, [rules.Rule("a", "a", "tool_use", pattern="y"), rules.Rule("b", "b", "tool_use", repositories=["r"])])
    assert rules.match_uses(rows, none).count() == rules.match_uses(rows, some).count() == 0
    assert rules.match_uses(rows, none).columns == rules.match_uses(rows, some).columns


def test_tool_lines(spark):
    from tracewell.functions import text as X

    cases = {
        ("Edit", "{}"): "Edit", ("Write", '{"file_path":"/a/b.txt","content":"1\\n2"}'): "b.txt - 2 lines", ("Read", '{"file_path":"c.py"}'): "c.py", ("Bash", '{"command":"' + "x" * 60 + '"}'): "x" * 50 + "...",
        ("Grep", '{"pattern":"p","glob":"*.py","path":"/z"}'): '"p" in *.py', ("Glob", '{"pattern":"q","path":"/z/y"}'): '"q" in y', ("Task", '{"subagentType":"Explore","prompt":"go"}'): "Explore - go",
        ("LSP", '{"operation":"hover","filePath":"/k/l.rs"}'): "hover - l.rs", ("WebFetch", '{"url":"https://a.org/b?c=1"}'): "a.org/b", ("TeamCreate", '{"team_name":"t"}'): "t", ("TaskCreate", "{}"): "Create task",
        ("TaskGet", '{"taskId":"4"}'): "Get task #4", ("SendMessage", '{"type":"shutdown_request","recipient":"al"}'): "Shutdown al", ("SendMessage", '{"type":"broadcast","summary":"s"}'): "Broadcast: s",
        ("TeamDelete", "{}"): "Delete team", ("Other", '{"zzz":"first","y":"no"}'): "first", ("Other", '{"query":"q"}'): "q", ("Other", "{}"): "Other", ("TaskUpdate", "{}"): "Update task",
    }
    rows = spark.createDataFrame(list(cases), "name string, input string")
    got = {(r.name, r.input): r.line for r in rows.withColumn("line", X.tool_line(rows.name, rows.input)).collect()}
    assert got == cases
