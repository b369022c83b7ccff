"""Rule lists, notes' heads, paths, folders of lines and enriched results, case by case."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_transcripts import entry, write
from tracewell.functions import paths, text as X
from tracewell.operators import links, listing, rules
from tracewell.operators.rules import BUILT_IN, Rule
from tracewell.sources import jsonl


def test_rules_are_added_changed_and_removed():
    own = [Rule("a", "A", "tool_use", pattern="x"), BUILT_IN[0]]
    assert [r.id for r in rules.add_rule(own, Rule("b", "B", require_error=True))] == ["a", BUILT_IN[0].id, "b"]
    changed = rules.update_rule(own, BUILT_IN[0].id, enabled=True, builtin=False)
    assert changed[1].enabled and changed[1].builtin and not own[1].enabled
    assert rules.update_rule(own, "a", mode="", pattern=None, threshold=5)[0].mode == "token_threshold"
    assert [r.id for r in rules.remove_rule(own, "a")] == [BUILT_IN[0].id]
    for bad in (lambda: rules.add_rule(own, Rule("a", "again", require_error=True)), lambda: rules.add_rule(own, Rule("c", " ", require_error=True)), lambda: rules.update_rule(own, "none"), lambda: rules.remove_rule(own, "none"), lambda: rules.remove_rule(own, BUILT_IN[0].id), lambda: rules.update_rule(own, "a", pattern="((a+)+")):
        with pytest.raises(ValueError):
            bad()


def test_rules_are_checked_inferred_and_merged():
    assert not any(map(rules.rule_errors, BUILT_IN))
    assert rules.rule_errors(Rule("i", "n", "tool_use", tool="Bash", pattern="x")) and not rules.rule_errors(Rule("i", "n", "tool_use", tool="Bash", pattern="x", field="command"))
    assert rules.rule_errors(Rule("i", "n", "token_threshold", threshold=-1)) and rules.rule_errors(Rule("i", "n", "token_threshold", token_kind="x"))
    assert len(rules.rule_errors(Rule("", "", "tool_use", ignore=["(", "ok"]))) == 3 and rules.rule_errors(Rule("i", "n", "other"))
    modes = [rules.infer_mode(Rule("i", "n", "", **k)) for k in ({"require_error": True, "pattern": "x"}, {"pattern": "x", "threshold": 3}, {"field": "x"}, {"threshold": 3}, {})]
    assert modes == ["tool_result", "tool_use", "tool_use", "token_threshold", "tool_result"]
    loaded = [Rule("old", "gone", require_error=True, builtin=True), Rule("mine", "mine", require_error=True), Rule(BUILT_IN[1].id, "renamed", require_error=True, builtin=True)]
    merged = rules.merge_rules(loaded)
    assert [r.id for r in merged] == ["mine", BUILT_IN[1].id, BUILT_IN[0].id, BUILT_IN[2].id] and merged[1].name == "renamed"


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_heads_of_notes(spark):
    text = 'x\n---\n'
    head = "---\r\nname: \"A: b\"\nother: 1\n\ndescription: 'd'\nmetadata:\n  type: user\n\t key : \"v\"\n  type: last\n  none\nmore:\n  type: not this\n---\nbody"
    got = one(spark, listing.frontmatter_parts(F.lit(head)).alias("a"), listing.frontmatter_parts(F.lit(text)).alias("b"), listing.frontmatter_parts(F.lit("---\nmetadata: x\n---")).alias("c"))
    assert (got[0]["name"], got[0]["description"], got[0]["metadata"]) == ("A: b", "d", {"type": "last", "key": "v"})
    assert got[1] is None and got[2]["name"] is None and got[2]["metadata"] == {}


def test_paths(spark):
    lit = F.lit
    assert one(spark, paths.mount_path(lit("/mnt/c/Users/x")), paths.mount_path(lit("/mnt/d")), paths.mount_path(lit("/mnt/data/x")), paths.drive_upper(lit("c:\\x")), paths.drive_upper(lit("/c"))) == ("C:/Users/x", "D:", "/mnt/data/x", "C:\\x", "/c")
    assert one(spark, paths.project_name(lit("-Users-me-my-app")), paths.project_name(lit("-Users-me-my-app"), lit("/Users/me/my-app/")), paths.project_name(lit("x"), lit("C:\\w\\app"))) == ("app", "my-app", "app")
    short = [("/Users/me/code/some/very/very/long/way/to/file.ts", None), ("/Users/me/code/src/a.ts", "/Users/me/code/"), ("/opt/a/b/c/d/e/f/g/h/i/j/k/l/m/n/o/p/q/file", None), ("/opt/aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa/b", None), ("C:\\Users\\me\\one\\two\\three\\four\\five\\six\\seventeen\\x.ts", None)]
    got = [one(spark, paths.shorten_path(lit(p), None if r is None else lit(r)))[0] for p, r in short]
    assert got == ["~/code/…/to/file.ts", "src/a.ts", "/opt/…/q/file", "/opt/aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa/b", "~\\one\\…\\seventeen\\x.ts"]
    mentions = {"/abs": "/abs", "@src/a": "/r/p/src/a", "~/x": "~/x", "@~/x": "~/x", "./a": "/r/p/a", "../a": "/r/a", "../../../a": "/r/a", "..": "/r/p/..", "a/../b": "/r/p/a/../b"}
    assert {m: one(spark, paths.resolve_mention(lit("/r/p"), lit(m)))[0] for m in mentions} == mentions


def test_hashes_over_units(spark):
    def plain(s):
        h, units = 0, s.encode("utf-16-le")
        for i in range(0, len(units), 2):
            h = (h * 31 + units[i] + 256 * units[i + 1]) & 0xFFFFFFFF
        return h - (1 << 32) if h >> 31 else h

    words = ["", "a", "/x/CLAUDE.md", "😀", "é😀日𝄞", "zzzzzzzzzzzzzzzzzzzz"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r.w: (r.h, r.i) for r in df.select("w", X.string_hash(F.col("w")).alias("h"), X.hash_id(F.col("w")).alias("i")).collect()} == {w: (plain(w), f"{abs(plain(w)):x}") for w in words}


def test_folders_and_numbers_of_lines(spark, tmp_path):
    write(tmp_path, "p", "ok", ["", json.dumps({"type": "summary"}), entry(1, cwd=""), entry(2, cwd="c:\\work"), entry(3, cwd="/later"), "{broken"])
    write(tmp_path, "p", "cut", [entry(1), "{broken", entry(2, cwd="/x")])
    write(tmp_path, "p", "none", [entry(1)])
    lines = jsonl.read_lines(spark, str(tmp_path))
    assert {r.file.rsplit("/", 1)[1]: r.cwd for r in jsonl.working_folder(lines).collect()} == {"ok.jsonl": "C:\\work"}
    numbered = jsonl.with_line_numbers(jsonl.parse_messages(lines)).where("session = 'cut'").orderBy("line_no").collect()
    assert [(r.line_no, r.message_no) for r in numbered] == [(0, 1), (2, 2)]


def test_enriched_results_and_skills(spark, tmp_path):
    result = lambda of, text, bad=False: [{"type": "tool_result", "tool_use_id": of, "content": text, "is_error": bad}]
    write(
        tmp_path, "p", "s",
        [
            entry(1, content=result("a", "plain"), sourceToolUseID="a", toolUseResult={"content": "rich", "isError": True}),
            entry(2, content=result("b", "plain b"), toolUseResult={"content": "without a call"}),
            entry(3, content=result("c", "old"), sourceToolUseID="c", toolUseResult={"error": "no"}),
            entry(4, content=result("c", "new")),
            entry(5, content="x", sourceToolUseID="d", toolUseResult="User rejected tool use"),
        ],
    )
    m = jsonl.read_messages(spark, str(tmp_path))
    got = {r.tool_use_id: (r.content, r.is_error) for r in links.result_map(jsonl.tool_results(m), rules.enriched_results(m)).collect()}
    assert got == {"a": ("rich", True), "b": ("plain b", False), "c": ("new", False)}
    linked = spark.createDataFrame([("s", "k", "Skill"), ("s", "r", "Read"), ("s", "q", "Skill")], "session string, id string, name string")
    said = spark.createDataFrame([("s", "k", 1, "first"), ("s", "k", 2, "last"), ("s", "r", 1, "x")], "session string, source_tool_use_id string, pos long, text string")
    assert {r.id: r.skill for r in links.with_skills(linked, said).collect()} == {"k": "last", "r": None, "q": None}


def test_projects_by_recency(spark):
    rows = [("a", "2026-01-01"), ("a", "2026-01-05"), ("b", "2026-01-04"), ("c", None)]
    df = spark.createDataFrame(rows, "project string, modified string").withColumn("modified", F.to_timestamp("modified"))
    assert [(r.project, r.sessions) for r in listing.projects_by_recency(df).collect()] == [("a", 2), ("b", 1), ("c", 1)]
