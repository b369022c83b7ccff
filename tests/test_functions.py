"""Scalar functions on values whose results are known."""

import pytest
from pyspark.sql import functions as F

from tracewell.functions import diff, formats, guards, markdown, paths, pretty, register
from tracewell.functions import text as X
from tracewell.sources.tail import route


def values(spark, f, *inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_formats(spark):
    n = lambda f: lambda c: f(c.cast("long"))
    assert values(spark, n(formats.format_tokens), "0", "999", "1000", "9950", "9999", "10499", "10500") == ["0", "999", "1.0k", "10.0k", "10.0k", "10k", "11k"]
    assert values(spark, n(formats.format_tokens_compact), "999", "1500", "1000000") == ["999", "1.5k", "1.0M"]
    assert values(spark, n(formats.format_duration), "999", "1500", "59999", "61000") == ["999ms", "1.5s", "60.0s", "1m 1s"]
    assert values(spark, n(formats.format_duration_whole), "999", "59999", "61000") == ["999ms", "59s", "1m 1s"]


def test_models(spark):
    got = values(spark, lambda c: formats.parse_model(c)["name"], "claude-sonnet-4-5-20250929", "claude-3-5-sonnet-20241022", "claude-3-opus-20240229", "claude-opus-4-20250514", "gpt-4", "claude", None, "claude-nova-2-1")
    assert got == ["sonnet4.5", "sonnet3.5", "opus3", "opus4", None, None, None, "nova2.1"]


def test_sanitize(spark):
    got = values(
        spark, X.sanitize, "<local-command-stdout> out </local-command-stdout>", "<command-name>/model</command-name><command-args> x y </command-args>", " a<system-reminder>b\nc</system-reminder> d ",
        "done <task-notification><task-id>1</task-id></task-notification> Read the output file to retrieve the result: /tmp/x", "<command-name>none</command-name>rest", "<local-command-stdout></local-command-stdout>",
    )
    assert got == ["out", "/model x y", "a d", "done", "rest", "<local-command-stdout></local-command-stdout>"]


def test_paths(spark):
    assert values(spark, paths.encode_path, "/a/b-c", "C:\\x\\y") == ["-a-b-c", "-C:-x-y"]
    assert values(spark, paths.decode_path, "-a-b-c", "-C:-x-y", "C--x-y") == ["/a/b/c", "C:/x/y", "C:/x/y"]
    assert values(spark, paths.ancestors, "/a/b/c.txt", "c.txt") == [["/a", "/a/b"], []]
    assert values(spark, lambda c: paths.join_path(F.lit("/a/b"), c), "../c", "./d/../e", "/x", "../../../y") == ["/a/c", "/a/b/e", "/x", "/y"]
    assert values(spark, route, "/p/s.jsonl", "/p/s/subagents/agent-1.jsonl", "/p/memory/a.md", "/todos/s.json", "/x.txt") == ["session", "subagent", "memory", "todo", "other"]


def test_guards(spark):
    assert values(spark, guards.is_encoded_path, "-a-b", "C--x", "-C:-x", "a", "-a:b:c", "", "-a/b") == [True, True, True, False, False, False, False]
    assert values(spark, guards.is_project_id, "-a::0123abcd", "-a::xyz", "-a") == [True, False, True]
    assert guards.limit(500, 20, 200) == 200 and guards.limit(-1, 20, 200) == 20 and guards.limit("x", 20, 200) == 20
    assert guards.search_query(" a ") == "a" and guards.is_inside("/a/b/../c", ["/a"]) and not guards.is_inside("/a/../b", ["/a"])
    with pytest.raises(ValueError):
        guards.search_query("x" * 513)


def test_file_references_and_hash(spark):
    assert values(spark, X.file_references, "see @src/a.ts, @./b @name @x/y @a/") == [["src/a.ts", "./b", "x/y"]]
    assert values(spark, X.string_hash, "", "a", "hello world, this is long") == [0, 97, _hash("hello world, this is long")]


def _hash(s):
    h = 0
    for c in s:
        h = (h * 31 + ord(c) + 2**31) % 2**32 - 2**31
    return h


def test_tool_summary(spark):
    got = values(spark, lambda c: X.tool_summary(F.get_json_object(c, "$.n"), F.get_json_object(c, "$.i")), '{"n":"Read","i":{"file_path":"/a/b.py"}}', '{"n":"Task","i":{"prompt":"p","subagent_type":"Explore"}}', '{"n":"WebFetch","i":{"url":"https://x.org/a/b?q=1"}}', '{"n":"Other","i":{"query":"q"}}', '{"n":"Bash","i":{}}')
    assert got == ["b.py", "Explore - p", "x.org/a/b", "q", "Bash"]


def test_pretty(spark):
    assert values(spark, pretty.output_text, '[{"type":"text","text":"a"},{"type":"text","text":"b"}]', '{"a":1}', "plain", None) == ["a\nb", '{\n  "a": 1\n}', "plain", None]
    assert values(spark, pretty.input_preview, '{"b":2.50,"a":"é"}') == ['{\n  "b": 2.5,\n  "a": "é"\n}']


def test_diff():
    assert diff.diff_lines(["a", "b", "c"], ["a", "x", "c", "d"]) == [("context", "a"), ("removed", "b"), ("added", "x"), ("context", "c"), ("added", "d")]
    assert diff.diff_lines([], ["a"]) == [("added", "a")] and diff.diff_lines(["a"], []) == [("removed", "a")]
    import random

    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        d = diff.diff_lines(a, b)
        assert [x for k, x in d if k != "added"] == a and [x for k, x in d if k != "removed"] == b


def test_markdown():
    got = markdown.segments("# Head **bold**\n\npara one\nstill `code` [link](u)\n- item *x*\n> quote\n```py\nfor x:\n  y\n```\n| a | b |\n|---|---|\n| c | <b>d</b> |\n")
    assert got == ["Head bold", "para one still code link", "item x", "quote", "for x:\n  y", "a", "b", "c", "d"]


def test_sql_functions(spark):
    register.register(spark)
    assert spark.sql("SELECT estimate_tokens('abcde'), format_tokens(1500), repository_id(' A ') = repository_id('a')").first()[:] == (2, "1.5k", True)
    assert [r.folder for r in spark.sql("SELECT folder FROM path_ancestors('/a/b/c') ORDER BY 1").collect()] == ["/a", "/a/b"]
