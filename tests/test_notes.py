"""Notes, agent files, memory indexes and settings."""

from tracewell.sources import notes


def test_notes(spark, tmp_path):
    (tmp_path / "rules" / "deep").mkdir(parents=True)
    (tmp_path / "A.md").write_text("x" * 9)
    (tmp_path / "rules" / "a.md").write_text("one")
    (tmp_path / "rules" / "deep" / "b.md").write_text("two\n")
    (tmp_path / "rules" / "c.txt").write_text("no")
    texts = notes.read_texts(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: (r.chars, r.tokens) for r in notes.file_notes(texts).collect()} == {"A.md": (9, 3), "a.md": (3, 1), "b.md": (4, 1)}
    r = notes.folder_notes(texts, "/rules/").first()
    assert (r.chars, r.tokens) == (7, 2)
    asked = {r.path[-4:]: (r.exists, r.tokens) for r in notes.with_missing(notes.file_notes(texts.where("name = 'A.md'")), [texts.where("name = 'A.md'").first().path, "/none"]).collect()}
    assert asked == {"A.md": (True, 3), "none": (False, 0)}


def test_agents_and_memory(spark, tmp_path):
    (tmp_path / "one.md").write_text('---\nname: "Scout"\ncolor: red\n---\ntext')
    (tmp_path / "two.md").write_text("no frontmatter")
    (tmp_path / "MEMORY.md").write_text("# Index\n- [First](one.md) — the hook\n* [Gone](gone.md)\nno entry\n" + "line\n" * 300)
    texts = notes.read_texts(spark, str(tmp_path))
    assert {(r.name, r.color) for r in notes.agent_configs(texts.where("name <> 'MEMORY.md'")).collect()} == {("Scout", "red"), ("two", None)}
    assert [r.name for r in notes.memory_orphans(texts).collect()] == ["two.md"]
    assert notes.memory_note(texts).first().chars < 1200
    links = spark.createDataFrame([("first-note",), ("ONE",), ("nothing",)], "slug string")
    files = spark.createDataFrame([("one.md", "First note"), ("two.md", "one")], "name string, title string")
    assert {r.slug: r.target for r in notes.resolve_links(links, files).collect()} == {"first-note": "one.md", "ONE": "one.md", "nothing": None}


def test_settings_and_todos(spark, tmp_path):
    assert notes.merged_settings('{"a": {"x": 2}, "z": 1}', {"a": {"x": 1, "y": 1}, "b": 3}) == {"a": {"x": 2, "y": 1}, "b": 3, "z": 1}
    assert notes.merged_settings("{broken", {"b": 3}) == {"b": 3}
    (tmp_path / "s1.json").write_text('[{"content": "do"}]')
    (tmp_path / "s2.json").write_text("{")
    assert [r.session for r in notes.todos(spark, str(tmp_path)).collect()] == ["s1"]
