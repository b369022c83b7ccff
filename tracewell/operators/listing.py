"""Lists of sessions, projects and repositories."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.functions import formats, paths


def encode_cursor(ts: int, session: str) -> str:
    return base64.b64encode(json.dumps({"timestamp": ts, "sessionId": session}, separators=(",", ":")).encode()).decode()


def decode_cursor(cursor: str) -> tuple[int, str]:
    got = json.loads(base64.b64decode(cursor))
    return got["timestamp"], got["sessionId"]


def page(rows: DataFrame, ts: str, key: str, after: tuple | None = None, size: int = 20) -> DataFrame:
    """The rows after a cursor (ts, key), newest first, ties by key; size + 1 of them, 201 at most: one more tells that there are more."""
    if after is not None:
        rows = rows.where((F.col(ts) < F.lit(after[0])) | ((F.col(ts) == F.lit(after[0])) & (F.col(key) > F.lit(after[1]))))
    return rows.orderBy(F.desc(ts), key).limit(min(size, 200) + 1)


def pinned(rows: DataFrame, pins: DataFrame, key: str) -> DataFrame:
    """Pinned rows in the order of their pins (key, pin_pos); pins of rows that are gone are dropped."""
    return pins.join(rows, key).orderBy("pin_pos")


def without_hidden(rows: DataFrame, hidden: DataFrame, key: str) -> DataFrame:
    """Rows that nobody hid (key); a hidden key without a row does nothing."""
    return rows.join(hidden.select(key).distinct(), key, "left_anti")


def projects_by_recency(sessions: DataFrame) -> DataFrame:
    """(project, sessions, recent) from sessions (project, modified), the one with the latest session first; those without a time come last."""
    per = sessions.groupBy("project").agg(F.count("*").alias("sessions"), F.max("modified").alias("recent"))
    return per.orderBy(F.desc_nulls_last("recent"), "project")


def by_date(rows: DataFrame, created: str, updated: str, as_of: Column) -> DataFrame:
    ts = F.greatest(F.coalesce(updated, created), F.col(created))
    return rows.withColumn("bucket", formats.date_bucket(ts, as_of))


def most_context(rows: DataFrame, consumption: str, key: str) -> DataFrame:
    return rows.orderBy(F.desc(F.coalesce(consumption, F.lit(0))), key)


def split_by_cwd(sessions: DataFrame) -> DataFrame:
    """(project, cwd, project_id, name, sessions, recent): sessions (project, base, session, cwd, ts) grouped into one project for each folder they ran in.

    With at most one known cwd a project stays whole. The shortest cwd is the root
    and keeps the plain name; ties go to the one that was seen last (by first ts,
    then cwd). Sessions without a cwd then form a group with the project's own id.
    """
    per = sessions.groupBy("project", "base", F.nullif("cwd", F.lit("")).alias("cwd")).agg(F.count("*").alias("sessions"), F.max("ts").alias("recent"), F.min("ts").alias("first"))
    whole = Window.partitionBy("project")
    known = F.count("cwd").over(whole)
    root = F.min(F.when(F.col("cwd").isNotNull(), F.struct(F.length("cwd").alias("n"), (-F.unix_micros(F.col("first").cast("timestamp"))).alias("t"), F.col("cwd").alias("cwd")))).over(whole)
    per = per.withColumn("_split", known > 1).withColumn("_root", root["cwd"])
    key = F.when(F.col("_split"), F.col("cwd"))
    named = F.when(key.isNull() | (F.col("cwd") == F.col("_root")), F.col("base")).otherwise(F.concat(F.col("base"), F.lit(" ("), paths.basename(F.col("cwd")), F.lit(")")))
    ident = F.when(key.isNull(), F.col("project")).otherwise(paths.composite_project_id(F.col("project"), F.col("cwd")))
    return per.select("project", ident.alias("project_id"), named.alias("name"), "sessions", "recent").groupBy("project", "project_id", "name").agg(F.sum("sessions").alias("sessions"), F.max("recent").alias("recent"))


def repository_groups(projects: DataFrame) -> DataFrame:
    """(repo, worktrees, total_sessions, recent, names) from projects (project, repo, name, sessions, recent, is_main).

    A project without a repository is one of its own; worktrees without sessions
    drop out; the main one comes first, then the most recent.
    """
    rows = projects.where("sessions > 0").withColumn("repo", F.coalesce("repo", "project"))
    order = F.struct((~F.col("is_main")).alias("side"), (-F.col("recent")).alias("age"), F.col("name").alias("name"))
    return rows.groupBy("repo").agg(F.count("*").alias("worktrees"), F.sum("sessions").alias("total_sessions"), F.max("recent").alias("recent"), F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["name"]), ",").alias("names"))


def orphans(files: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Files that no entry of the index names."""
    return files.join(index.select(key).distinct(), key, "left_anti").orderBy(key)


def memory_entries(text: DataFrame, column: str = "text") -> DataFrame:
    """(line, title, target, hook) of the lines "- [title](file.md) — hook" of an index."""
    line = r"^\s*[-*]\s*\[([^\]]+)\]\(([^)]+\.md)\)\s*(?:[—–-]+\s*(.*))?$"
    each = text.select("*", F.posexplode(F.split(column, "\n")).alias("line", "_text")).where(F.col("_text").rlike(line))
    return each.select(*[c for c in text.columns if c != column], "line", F.regexp_extract("_text", line, 1).alias("title"), F.regexp_extract("_text", line, 2).alias("target"), F.regexp_extract("_text", line, 3).alias("hook"))


def wikilinks(text: DataFrame, column: str = "text") -> DataFrame:
    """The [[slugs]] of a text outside of code."""
    bare = F.regexp_replace(F.regexp_replace(F.col(column), r"(?s)```.*?```", ""), "`[^`]*`", "")
    return text.select(*[c for c in text.columns if c != column], F.explode(F.regexp_extract_all(bare, F.lit(r"\[\[([^\]|]+)"), F.lit(1))).alias("slug"))


def frontmatter(column: Column) -> Column:
    """Map of the flat keys between the --- lines at the top of a text."""
    block = F.regexp_extract(column, r"(?s)\A---\n(.*?)\n---", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:\s*\S"))
    entry = lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+):", 1).alias("key"), F.regexp_replace(F.trim(F.regexp_extract(x, r"^[\w-]+:\s*(.*)$", 1)), "^[\"']|[\"']$", "").alias("value"))
    return F.map_from_entries(F.transform(lines, entry))


def frontmatter_parts(column: Column) -> Column:
    """(name, description, metadata) of the lines between --- at the top of a text: two flat keys, and the indented keys below metadata as a map; null without such lines.

    Any other key at the margin ends the block; quotes round a value are dropped.
    """
    block = F.regexp_extract(column, r"(?s)\A---\r?\n(.*?)\r?\n---(\r?\n|\z)", 1)
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: F.length(trim(x)) > 0)
    margin = lambda x: ~x.rlike(r"^\s")
    key = lambda x: trim(F.substring_index(x, ":", 1))
    value = lambda x: F.regexp_replace(F.regexp_replace(trim(F.substr(x, F.instr(x, ":") + 1)), '^"(.*)"$', "$1"), "^'(.*)'$", "$1")
    flat = lambda name: F.try_element_at(F.transform(F.filter(lines, lambda x: margin(x) & x.contains(":") & (key(x) == name)), value), F.lit(-1))
    # Each line with the last key at the margin before it.
    under = F.transform(lines, lambda x, i: F.struct(x.alias("x"), key(F.try_element_at(F.filter(F.slice(lines, F.lit(1), i + 1), margin), F.lit(-1))).alias("k")))
    own = F.filter(under, lambda u: ~margin(u["x"]) & (u["k"] == "metadata") & u["x"].contains(":") & (key(u["x"]) != ""))
    # Of a key that repeats the last value counts.
    pairs = F.transform(own, lambda u: F.struct(key(u["x"]).alias("key"), value(u["x"]).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["key"] == p["key"]))
    there = column.rlike(r"(?s)\A---\r?\n.*?\r?\n---(\r?\n|\z)")
    return F.when(there, F.struct(flat("name").alias("name"), flat("description").alias("description"), F.map_from_entries(last).alias("metadata")))
