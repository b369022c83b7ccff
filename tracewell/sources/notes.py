"""Markdown notes and settings that go into a session's context, read as tables.

Each reader takes any path that Spark can list; missing files give no rows, and
with_missing() tells which of the asked ones are absent.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewell.functions import text as X
from tracewell.operators import listing

MEMORY_LINES = 200


def read_texts(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """(path, folder, name, text) of each text file under a path; Spark doesn't list folders below it whose names begin with a dot, so name those too."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    file = F.col("_metadata.file_path")
    return whole.select(file.alias("path"), F.regexp_extract(file, "^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract(file, "([^/]*)$", 1).alias("name"), F.col("value").alias("text"))


def file_notes(texts: DataFrame) -> DataFrame:
    """(path, chars, tokens) of single files."""
    return texts.select("path", F.length("text").cast("long").alias("chars"), X.estimate_tokens(F.col("text")).alias("tokens"))


def folder_notes(texts: DataFrame, folder: str) -> DataFrame:
    """(path, chars, tokens) of a folder of rules as one note: the files in order of their paths, joined by line ends. The folder is one project's, so its texts fit a row."""
    own = texts.where(F.col("path").contains(folder))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda x: x["text"]), "\n")
    a = own.agg(F.sum(F.length("text")).alias("chars"), joined.alias("text"), F.count("*").alias("n")).where("n > 0")
    return a.select(F.lit(folder).alias("path"), "chars", X.estimate_tokens(F.col("text")).alias("tokens"))


def memory_note(texts: DataFrame) -> DataFrame:
    """(path, chars, tokens) of memory indexes: their first lines only are loaded."""
    head = F.array_join(F.slice(F.split("text", "\n"), 1, MEMORY_LINES), "\n")
    return file_notes(texts.where("name = 'MEMORY.md'").withColumn("text", head))


def with_missing(notes: DataFrame, asked: list[str], default_tokens: int = 500) -> DataFrame:
    """Each asked path, with the tokens of its note, or 0 where it is missing; default_tokens stands for what couldn't be looked up (null)."""
    paths = notes.sparkSession.createDataFrame([(p,) for p in asked], "path string")
    found = notes.withColumn("exists", F.lit(True))
    joined = paths.join(found, "path", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
    return joined.withColumn("tokens", F.when(F.col("exists"), F.coalesce("tokens", F.lit(default_tokens))).otherwise(0)).withColumn("chars", F.coalesce("chars", F.lit(0)))


def agent_configs(texts: DataFrame) -> DataFrame:
    """(name, color) of agent files: the frontmatter's name, else the file's."""
    keys = listing.frontmatter(F.col("text"))
    get = lambda k: F.nullif(F.try_element_at(keys, F.lit(k)), F.lit(""))
    return texts.select(F.coalesce(get("name"), F.regexp_replace("name", r"\.md$", "")).alias("name"), get("color").alias("color"))


def memory_orphans(texts: DataFrame, index: str = "MEMORY.md") -> DataFrame:
    """Memory files that their index doesn't name."""
    named = listing.memory_entries(texts.where(F.col("name") == index).select("text")).select(F.regexp_extract("target", "([^/]*)$", 1).alias("name"))
    return listing.orphans(texts.where(F.col("name") != index).select("name"), named, "name")


def resolve_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """links (slug) with the best of files (name, title): the same file name, else its stem, else the title, else the title with dashes, case ignored."""
    low = lambda c: F.lower(F.trim(c))
    stem = F.regexp_replace("name", r"\.md$", "")
    keys = files.select("name", F.explode(F.array(F.struct(F.lit(1).alias("rank"), low(F.col("name")).alias("key")), F.struct(F.lit(2).alias("rank"), low(stem).alias("key")), F.struct(F.lit(3).alias("rank"), low(F.col("title")).alias("key")), F.struct(F.lit(4).alias("rank"), F.regexp_replace(low(F.col("title")), r"[\s_]+", "-").alias("key")))).alias("k")).select("name", "k.*")
    each = links.withColumn("key", low(F.col("slug"))).join(keys, "key", "left")
    return each.groupBy("slug").agg(F.min_by("name", F.struct("rank", "name")).alias("target"))


def todos(spark: SparkSession, path: str) -> DataFrame:
    """(session, todo): the JSON text of each session's list; broken files are left out."""
    texts = read_texts(spark, path, "*.json")
    return texts.where(F.try_parse_json("text").isNotNull()).select(F.regexp_replace("name", r"\.json$", "").alias("session"), F.col("text").alias("todo"))


def merged_settings(own: str | None, defaults: dict) -> dict:
    """Settings from a JSON text over their defaults, section by section; a broken text gives the defaults."""
    try:
        given = json.loads(own or "{}")
    except ValueError:
        given = {}
    given = given if isinstance(given, dict) else {}
    return {k: {**v, **given[k]} if isinstance(v, dict) and isinstance(given.get(k), dict) else given.get(k, v) for k, v in defaults.items()} | {k: v for k, v in given.items() if k not in defaults}
