"""Which parts of a session fill its context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tracewell.functions import paths

#: The six kinds of injections.
CATEGORIES = ("claude-md", "mentioned-file", "tool-output", "task-coordination", "thinking-text", "user-message")
#: Tools whose tokens count as coordination.
COORDINATION = ("SendMessage", "TeamCreate", "TeamDelete", "TaskCreate", "TaskUpdate", "TaskList", "TaskGet")
MOST_FILE_TOKENS = 25_000


def with_phase(rows: DataFrame, by: tuple[str, ...] = ("session",), pos: str = "pos", compact: str = "compact") -> DataFrame:
    """phase: 1 and up, one more from each compaction on."""
    return rows.withColumn("phase", F.sum(F.col(compact).cast("int")).over(Window.partitionBy(*by).orderBy(pos)) + 1)


def tool_category(tool: str = "tool"):
    return F.when(F.col(tool).isin(*COORDINATION), "task-coordination").otherwise("tool-output")


def cumulative(rows: DataFrame, by: tuple[str, ...] = ("session",), pos: str = "pos") -> DataFrame:
    """Running tokens and counts of each category inside a phase; needs phase, category and tokens."""
    w = Window.partitionBy(*by, "phase", "category").orderBy(pos)
    return rows.withColumn("total_tokens", F.sum("tokens").over(w)).withColumn("total_count", F.count("*").over(w))


def by_category(rows: DataFrame, by: tuple[str, ...] = ("session",)) -> DataFrame:
    return rows.groupBy(*by, "category").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))


def first_seen(rows: DataFrame, by: list[str], what: str, order: list[str]) -> DataFrame:
    """The first row of each value inside a group."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, what).orderBy(*order))).where("_rank = 1").drop("_rank")


def folder_notes(reads: DataFrame, known: DataFrame | None = None, name: str = "CLAUDE.md") -> DataFrame:
    """(session, phase, pos, folder_note): notes of all folders above the files that were read, each at its first sight in a phase; reads (session, phase, pos, path, root).

    known (folder_note, tokens), if given, says which of them exist.
    """
    each = reads.select("session", "phase", "pos", F.explode(paths.ancestors(F.col("path"), F.col("root"))).alias("folder"), "root").where("folder <> root")
    found = first_seen(each.withColumn("folder_note", F.concat("folder", F.lit(f"/{name}"))), ["session", "phase"], "folder_note", ["pos"]).select("session", "phase", "pos", "folder_note")
    return found if known is None else found.join(known, "folder_note")


def mentioned_files(mentions: DataFrame, stats: DataFrame) -> DataFrame:
    """Files that are mentioned, exist and are no larger than the limit, each once in a phase; mentions (session, phase, pos, path), stats (path, tokens)."""
    return first_seen(mentions.join(stats.where(F.col("tokens") <= MOST_FILE_TOKENS), "path"), ["session", "phase"], "path", ["pos"])


def folder_tree(files: DataFrame, path: str = "path") -> DataFrame:
    """(folder, files, tokens) of every folder above the files (path, tokens)."""
    return files.select(F.explode(paths.ancestors(F.col(path))).alias("folder"), "tokens").groupBy("folder").agg(F.count("*").alias("files"), F.sum("tokens").alias("tokens"))
