"""One object for the transcripts of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewell.functions import text as X
from tracewell.operators import classify, exports, items, links, listing, search, sessions, views
from tracewell.sources import jsonl


class Transcripts:
    """Questions about the session files under a folder; each answer is a DataFrame."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def messages(self) -> DataFrame:
        return classify.with_category(jsonl.read_messages(self.spark, self.path)).withColumn("pos", F.col("line_no")).withColumn("id", F.col("uuid"))

    def main(self) -> DataFrame:
        """Messages of the main threads, with the text of all their text blocks."""
        m = self.messages().where("not is_sidechain")
        joined = F.array_join(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
        text = F.coalesce("text", joined)
        return m.withColumn("text", text).withColumn("tokens", X.estimate_tokens(text))

    def metrics(self) -> DataFrame:
        return sessions.session_metrics(self.messages().select("session", "pos", "ts", "request_id", "usage.*"))

    def chunks(self) -> DataFrame:
        return sessions.chunks(self.main())

    def turn_counts(self) -> DataFrame:
        m = self.messages()
        return sessions.turn_count(m.select("session", "pos", classify.is_user_input(m).alias("is_user"), ((m["type"] == "assistant") & ~m["model"].eqNullSafe(F.lit("<synthetic>")) & ~m["is_sidechain"]).alias("is_assistant")))

    def phases(self) -> DataFrame:
        m = self.messages()
        used = F.col("usage.input") + F.col("usage.cache_read") + F.col("usage.cache_creation")
        main = (m["type"] == "assistant") & ~m["is_sidechain"] & ~m["model"].eqNullSafe(F.lit("<synthetic>"))
        return sessions.compaction_phases(m.select("session", "pos", F.col("is_compact").alias("compact"), F.when(main, used).alias("ctx")))

    def steps(self) -> DataFrame:
        return views.steps(self.messages().where("not is_sidechain"))

    def tools(self) -> DataFrame:
        """Calls with their results; a result that names its source goes there."""
        m = self.messages()
        results = jsonl.tool_results(m).select("session", F.coalesce("source_tool_use_id", "tool_use_id").alias("tool_use_id"), F.struct("line_no", "block_no").alias("pos"), "content", "is_error", "ts")
        return links.link_tools(jsonl.tool_calls(m), results)

    def search(self, query: str, limit: int = 50) -> DataFrame:
        found = search.hits(search.searchable(self.main()), query)
        times = self.messages().select("session", "pos", "ts")
        return search.top_hits(found.join(times, ["session", "pos"]), [F.desc("ts"), "session", "pos", "match_no"], limit)

    def sessions(self, after: tuple | None = None, size: int = 20) -> DataFrame:
        return listing.page(jsonl.session_files(self.spark, self.path), "modified", "session", after, size)

    def projects(self) -> DataFrame:
        files = jsonl.session_files(self.spark, self.path)
        cwd = jsonl.first_cwd(jsonl.read_messages(self.spark, self.path))
        named = files.join(cwd, "session", "left").withColumn("base", F.regexp_extract("project", "([^-]+)$", 1))
        return listing.split_by_cwd(named.select("project", "base", "session", "cwd", F.col("modified").alias("ts")))

    def export(self, style: str = "text") -> DataFrame:
        rows = self.main().where("category <> 'hardNoise'").withColumnRenamed("category", "kind")
        return (views.export_markdown if style == "markdown" else views.export_text)(rows, ["session"], "pos")

    def threads(self) -> DataFrame:
        """Each message's place in its thread (links.thread_tree); links.thread_members gives what lies above and below some of them."""
        m = self.messages()
        return links.thread_tree(m.select("session", F.col("uuid").alias("node"), F.col("parent_uuid").alias("parent"), "pos"), ["session"], order="pos")

    def subagent_items(self, subagents: DataFrame | None = None) -> DataFrame:
        """What the files of subagents show, in order; subagents (session, id, parent_task, ts) are those that they started themselves."""
        m = jsonl.read_messages(self.spark, self.path).where(F.col("file").rlike(r"/agent-[^/]+\.jsonl$"))
        return items.subagent_items(m, subagents)

    def export_parts(self, style: str = "plaintext") -> DataFrame:
        """(session, place, text): sessions with their header, thinking, calls and cut results; exports.write_parts writes them in order."""
        m = self.messages().where("not is_sidechain")
        rows = sessions.mark_runs(self.main()).select("session", "run", "pos", "category", F.col("text").alias("said"))
        chunks = rows.groupBy("session", F.col("run").alias("chunk")).agg(F.min_by("category", "pos").alias("kind"), F.min_by("said", "pos").alias("text")).withColumnRenamed("chunk", "pos")
        placed = rows.where("category = 'ai'").select("session", "pos", F.col("run").alias("chunk"))
        replies = m.join(placed, ["session", "pos"]).select("session", F.col("chunk").alias("pos"), "line_no", "content_kind", "text", "blocks")
        calls = self.tools().join(placed.withColumnRenamed("pos", "line_no"), ["session", "line_no"])
        tools = calls.select("session", F.col("chunk").alias("pos"), (F.col("line_no") * 10_000 + F.col("block_no")).alias("tool_no"), "name", F.col("input_json").alias("input"), "is_orphan", F.col("result_is_error").alias("is_error"), F.col("result_content").alias("result"))
        about = m.groupBy("session").agg(F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("pos"))).alias("project"), F.min_by("git_branch", F.when(F.col("git_branch").isNotNull(), F.col("pos"))).alias("branch"), F.min("ts").alias("created"))
        return exports.export_parts(self.metrics().join(about, "session"), chunks, replies, tools, ["session"], style)
