"""What a message is: noise, compaction, command output, user or assistant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.functions import text as X


def _any_text(blocks: Column, test) -> Column:
    return F.exists(blocks, lambda b: (b["type"] == "text") & test(F.coalesce(b["text"], F.lit(""))))


def _interrupted(blocks: Column) -> Column:
    one = F.get(blocks, F.lit(0))
    return (F.size(blocks) == 1) & (one["type"] == "text") & F.coalesce(one["text"].startswith(X.INTERRUPTED), F.lit(False))


def _starts(c: Column, tags) -> Column:
    out = F.lit(False)
    for t in tags:
        out = out | c.startswith(t)
    return out


def is_hard_noise(m: DataFrame) -> Column:
    t = X.js_trim(m["text"])
    wrapped = F.lit(False)
    for tag in X.NOISE_TAGS:
        wrapped = wrapped | (t.startswith(tag) & t.endswith(tag.replace("<", "</")))
    empty = t.isin(X.STDOUT + X.STDOUT.replace("<", "</"), X.STDERR + X.STDERR.replace("<", "</"))
    user = F.when(m["content_kind"] == "string", wrapped | empty | t.startswith(X.INTERRUPTED)).otherwise(_interrupted(m["blocks"]))
    kind = m["type"]
    noise = kind.isin("system", "summary", "file-history-snapshot", "queue-operation") | ((kind == "assistant") & m["model"].eqNullSafe(F.lit("<synthetic>")))
    return noise | ((kind == "user") & F.coalesce(user, F.lit(False)))


def is_teammate(m: DataFrame) -> Column:
    own = F.when(m["content_kind"] == "string", X.js_trim(m["text"]).rlike(X.TEAMMATE)).otherwise(_any_text(m["blocks"], lambda t: X.js_trim(t).rlike(X.TEAMMATE)))
    return (m["type"] == "user") & ~m["is_meta"] & own


def is_command_output(m: DataFrame) -> Column:
    own = F.when(m["content_kind"] == "string", _starts(m["text"], (X.STDOUT, X.STDERR))).otherwise(_any_text(m["blocks"], lambda t: t.startswith(X.STDOUT)))
    return (m["type"] == "user") & own


def is_user_input(m: DataFrame) -> Column:
    t = X.js_trim(m["text"])
    string = ~_starts(t, X.SYSTEM_TAGS) & (F.length(t) > 0)
    shown = F.exists(m["blocks"], lambda b: b["type"].isin("text", "image"))
    array = shown & ~_interrupted(m["blocks"]) & ~_any_text(m["blocks"], lambda x: _starts(x, X.SYSTEM_TAGS))
    return (m["type"] == "user") & ~m["is_meta"] & ~is_teammate(m) & F.when(m["content_kind"] == "string", string).otherwise(array)


def category(m: DataFrame) -> Column:
    """hardNoise, compact, system, user or ai: the first that fits."""
    return F.when(is_hard_noise(m), "hardNoise").when(m["is_compact"], "compact").when(is_command_output(m), "system").when(is_user_input(m), "user").otherwise("ai")


def with_category(m: DataFrame) -> DataFrame:
    return m.withColumn("category", category(m))


def type_counts(m: DataFrame, by: str = "session") -> DataFrame:
    """Messages of each kind of a session, in one pass."""
    real = (m["type"] == "user") & ~m["is_meta"] & ((m["content_kind"] == "string") | F.exists(m["blocks"], lambda b: b["type"].isin("text", "image")))
    internal = (m["type"] == "user") & m["is_meta"]
    return m.groupBy(by).agg(
        F.count_if(m["type"] == "user").alias("users"), F.count_if(real).alias("real_users"), F.count_if(internal).alias("internal_users"),
        F.count_if(m["type"] == "assistant").alias("assistants"), F.count_if(m["type"] == "system").alias("systems"),
        F.count_if(~m["type"].isin("user", "assistant", "system")).alias("others"), F.count_if(m["is_sidechain"]).alias("sidechain"),
    )


def is_displayable(m: DataFrame) -> Column:
    """Whether a row alone makes its session worth a place in the list; sidechains never do, and what is meta always does."""
    t = X.js_trim(m["text"])
    wrapped = F.lit(False)
    for tag in X.NOISE_TAGS:
        wrapped = wrapped | (t.startswith(tag) & t.endswith(tag.replace("<", "</")))
    noisy = _any_text(m["blocks"], lambda b: F.coalesce(*[F.when(b.startswith(tag) & X.js_trim(b).endswith(tag.replace("<", "</")), True) for tag in X.NOISE_TAGS], F.lit(False)))
    has = lambda *kinds: F.exists(m["blocks"], lambda b: b["type"].isin(*kinds))
    array = has("tool_result") | (has("text", "image") & (_interrupted(m["blocks"]) | ~noisy))
    user = m["is_meta"] | F.when(m["content_kind"] == "string", ~wrapped & (F.length(t) > 0)).otherwise(array)
    return ~m["is_sidechain"] & F.coalesce(((m["type"] == "assistant") & ~m["model"].eqNullSafe(F.lit("<synthetic>"))) | ((m["type"] == "user") & user), F.lit(False))


def displayable_sessions(m: DataFrame, by: str = "session") -> DataFrame:
    """The sessions with anything to show."""
    return m.where(is_displayable(m)).select(by).distinct()
