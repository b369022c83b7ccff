"""Alert rules over messages, and the alerts they raise."""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F

from tracewell.functions import formats
from tracewell.functions import text as X
from tracewell.operators.ordered import anchored

# Shapes that make a pattern slow on some text, so that it isn't used.
_RISKY = (
    r"\([^)]{0,50}[+*][^)]{0,50}\)[+*]",  # a repeat inside a repeat
    r"\([^)|]{0,50}\|[^)]{0,50}\)[+*]",  # alternatives that repeat
    r"[+*]\{",
    r"\}[+*]",
    r"\\[1-9][+*]",  # a reference back that repeats
    r"\[[^\]]{20}\][+*]",
)


@dataclass
class Rule:
    """tool_result rules look at results, tool_use ones at inputs, token_threshold ones at sizes."""

    id: str
    name: str
    mode: str = "tool_result"
    tool: str | None = None
    pattern: str | None = None
    ignore: list[str] = dataclasses.field(default_factory=list)
    require_error: bool = False
    token_kind: str = "total"
    threshold: int = 0
    projects: list[str] = dataclasses.field(default_factory=list)
    enabled: bool = True
    #: The field of a call's input that is looked at; without one, the whole input.
    field: str | None = None
    #: Repositories that the rule is meant for; none means all.
    repositories: list[str] = dataclasses.field(default_factory=list)
    #: Built-in rules can be changed and switched off, but not removed.
    builtin: bool = False


# The rules that are there from the start, switched off.
BUILT_IN = (
    Rule("builtin-bash-command", ".env File Access Alert", "tool_use", pattern="/.env", enabled=False, builtin=True),
    Rule("builtin-tool-result-error", "Tool Result Error", "tool_result", require_error=True, ignore=[r"The user doesn't want to proceed with this tool use\.", r"\[Request interrupted by user for tool use\]"], enabled=False, builtin=True),
    Rule("builtin-high-token-usage", "High Token Usage", "token_threshold", threshold=8000, enabled=False, builtin=True),
)


def _is_balanced(pattern: str) -> bool:
    """Whether brackets pair up; those after a backslash or inside a class are plain characters."""
    bare = re.sub(r"\[(?:\\.|[^\]\\])*\]", "", re.sub(r"\\[^\[\]]", "", pattern))
    bare = re.sub(r"\\.", "", bare)
    while (less := re.sub(r"\(\)|\{\}", "", re.sub(r"[^(){}\[\]]", "", bare))) != bare:
        bare = less
    return not bare


def is_safe_pattern(pattern: str) -> bool:
    """At most 100 characters, balanced, free of risky shapes, and it compiles; rules with other patterns never match."""
    if not pattern or len(pattern) > 100 or any(re.search(p, pattern) for p in _RISKY) or not _is_balanced(pattern):
        return False
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def infer_mode(rule: Rule) -> str:
    """What a rule without a mode is meant for: errors of results, a pattern (or field) in uses, a threshold; results if nothing tells."""
    if rule.require_error:
        return "tool_result"
    if rule.pattern or rule.field:
        return "tool_use"
    return "token_threshold" if rule.threshold else "tool_result"


def rule_errors(rule: Rule) -> list[str]:
    """What is wrong with a rule; nothing if it can be used."""
    found = [f"{name} is required" for name in ("id", "name", "mode") if not (getattr(rule, name) or "").strip()]
    if rule.mode and rule.mode not in ("tool_result", "tool_use", "token_threshold"):
        found.append(f"unknown mode {rule.mode}")
    if rule.mode == "tool_use" and rule.tool and not rule.field:
        found.append("a field is required for the uses of one tool")
    if rule.mode == "tool_result" and not rule.require_error and not rule.tool:
        found.append("a tool is required for a pattern in results")
    if rule.mode == "token_threshold":
        if rule.threshold is None or rule.threshold < 0:
            found.append("the threshold must not be negative")
        if rule.token_kind not in ("input", "output", "total"):
            found.append("the kind of tokens is required")
    found += [f"pattern {p} can't be used" for p in [rule.pattern, *rule.ignore] if p and not is_safe_pattern(p)]
    return found


def _checked(rule: Rule) -> Rule:
    if errors := rule_errors(rule):
        raise ValueError("; ".join(errors))
    return rule


def add_rule(rules: list[Rule], rule: Rule) -> list[Rule]:
    if any(r.id == rule.id for r in rules):
        raise ValueError(f"there is a rule {rule.id} already")
    return [*rules, _checked(rule)]


def update_rule(rules: list[Rule], rule_id: str, **changes) -> list[Rule]:
    """rules with one changed; whether it is built in stays as it is."""
    if all(r.id != rule_id for r in rules):
        raise ValueError(f"there is no rule {rule_id}")

    def changed(r: Rule) -> Rule:
        new = dataclasses.replace(r, **{k: v for k, v in changes.items() if k != "builtin"})
        return _checked(new if new.mode else dataclasses.replace(new, mode=infer_mode(new)))

    return [changed(r) if r.id == rule_id else r for r in rules]


def remove_rule(rules: list[Rule], rule_id: str) -> list[Rule]:
    found = [r for r in rules if r.id == rule_id]
    if not found:
        raise ValueError(f"there is no rule {rule_id}")
    if found[0].builtin:
        raise ValueError("built-in rules can only be switched off")
    return [r for r in rules if r.id != rule_id]


def merge_rules(loaded: list[Rule], defaults: tuple[Rule, ...] = BUILT_IN) -> list[Rule]:
    """Loaded rules as they are, without built-in ones that are no more, and with those that are missing."""
    known = {r.id for r in defaults if r.builtin}
    kept = [r for r in loaded if not r.builtin or r.id in known]
    return kept + [r for r in defaults if r.builtin and all(k.id != r.id for k in kept)]


def compiles(spark: SparkSession, pattern: str) -> bool:
    """Whether Spark's own regular expressions take the pattern: Python's compiler accepts some that would fail a stage later."""
    try:
        spark.sql("SELECT '' RLIKE :p", args={"p": f"(?i){pattern}"}).collect()
    except Exception as e:  # noqa: BLE001  the class depends on where the session runs
        if "INVALID_PARAMETER_VALUE" in str(e) or "PatternSyntax" in str(e) or "regex" in str(e).lower():
            return False
        raise
    return True


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The enabled rules with usable patterns; a list that people write, so it is small."""
    rows = []
    for r in rules:
        usable = lambda p: is_safe_pattern(p) and compiles(spark, p)
        if r.enabled and (r.pattern is None or usable(r.pattern)):
            ignore = "|".join(f"(?:{p})" for p in r.ignore if usable(p))
            rows.append({**asdict(r), "ignore": ignore or None})
    schema = (
        "id string, name string, mode string, tool string, pattern string, ignore string, require_error boolean, token_kind string, threshold long, projects array<string>, "
        "repositories array<string>, field string"
    )
    fields = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple(r[f] for f in fields) for r in rows], schema).select(*[F.col(f).alias(f"rule_{f}") for f in fields])


def _matches(value: Column, pattern: str | None) -> Column:
    """Case doesn't count; the pattern is a literal, so it is compiled once."""
    return F.lit(None).cast("boolean") if pattern is None else value.rlike(f"(?i){pattern}")


def _ignored(value: Column, rule: Row) -> Column:
    return F.coalesce(_matches(value, rule.rule_ignore), F.lit(False))


def _each_match(rows: DataFrame, rules: DataFrame, mode: str, test: Callable[[Row], Column]) -> tuple[DataFrame, list[Row]]:
    """rows once for each rule of a mode that is meant for them and whose test they pass, with _rule, the rule's place in the list that comes with them.

    The rules, which people write, are read to the driver and become literal
    conditions of one projection; no row is joined with them. A row that passes none is
    filtered before anything is exploded, and a row carries the places of its rules only.
    """
    own = rules.where(F.col("rule_mode") == mode).collect()
    repository = F.col("repository") if "repository" in rows.columns else F.lit(None).cast("string")
    found = []
    for k, r in enumerate(own):
        fits = test(r)
        if r.rule_projects:
            fits = fits & F.col("project").isin(r.rule_projects)
        if r.rule_repositories:
            fits = fits & repository.isin(r.rule_repositories)
        found.append(F.when(fits, k))
    if not found:
        return rows.where(F.lit(False)).withColumn("_rule", F.lit(0)), own
    marked = rows.withColumn("_fits", F.array_compact(F.array(*found)))
    return marked.where(F.size("_fits") > 0).select(*rows.columns, F.explode("_fits").alias("_rule")), own


def _with_rule(found: DataFrame, own: list[Row], rules: DataFrame, columns: list[str]) -> DataFrame:
    """found (.., _rule) with the columns of their rules."""
    if not own:
        return found.select(*columns).join(rules.limit(0), F.lit(False))
    says = [F.struct(*[_literal(r[f.name], f.dataType.simpleString()).alias(f.name) for f in rules.schema.fields]) for r in own]
    return found.select(*columns, F.get(F.array(*says), F.col("_rule")).alias("_says")).select(*columns, "_says.*")


def _literal(value, kind: str) -> Column:
    return (F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)).cast(kind)


def _is_tool(rule: Row) -> Column:
    return F.lit(True) if rule.rule_tool is None else F.col("tool") == rule.rule_tool


def match_results(results: DataFrame, rules: DataFrame) -> DataFrame:
    """First match of each message and rule: errors that aren't ignored, or the pattern in a tool's result; results (project, message, pos, tool, content, is_error), and repository where rules ask for it."""

    def test(r: Row) -> Column:
        value = F.col("content")
        if r.rule_require_error:
            return F.col("is_error") & ~_ignored(value, r)
        return F.lit(r.rule_tool is not None) & _is_tool(r) & _matches(value, r.rule_pattern) & ~_ignored(value, r)

    return _first(results, rules, "tool_result", test)


def match_uses(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """First match of each message and rule in the inputs of calls (project, message, pos, tool, input), or in one field of them; without a pattern every value matches."""

    def test(r: Row) -> Column:
        value = F.col("input") if r.rule_field is None else F.get_json_object("input", f"$['{r.rule_field}']")
        fits = F.lit(True) if r.rule_pattern is None else _matches(value, r.rule_pattern)
        return _is_tool(r) & (F.length(value) > 0) & fits & ~_ignored(value, r)

    return _first(calls, rules, "tool_use", test)


def token_message(tool: Column, input_json: Column, tokens: Column, kind: str) -> Column:
    """What an alert about a call's size says; ignore patterns look at it."""
    label = "" if kind == "total" else f" {kind}"
    return F.concat(tool, F.lit(" - "), X.tool_summary(tool, input_json), F.lit(" : ~"), formats.format_tokens(tokens), F.lit(f"{label} tokens"))


def match_tokens(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """All calls (project, message, pos, tool, input_tokens, output_tokens) above a threshold, with tokens; where input is there, ignore patterns look at the alert's text."""
    sizes = {"input": F.col("input_tokens"), "output": F.col("output_tokens")}

    def size(kind: str | None) -> Column:
        return sizes.get(kind or "total", F.col("input_tokens") + F.col("output_tokens"))

    def test(r: Row) -> Column:
        fits = _is_tool(r) & (size(r.rule_token_kind) > r.rule_threshold) & F.lit(r.rule_threshold > 0)
        if r.rule_ignore is not None and "input" in calls.columns:
            fits = fits & ~_ignored(token_message(F.col("tool"), F.col("input"), size(r.rule_token_kind), r.rule_token_kind), r)
        return fits

    found, own = _each_match(calls, rules, "token_threshold", test)
    each = _with_rule(found, own, rules, calls.columns)
    kind = F.col("rule_token_kind")
    return each.withColumn("tokens", F.when(kind == "input", F.col("input_tokens")).when(kind == "output", F.col("output_tokens")).otherwise(F.col("input_tokens") + F.col("output_tokens")))


def _string_at(json: Column, key: str) -> Column:
    """The value at a key if it is a string."""
    value = F.try_variant_get(F.try_parse_json(json), f"$.{key}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.get_json_object(json, f"$.{key}"))


def enriched_text(result_json: Column) -> Column:
    """The text of an enriched result: its error, else what it wrote to stderr, else its content, else its message; empty without any."""
    stderr = _string_at(result_json, "stderr")
    written = F.when(F.length(X.js_trim(stderr)) > 0, stderr)
    return F.coalesce(_string_at(result_json, "error"), written, _string_at(result_json, "content"), _string_at(result_json, "message"), F.lit(""))


def enriched_results(messages: DataFrame) -> DataFrame:
    """(session, line_no, source_tool_use_id, content, is_error) of the enriched results that name their call."""
    flag = lambda k: F.coalesce(F.get_json_object("tool_use_result", f"$.{k}") == "true", F.lit(False))
    own = messages.where(F.col("tool_use_result").startswith("{") & F.col("source_tool_use_id").isNotNull())
    return own.select("session", "line_no", "source_tool_use_id", enriched_text(F.col("tool_use_result")).alias("content"), (flag("isError") | flag("is_error")).alias("is_error"))


def error_text(content_json: Column) -> Column:
    """The text of a result's content: a string, or the text blocks of an array by lines; Unknown error if that is blank."""
    blocks = F.from_json(content_json, "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])
    plain = F.get_json_object(F.concat(F.lit('{"v":'), content_json, F.lit("}")), "$.v")
    said = X.js_trim(F.when(F.ltrim(content_json).startswith("["), F.array_join(texts, "\n")).when(F.ltrim(content_json).startswith('"'), plain))
    return F.when(F.length(said) > 0, said).otherwise("Unknown error")


def alert_message(text: Column, most: int = 500) -> Column:
    return X.truncate(text, most)


def trial(found: DataFrame, order: Column, rows: int = 50, most: int = 10_000) -> DataFrame:
    """The first rows of what a rule found, with how many there are (most at most) and whether there are more than that."""
    counted = found.limit(most + 1).agg(F.count("*").alias("_n"))
    out = found.orderBy(order).limit(rows).crossJoin(F.broadcast(counted))
    return out.withColumn("total", F.least(F.col("_n"), F.lit(most))).withColumn("truncated", F.col("_n") > most).drop("_n")


def _first(rows: DataFrame, rules: DataFrame, mode: str, test: Callable[[Row], Column]) -> DataFrame:
    """The first match of each message and rule, with the rule's columns."""
    found, own = _each_match(rows, rules, mode, test)
    rest = [c for c in rows.columns if c not in ("project", "message")]
    one = found.groupBy("project", "message", "_rule").agg(F.min_by(F.struct(*rest), "pos").alias("r")).select("project", "message", "_rule", "r.*")
    return _with_rule(one, own, rules, ["project", "message", *rest])


def upsert_alerts(alerts: DataFrame, key: str = "tool_use_id") -> DataFrame:
    """One alert for each call: one from a subagent before others, then the earliest; alerts without a call all stay. Needs from_subagent and arrival."""
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("from_subagent"), "arrival"))
    called = alerts.where(F.col(key).isNotNull()).withColumn("_rank", best).where("_rank = 1").drop("_rank")
    return called.unionByName(alerts.where(F.col(key).isNull()))  # not ranked: they would all meet in one task


def newest(alerts: DataFrame, cap: int = 100) -> DataFrame:
    return alerts.orderBy(F.desc("ts"), F.desc("id")).limit(cap)


def alert_stats(alerts: DataFrame, by: str) -> DataFrame:
    return alerts.groupBy(by).agg(F.count("*").alias("total"), F.count_if(~F.col("is_read")).alias("unread"))


def chips(alerts: DataFrame, name: str = "rule_name") -> DataFrame:
    """Alerts of each rule, the most first; those without a rule count as Other."""
    return alerts.groupBy(F.coalesce(name, F.lit("Other")).alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def mark_read(alerts: DataFrame, ids: list[str] | DataFrame | None = None) -> DataFrame:
    """Alerts with those of the ids read, or all of them; many ids come as a table (id)."""
    if ids is None:
        return alerts.withColumn("is_read", F.lit(True))
    if isinstance(ids, DataFrame):
        chosen = ids.select("id").distinct().withColumn("_chosen", F.lit(True))
        return alerts.join(chosen, "id", "left").withColumn("is_read", F.col("is_read") | F.coalesce("_chosen", F.lit(False))).drop("_chosen")
    return alerts.withColumn("is_read", F.col("is_read") | F.col("id").isin(ids))


def mark_rule_read(alerts: DataFrame, label: str) -> DataFrame:
    """Alerts with those of one rule read; Other means those without a rule."""
    return alerts.withColumn("is_read", F.col("is_read") | (F.coalesce("rule_name", F.lit("Other")) == label))


def clear(alerts: DataFrame, label: str | None = None) -> DataFrame:
    """Alerts without those of one rule, or none."""
    return alerts.where(F.lit(False)) if label is None else alerts.where(F.coalesce("rule_name", F.lit("Other")) != label)


def page_of(alerts: DataFrame, offset: int = 0, limit: int = 20) -> DataFrame:
    """One page of alerts, the newest first: an exact top-k."""
    return alerts.orderBy(F.desc("ts"), F.desc("id")).offset(offset).limit(limit)


@dataclass
class Notifications:
    """When alerts are shown; what isn't shown is stored all the same."""

    enabled: bool = True
    #: Alerts before this time (milliseconds of their own clock) aren't shown.
    snoozed_until_ms: int | None = None
    ignored_repositories: list[str] = dataclasses.field(default_factory=list)
    ignored_patterns: list[str] = dataclasses.field(default_factory=list)
    throttle_ms: int = 5000


def silence(alerts: DataFrame, settings: Notifications) -> Column:
    """Why the settings hold an alert (message, ts_ms, and repository where known) back, in the order in which they are asked; null if they don't."""
    repository = F.col("repository") if "repository" in alerts.columns else F.lit(None).cast("string")
    usable = [p for p in settings.ignored_patterns if compiles(alerts.sparkSession, p)]
    ignored = F.lit(False)
    for p in usable:
        ignored = ignored | F.coalesce(_matches(F.col("message").cast("string"), p), F.lit(False))
    snoozed = F.lit(False) if settings.snoozed_until_ms is None else F.col("ts_ms") < settings.snoozed_until_ms
    return (
        F.when(F.lit(not settings.enabled), "disabled")
        .when(snoozed, "snoozed")
        .when(repository.isin(settings.ignored_repositories) if settings.ignored_repositories else F.lit(False), "repository")
        .when(ignored, "pattern")
    )


def _shown(alerts: DataFrame, width_ms: int) -> DataFrame:
    """(project, message, ts_ms, id) of what is shown: in each key the first alert, and each one width_ms or more after the last that was."""
    first = alerts.where("ts_ms is not null").groupBy("project", "message", F.col("ts_ms").cast("long").alias("ts_ms")).agg(F.min("id").alias("id"))
    return anchored(first, ["project", "message"], "ts_ms", width_ms).where("anchor = ts_ms").select("project", "message", "ts_ms", "id")


def throttled(alerts: DataFrame, seconds: int = 5) -> DataFrame:
    """is_shown: no alert of the same project and message was shown in the seconds before.

    What was shown depends on what was shown before, so the distinct times of a key are
    run through in order (ordered.anchored), with one time as state; no key is gathered,
    and the alerts of a very frequent message are thinned to one for each millisecond
    before they move. An alert without a time isn't shown. Ids must be distinct.
    """
    shown = _shown(alerts, seconds * 1000).select("id", F.lit(True).alias("_shown"))
    return alerts.join(shown, "id", "left").withColumn("is_shown", F.coalesce("_shown", F.lit(False))).drop("_shown").select(*alerts.columns, "is_shown")


def suppressed(alerts: DataFrame, settings: Notifications) -> DataFrame:
    """alerts (id, project, message, ts_ms, ..) with suppressed_by: disabled, snoozed, repository, pattern or throttled; null where it is shown.

    Only alerts that nothing else holds back count for the throttle.
    """
    held = alerts.withColumn("_held", silence(alerts, settings))
    shown = _shown(held.where("_held is null"), settings.throttle_ms).select("id", F.lit(True).alias("_shown"))
    reason = F.coalesce("_held", F.when(F.col("_shown").isNull(), "throttled"))
    return held.join(shown, "id", "left").withColumn("suppressed_by", reason).select(*alerts.columns, "suppressed_by")
