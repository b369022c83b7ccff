"""What fills a session's context, group by group: phases, injections with the span in which they hold, and notes whose sizes come late.

Items are rows (.., pos, item) with item user, ai or compact; a compaction empties the
context, so whatever was put in holds up to the last ai group of its phase. An
injection is one row with that span (from_place, to_place) and never a copy in each
group that still holds it: sums of a group are running sums, and the list of a group is
a look into the spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.functions import paths
from tracewell.operators.context import CATEGORIES
from tracewell.operators.links import in_interval

# The sources of notes that every session loads, in the order in which they are listed, with the places they are shown at (r and b stand for the project's root and the base folder).
GLOBAL_SOURCES = (
    ("enterprise", "enterprise", "", False),
    ("user", "user-memory", "b/CLAUDE.md", False),
    ("project", "project-memory", "r/CLAUDE.md", False),
    ("project-alt", "project-memory", "r/.claude/CLAUDE.md", False),
    ("project-rules", "project-rules", "r/.claude/rules", True),
    ("project-local", "project-local", "r/CLAUDE.local.md", False),
    ("user-rules", "user-rules", "b/rules", True),
    ("auto-memory", "auto-memory", "b/projects/e/memory/MEMORY.md", False),
)
DEFAULT_NOTE_TOKENS = 500
MEMORY_LINES = 200


def ai_groups(items: DataFrame, by: list[str], pos: str = "pos") -> DataFrame:
    """(.., group, phase, place, is_first, is_last, user_pos, compact_pos, previous_group) of each ai item, with the item's other columns.

    phase counts from 1, one more from each compaction on; place counts the groups of a
    phase. user_pos is the last user item since the group or compaction before; earlier
    ones belong to no group. compact_pos is the compaction that opened the phase, and
    previous_group the ai item before, in whatever phase.
    """
    upto = Window.partitionBy(*by).orderBy(pos)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    item = F.col("item")
    latest = lambda what, w: F.last(F.when(what, F.col(pos)), True).over(w)
    marked = items.select(
        "*",
        (F.sum((item == "compact").cast("int")).over(upto) + 1).cast("long").alias("phase"),
        latest(item == "user", before).alias("_user"),
        latest(item != "user", before).alias("_other"),
        latest(item == "compact", upto).alias("compact_pos"),
        latest(item == "ai", before).alias("previous_group"),
    ).where(item == "ai")
    phase = Window.partitionBy(*by, "phase").orderBy(pos)
    user = F.when(F.col("_other").isNull() | (F.col("_user") > F.col("_other")), F.col("_user"))
    placed = marked.withColumn("user_pos", user).withColumn("place", F.row_number().over(phase).cast("long")).withColumn("is_last", F.lead(pos).over(phase).isNull())
    rest = [c for c in items.columns if c not in (*by, pos, "item")]
    return placed.select(*by, F.col(pos).alias("group"), "phase", "place", (F.col("place") == 1).alias("is_first"), "is_last", "user_pos", "compact_pos", "previous_group", *rest)


def injections(groups: DataFrame, by: list[str], on_groups: DataFrame | None = None, on_users: DataFrame | None = None, everywhere: DataFrame | None = None) -> DataFrame:
    """(.., phase, group, from_place, to_place, category, what, tokens, n, order_no): what each group put into the context.

    on_groups come with ai items and on_users with user items: (.., pos, category, what,
    tokens, n, order_no); n is what they count for. everywhere (.., category, what,
    tokens, n, order_no) comes with the first group of each phase. Something with a
    what (a path) enters once in a phase, with its first group and there with its first
    order_no, whatever its category.
    """
    cols = ["category", "what", "tokens", "n", "order_no"]
    place = [*by, "phase", "group", F.col("place").alias("from_place")]
    found = []
    if everywhere is not None:
        found.append(groups.where("is_first").select(*place).join(everywhere, by).select(*by, "phase", "group", "from_place", *cols))
    for rows, at in ((on_groups, "group"), (on_users, "user_pos")):
        if rows is not None:
            found.append(groups.select(*place, F.col(at).alias("pos")).join(rows, [*by, "pos"]).select(*by, "phase", "group", "from_place", *cols))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    first = Window.partitionBy(*by, "phase", "what").orderBy("from_place", "order_no", "category")
    named = every.where("what is not null").withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")
    ends = groups.where("is_last").select(*by, "phase", F.col("place").alias("to_place"))
    return named.unionByName(every.where("what is null")).join(ends, [*by, "phase"])


def held_at(found: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """The injections that each of some groups (.., phase, group, place) holds: all that entered up to it, in its phase."""
    points = groups.select(*by, "phase", F.col("group").alias("held_by"), F.col("place").alias("ts"))
    spans = found.withColumnsRenamed({"from_place": "start", "to_place": "end"})
    return in_interval(points, spans, [*by, "phase"], "both").drop("ts").withColumnsRenamed({"start": "from_place", "end": "to_place"})


def last_lists(found: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """The whole list of the last group of each phase: everything that entered in it."""
    last = groups.where("is_last").select(*by, "phase", F.col("group").alias("held_by"))
    return found.join(last, [*by, "phase"])


def group_stats(groups: DataFrame, found: DataFrame, by: list[str], categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """groups with new_tokens, new_count, tokens and count as maps by category, and total_tokens: what a group added, and all that its context then holds."""
    of = lambda c, v: F.coalesce(F.sum(F.when(F.col("category") == c, F.col(v))), F.lit(0)).cast("long")
    per = found.groupBy(*by, "group").agg(*[of(c, v).alias(f"_{v}_{k}") for k, c in enumerate(categories) for v in ("tokens", "n")])
    names = [f"_{v}_{k}" for k in range(len(categories)) for v in ("tokens", "n")]
    each = groups.join(per, [*by, "group"], "left").na.fill(0, names)
    upto = Window.partitionBy(*by, "phase").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.select(*groups.columns, *names, *[F.sum(c).over(upto).alias(f"_all{c}") for c in names])
    table = lambda prefix: F.create_map(*[x for k, c in enumerate(categories) for x in (F.lit(c), F.col(f"{prefix}_{k}"))])
    total = sum((F.col(f"_all_tokens_{k}") for k in range(1, len(categories))), F.col("_all_tokens_0"))
    return each.select(*groups.columns, table("_tokens").alias("new_tokens"), table("_n").alias("new_count"), table("_all_tokens").alias("tokens"), table("_all_n").alias("count"), total.alias("total_tokens"))


def phases(groups: DataFrame, by: list[str]) -> DataFrame:
    """(.., phase, first_group, last_group, compact_pos, before, after, delta) of each phase that has an ai group.

    before is the last reading of the group before the compaction and after the first
    reading in the phase, where groups have them (first_total, last_total); without
    either there is no delta.
    """
    one = groups.groupBy(*by, "phase").agg(F.min_by("group", "place").alias("first_group"), F.max_by("group", "place").alias("last_group"), F.first("compact_pos").alias("compact_pos"), F.min_by("previous_group", "place").alias("_p"), F.min_by("first_total", "place").alias("_after"))
    reading = groups.select(*by, F.col("group").alias("_p"), F.col("last_total").alias("_before"))
    both = F.col("compact_pos").isNotNull() & F.col("_before").isNotNull() & F.col("_after").isNotNull()
    when = lambda c: F.when(both, c)
    return one.join(reading, [*by, "_p"], "left").select(*by, "phase", "first_group", "last_group", "compact_pos", when(F.col("_before")).alias("before"), when(F.col("_after")).alias("after"), when(F.col("_after") - F.col("_before")).alias("delta"))


def global_sources(projects: DataFrame, texts: DataFrame, base: str, enterprise: str) -> DataFrame:
    """(project, root, source, path, exists, chars, tokens) of the eight notes that a project's sessions load.

    projects (project, root), texts (path, text) the files at hand. A folder counts all
    .md files below it, joined by line ends; of memory indexes the first lines only
    count. Folders meet their files by equality on each folder above a file.
    """
    fill = lambda place: F.regexp_replace(
        F.when(F.lit(place == ""), F.lit(enterprise)).when(F.lit(place.startswith("b")), F.lit(base + place[1:])).otherwise(F.concat("root", F.lit(place[1:]))), "/e/memory/", F.concat(F.lit("/"), paths.encode_path(F.col("root")), F.lit("/memory/"))
    )
    asked = projects.select("project", "root", F.explode(F.array(*[F.struct(F.lit(k).alias("order_no"), F.lit(key).alias("source"), fill(place).alias("path"), F.lit(folder).alias("is_folder")) for k, (key, _, place, folder) in enumerate(GLOBAL_SOURCES)])).alias("s")).select("project", "root", "s.*")
    plain = texts.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "text")
    head = F.array_join(F.slice(F.split("text", "\n"), 1, MEMORY_LINES), "\n")
    sized = plain.select("path", F.length("text").cast("long").alias("chars"), F.length(head).cast("long").alias("head_chars"))
    single = sized.select("path", "chars", "head_chars", F.lit(1).cast("long").alias("files"))
    above = sized.where(F.col("path").endswith(".md")).select(F.explode(paths.ancestors(F.col("path"))).alias("path"), "chars").groupBy("path").agg(F.sum("chars").alias("chars"), F.count("*").alias("files"))
    files = asked.where("not is_folder").join(single, "path", "left").withColumn("chars", F.when(F.col("source") == "auto-memory", F.col("head_chars")).otherwise(F.col("chars"))).drop("head_chars")
    every = files.unionByName(asked.where("is_folder").join(above, "path", "left"))
    joined = F.col("chars") + F.greatest(F.col("files") - 1, F.lit(0))
    there = F.col("files").isNotNull()
    return every.select("project", "root", "order_no", "source", "path", there.alias("exists"), F.coalesce("chars", F.lit(0)).alias("chars"), F.coalesce(F.ceil(joined / 4).cast("long"), F.lit(0)).alias("tokens"))


def global_notes(sources: DataFrame, by: list[str]) -> DataFrame:
    """sources (.., source, path, tokens) as what injections() takes everywhere: unknown sizes (null) count with a default, empty and missing ones don't enter."""
    tokens = F.coalesce("tokens", F.lit(DEFAULT_NOTE_TOKENS)).cast("long")
    order = F.coalesce(*[F.when(F.col("source") == key, k - len(GLOBAL_SOURCES)) for k, (key, *_) in enumerate(GLOBAL_SOURCES)], F.lit(-1))
    return sources.select(*by, F.lit("claude-md").alias("category"), F.col("path").alias("what"), tokens.alias("tokens"), F.lit(1).cast("long").alias("n"), order.cast("long").alias("order_no")).where("tokens > 0")


def note_tracker(groups: DataFrame, found: DataFrame, by: list[str], corrections: DataFrame | None = None) -> DataFrame:
    """(.., group, new_count, count, tokens, percent, new_count_after, count_after, tokens_after, percent_after): notes in the context of each group.

    groups have input, the tokens of their reply; percent is what the notes take of them
    (0 without any). found are the notes' injections, with estimates. corrections
    (what, tokens, at) are readings of single notes as they come in: the latest by at
    counts; a note whose reading is null or not above 0 isn't there and leaves all groups.
    Notes without a reading keep their estimates. Both versions come from the same spans,
    so a correction changes sums and no list.
    """
    notes = found.where("category = 'claude-md'")
    if corrections is None:
        corrections = found.sparkSession.createDataFrame([], "what string, tokens long, at long")
    reading = corrections.groupBy("what").agg(F.max_by(F.struct(F.col("tokens").cast("long").alias("v")), "at").alias("_r"))
    merged = notes.join(reading, "what", "left").withColumn("_after", F.when(F.col("_r").isNull(), F.col("tokens")).otherwise(F.coalesce("_r.v", F.lit(0))))
    per = merged.groupBy(*by, "group").agg(F.sum("tokens").alias("_t"), F.count("*").alias("_c"), F.sum("_after").alias("_ta"), F.count_if(F.col("_after") > 0).alias("_ca"))
    each = groups.select(*by, "phase", "group", "place", "input").join(per, [*by, "group"], "left").na.fill(0, ["_t", "_c", "_ta", "_ca"])
    upto = Window.partitionBy(*by, "phase").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = lambda c: F.sum(c).over(upto).cast("long")

    def share(c: str) -> Column:
        return F.when(F.col("input") > 0, run(c) / F.col("input") * 100).otherwise(F.lit(0.0))

    return each.select(*by, "group", F.col("_c").alias("new_count"), run("_c").alias("count"), run("_t").alias("tokens"), share("_t").alias("percent"), F.col("_ca").alias("new_count_after"), run("_ca").alias("count_after"), run("_ta").alias("tokens_after"), share("_ta").alias("percent_after"))
