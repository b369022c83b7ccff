"""Line dedup: repeated runs of lines, found in the suffix array of the line-ID sequences.

The array is built by prefix doubling and kept as its buckets: after round k the
suffixes whose first 2^k lines agree share a name, which is the rank of their
bucket up to order; as no later step uses the order between buckets, it isn't
computed. The names of round k+1 come from two names of round k, 2^k lines
apart. A window of any length between 2^k and 2^(k+1) is named by two names of
round k that overlap, so a bucket at any depth, the suffixes of an interval whose
longest common prefix is at least that depth, is one group of equal names. The
group's first place is the copy that stays.

Only lines that stand in two places or more take part: any other line ends a run.
A run counts from min_words words on. A line lies in such a run exactly if it
lies in a shortest window of min_words words that begins, or ends, at a line of
the run, so these windows are all that must be named; they have at most min_words
lines, which bounds the rounds (6 for 50 words) whatever the run's length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.llm.store import free_name, keep

WORD = r"[^\x20\x09-\x0D]+"
PLACE = ["doc", "th"]
_NO_ID = -(1 << 63)


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, th, seq, pos, nw, a, b) of each line with a word: its number among those, its number among all lines, its words, and a 128-bit name of the line."""
    text = docs.select(_doc(), F.xxhash64("text").alias("th"), "text").where("text is not null")
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    lines = text.select(*PLACE, F.posexplode(F.filter(numbered, lambda x: x["line"].rlike(WORD))).alias("seq", "x"))
    line = F.col("x.line")
    return lines.select(*PLACE, "seq", F.col("x.pos").alias("pos"), F.regexp_count(line, F.lit(WORD)).alias("nw"), F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _first_reaching(words: Column, least: int) -> Column:
    """How many of the first numbers of an array sum up to least; null if all do not."""
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("n"))
    step = lambda s, w: F.when(s["total"] >= least, s).otherwise(F.struct((s["total"] + w).alias("total"), (s["n"] + 1).alias("n")))
    return F.aggregate(words, start, step, lambda s: F.when(s["total"] >= least, s["n"]))


def repeated_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc, th, pos_from, pos_to, lines): the later copies of repeated runs of lines, merged where they touch or overlap; th is the hash of the text."""
    every = _lines(docs)
    # Written, so that the join below has two plain exchanges: a line that stands everywhere is then split over tasks.
    repeated = keep(every.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    # A row that repeats both id and text has each line twice; it is one document here.
    own = Window.partitionBy(*PLACE, "seq").orderBy("pos")
    some = keep(every.join(repeated, ["a", "b"], "left_semi"), "lines")
    some = some.repartition(*PLACE).withColumn("again", F.row_number().over(own)).where("again = 1").drop("again")
    in_order = Window.partitionBy(*PLACE).orderBy("seq")
    some = some.withColumn("island", F.col("seq") - F.row_number().over(in_order))

    run = Window.partitionBy(*PLACE, "island").orderBy("seq")
    levels = max(1, math.ceil(math.log2(min_words + 1)))
    for k in range(levels - 1):
        # A window that would leave the run has no name.
        a, b = (F.lead(f"{x}{k}" if k else x, 1 << k).over(run) for x in "ab")
        here = [F.col(f"{x}{k}" if k else x) for x in "ab"]
        some = some.withColumn("_a", a).withColumn("_b", b)
        for x, seed in (("a", 2), ("b", 3)):
            some = some.withColumn(f"{x}{k + 1}", F.when(F.col("_a").isNotNull(), F.xxhash64(F.lit(seed), *here, "_a", "_b")))
    ahead = run.rowsBetween(0, min_words - 1)
    behind = run.rowsBetween(-(min_words - 1), 0)
    some = some.withColumn("forward", _first_reaching(F.collect_list("nw").over(ahead), min_words))
    some = some.withColumn("backward", _first_reaching(F.reverse(F.collect_list("nw").over(behind)), min_words))
    names = [f"{x}{k}" if k else x for k in range(levels) for x in "ab"]
    some = keep(some.select(*PLACE, "seq", "pos", "forward", "backward", *names), "names")

    length = F.explode(F.array_distinct(F.filter(F.array(F.struct(F.col("seq").alias("start"), F.col("forward").alias("n")), F.struct((F.col("seq") - F.col("backward") + 1).alias("start"), F.col("backward").alias("n"))), lambda w: w["n"].isNotNull())))
    windows = some.select(*PLACE, length.alias("w")).select(*PLACE, "w.start", "w.n").distinct()
    level = F.length(F.bin("n")) - 1
    windows = windows.withColumn("tail", F.col("start") + F.col("n") - F.pow(F.lit(2), level).cast("int"))

    def named(df: DataFrame, at: str, out: str) -> DataFrame:
        pick = lambda x: F.element_at(F.array(*[F.col(f"{x}{k}" if k else x) for k in range(levels)]), level + 1)
        from_names = some.select(*PLACE, F.col("seq").alias(at), *names)
        return df.join(from_names, [*PLACE, at]).withColumn(f"{out}_a", pick("a")).withColumn(f"{out}_b", pick("b")).drop(*names)

    windows = keep(named(named(windows, "start", "head"), "tail", "end").select(*PLACE, "start", "n", "head_a", "head_b", "end_a", "end_b"), "windows")
    bucket = ["n", "head_a", "head_b", "end_a", "end_b"]
    place = F.struct(*PLACE, "start")
    first = keep(windows.groupBy(*bucket).agg(F.min(place).alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), "buckets")
    later = windows.join(first, bucket).where(~place.eqNullSafe(F.col("first"))).select(*PLACE, "start", (F.col("start") + F.col("n") - 1).alias("stop"))

    so_far = Window.partitionBy(*PLACE).orderBy("start", "stop")
    merged = later.withColumn("reach", F.max("stop").over(so_far.rowsBetween(Window.unboundedPreceding, -1)))
    merged = merged.withColumn("part", F.sum(F.when(F.col("start") <= F.col("reach") + 1, 0).otherwise(1)).over(so_far))
    merged = merged.groupBy(*PLACE, "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    at = some.select(*PLACE, "seq", "pos")
    spans = merged.join(at.select(*PLACE, F.col("seq").alias("start"), F.col("pos").alias("pos_from")), [*PLACE, "start"]).join(at.select(*PLACE, F.col("seq").alias("stop"), F.col("pos").alias("pos_to")), [*PLACE, "stop"])
    return spans.select(*PLACE, "pos_from", "pos_to", (F.col("stop") - F.col("start") + 1).alias("lines"))


def dedup_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """All columns of docs, the text without later copies of repeated line runs, and n_lines_removed.

    Of the places of a run of min_words words or more (lines compare by all their
    bytes; lines without a word neither count nor end a run), the first by
    (doc_id, number of the line) stays, null ids first; the others lose it, with the
    blank lines inside. A text that loses all lines becomes empty. Null texts stay
    null; rows that repeat both id and text are decided once and treated alike; rows
    that share an id only are told apart by their text. Columns of any other names
    pass unchanged; if docs has a n_lines_removed of its own, the count is the last
    column, under store.free_name(). An empty table gives an empty one.
    """
    count = free_name(docs.columns, "n_lines_removed")
    spans = repeated_runs(docs, min_words).groupBy(*PLACE).agg(F.collect_list(F.struct("pos_from", "pos_to")).alias("spans"), F.sum("lines").cast("long").alias("removed"))
    # The row travels whole in one column, so no name of its can clash with those used here.
    rows = docs.select(_doc(), F.xxhash64("text").alias("th"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = rows.join(spans, PLACE, "left")
    own = lambda c: F.col("row").getField(c)
    left = F.filter(F.split(own("text"), "\n", -1), lambda x, i: ~F.exists("spans", lambda s: (i >= s["pos_from"]) & (i <= s["pos_to"])))
    text = F.when(F.col("spans").isNull(), own("text")).otherwise(F.array_join(left, "\n"))
    return out.select(*[(text if c == "text" else own(c)).alias(c) for c in docs.columns], F.coalesce("removed", F.lit(0)).cast("long").alias(count))
