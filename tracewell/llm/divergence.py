"""Source divergence audit: how the sources of a language differ in their words.

Each task lower-cases, splits, dictionary-encodes and groups whole Arrow batches
(pyarrow.compute) and gives partial counts of (lang, source, term). They meet in one
shuffle by (lang, term), where each task holds its shard of the terms with all of
their sources. The shards are written, and the divergences are sums over them.

For a pair of sources only the terms that both have are looked at together; the rest
follows from a histogram of each source's counts, since a term that a source lacks has
the same probability there as every other such term. All arithmetic is in integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.llm import words as W
from tracewell.llm.store import keep

#: What separates terms: all ASCII that isn't a letter.
SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
#: Distinct partial counts that a task holds before it passes them on.
HELD = 400_000
#: Pairs of sources that are looked at together.
PAIRS = 500_000


def _counts(texts: pa.Array, group: np.ndarray) -> pa.Table:
    """(group, term, n, df) of some texts, by Arrow kernels only."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=SEPARATORS)
    terms, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.not_equal(terms, "")
    coded = terms.filter(full).dictionary_encode()
    row = pa.table({"row": pc.cast(owner.filter(full), pa.int32()), "code": coded.indices})
    per_text = row.group_by(["row", "code"], use_threads=False).aggregate([([], "count_all")])
    per_text = per_text.append_column("group", pa.array(group).take(per_text["row"]))
    merged = per_text.group_by(["group", "code"], use_threads=False).aggregate([("count_all", "sum"), ([], "count_all")])
    return pa.table({"group": merged["group"], "term": coded.dictionary.take(merged["code"].combine_chunks()), "n": merged["count_all_sum"], "df": merged["count_all"]})


def partial_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): occurrences and texts, added up within a task as far as memory allows."""

    def run(batches):
        held: list[pa.Table] = []
        groups: dict[tuple[str, str], int] = {}

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by(["group", "term"], use_threads=False).aggregate([("n", "sum"), ("df", "sum")]).rename_columns(["group", "term", "n", "df"])

        def out(table: pa.Table):
            pairs = list(groups)
            lang, source = (pa.array([p[i] for p in pairs], pa.string()).take(table["group"].combine_chunks()) for i in (0, 1))
            whole = pa.table({"lang": lang, "source": source, "term": table["term"].cast(pa.string()), "n": table["n"], "df": table["df"]})
            yield from whole.to_batches(max_chunksize=50_000)

        for batch in batches:
            texts, lang, source = (pc.fill_null(batch.column(i), "") for i in range(3))
            own = np.array([groups.setdefault(p, len(groups)) for p in zip(lang.to_pylist(), source.to_pylist(), strict=True)], np.int32)
            texts = texts.cast(pa.large_string())
            for block in W.blocks(texts, 4 * W.BLOCK_BYTES):
                held.append(_counts(texts.slice(block.first, len(block)), own[block.first : block.first + len(block)]))
                if sum(t.num_rows for t in held) > HELD:
                    held = [merged()]
                    if held[0].num_rows > HELD // 2:
                        yield from out(held[0])
                        held = []
        if held:
            yield from out(merged())

    own = docs.select(*[F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")])
    return own.mapInArrow(run, "lang string, source string, term string, n long, df long")


def shards(docs: DataFrame, min_docs: int = 3) -> DataFrame:
    """(term_id, lang, term, n_lang, sources: list of (source, n)) for each term in min_docs texts of its language or more.

    One shuffle by (lang, term); a list has an entry for each source, never for each
    text. The table is written.
    """
    merged = partial_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    terms = merged.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n_lang"), F.collect_list(F.struct("source", "n")).alias("sources"))
    return keep(terms.where(F.col("df") >= min_docs).drop("df").withColumn("term_id", F.monotonically_increasing_id()), "terms")


def _p(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + v)); v is at least 1 wherever it counts."""
    wide = lambda c: c.cast("decimal(20, 0)")  # noqa: E731  counts of more than 9e9 would not fit a long here
    return F.lit(1).cast("long") + F.call_function("div", wide(n + 1) * F.lit(SCALE), wide(F.greatest(total + v, F.lit(1))))


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def group_totals(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(group_id, lang, source, n_group, n_terms, p0) for every (lang, source) that occurs: kept occurrences, kept terms of the language, and the probability of a term that the source lacks."""
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    counted = terms.select("lang", F.explode("sources").alias("s")).groupBy("lang", F.col("s.source").alias("source")).agg(F.sum("s.n").alias("n_group"))
    size = terms.groupBy("lang").agg(F.count("*").alias("n_terms"))
    found = groups.join(counted, ["lang", "source"], "left").join(size, "lang", "left").na.fill(0, ["n_group", "n_terms"])
    return keep(found.withColumn("p0", _p(F.lit(0).cast("long"), F.col("n_group"), F.col("n_terms"))).withColumn("group_id", F.monotonically_increasing_id()), "groups")


def _shared(batches):
    """For rows of (ids, p, p0) lists, one for each term: what its pairs of sources add to a pair's value beyond the histograms."""
    for batch in batches:
        ids, p, p0 = (batch.column(i) for i in range(3))
        ends = np.asarray(ids.offsets, np.int64)
        ids, p, p0 = (np.asarray(c.values) for c in (ids, p, p0))
        size = np.diff(ends)
        # An entry of a term meets all entries of that term.
        first, many = np.repeat(ends[:-1], size), np.repeat(size, size)
        entry = np.arange(ends[0], ends[-1])
        reach = np.concatenate([[0], np.cumsum(many)])
        a = 0
        while a < len(entry):
            b = max(a + 1, int(np.searchsorted(reach, reach[a] + PAIRS, "right")) - 1)
            left = np.repeat(entry[a:b], many[a:b])
            right = np.arange(len(left)) - np.repeat(reach[a:b] - reach[a], many[a:b]) + np.repeat(first[a:b], many[a:b])
            other = left != right
            left, right = left[other], right[other]
            f = lambda x, y: (x - y) * (x - y) // y
            value = f(p[left], p[right]) - f(p[left], p0[right]) - f(p0[left], p[right]) + f(p0[left], p0[right])
            found = pa.table({"a": ids[left], "b": ids[right], "value": value}).group_by(["a", "b"], use_threads=False).aggregate([("value", "sum")])
            yield from found.rename_columns(["a", "b", "value"]).to_batches()
            a = b


def _ranked(rows: DataFrame, part: str, most: int | None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    rows = rows.withColumn("rank", F.row_number().over(order))
    return (rows if most is None else rows.where(F.col("rank") <= most)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def term_report(terms: DataFrame, groups: DataFrame, most: int = 200) -> DataFrame:
    """The terms that a source has more of than its language, the most divergent first."""
    total = groups.groupBy("lang").agg(F.sum("n_group").alias("n_all"))
    each = terms.select("lang", "term", "n_lang", F.inline("sources")).join(groups.drop("group_id", "p0"), ["lang", "source"]).join(total, "lang")
    p, q = _p(F.col("n"), F.col("n_group"), F.col("n_terms")), _p(F.col("n_lang"), F.col("n_all"), F.col("n_terms"))
    both = each.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    return _ranked(both.select("lang", "source", "item", _f(F.col("p"), F.col("q")).alias("value")), "term", most)


def pair_report(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """Each source against each other source of its language: f(p, q) summed over all kept terms.

    The sum over all terms is that over a source's own terms against the other's p0, plus
    that over the other's terms against this one's p0, plus n_terms times both p0, and
    for terms that both have a correction.
    """
    own = groups.select("lang", "source", "group_id", "p0", F.col("n_group"), "n_terms")
    each = terms.select("term_id", "lang", F.inline("sources")).join(own, ["lang", "source"])
    each = each.select("term_id", "lang", "source", "group_id", "p0", _p(F.col("n"), F.col("n_group"), F.col("n_terms")).alias("p"))
    lists = each.groupBy("term_id").agg(F.collect_list(F.struct("group_id", "p", "p0")).alias("e")).where(F.size("e") > 1)
    shared = lists.select(F.col("e.group_id").alias("ids"), F.col("e.p").alias("p"), F.col("e.p0").alias("p0")).mapInArrow(_shared, "a long, b long, value long")
    histogram = keep(each.groupBy("lang", "group_id", "p").agg(F.count("*").alias("times")), "histogram")
    a = own.select("lang", "source", F.col("group_id").alias("a"), F.col("p0").alias("a0"), "n_terms")
    b = own.select("lang", F.col("source").alias("item"), F.col("group_id").alias("b"), F.col("p0").alias("b0"))
    pairs = a.join(b, "lang").where("a <> b")
    zero = _f(F.col("a0"), F.col("b0"))
    have_a = histogram.select(F.col("group_id").alias("a"), "p", "times").join(pairs, "a").select("a", "b", ((_f(F.col("p"), F.col("b0")) - zero) * F.col("times")).alias("value"))
    have_b = histogram.select(F.col("group_id").alias("b"), "p", "times").join(pairs, "b").select("a", "b", ((_f(F.col("a0"), F.col("p")) - zero) * F.col("times")).alias("value"))
    none = pairs.select("a", "b", (zero * F.col("n_terms")).alias("value"))
    value = shared.unionByName(have_a).unionByName(have_b).unionByName(none).groupBy("a", "b").agg(F.sum("value").alias("value"))
    return _ranked(pairs.join(value, ["a", "b"]).select("lang", "source", "item", "value"), "pair", None)


def audit(docs: DataFrame, min_docs: int = 3, most: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): part pair has each other source of the language, part term the source's most divergent terms.

    docs has text, lang and source; nulls count as ''. A term is a run of ASCII letters
    and characters beyond ASCII, with A-Z lower-cased; a language keeps the terms that
    min_docs of its rows have. With q the other's probability of a term (the whole
    language's in part term), in units of 1e-9, a term's value is floor((p - q)^2 / q).
    Rows that repeat count each. A source without terms takes part with counts of 0; a
    language without kept terms has pairs of value 0; an empty table gives no row.
    """
    terms = shards(docs, min_docs)
    groups = group_totals(docs, terms)
    return pair_report(terms, groups).unionByName(term_report(terms, groups, most))
