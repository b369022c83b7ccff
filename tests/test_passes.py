"""Ordered passes, interval joins, threads and line differences against plain Python, also at sizes where a wrong plan shows."""

import random
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.functions import diff
from tracewell.operators import links, ordered, rules, sessions


def plain_anchors(rows, width):
    out, last = [], {}
    for key, t in sorted(set(rows), key=lambda r: (str(r[0]), r[1])):
        if key not in last or t - last[key] >= width:
            last[key] = t
        out.append((key, t, last[key]))
    return sorted(out, key=str)


@pytest.mark.parametrize(("width", "batch"), [(1, "7"), (100, "3"), (100, "10000"), (10**15, "5")])
def test_anchors(spark, width, batch):
    r = random.Random(width)
    rows = [(r.choice(["a", "b", None, "c"]), r.randrange(-500, 1500)) for _ in range(300)] + [("far", 9 * 10**17), ("far", -9 * 10**17)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        points = spark.createDataFrame(rows, "k string, t long")
        got = [tuple(x) for x in ordered.anchored(points.distinct(), ["k"], "t", width).collect()]
        assert sorted(got, key=str) == plain_anchors(rows, width)
        assert ordered.with_anchor(points, ["k"], "t", width).count() == len(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_parallel_groups_of_one_long_session(spark):
    """A million starts of one session: 0.1 s apart in runs of 25, so each run breaks into windows from its first start."""
    n = 1_000_000
    rows = spark.range(n).select(F.lit("s").alias("session"), F.col("id").cast("string").alias("id"), (F.expr("id div 25") * 5000 + F.col("id") % 25 * 30).alias("ts_ms"))
    began = time.time()
    groups = sessions.parallel_groups(rows)
    sizes = {(r.n, r["count"]) for r in groups.groupBy("n").count().collect()}
    # 25 starts 30 ms apart: four in each window of 100 ms, and one is left.
    assert sizes == {(4, n // 25 * 6), (1, n // 25)}
    assert time.time() - began < 120


def test_throttle_and_suppression(spark):
    rows = [(i, "p", "m", t, None) for i, t in enumerate([0, 10, 4999, 5000, 5000, 9999, 10_000])] + [(20, "p", "other", 1, None), (21, "p", "m", None, None), (22, None, "m", 5, None), (23, None, "m", 6, None), (24, "p", "m", 12_000, "r")]
    alerts = spark.createDataFrame(rows, "id long, project string, message string, ts_ms long, repository string")
    shown = {r.id for r in rules.throttled(alerts).where("is_shown").collect()}
    assert shown == {0, 3, 6, 20, 22}
    settings = rules.Notifications(snoozed_until_ms=10, ignored_repositories=["r"], ignored_patterns=["^OTH", "(", "[a-"])
    got = {r.id: r.suppressed_by for r in rules.suppressed(alerts, settings).collect()}
    assert got == {0: "snoozed", 1: None, 2: "throttled", 3: "throttled", 4: "throttled", 5: None, 6: "throttled", 20: "snoozed", 21: "throttled", 22: "snoozed", 23: "snoozed", 24: "repository"}
    assert {r.suppressed_by for r in rules.suppressed(alerts, rules.Notifications(enabled=False)).collect()} == {"disabled"}


def test_patterns_are_compiled_where_they_run(spark):
    assert rules.compiles(spark, "a+") and not rules.compiles(spark, "(a") and not rules.compiles(spark, "(?P<n>a)")  # Python's own form
    assert rules.rule_table(spark, [rules.Rule("r", "r", "tool_use", pattern="(?P<n>a)")]).count() == 0


@pytest.mark.parametrize("closed", ["both", "left", "neither"])
def test_in_interval(spark, closed):
    r = random.Random(4)
    points = [(r.choice("ab"), i, r.randrange(1000)) for i in range(200)] + [("a", 900, None), ("c", 901, 5)]
    spans = []
    for i in range(80):
        a = r.randrange(1000)
        spans.append((r.choice("ab"), i, a, r.choice([a, a + r.randrange(1, 9), a + r.randrange(300), None, a - 5])))
    spans += [("a", 500, None, 7), ("b", 501, 0, 10**12), ("d", 502, 0, None), ("a", 503, -5, None)]
    p, s = spark.createDataFrame(points, "k string, p long, ts long"), spark.createDataFrame(spans, "k string, s long, start long, end long")
    low = (lambda t, a: t > a) if closed == "neither" else (lambda t, a: t >= a)
    high = (lambda t, b: t <= b) if closed == "both" else (lambda t, b: t < b)
    want = sorted((x, y) for k, x, t in points for j, y, a, b in spans if k == j and t is not None and a is not None and low(t, a) and (b is None or high(t, b)))
    assert sorted((x.p, x.s) for x in links.in_interval(p, s, ["k"], closed).collect()) == want
    as_time = lambda df, *cs: df.select(*[F.timestamp_micros(c).alias(c) if c in cs else F.col(c) for c in df.columns])
    got = links.in_interval(as_time(p, "ts"), as_time(s, "start", "end"), ["k"], closed).collect()
    assert sorted((x.p, x.s) for x in got) == want
    assert links.in_interval(p, s.limit(0), ["k"], closed).count() == 0


def test_interval_join_of_one_long_session(spark):
    """100,000 points and 10,000 spans of one session: all pairs would be 10^9."""
    p = spark.range(100_000).select(F.lit("s").alias("k"), F.col("id").alias("p"), (F.col("id") * 10).alias("ts"))
    s = spark.range(10_000).select(F.lit("s").alias("k"), F.col("id").alias("s"), (F.col("id") * 100).alias("start"), F.when(F.col("id") < 9_999, F.col("id") * 100 + 100).alias("end"))
    joined = links.in_interval(p, s, ["k"], "left")
    assert "_bucket" in joined._jdf.queryExecution().optimizedPlan().toString()
    began = time.time()
    assert joined.groupBy("s").count().groupBy("count").count().collect() == [(10, 10_000)]
    assert time.time() - began < 60


def test_responses_by_time_and_by_order(spark):
    rows = [("s", 0, 5, True, False, "assistant"), ("s", 1, 10, True, False, "user"), ("s", 2, 10, False, True, "assistant"), ("s", 3, 12, False, True, "assistant"), ("s", 4, 20, True, False, "user"), ("s", 5, 20, True, False, "user"), ("s", 6, 20, False, True, "assistant"), ("s", 7, 15, False, True, "assistant"), ("s", 8, 30, False, False, "user"), ("s", 9, 31, False, True, "assistant"), ("q", 1, 3, False, True, "assistant")]
    df = spark.createDataFrame(rows, "session string, pos long, ts long, is_user boolean, is_response boolean, type string")
    assert {(r.pos, r.turn, r.user_pos) for r in links.responses(df).collect()} == {(3, 1, 1), (7, 1, 1), (9, 3, 5)}
    assert {(r.pos, r.user_pos) for r in links.responses_in_order(df).collect()} == {(2, 1), (3, 1), (6, 5), (7, 5), (9, 8)}


def plain_tree(rows):
    """Depth, root and descendants by walking up; None on or below a cycle."""
    parent = {(k, n): p for k, n, p in rows}
    up, cyclic = {}, set()
    for k, n in parent:
        chain, x = [], n
        while x is not None and (k, x) in parent and x not in chain:
            chain.append(x)
            x = parent[k, x]
        if x is not None and (k, x) in parent:
            cyclic.add((k, n))
        up[k, n] = chain
    return up, cyclic


def test_thread_tree(spark):
    r = random.Random(6)
    rows = [(k, n, r.choice([None, r.randrange(n) if n else None, r.randrange(n) if n else None, n - 1 if n else None])) for k in ("a", "b") for n in range(60)]
    rows += [("c", 1, 2), ("c", 2, 3), ("c", 3, 1), ("c", 4, 3), ("c", 5, 5), ("c", 6, 99), ("c", 7, 6)]
    df = spark.createDataFrame(rows, "session string, node long, parent long")
    tree = links.thread_tree(df, ["session"])
    got = {(x.session, x.node): x for x in tree.collect()}
    up, cyclic = plain_tree(rows)
    assert set(got) == set(up) and {k for k, x in got.items() if x.on_cycle} == cyclic
    for k, x in got.items():
        if k in cyclic:
            assert x.root is None and x["first"] is None
        else:
            assert (x.root, x.depth) == (up[k][-1], len(up[k]) - 1)
            below = {n for (s, n), chain in up.items() if s == k[0] and k[1] in chain[1:] and (s, n) not in cyclic}
            inside = {n for (s, n), y in got.items() if s == k[0] and y.root == x.root and x["first"] < (y["first"] or 1) < x["last"]}
            assert below == inside
    members = links.thread_members(tree, df.where("node % 7 = 3"), ["session"]).collect()
    want = {(k, n, x, "ancestor" if i else "self") for (k, n), chain in up.items() if n % 7 == 3 and (k, n) not in cyclic for i, x in enumerate(chain)}
    want |= {(k, x, n, "descendant") for (k, n), chain in up.items() if (k, n) not in cyclic for x in chain[1:] if x % 7 == 3}
    assert {(m.session, m["of"], m.node, m.relation) for m in members} == want and len(members) == len(want)


def test_thread_tree_of_a_long_chain(spark):
    n = 100_000
    tree = links.thread_tree(spark.range(n).select(F.lit("s").alias("session"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent")), ["session"])
    assert tree.agg(F.max("depth"), F.countDistinct("root"), F.count_if("on_cycle"), F.max(F.expr("last - first"))).first() == (n - 1, 1, 0, 2 * n - 1)


def matrix_diff(old, new):
    best = np.zeros((len(old) + 1, len(new) + 1), int)
    for i, x in enumerate(old):
        for j, y in enumerate(new):
            best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
    i, j, out = len(old), len(new), []
    while i or j:
        if i and j and old[i - 1] == new[j - 1]:
            i, j = i - 1, j - 1
            out.append(("context", old[i]))
        elif j and (not i or best[i, j - 1] >= best[i - 1, j]):
            j -= 1
            out.append(("added", new[j]))
        else:
            i -= 1
            out.append(("removed", old[i]))
    return out[::-1]


def test_diff_is_that_of_the_matrix():
    r = random.Random(8)
    for _ in range(300):
        old, new = ([r.choice("abcd") for _ in range(r.randrange(40))] for _ in range(2))
        # The shared head is set apart first, as the library does; the rest goes back through the matrix.
        head = 0
        while head < min(len(old), len(new)) and old[head] == new[head]:
            head += 1
        assert diff.diff_lines(old, new) == [("context", x) for x in old[:head]] + matrix_diff(old[head:], new[head:])


def test_diff_of_20000_lines_in_little_memory():
    r = random.Random(1)
    old = [str(r.randrange(5000)) for _ in range(20_000)]
    new = [x for x in old if r.random() > 0.3] + [str(r.randrange(5000)) for _ in range(6000)]
    tracemalloc.start()
    d = diff.diff_lines(old, ["first", *new])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200_000_000
    assert [x for k, x in d if k != "added"] == old and [x for k, x in d if k != "removed"] == ["first", *new]
