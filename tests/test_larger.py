"""What only larger tables bring: keys with more digits, long sessions, texts with many matches."""

import random
import re

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from tests.test_oracle import rows
from tracewell.operators import links, search
from tracewell.plans import catalog


def test_tool_summary_of_keys_with_many_digits(spark, tmp_path):
    """Descriptions of 49 to 52 characters: the ones that are cut too."""
    made = [(k, n, 10**p + n, 10**q + n) for k, (p, q) in enumerate([(4, 4), (5, 4), (5, 5), (6, 4), (6, 5)]) for n in range(6)]
    spark.createDataFrame(made, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.QUERIES["tool_summary"](spark, str(tmp_path)).toPandas()
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = duck.sql(catalog.ORACLES["tool_summary"]).df()
    assert rows(got) == rows(want)
    assert got.summary.str.len().max() == 50


def test_thread_tree_locally_and_by_joins(spark):
    """Both ways say the same of sessions with repeats, cycles, missing parents, an order with gaps and a null session's neighbours."""
    r = random.Random(9)
    made = []
    for s in range(40):
        n = r.choice([1, 3, 30, 200])
        made += [(f"s{s}", f"n{k}", r.choice([None, f"n{r.randrange(n)}", f"n{k // 2}", "gone"]), r.choice([None, *range(20)])) for k in range(n) for _ in range(r.choice([1, 1, 2]))]
    # Of equal places in the order either row may count: one of each.
    made = list({(s, n, at): (s, n, p, at) for s, n, p, at in made}.values())
    df = spark.createDataFrame(made, "session string, node string, parent string, at int")
    for order in ("at", None):
        rows = df if order else df.dropDuplicates(["session", "node"])
        rows = rows.localCheckpoint()
        local = sorted(links.thread_tree(rows, ["session"], order=order).collect())
        for most in (0, 30):
            assert sorted(links.thread_tree(rows, ["session"], order=order, local_rows=most).collect()) == local
    assert any(x.on_cycle for x in local) and any((x.depth or 0) > 3 for x in local)


def test_thread_tree_in_chunks(spark):
    """Sessions that lie across batches and chunks of a task stay whole: chains of many lengths."""
    rows = spark.range(150).select(F.col("id").alias("session"), F.explode(F.sequence(F.lit(0), 20 * F.col("id"))).alias("node"))
    rows = rows.withColumn("parent", F.when(F.col("node") > 0, F.col("node") - 1)).coalesce(1)
    got = links.thread_tree(rows, ["session"]).groupBy("session").agg(F.count("*").alias("n"), F.max("depth").alias("depth"), F.max(F.expr("last - first")).alias("wide"), F.count_if(F.col("root") == 0).alias("under"))
    assert {tuple(x) for x in got.collect()} == {(k, 20 * k + 1, 20 * k, 40 * k + 1, 20 * k + 1) for k in range(150)}


def test_short_sessions_are_not_joined(spark):
    """The threads of short sessions come from one shuffle of their rows, not from joins of whole tours."""
    rows = spark.range(5000).select((F.col("id") % 50).alias("session"), F.col("id").alias("node"), F.when(F.col("id") > 49, F.col("id") - 50).alias("parent"))
    plan = links.thread_tree(rows, ["session"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_thread_members_are_not_broadcast(spark):
    """Places make small files even where they are many; the joins over them sort."""
    rows = spark.range(3000).select((F.col("id") % 30).alias("session"), F.col("id").alias("node"), F.when(F.col("id") > 29, F.col("id") - 30).alias("parent"))
    members = links.thread_members(links.thread_tree(rows, ["session"]), rows.where("node % 100 = 99"), ["session"])
    assert "BroadcastHashJoin" not in members._jdf.queryExecution().executedPlan().toString()
    assert members.count() == 30 * 100


def test_matches_are_given_out_in_small_batches():
    """A batch of texts with many matches gives many small lists of results; one long text's matches are packed as they are found."""
    texts = ["a THE b " * k for k in (0, 1, 3, 500)] * 50 + [None, "", "the" * 20_000]
    out = list(search._lists(iter([pa.array(texts)]), "the", 5, pack=1000))
    assert len(out) > 20 and max(sum(map(len, x.to_pylist())) for x in out[:-1]) < 1500
    got = [x for part in out for x in part.to_pylist()]
    assert len(got) == len(texts)
    for text, places in zip(texts, got, strict=True):
        assert [p["offset"] for p in places] == [m.start() for m in re.finditer("the", (text or "").lower())]
        assert all(text[p["offset"] : p["offset"] + 3] == p["matched"] and p["context"].strip(".") in text for p in places)


def test_hits_across_many_batches(spark):
    """Rows keep their own matches where a batch of texts gives several batches of results."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x On "), (F.col("id") % 40).cast("int")).alias("text")).coalesce(1)
    got = search.hits(docs, "on").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("offset").alias("last"), F.max("match_no").alias("no"))
    assert {tuple(r) for r in got.collect()} == {(k, k % 40, 5 * (k % 40) - 3, k % 40 - 1) for k in range(3000) if k % 40}
