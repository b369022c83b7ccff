"""Source divergence against plain integer arithmetic over dense counts."""

import random
import re
from collections import Counter, defaultdict

from tests.llm.test_documents import SCHEMA
from tracewell.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, min_docs=3, most=200):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    data = [(r[2] or "", r[3] or "", TERM.findall(lower(r[1] or ""))) for r in rows]
    out = []
    for lang in {d[0] for d in data}:
        own = [d for d in data if d[0] == lang]
        df = Counter(w for _, _, ws in own for w in set(ws))
        terms = [w for w, n in df.items() if n >= min_docs]
        counts = defaultdict(Counter)
        for _, source, ws in own:
            counts[source].update(ws)
        whole = sum(counts.values(), Counter())

        def p(c, terms=terms):
            total = sum(c[w] for w in terms)
            return {w: 1 + 10**9 * (c[w] + 1) // (total + len(terms)) for w in terms}

        q_all = p(whole)
        ps = {s: p(c) for s, c in counts.items()}
        for s in counts:
            f = lambda a, b: (a - b) ** 2 // b
            pairs = [(o, sum(f(ps[s][w], ps[o][w]) for w in terms)) for o in counts if o != s]
            found = [(w, f(ps[s][w], q_all[w])) for w in terms if counts[s][w] and ps[s][w] > q_all[w]]
            for part, items, top in (("pair", pairs, None), ("term", found, most)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items[:top])]
    return sorted(out)


def table():
    r = random.Random(11)
    words = ["alpha", "Beta", "BETA", "étude", "日本", "İx", "ﬁ", "don't", "x1y", "Σς"] + [f"w{c}" for c in "abcdefghij"]
    rows = []
    for i in range(160):
        weights = [1 + (i % 5) * (k % 3) for k in range(len(words))]
        text = " ".join(r.choices(words, weights, k=r.randint(0, 40)))
        rows.append((i, text, r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "é", None, "src-with-a-long-name"]), 1, "r", "k", i))
    rows += [(200, None, "en", "empty source", 0, "", "", 0), (201, "solo", "xx", "one", 0, "", "", 0), (202, "", "yy", "b", 0, "", "", 0), (203, None, "yy", "a", 0, "", "", 0)]
    rows += [rows[3]] * 3 + [(300, "word " * 30_000, "en", "s1", 0, "", "", 0), (301, "\x00\x01 [] {} ~\x7f 12", "en", "s9", 0, "", "", 0)]
    return rows


def test_same_as_plain(spark, monkeypatch):
    rows = table()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == plain(rows)
    assert sorted(tuple(r) for r in divergence.audit(docs, min_docs=8, most=2).collect()) == plain(rows, 8, 2)


def test_counts_of_many_batches(spark):
    """Partial counts are passed on early where a task holds too many, and pairs come a few at a time."""
    rows = table()
    held, pairs = divergence.HELD, divergence.PAIRS
    divergence.HELD, divergence.PAIRS = 10, 7
    try:
        docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
        merged = divergence.partial_counts(docs).groupBy("lang", "source", "term").agg({"n": "sum", "df": "sum"}).collect()
    finally:
        divergence.HELD, divergence.PAIRS = held, pairs
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, df = Counter(), Counter()
    for r in rows:
        ws = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        want.update((r[2] or "", r[3] or "", w) for w in ws)
        df.update((r[2] or "", r[3] or "", w) for w in set(ws))
    assert {(r.lang, r.source, r.term): (r["sum(n)"], r["sum(df)"]) for r in merged} == {k: (n, df[k]) for k, n in want.items()}


def test_names_and_empty(spark):
    docs = spark.createDataFrame(table(), SCHEMA)
    odd = docs.select("text", "lang", "source", *[docs["n"].alias(c) for c in ("term", "df", "value", "item", "rank", "group_id", "p0")])
    assert sorted(map(tuple, divergence.audit(odd).collect())) == plain(table())
    assert divergence.audit(docs.limit(0)).count() == 0
