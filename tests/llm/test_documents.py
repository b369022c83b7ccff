"""Operators on documents against plain Python, on small tables with odd rows."""

import collections
import random
import re
import zlib

import pyarrow as pa
import pytest

from tracewell.llm import cotraining, hilbert, hyperminhash, line_runs, ngram_rules, packing, tiling
from tracewell.llm import words as W

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep string, key string, n long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
random.seed(7)
VOCABULARY = [f"w{i}" for i in range(300)] + ["Über", "naïve", "日本", "don't", "a,b"]


def sentence(n):
    return " ".join(random.choice(VOCABULARY) for _ in range(n))


def texts():
    base = [sentence(random.randint(30, 120)) for _ in range(40)]
    near = [" ".join(w if random.random() > 0.02 else "zz" for w in t.split(" ")) for t in base[:20]]
    lines = [sentence(30) for _ in range(6)]
    runs = ["\n".join([sentence(8), *lines[:3], "", lines[3], sentence(9)]) for _ in range(4)] + ["\n".join(lines), "\n".join([lines[2], lines[1]])]
    odd = [None, "", "   \n\t", "one", "one two", "a b c", "a b c", "x " * 500, "\n".join(["same line here"] * 9), sentence(4000), "é \x00 \x1c z", "İ ﬁ Σ"]
    return base + near + base[:5] + runs + odd


@pytest.fixture(scope="module")
def data():
    rows = [(i, t, random.choice(["en", "de", None]), random.choice(["s1", "s2", "long-source-name"]), None if t is None else len(t), "r", "k", i) for i, t in enumerate(texts())]
    return [*rows, (None, "no id at all", None, None, None, None, None, None), rows[3], rows[3]]


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(t):
    return WORD.findall(t or "")


def test_words_of_blocks(data):
    column = pa.array([r[1] for r in data])
    got = []
    for block in W.blocks(column, 500):
        starts, ends, doc = block.words()
        raw = block.data.tobytes()
        per = collections.defaultdict(list)
        for a, b, d in zip(starts, ends, doc, strict=True):
            per[d].append(raw[a:b].decode())
        got += [per[i] for i in range(len(block))]
        h = W.span(block.sums(False), starts, ends)
        by_word = {}
        for a, b, x in zip(starts, ends, h, strict=True):
            assert by_word.setdefault(raw[a:b], x) == x
        assert len(set(by_word.values())) == len(by_word)
    assert got == [words_of(r[1]) for r in data]


def counts(t):
    t = t or ""
    w = words_of(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    times = collections.Counter(windows)
    inside = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(inside)


def test_quality_rules(spark, docs, data, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(31, 0, 0), (32, 1, 1), (None, 1, 0), (33, None, None)], "doc_id long, quality int, toxic int")
    got = ngram_rules.quality_rules(docs, labels).collect()
    want = collections.Counter((r[0], *counts(r[1])) for r in data)
    assert collections.Counter((r.doc_id, *(r[c] for c in ngram_rules.COUNTS)) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.score >= -0.06)
    # The score against a plain count of buckets.
    table = ngram_rules.ratios(ngram_rules.bucket_counts(docs, ngram_rules.trusted_sample(labels, 1000)).collect())
    total = [collections.Counter(), collections.Counter()]
    per = {}
    for doc_id, t, *_ in data:
        for block in W.blocks(pa.array([t])):
            _, _, doc, h = ngram_rules.words_of(block)
            f, _ = ngram_rules.features(h, doc)
            per[doc_id, t] = f
            total[0].update(f.tolist())
            if doc_id is not None and doc_id < 30:
                total[1].update(f.tolist())
    import math

    n, m = sum(total[0].values()), sum(total[1].values())
    for b in list(total[0])[:200]:
        assert table[b] == pytest.approx(math.log((total[1][b] + 1) / (m + ngram_rules.BUCKETS)) - math.log((total[0][b] + 1) / (n + ngram_rules.BUCKETS)))
    scores = {r.doc_id: r.score for r in got}
    for (doc_id, _), f in per.items():
        assert scores[doc_id] == pytest.approx(sum(table[x] for x in f) / max(1, len(f)))
    assert ngram_rules.quality_rules(empty, labels).count() == 0
    assert {r.score for r in ngram_rules.quality_rules(docs, labels.limit(0)).collect()} == {0.0}


def shingles(t, n):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words_of(t)]
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, data, empty, n, percent):
    got = {(r.doc_id): (r.n_shingles, r.component_id, r.kept) for r in hyperminhash.near_duplicates(docs, n, percent / 100).collect()}
    sets = {r[0]: shingles(r[1], n) for r in data if r[0] is not None}
    label = {d: d for d in sets}
    for _ in range(len(sets)):
        before = dict(label)
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    assert {d: v for d, v in got.items() if d is not None} == {d: (len(sets[d]), label[d], label[d] == d) for d in sets}
    assert got[None][1:] == (None, True)
    assert hyperminhash.near_duplicates(empty).count() == 0


def test_components(spark):
    from tracewell.llm.components import connected_components

    rng = random.Random(8)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 250 + i) for i in range(20)] + [(7, 7), (None, 3)]
    label = {n: n for e in edges for n in e if None not in e and e[0] != e[1]}
    for _ in range(100):
        for a, b in edges:
            if a is not None and a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == label
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def components_of(made, n, percent):
    sets = {i: shingles(t, n) for i, t in made}
    label = {d: d for d in sets}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) > 0]
    for _ in range(len(made)):
        before = dict(label)
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label
    return label


def test_large_group_of_near_copies(spark, monkeypatch):
    """Copies that differ from a hidden centre, most of them from each other as well: no link is lost across blocks."""
    rng = random.Random(3)
    centre = [f"c{i}" for i in range(150)]
    made = []
    for i in range(120):
        t = list(centre)
        for _ in range(rng.randint(1, 9)):
            t[rng.randrange(len(t))] = f"x{rng.random()}"
        made.append((i, " ".join(t)))
    monkeypatch.setattr(hyperminhash, "BLOCK", 16)
    docs = spark.createDataFrame(made, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in hyperminhash.near_duplicates(docs, 3, 0.85).collect()} == components_of(made, 3, 85)


def test_links_beside_a_shared_passage(spark):
    """20,000 documents that share a passage but are no copies, with some true pairs among them: band values of thousands, and no pairs of all of them."""
    passage = " ".join(f"p{i}" for i in range(40))
    made = [(i, f"{passage} " + " ".join(f"d{i}x{k}" for k in range(24))) for i in range(20_000)]
    made += [(100_000 + i, made[i][1] + " more") for i in range(0, 20_000, 400)]
    got = hyperminhash.near_duplicates(spark.createDataFrame(made, "doc_id long, text string").repartition(8), 5, 0.8)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: i % 100_000 for i, _ in made}


def test_recall_by_size_and_similarity():
    """The share of pairs that have a band in common, for sets of 4 to 2,000 shingles just above the threshold."""
    import numpy as np

    rng = np.random.default_rng(5)
    for threshold, sizes in ((0.8, (4, 8, 12, 40, 120, 300, 2000)), (0.85, (6, 17, 60, 200, 2000))):
        for n in sizes:
            both = int(np.ceil(n * threshold - 1e-9)) if n < 20 else int(np.ceil(2 * n * threshold / (1 + threshold)))
            m = n + 1 if n < 20 else n
            both = n if n < 20 else both
            if n < 20 and n / m < threshold:
                continue
            found, tries = 0, 400 if n < 500 else 60
            for _ in range(tries):
                u = rng.permutation(rng.integers(0, 2**64 - 1, n + m - both, dtype=np.uint64))
                a, b = (np.ascontiguousarray(hyperminhash.registers([np.sort(x)])).view(np.uint64) for x in (u[:n], u[n - both :]))
                found += bool((hyperminhash.band_keys(a) == hyperminhash.band_keys(b)).any())
            assert found >= 0.995 * tries, (threshold, n)


def test_dense_registers():
    import numpy as np

    rng = np.random.default_rng(6)
    for n in (1, 3, 50, 5000):
        regs = hyperminhash.registers([np.sort(rng.integers(0, 2**64 - 1, n, dtype=np.uint64))])
        assert (regs != hyperminhash.EMPTY).all() and len(set(regs[0].tolist())) <= n
    assert (hyperminhash.registers([np.zeros(0, np.uint64)]) == hyperminhash.EMPTY).all()


def test_short_near_copies_are_linked(spark):
    """Texts of eight words and the same with a ninth: four of five shingles."""
    made = []
    for i in range(1500):
        t = " ".join(f"p{i}w{k}" for k in range(9))
        made += [(2 * i, t), (2 * i + 1, t.rsplit(" ", 1)[0])]
    got = hyperminhash.near_duplicates(spark.createDataFrame(made, "doc_id long, text string"), 5, 0.8)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: i - i % 2 for i, _ in made}


def test_estimate_follows_jaccard():
    import numpy as np

    rng = np.random.default_rng(1)
    for j in (0.5, 0.8, 0.95):
        size, both = 4000, int(4000 * 2 * j / (1 + j))
        u = rng.integers(0, 2**63, 2 * size - both, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        regs = hyperminhash.registers([np.unique(u[:size]), np.unique(u[size - both :])])
        got = hyperminhash.estimate(regs[:1], regs[1:], np.array([size]), np.array([size]))[0]
        assert abs(got - j) < 0.15
        for small in (5, 20, 80):
            both = int(small * 2 * j / (1 + j))
            v = rng.integers(0, 2**64 - 1, 2 * small - both, dtype=np.uint64)
            regs = hyperminhash.registers([np.sort(v[:small]), np.sort(v[small - both :])])
            got = hyperminhash.estimate(regs[:1], regs[1:], np.array([small]), np.array([small]))[0]
            assert got >= hyperminhash.margin(np.array([small]), both / (2 * small - both))[0]


def test_line_dedup(docs, data, empty):
    """Against a plain search for runs that stand earlier; lines are kept by their own rule, so short repeats stay."""
    got = collections.Counter((r.doc_id, r.text, r.n_lines_removed) for r in line_runs.dedup_lines(docs).collect())
    plain = {}
    for r in data:
        if r[1] is not None:
            plain[-1 if r[0] is None else r[0], r[1]] = [(i, x) for i, x in enumerate(r[1].split("\n")) if WORD.search(x)]
    places = [(k, i) for k in plain for i in range(len(plain[k]))]
    gone = {k: set() for k in plain}
    for k, i in places:
        for k2, i2 in places:
            if (k2[0], i2) < (k[0], i):
                n = words = 0
                while i + n < len(plain[k]) and i2 + n < len(plain[k2]) and plain[k][i + n][1] == plain[k2][i2 + n][1]:
                    words += len(words_of(plain[k][i + n][1]))
                    n += 1
                if words >= 50:
                    gone[k] |= set(range(i, i + n))
    want = collections.Counter()
    for r in data:
        if r[1] is None:
            want[r[0], None, 0] += 1
            continue
        k = (-1 if r[0] is None else r[0], r[1])
        cut, run = set(), None
        for i in range(len(plain[k])):
            if i in gone[k]:
                cut |= set(range(plain[k][i - 1][0] + 1 if i - 1 in gone[k] else plain[k][i][0], plain[k][i][0] + 1))
        want[r[0], "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in cut), len(gone[k])] += 1
    assert got == want
    assert any(n for _, _, n in want)
    assert line_runs.dedup_lines(docs).columns == [*docs.columns, "n_lines_removed"]
    assert line_runs.dedup_lines(empty).count() == 0


def test_line_dedup_with_clashing_names(spark):
    lines = "\n".join(f"a line of seven words with {i}" for i in range(9))
    names = ["doc", "th", "_spans", "spans", "removed", "row", "n_lines_removed", "a", "b", "seq", "pos", "N"]
    docs = spark.createDataFrame([(i, t, *[f"{c}{i}" for c in names]) for i, t in enumerate([lines, f"x\n{lines}\ny", None, ""])], ", ".join(["doc_id long", "text string", *[f"`{c}` string" for c in names]]))
    got = line_runs.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines_removed_1"]
    rows = {r.doc_id: r for r in got.collect()}
    assert [(rows[i].text, rows[i].n_lines_removed_1) for i in range(4)] == [(lines, 0), ("x\ny", 9), (None, 0), ("", 0)]
    assert all(rows[i][c] == f"{c}{i}" for i in range(4) for c in names)


def test_decontamination(spark, docs, data):
    item = [f"t{i}" for i in range(40)]
    tests = spark.createDataFrame([(1, " ".join(item)), (2, "Short, one here"), (3, None), (4, ""), (None, "w1 w2"), (5, " ".join(item[:20]) + " " + sentence(30))], "item_id long, text string")
    planted = {
        9001: "pre fix " + " ".join(item) + " post fix",
        9002: " ".join(item[20:]).upper() + " between " + " ".join(item[:20]),  # reordered, other case
        9003: " ".join(item[:25]),  # five eighths only
        9004: " ".join(x for w in item for x in (w, "and")),  # no five in a row
        9005: "so SHORT one, here it is",
    }
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(planted.items()), "doc_id long, text string"))
    found = tiling.contamination(more, tests, block_bytes=150).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(9001, 1), (9002, 1), (9005, 2)}
    assert {r.doc_id: r.n_tiles for r in found}[9002] == 2
    for r in found:
        assert r.coverage >= 0.8 and sum(t.length for t in r.tiles) <= 40
    kept = tiling.decontaminate(more, tests)
    assert kept.count() == len(data) + 2 and kept.columns == ["doc_id", "text"]
    assert tiling.contamination(more, tests.limit(0)).count() == 0
    assert tiling.contamination(more.limit(0), tests).count() == 0


def plain_tiles(a, b, least):
    """Greedy string tiling by its definition: of all unmarked matches the longest, ties by place, until none of least tokens is left."""
    in_a, in_b, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for p in range(len(a)):
            for t in range(len(b)):
                n = 0
                while p + n < len(a) and t + n < len(b) and a[p + n] == b[t + n] and p + n not in in_a and t + n not in in_b:
                    n += 1
                best = min(best, (-n, p, t))
        n, p, t = -best[0], best[1], best[2]
        if n < least or n == 0:
            return sorted(out)
        in_a |= set(range(p, p + n))
        in_b |= set(range(t, t + n))
        out.append((p, t, n))


@pytest.mark.parametrize("pairs", [3, 1_000_000])
def test_tiles_equal_plain_greedy_tiling(monkeypatch, pairs):
    import numpy as np

    monkeypatch.setattr(tiling, "PAIRS", pairs)
    rng = random.Random(3)
    some = lambda n, letters: np.array([rng.randrange(letters) for _ in range(n)], np.uint64)
    for letters in (1, 2, 3, 6):
        items = [some(rng.randint(1, 14), letters) for _ in range(6)]
        texts = [some(rng.randint(0, 30), letters) for _ in range(12)] + [np.concatenate([items[0][5:], items[1], items[0][:5]])]
        own = tiling.Tests(list(range(6)), items, 3)
        doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        found = own.matches(np.concatenate(texts), doc)
        for d, text in enumerate(texts):
            for i, item in enumerate(items):
                least, runs = min(3, len(item)), found.get((d, i))
                got = []
                if runs:
                    runs.t = runs.t - at[d]
                    got = tiling.tile(item, text, runs, least)
                assert sorted(got) == plain_tiles(item, text, least)


def test_repeated_tokens_make_one_run_a_diagonal():
    import time

    import numpy as np

    own = tiling.Tests([1], [np.full(200, 7, np.uint64)], 5)
    begin = time.perf_counter()
    runs = own.matches(np.full(50_000, 7, np.uint64), np.zeros(50_000, np.int64))[0, 0]
    assert len(runs.p) == 50_000 + 200 - 2 * 5 + 1
    assert tiling.tile(own.tokens[0], np.full(50_000, 7, np.uint64), runs, 5) == [(0, 0, 200)]
    assert time.perf_counter() - begin < 20


def test_packing(docs, data, empty):
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(packing.vocabulary("word_bpe_49k.json"))
    got = packing.pack(docs).collect()
    want = {(r[0], r[1]): [*own.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in data}
    rows = collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got)
    expected = collections.Counter()
    for r in data:
        ids = want[r[0], r[1]]
        for s in range(0, len(ids), 2048):
            part = ids[s : s + 2048]
            expected[r[0], s, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)), len(ids)] += 1
    assert rows == expected
    per = collections.defaultdict(list)
    for r in got:
        per[r.sequence_id].append((r.offset, r.length))
    for pieces in per.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(per) == list(range(len(per)))
    assert packing.pack(empty).count() == 0


def test_token_ids_of_odd_texts():
    from tokenizers import Tokenizer

    text = packing.vocabulary("word_bpe_49k.json")
    own, ids_of = Tokenizer.from_str(text), packing.Ids(text, most=50)
    rng = random.Random(1)
    odd = ["".join(rng.choice("ab'S ,.<|>éΣ́\x00\x1c  1\n") for _ in range(rng.randint(0, 40))) for _ in range(500)] + ["it's 'store <|endoftext|>x<|startoftext|>,y", "x" * 3000]
    got = []
    for block in W.blocks(pa.array(odd), 700):
        ids, at = ids_of(block)
        got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == [own.encode(t, add_special_tokens=False).ids for t in odd]


def test_token_ids_of_tokenizers_that_keep_case_and_space():
    from tokenizers import Tokenizer

    text = packing.vocabulary("byte_bpe_50k.json")
    own, ids_of = Tokenizer.from_str(text), packing.Ids(text)
    odd = ["The Cat  sat", "the cat\n\nSAT", "", "naïve É 日本", " x"]
    got = []
    for block in W.blocks(pa.array(odd), 20):
        ids, at = ids_of(block)
        got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == [own.encode(t, add_special_tokens=False).ids for t in odd]


def test_least_squares_meet_the_conditions_of_the_least():
    import numpy as np

    rng = np.random.default_rng(2)
    combos, counts = packing.combinations(12), np.concatenate([[0], rng.integers(0, 900, 12)])
    x = packing.nnls(combos, counts, sweeps=20_000)
    weight = 1.0 + np.arange(13) / 13
    takes = np.array([[combo.count(c) for c in range(13)] for combo in combos], float)
    slope = takes @ (weight * (takes.T @ x - counts))
    assert (x >= 0).all() and (slope > -2).all() and (np.abs(slope[x > 1]) < 2).all()


def test_plan_takes_each_piece_once():
    rng = random.Random(5)
    for counts in ({}, {1: 7}, {256: 3}, {200: 10, 56: 4, 30: 100}, {rng.randint(1, 256): rng.randint(1, 5000) for _ in range(200)}):
        made = packing.plan(counts, 256)
        used = collections.Counter()
        for combo, n in made:
            assert sum(combo) <= 256 and n > 0
            for c in combo:
                used[c] += n
        assert used == {c: n for c, n in counts.items() if n}
    full = packing.plan({c: 1000 for c in range(1, 257)}, 256)
    assert sum(n for _, n in full) <= 1000 * sum(range(1, 257)) / 256 * 1.02


def test_hilbert_is_a_curve(spark):
    """Neighbours along the curve are neighbours in the grid, and each cell has its own index."""
    from pyspark.sql import functions as F

    for dims, bits in ((2, 3), (3, 2), (1, 4)):
        side = 1 << bits
        grid = spark.range(side**dims).select(*[(F.floor(F.col("id") / side**k) % side).cast("int").alias(f"x{k}") for k in range(dims)])
        got = sorted((r.h, *r[:dims]) for r in grid.select("*", hilbert.hilbert_index([F.col(f"x{k}") for k in range(dims)], bits).alias("h")).collect())
        assert [g[0] for g in got] == list(range(side**dims))
        for a, b in zip(got[:-1], got[1:], strict=True):
            assert sum(abs(x - y) for x, y in zip(a[1:], b[1:], strict=True)) == 1


def test_sharding(docs, data, empty):
    got = hilbert.shard_by_hilbert(docs).collect()
    rows = collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got)
    assert rows == collections.Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in data)
    per = collections.defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        per[r.shard].append((r.slot, r.hilbert))
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1 and set(per) == set(range(40))
    order = [h for s in range(40) for _, h in sorted(per[s])]
    assert order == sorted(order)
    for shard in per.values():
        assert sorted(s for s, _ in shard) == list(range(len(shard)))
    assert hilbert.shard_by_hilbert(empty).count() == 0
    assert hilbert.shard_by_hilbert(docs.select("doc_id", "text")).count() == len(data)


def test_cells_of_strings_with_a_common_beginning(spark):
    rows = [(f"https://example.com/{k:03d}",) for k in range(40) for _ in range(1 + 50 * (k == 3))] + [(None,)]
    df = spark.createDataFrame(rows, "source string")
    got = {r.source: r.cell for r in df.select("source", hilbert.cells(df, ["source"])[0].alias("cell")).collect()}
    assert got.pop(None) == 0
    assert len(set(got.values())) == 40 and sorted(got, key=got.get) == sorted(got)
    few = {r.cell for r in df.select(hilbert.cells(df, ["source"], 3)[0].alias("cell")).collect()}
    assert few == set(range(8))
    assert df.limit(0).select(hilbert.cells(df.limit(0), ["source"])[0]).count() == 0


def test_write_shards(docs, data, spark, tmp_path):
    hilbert.write_shards(docs, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(data)
    # Own columns of any name come back as they were.
    names = ["shard", "slot", "size", "_id", "text_crc32", "_crc", "_size", "row", "own_id", "hilbert"]
    odd = docs.select("doc_id", "text", "lang", *[(docs["n"] + k).alias(c) for k, c in enumerate(names)])
    hilbert.write_shards(odd, str(tmp_path / "odd"))
    back = spark.read.parquet(str(tmp_path / "odd"))
    assert sorted(map(str, back.select(*odd.columns).collect())) == sorted(map(str, odd.collect()))
    assert set(back.columns) == {*odd.columns, "shard_1"}


def test_classifier_on_held_out_rows(spark, empty):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        bad = i % 4 == 0
        t = sentence(rng.randint(20, 60)) + (" awful idiot" if bad else "")
        rows.append((i, t, "en", "spam" if bad and rng.random() < 0.9 else "s1", len(t), None, None, None))
        if i < 600:
            labels.append((i, 0 if bad and i % 8 else 1, 1 if bad and not i % 8 else 0))
    rows += [(None, None, None, None, None, None, None, None), (2000, "", None, None, 0, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame([*labels, (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = cotraining.classify(docs, known)
    assert got.columns == [*docs.columns, "text_logit", "meta_logit", "quality_score", "quality_kept"]
    found = {r.doc_id: r.quality_kept for r in got.collect()}
    assert len(found) == len(rows)
    assert sum(found[i] == (i % 4 != 0) for i in range(600, 900)) >= 285
    model = cotraining.fit(docs, known, fit_rows=300)
    assert len(model.held_out_loss) == len(model.exchanged) + 1 and 0 < model.threshold <= 0.5
    assert cotraining.classify(empty, known).count() == 0
    assert cotraining.classify(docs, known.limit(0)).count() == len(rows)


def test_views_exchange_labels_both_ways_and_it_helps(spark):
    """Few labels, two reasons for bad rows, each seen by one view: what the exchange adds, on rows without labels."""
    rng = random.Random(11)
    rows, bad = [], {}
    for i in range(4000):
        bad[i] = i % 5 == 0
        mark = f" rude{rng.randint(1, 8)} rude{rng.randint(1, 8)}" if bad[i] else f" kind{rng.randint(1, 8)}"
        rows.append((i, sentence(rng.randint(20, 40)) + mark, "en", f"spam{i % 3}" if bad[i] else f"s{i % 7}", 100, None, None, None))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    known = spark.createDataFrame([(i, int(not bad[i]), 0) for i in range(0, 4000, 16)], "doc_id long, quality int, toxic int")
    alone, both = (cotraining.fit(docs, known, rounds=k, grow=100) for k in (0, 2))
    assert alone.exchanged == [] and both.exchanged and min(map(max, zip(*both.exchanged, strict=True))) > 0
    wrong = []
    for model in (alone, both):
        found = cotraining._scored(docs, ["lang", "source", "n_chars"], [model.text, model.meta]).collect()
        wrong.append(sum((r.t < 0) != bad[r.doc_id] for r in found))
    assert wrong[1] <= wrong[0]


def test_exchange_on_sample_tables(spark):
    folder = "/root/testdata/sf0.1"
    model = cotraining.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    assert all(n > 0 for n in model.exchanged[0]) and model.held_out_loss[-1] < 0.1


def test_classifier_bounds_repeats_and_keeps_own_columns(spark):
    rows = [(i, sentence(30) + (" awful" if i % 3 == 0 else ""), "x", i) for i in range(120)] + [(7, f"again {i}", "x", i) for i in range(300)] + [(None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality_kept string, m0 long")
    known = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)] * 2, "doc_id long, quality int, toxic int")
    ids, y, features = cotraining._fetch(docs, known.where("quality = 1").select("doc_id", "quality").distinct().withColumnRenamed("quality", "y"), ["m0"])
    assert len(ids) == len(set(ids.tolist())) == 40 and len(features[0]) == 40
    got = cotraining.classify(docs, known)
    assert got.columns == [*docs.columns, "text_logit", "meta_logit", "quality_score", "quality_kept_1"]
    assert collections.Counter((r.doc_id, r.text, r.quality_kept, r.m0) for r in got.collect()) == collections.Counter(rows)


def test_threshold_costs_least():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(50):
        p, y = rng.random(30), rng.integers(0, 2, 30)
        cost = lambda t: 5 * (y[p < t] == 1).sum() + (y[p >= t] == 0).sum()  # noqa: B023, E731
        t = cotraining.best_threshold(p, y)
        if 0.02 < t < 0.5:
            assert cost(t) == min(cost(x) for x in [0, *p + 1e-9])


def test_combination_leans_on_the_lesser_view():
    import numpy as np

    rng = np.random.default_rng(4)
    t, m = rng.normal(0, 3, 3000), rng.normal(0, 3, 3000)
    y = ((t > 0) & (m > 0)).astype(float)
    w = cotraining.fit_combination(t, m, y)
    assert ((cotraining.combined(w, t, m) > 0) == y).mean() > 0.97 > ((t + m > 0) == y).mean()
    assert cotraining.fit_combination(t, m, y * 0).tolist() == [0, 0, 0, 1]


def test_tuned_sample_does_not_depend_on_partitions(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    a, b = (sorted((str(r.doc_id), round(r.quality_score, 9)) for r in cotraining.classify(d, labels).collect()) for d in (docs, docs.repartition(7)))
    assert a == b
