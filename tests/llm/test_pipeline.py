"""Each stage of the pipeline against a plain version of it, on its own input."""

import re

import pytest

import corpus_pipeline
from tests.llm.test_documents import WORD, shingles, words_of
from tracewell.llm import cotraining

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(name, rows before, rows after), each stage written and read again."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        done = f(spark, docs, FOLDER)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert done.columns == docs.columns
        done.write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs.collect(), after.collect()))
        docs = after
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "packing"]


def test_classifier_stage(spark, stages):
    _, before, after = stages[0]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    own = {r.doc_id: r.quality_kept for r in cotraining.classify(spark.read.parquet(f"{FOLDER}/documents.parquet"), labels).collect()}
    assert {r.doc_id for r in after} == {d for d, kept in own.items() if kept}
    good = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()}
    bad = {r.doc_id for r in labels.where("quality = 0 or toxic = 1").collect()}
    kept = {r.doc_id for r in after}
    # 87 labels only: little of the rare kinds can be learnt, and clean texts must stay.
    assert len(good & kept) >= 0.97 * len(good) and len(bad & kept) <= 0.8 * len(bad)


def test_line_stage(stages):
    _, before, after = stages[1]
    texts = {r.doc_id: [x for x in (r.text or "").split("\n") if WORD.search(x)] for r in before}
    seen, left = set(), {}
    starts = {}
    for d in sorted(texts):
        for i in range(len(texts[d])):
            for j in range(i, len(texts[d])):
                if sum(len(words_of(x)) for x in texts[d][i : j + 1]) >= 50:
                    starts.setdefault("\n".join(texts[d][i : j + 1]), (d, i))
                    break
    del seen
    for d, lines in texts.items():
        gone = set()
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                run = lines[i : j + 1]
                if sum(len(words_of(x)) for x in run) >= 50:
                    key = "\n".join(run)
                    if key in starts and starts[key] < (d, i):
                        gone |= set(range(i, j + 1))
                    break
        # Windows that end at a line, too.
        for j in range(len(lines)):
            for i in range(j, -1, -1):
                run = lines[i : j + 1]
                if sum(len(words_of(x)) for x in run) >= 50:
                    if any(d2 < d and "\n".join(run) in "\n".join(texts[d2]) and any(texts[d2][k : k + len(run)] == run for k in range(len(texts[d2]))) for d2 in texts):
                        gone |= set(range(i, j + 1))
                    break
        left[d] = [x for i, x in enumerate(lines) if i not in gone]
    got = {r.doc_id: [x for x in (r.text or "").split("\n") if WORD.search(x)] for r in after}
    assert got == {d: x for d, x in left.items() if x or not texts[d]}


def test_near_stage(stages):
    _, before, after = stages[2]
    sets = {r.doc_id: shingles(r.text, 5) for r in before}
    label = {d: d for d in sets}
    for _ in range(10):
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert {r.doc_id for r in after} == {d for d in sets if label[d] == d}


def test_decontamination_stage(spark, stages):
    _, before, after = stages[3]
    plain = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [" ".join(plain(r.text)) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in after}
    for r in before:
        whole = any(f" {i} " in f" {' '.join(plain(r.text))} " for i in items)
        assert not (whole and r.doc_id in kept)
    five = {tuple(i.split()[k : k + 5]) for i in items for k in range(len(i.split()) - 4)}
    clean = {r.doc_id for r in before if not any(tuple(plain(r.text)[k : k + 5]) in five for k in range(len(plain(r.text)) - 4))}
    assert clean <= kept


def test_packing_stage(stages):
    _, before, after = stages[4]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    per = {}
    for r in after:
        per[r.doc_id] = per.get(r.doc_id, 0) + r.length
    assert all(per[r.doc_id] == r.doc_tokens for r in after)


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, FOLDER).count() == len(stages[-1][2])


ODD = ["doc", "th", "row", "rep", "key", "c", "u", "v", "s", "h", "m0", "y", "n_shingles", "component_id", "kept", "members", "quality_kept", "n_lines_removed", "count", "item_id", "coverage", "tiles"]


def test_odd_rows_through_each_stage(spark):
    """Nulls in any column, empty and long texts, repeated rows and ids, an empty table, and extra columns with names of the operators' own."""
    rows = [r.asDict() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60).collect()]
    rows += [dict.fromkeys(rows[0]), {**rows[0], "doc_id": 900_001, "text": None}, {**rows[0], "doc_id": 900_002, "text": ""}, {**rows[0], "doc_id": 900_003, "text": " ".join(f"w{i}" for i in range(60_000))}]
    rows += [rows[5]] * 3 + [{**rows[6], "text": "another text of the same id"}]
    names = list(rows[0])
    schema = ", ".join([f"{n} {t}" for n, t in spark.read.parquet(f"{FOLDER}/documents.parquet").dtypes] + [f"`{n}` string" for n in ODD])
    docs = spark.createDataFrame([(*[r[n] for n in names], *[f"{n} of {r['doc_id']}" for n in ODD]) for r in rows], schema).repartition(3)
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            done = stage(spark, some, FOLDER)
            got = done.collect()
            if name == "packing":
                assert {r.doc_id for r in got} == {r.doc_id for r in some.collect()}
                continue
            assert done.columns == docs.columns, name
            assert all(r[n] == f"{n} of {r.doc_id}" for r in got for n in ODD), name
            kept = {r.doc_id for r in got}
            assert not some.limit(1).count() or {900_001, 900_002} <= kept or name == "quality classifier", name
            if name == "MinHash near-dedup" and got:
                assert sum(r.doc_id == rows[5]["doc_id"] for r in got) <= 1
