"""What a worker holds for a batch of texts."""

import tracemalloc

import pyarrow as pa

from tracewell.llm import cotraining, packing, words


def test_features_take_little_memory():
    """Some 4 MB of texts: the arrays of a block are made for a part of them at a time."""
    texts = [" ".join(f"w{(i * 31 + k * k) % 5000}" for k in range(400)) for i in range(1600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array(["en"] * len(texts))], ["doc_id", "text", "lang"])
    words._power("up", 1), words._power("down", 1)
    tracemalloc.start()
    n = sum(len(block) for block, _, _ in cotraining._features(batch, 2))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(texts) and peak < 30_000_000, peak


def _ids(ids_of, texts, size):
    for block in words.blocks(pa.array(texts), size):
        ids, at = ids_of(block)
        yield from (ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True))


def test_token_ids_take_little_memory():
    """Some 4 MB of texts of few words: tables for these words, arrays for a part of the texts at a time."""
    texts = [" ".join(f"w{(i * 31 + k * k) % 5000}" for k in range(400)) for i in range(1600)]
    size = getattr(packing, "TEXT_BYTES", words.BLOCK_BYTES)
    words._power("up", 1), words._power("down", 1)
    tokenizer = packing.vocabulary("word_bpe_49k.json")
    tracemalloc.start()
    n = sum(1 for _ in _ids(packing.Ids(tokenizer), texts, size))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(texts) and peak < 40_000_000, peak


def test_token_ids_while_the_tables_grow():
    from tokenizers import Tokenizer

    tokenizer = packing.vocabulary("word_bpe_49k.json")
    texts = [" ".join(f"x{(i * 37 + k) % 20_011:x}" for k in range(60)) for i in range(900)]
    told = [x.ids for x in Tokenizer.from_str(tokenizer).encode_batch(texts, add_special_tokens=False)]
    for most in (3_000, 1_000_000):
        ids_of = packing.Ids(tokenizer, most)
        for _ in range(2):
            assert list(_ids(ids_of, texts, 20_000)) == told
        assert most == 3_000 or ids_of.known > 10_000 and len(ids_of.keys) >= 4 * ids_of.known


def test_tasks_of_a_worker_share_the_token_ids():
    tokenizer = packing.vocabulary("word_bpe_49k.json")
    ids_of = packing.ids_of_worker(tokenizer)
    first = list(_ids(ids_of, ["one two", "", "three"], 20))
    assert packing.ids_of_worker(str(tokenizer.encode(), "utf-8")) is ids_of
    assert list(_ids(ids_of, ["one two", "", "three"], 20)) == first == list(_ids(packing.Ids(tokenizer), ["one two", "", "three"], 20))


def test_fit_takes_little_of_the_drivers_memory(spark):
    """4,000 labelled rows of some 400 features: what the driver's Python holds is little more than the features."""
    rows = [(i, " ".join(f"w{(i * 31 + k * k) % 5000}" for k in range(400)) + (" awful" if i % 3 == 0 else ""), "en") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    known = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(4000)], "doc_id long, quality int, toxic int")
    tracemalloc.start()
    model = cotraining.fit(docs, known, rounds=0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.text.weight.any() and peak < 40_000_000, peak


def test_fit_in_parts_adds_in_the_same_order(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 60, rng.integers(0, 30))) for _ in range(500)]
    y = np.array([float(7 in r) for r in rows])
    found = []
    for part in (1, 100, 1 << 16):
        monkeypatch.setattr(cotraining, "PART", part)
        view = cotraining.fit_linear([cotraining.sparse(rows[:300]), cotraining.sparse([]), cotraining.sparse(rows[300:])], y, rounds=40)
        cotraining.calibrate(view, cotraining.sparse(rows), y)
        found.append((view.weight.tolist(), view.bias, view.slope, view.shift))
        assert ((view.raw_of(cotraining.sparse(rows)) > 0) == y).mean() > 0.95
    assert found[0] == found[1] == found[2]
