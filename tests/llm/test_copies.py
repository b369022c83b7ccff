"""Exact dedup against plain Python: fingerprints, long texts in parts, collisions, odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest

from tests.llm.test_documents import SCHEMA
from tracewell.llm import fingerprints as P

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def normal(t):
    return SPACES.sub(" ", t or "")


def odd_texts():
    r = random.Random(3)
    long = " ".join(r.choice(["ab", "é", "日本", "c\t\n"]) for _ in range(2000))
    spaced = re.sub(" ", " \n\t ", long)
    return [None, "", " ", "\t\n", "a b", "a\x0bb", "a  b ", "a b ", " a b", "a\x00b", "a b", "A b", long, spaced, long + "x", long[:-1] + "y", "x" * 700, "x" * 699 + "y", " " * 900, "x" * 256, "x" * 255 + " ", "x" * 255 + "  ", *["dup dup"] * 40]


@pytest.fixture(scope="module")
def rows():
    texts = odd_texts()
    out = [(i, t, "en", "s", 1, "r", "k", i) for i, t in enumerate(texts)]
    random.Random(5).shuffle(out)
    return [*out, (None, "a b", None, None, None, None, None, None), (None, "only here", None, None, None, None, None, None), (4, "a b", None, None, None, None, None, None), (4, "other", None, None, None, None, None, None)]


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(normal(r[1]), []).append(r[0])
    out = []
    for t, ids in groups.items():
        first = min(ids, key=lambda i: (i is None, i or 0))
        kept = False
        for i in ids:
            out.append((i, first, len(ids), i == first and not kept, hashlib.sha256(t.encode()).hexdigest()))
            kept |= i == first
    return sorted(out, key=str)


def test_fingerprints_compose():
    r = random.Random(1)
    for _ in range(50):
        data = bytes(r.randrange(256) for _ in range(r.randint(2, 400)))
        cut = r.randint(1, len(data) - 1)
        whole = sum(c * pow(P.base(4), i, P.P) for i, c in enumerate(data)) % P.P
        array = np.frombuffer(data, np.uint8)
        one = P.hashes(array, np.array([0, len(data)]), 4)[0]
        x, y = P.hashes(array, np.array([0, cut, len(data)]), 4)
        assert one == whole == (x + P.shifted(y, cut, 4)) % P.P


@pytest.mark.parametrize("size", [1, 2, 7, 64, 10_000])
def test_parts_are_the_normalised_text(size):
    for t in odd_texts():
        raw = (t or "").encode()
        if raw:
            parts = [p.tobytes() for p in P.parts_of(np.frombuffer(raw, np.uint8), size)]
            assert b"".join(parts).decode() == normal(t)
            assert all(len(p) == size for p in parts[:-1]) and parts[-1]


# Fingerprints of one and three bits make most rows collide; parts of 256 bytes cut the long texts.
@pytest.mark.parametrize(("bits", "part_bytes", "filter_bits"), [(61, P.PART_BYTES, P.FILTER_BITS), (61, 256, 64), (3, 256, 128), (1, P.PART_BYTES, 64)])
def test_same_as_plain(spark, rows, bits, part_bytes, filter_bits):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = P.exact_duplicates(docs, bits, part_bytes, filter_bits).collect()
    # Which of two rows that repeat id and text stays isn't said; one does.
    assert sorted([tuple(r) for r in got], key=str) == plain(rows)


def test_names_and_empty(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    odd = docs.select("doc_id", "text", *[docs["n"].alias(c) for c in ("fp", "n_bytes", "sha", "row", "tag", "kept", "group_size", "stays", "normalised", "number", "text_sha256")])
    left = P.remove_copies(odd)
    assert left.columns == odd.columns
    kept = [r for r in plain(rows) if r[3]]
    assert sorted((r.doc_id, hashlib.sha256(normal(r.text).encode()).hexdigest()) for r in left.collect() if r.doc_id is not None) == sorted((r[0], r[4]) for r in kept if r[0] is not None)
    assert left.count() == len(kept)
    assert P.exact_duplicates(docs.limit(0)).count() == 0
