"""Spelling variants against brute force: all pairs by plain edit distance."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_documents import SCHEMA
from tracewell.llm import spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def plain(rows):
    n = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 7
    n = {w: k for w, k in n.items() if k >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 10 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def table():
    r = random.Random(2)
    stems = ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "banana", "bananas", "Bananaß", "thertion", "thertions", "tehrtion", "strasse", "straße", "ÉTUDESÉ", "étudesé", "xabcdef", "abcdefx", "abcdefg", "Ünterwegs"]
    letters = "abÉé÷ÿz"
    more = []
    for s in stems * 8:
        k, c = r.randrange(len(s) + 1), r.choice(letters)
        more.append(r.choice([s[:k] + c + s[k:], s[:k] + c + s[k + 1 :], s[:k] + s[k + 1 :]]))
    words = stems + more
    rows = [(i, " ".join(r.choices(words, [1 + 3000 // (1 + k * k) for k in range(len(words))], k=120)), "en", "s", 1, "r", "k", i) for i in range(60)]
    rows += [(900, "chained chained " + "chainedx " * 30 + "chainedxy " * 400, "en", "s", 1, "", "", 0), (901, None, "", "", 0, "", "", 0), (902, "", "", "", 0, "", "", 0)]
    rows += [(None, "without anid withoutanid withoutanid", "", "", 0, "", "", 0), (903, " ".join(["q" * 800, "q" * 800, "q" * 801, "q" * 801, "q" * 700 + "x" + "q" * 99] * 2), "", "", 0, "", "", 0)]
    return rows + [rows[0]] * 2


# Blocks of 3 words at most make the ranges small; 8192 leaves them halves.
@pytest.mark.parametrize("most", [3, 8192])
def test_same_as_plain(spark, most):
    rows = table()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted(tuple(r) for r in spelling.variants(docs, most=most).collect())
    assert got == plain(rows)
    assert any(r[2] not in (r[0], r[1]) for r in got)  # a chain of two


def test_near_in_slices(monkeypatch):
    """Groups of more than 64 words, and lanes that are cut."""
    monkeypatch.setattr(spelling, "LANES", 50)
    r = random.Random(9)
    groups = [sorted({"".join(r.choices("abÿ", k=r.choice([7, 8]))) for _ in range(size)}) for size in (300, 2, 90, 65)]
    words = [w for g in groups for w in g]
    group = np.repeat(np.arange(4), [len(g) for g in groups])
    lengths = np.array([len(w) for w in words])
    got = [p for q, v in spelling.near(spelling.codes(words, 8), lengths, group, 7) for p in zip(q.tolist(), v.tolist(), strict=True)]
    want = {(i, j) for i, w in enumerate(words) for j, v in enumerate(words) if group[i] == group[j] and min(len(w), len(v)) == 7 and one_edit(w, v)}
    assert len(got) == len(set(got)) and set(got) == want


def test_names_and_empty(spark):
    docs = spark.createDataFrame(table(), SCHEMA)
    odd = docs.select("doc_id", "text", *[docs["n"].alias(c) for c in ("word", "form", "root", "m", "lo", "hi", "n_near")])
    assert sorted(tuple(r) for r in spelling.variants(odd).collect()) == plain(table())
    assert spelling.variants(docs.limit(0)).count() == 0
