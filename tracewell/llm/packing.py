"""Sequence packing: non-negative least squares over shallow length combinations.

A document is cut only where it is longer than the window: into full windows and
one rest. Lengths fall into classes of STEP tokens; all combinations of up to
three classes that fill the window are enumerated, and their repeat counts are
solved against the histogram of lengths by non-negative least squares, rounded
down, and cut to what is there. What stays over is packed by a greedy best fit
on the histogram itself. So the plan is made from as many numbers as there are
classes, however many documents there are; Spark then numbers the pieces inside
each class and looks their places up in the plan.
"""

from __future__ import annotations

import functools
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tracewell.llm import words as W
from tracewell.llm.store import keep

WINDOW, STEP = 2048, 8
END = 1
#: Bytes of text whose ids are made at once; a byte takes some fifty bytes of arrays meanwhile.
TEXT_BYTES = 1 << 18
SCHEMA = pa.schema([(k, pa.int32() if k in ("class", "task") else pa.int64()) for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "task", "nth")])


def vocabulary(path: str) -> str:
    """The text of a tokenizer's file in the package of public tokenizers, or at any other path."""
    import public_tokenizers

    with open(path if "/" in path else public_tokenizers.path(path), encoding="utf-8") as f:
        return f.read()


_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True
_BREAK = _MARK.copy()
_BREAK[ord("'")] = False


def _by_words(tokenizer: str) -> bool:
    """Whether a tokenizer lower-cases and drops the white space between words."""
    import json

    spec = json.loads(tokenizer)
    inner = lambda x, key: x.get(key, [x]) if x else []
    lower = any(x["type"] == "Lowercase" for x in inner(spec.get("normalizer"), "normalizers"))
    split = next(iter(inner(spec.get("pre_tokenizer"), "pretokenizers")), {})
    return lower and split.get("type") == "Split" and split.get("behavior") == "Removed" and bool(split.get("invert"))


class Ids:
    """Token ids of blocks of texts, with one tokenizer call for each new piece of a word.

    Words end at ASCII white space, and pieces also where an ASCII letter meets
    an ASCII mark, save after an apostrophe: the tokenizer's pattern never joins
    across these places, and it lower-cases (the tests compare with whole texts).
    Known pieces are found by hash, all of a block at once, in tables that grow with
    them. The memory is emptied when it holds a million pieces, so it is bounded. Tokenizers of another kind
    (that keep white space or the case of letters) are given whole texts.
    """

    def __init__(self, tokenizer: str, most: int = 1_000_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own, self.by_words = Tokenizer.from_str(tokenizer), _by_words(tokenizer)
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.known, self.bits = 0, 12
        self.keys = np.zeros(1 << self.bits, W.U)
        self.values = np.zeros(1 << self.bits, np.int32)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros((1 << 14) + 1, np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        out, left, slot = np.full(len(h), -1, np.int64), np.arange(len(h)), (h >> W.U(64 - self.bits)).astype(np.int64)
        while len(left):
            there = self.keys[slot]
            hit = there == h[left]
            out[left[hit]] = self.values[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def _put(self, h: np.ndarray, values: np.ndarray) -> None:
        slot = (h >> W.U(64 - self.bits)).astype(np.int64)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            won = free & (self.keys[slot] == h)
            self.values[slot[won]] = values[won]
            h, values, slot = h[~won], values[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _make_room(self, n: int) -> None:
        """Larger tables if n pieces would fill more than a quarter of them, or, in the largest that most asks for, more than half."""
        bits = self.bits
        while n << (2 if bits < (4 * self.most).bit_length() - 1 else 1) > 1 << bits:
            bits += 1
        if bits > self.bits:
            there = self.keys != 0
            h, values = self.keys[there], self.values[there]
            self.bits, self.keys, self.values = bits, np.zeros(1 << bits, W.U), np.zeros(1 << bits, np.int32)
            self._put(h, values)

    def _learn(self, h: np.ndarray, new: list[str]) -> None:
        lists = [x.ids for x in self.own.encode_batch_fast(new, add_special_tokens=False)]
        n, used, total = self.known, int(self.at[self.known]), sum(map(len, lists))
        while len(self.at) <= n + len(new) + 1:
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        while len(self.flat) < used + total:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[used : used + total] = [i for x in lists for i in x]
        self.at[n + 1 : n + 1 + len(new)] = used + np.cumsum([len(x) for x in lists])
        self.known += len(new)
        self._make_room(self.known)
        self._put(h, np.arange(n, n + len(new)))

    def __call__(self, block: W.Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block, and where those of each text begin."""
        if not self.by_words:
            raw, at = block.data.tobytes(), block.offsets.tolist()
            lists = [x.ids for x in self.own.encode_batch_fast([raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)], add_special_tokens=False)]
            return np.array([i for x in lists for i in x], np.uint32), np.cumsum([0, *map(len, lists)])
        starts, ends, _ = block.words()
        data = block.data
        if len(starts) and b"<|" not in data.tobytes():  # else a special token could stand there, which must not be cut
            cut = np.flatnonzero((_LETTER[data[:-1]] & _MARK[data[1:]]) | (_BREAK[data[:-1]] & _LETTER[data[1:]])) + 1
            cut = cut[~np.isin(cut, block.offsets)]
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        doc = np.searchsorted(block.offsets[1:], starts, "right")
        h = W.span(block.sums(lower=True), starts, ends) | W.U(1)
        if self.known > self.most:
            self.clear()
        which = self._find(h)
        if len(lost := np.flatnonzero(which < 0)):
            new, first, back = np.unique(h[lost], return_index=True, return_inverse=True)
            raw = data.tobytes()
            for a in range(0, len(new), self.most):
                part = slice(a, a + self.most)
                spots = lost[first[part]]
                self._learn(new[part], [raw[x:y].decode("utf-8", "replace") for x, y in zip(starts[spots].tolist(), ends[spots].tolist(), strict=True)])
            which[lost] = self._find(new)[back]
        size = self.at[which + 1] - self.at[which]
        to = np.cumsum(size)
        total = int(to[-1]) if len(to) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.at[which] - (to - size), size)]
        return ids, np.concatenate([[0], to])[W.bounds(doc, len(block))]


@functools.lru_cache(maxsize=1)
def ids_of_worker(tokenizer: str) -> Ids:
    """One tokenizer with its known pieces for all tasks of a worker, one after the other: made anew for each, they leave holes in its memory."""
    return Ids(tokenizer)


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """The pieces of each document, numbered inside their task and length class."""
    last = np.array([END], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), {}
        ids_of = ids_of_worker(tokenizer)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for block in W.blocks(batch.column(1), TEXT_BYTES):
                ids, at = ids_of(block)
                raw, rows = memoryview(ids.astype("<u4").tobytes()), []
                for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    total = b - a + 1
                    for start in range(0, total, window):
                        size = min(window, total - start)
                        ends_here = start + size == total
                        crc = zlib.crc32(raw[4 * (a + start) : 4 * (a + start + size - ends_here)])
                        kind = -(-size // STEP)
                        seen[kind] = (nth := seen.get(kind, 0)) + 1
                        rows.append((doc_ids[block.first + i], start, size, zlib.crc32(last, crc) if ends_here else crc, total, kind, task, nth))
                columns = zip(zip(*rows, strict=True), SCHEMA, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in columns], schema=SCHEMA)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, task int, nth long")


def combinations(classes: int) -> list[tuple[int, ...]]:
    """All multisets of one to three classes whose sum is the whole window."""
    out: list[tuple[int, ...]] = [(classes,)]
    out += [(classes - b, b) for b in range(1, classes // 2 + 1)]
    out += [(classes - b - c, b, c) for c in range(1, classes // 3 + 1) for b in range(c, (classes - c) // 2 + 1)]
    return out


def nnls(combos: list[tuple[int, ...]], counts: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - counts|^2, by projected coordinate descent; A has how often a combination takes each class.

    A length that is left over costs the window's rest, so long classes weigh more.
    """
    weight = 1.0 + np.arange(len(counts)) / len(counts)
    takes = [dict((c, combo.count(c)) for c in combo) for combo in combos]
    norm = [sum(weight[c] * n * n for c, n in t.items()) for t in takes]
    x, rest = [0.0] * len(combos), [float(v) for v in counts]
    w, total = weight.tolist(), float(counts.sum())
    for _ in range(sweeps):
        moved = 0.0
        for j, t in enumerate(takes):
            new = x[j] + sum(w[c] * n * rest[c] for c, n in t.items()) / norm[j]
            if new < 0.0:
                new = 0.0
            if (d := new - x[j]) != 0.0:
                for c, n in t.items():
                    rest[c] -= n * d
                x[j] = new
                moved = max(moved, abs(d))
        if moved < max(0.05, 1e-7 * total):
            break
    return np.array(x)


def plan(counts: dict[int, int], classes: int) -> list[tuple[tuple[int, ...], int]]:
    """(classes in one sequence, how many such sequences): takes each of the counted pieces exactly once."""
    left = np.zeros(classes + 1, np.int64)
    for c, n in counts.items():
        left[c] = n
    combos = combinations(classes)
    out = []
    for combo, x in zip(combos, nnls(combos, left), strict=True):
        n = int(x)
        for c in set(combo):
            n = min(n, int(left[c]) // combo.count(c))
        if n > 0:
            out.append((combo, n))
            for c in combo:
                left[c] -= n
    there = [int(c) for c in np.flatnonzero(left)]
    while there:
        combo, room = [], classes
        need: dict[int, int] = {}
        at = len(there) - 1
        while at >= 0 and room > 0:
            at = bisect_right(there, min(room, there[at])) - 1
            if at < 0:
                break
            c = there[at]
            n = min(int(left[c]) - need.get(c, 0), room // c)
            if n > 0:
                combo += [c] * n
                need[c] = need.get(c, 0) + n
                room -= n * c
            at -= 1
        times = min(int(left[c]) // n for c, n in need.items())
        out.append((tuple(combo), times))
        for c, n in need.items():
            left[c] -= n * times
        there = [c for c in there if left[c]]
    return out


def places(made: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(class, first and last number in it, sequence of the first, slot): where the pieces of each class go."""
    used: dict[int, int] = {}
    out, base = [], 0
    for combo, n in made:
        for slot, c in enumerate(combo):
            lo = used.get(c, 0)
            out.append((c, lo, lo + n - 1, base, slot))
            used[c] = lo + n
        base += n
    return out


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece of documents (doc_id, text).

    Every id of every document, its closing id included, lies in one piece; null
    and empty texts have the closing id only. Rows that repeat a document are
    packed again. Sequences are numbered from 0; an empty table gives none.
    """
    spark = docs.sparkSession
    cut = keep(pieces(docs, vocabulary(tokenizer), window), "pieces")
    classes = window // STEP
    per_task = cut.groupBy("class", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = keep(per_task.select("class", "task", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "base")
    # At most one row for each class: bounded by the window.
    counts = {r["class"]: r["n"] for r in base.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    table = places(plan(counts, classes))
    rows = spark.createDataFrame(table or [(0, 0, -1, 0, 0)], "class int, lo long, hi long, first long, slot int")
    numbered = cut.join(base.drop("n"), ["class", "task"]).withColumn("number", F.col("nth") + F.col("base"))
    # The plan has a few thousand rows at any size of input.
    placed = numbered.join(F.broadcast(rows), (numbered["class"] == rows["class"]) & F.col("number").between(F.col("lo"), F.col("hi")))
    placed = placed.withColumn("sequence_id", F.col("first") + F.col("number") - F.col("lo"))
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"))
