"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracewell.llm import words as W

#: A token is a run of ASCII letters and digits and of bytes beyond ASCII; marks and space part tokens, A-Z are lower-cased.
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FILTER_BITS = 20
#: Pairs of equal seeds that are held at once.
PAIRS = 1_000_000


def tokens(block: W.Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a block, and the text of each."""
    starts, ends, doc = block.pieces(_TOKEN[block.data])
    return W.span(block.sums(lower=True), starts, ends), doc


@dataclass
class Tests:
    """Test items, with an index of their seeds: windows of least tokens, or the whole of a shorter item."""

    ids: list
    tokens: list[np.ndarray]
    least: int

    def __post_init__(self):
        parts: dict[int, list] = {}
        for i, t in enumerate(self.tokens):
            if n := min(self.least, len(t)):
                g, at = W.grams(t, np.zeros(len(t), np.int64), n)
                parts.setdefault(n, []).append((g, np.full(len(g), i, np.int32), at.astype(np.int32)))
        # Of each seed length: sorted hashes with the item and the place of each, and a table of the first bits.
        self.seeds, self.maybe = {}, {}
        for n, found in sorted(parts.items()):
            g, item, at = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(g, kind="stable")
            self.seeds[n] = g[order], item[order], at[order]
            self.maybe[n] = np.zeros(1 << _FILTER_BITS, bool)
            self.maybe[n][g >> W.U(64 - _FILTER_BITS)] = True

    def matches(self, h: np.ndarray, doc: np.ndarray) -> dict[tuple[int, int], Runs]:
        """(text, item): where runs of seeds of the item stand in the item and in the texts.

        Pairs of places are made PAIRS at a time, in the order of the texts, and joined
        to runs at once: a repeated token gives as many pairs as text and item have
        places together, but one run for each diagonal only.
        """
        found: list[np.ndarray] = []
        for n, (seeds, item, place) in self.seeds.items():
            g, at = W.grams(h, doc, n)
            some = np.flatnonzero(self.maybe[n][g >> W.U(64 - _FILTER_BITS)])
            lo, hi = (np.searchsorted(seeds, g[some], side) for side in ("left", "right"))
            some, lo, size = some[lo < hi], lo[lo < hi], (hi - lo)[lo < hi]
            to = np.cumsum(size)
            first = 0
            while first < len(some):
                before = int(to[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(to, before + PAIRS, "right")))
                part = slice(first, last)
                j = np.arange(int(to[last - 1]) - before) + np.repeat(lo[part] - (to[part] - size[part] - before), size[part])
                t = np.repeat(at[some[part]], size[part])
                p = place[j].astype(np.int64)
                found.append(joined(np.stack([doc[t], item[j], t - p, p, p + n])))
                first = last
        if not found:
            return {}
        runs = joined(np.concatenate(found, axis=1))
        cut = np.flatnonzero((np.diff(runs[:2], axis=1) != 0).any(axis=0)) + 1
        edges = [0, *cut.tolist(), runs.shape[1]] if runs.shape[1] else [0]
        return {(int(runs[0, a]), int(runs[1, a])): Runs(runs[3, a:b], runs[3, a:b] + runs[2, a:b], runs[4, a:b] - runs[3, a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)}


@dataclass
class Runs:
    """Maximal matches: their starts in the item and in the texts, and their lengths."""

    p: np.ndarray
    t: np.ndarray
    n: np.ndarray


def joined(runs: np.ndarray) -> np.ndarray:
    """Rows text, item, diagonal, start, end of matches: those of one diagonal that overlap or touch are joined."""
    if not runs.shape[1]:
        return runs
    runs = runs[:, np.lexsort(runs[3::-1])]
    new = (np.diff(runs[:3], axis=1) != 0).any(axis=0) | (runs[3, 1:] > runs[4, :-1])
    starts = np.flatnonzero(np.concatenate([[True], new]))
    return np.concatenate([runs[:4, starts], np.maximum.reduceat(runs[4], starts)[None]])


def tile(a: np.ndarray, b: np.ndarray, runs: Runs, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of a by b: (start in a, start in b, length) of each tile.

    runs are the maximal matches of a and b, joined from windows of least tokens with
    equal Karp-Rabin fingerprints. The longest match with no marked token becomes a
    tile, ties by place; one that a tile has cut into is split, and its parts wait for
    their turn. Once fewer than least tokens of a are unmarked, no tile is left.
    """
    heap = [(-n, p, t) for p, t, n in zip(runs.p.tolist(), runs.t.tolist(), runs.n.tolist(), strict=True)]
    if not heap:
        return []
    heapq.heapify(heap)
    first = int(runs.t.min())
    in_a, in_b, out = np.zeros(len(a), bool), np.zeros(int((runs.t + runs.n).max()) - first, bool), []
    left = len(a)
    while heap and left >= least:
        n, p, t = heapq.heappop(heap)
        n, u = -n, t - first
        marked = in_a[p : p + n] | in_b[u : u + n]
        if marked.any():
            edges = np.flatnonzero(np.diff(np.concatenate([[True], marked, [True]]).astype(np.int8))).tolist()
            for x, y in zip(edges[::2], edges[1::2], strict=True):
                if y - x >= least:
                    heapq.heappush(heap, (x - y, p + x, t + x))
        elif np.array_equal(a[p : p + n], b[t : t + n]):  # else fingerprints of different windows are equal
            in_a[p : p + n] = in_b[u : u + n] = True
            left -= n
            out.append((p, t, n))
    return out


def _item_blocks(tests: DataFrame, least: int, block_bytes: int):
    """The test items, some at a time: each part is small enough to broadcast."""
    tests = tests.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null").distinct()
    total = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // block_bytes)
    for k in range(parts):
        part = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").toArrow()
        found = []
        for block in W.blocks(part.column("text")):
            h, doc = tokens(block)
            at = W.bounds(doc, len(block))
            found += [h[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        yield Tests(part.column("item_id").to_pylist(), found, least)


def contamination(docs: DataFrame, tests: DataFrame, threshold: float = 0.8, least: int = 5, block_bytes: int = 8_000_000) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, tiles) of each document and test item whose tiles cover the threshold of the item's tokens or more.

    tests is (item_id, text). It is broadcast if it has block_bytes at most, and in
    parts of that size, with one scan of the documents for each, if it has more; so
    no row is shuffled. Whole texts are searched. Passages whose parts were
    reordered still count, as tiles may stand anywhere. Null and empty texts, test
    items without tokens and null item_ids match nothing; items that repeat both id
    and text count once; repeated documents are reported for each row.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, coverage double, n_tiles int, tiles array<struct<item_start:int,doc_start:int,length:int>>"
    out = None
    for part in _item_blocks(tests, least, block_bytes):
        shared = spark.sparkContext.broadcast(part)

        def run(batches, shared=shared):
            own = shared.value
            for batch in batches:
                rows = []
                for block in W.blocks(batch.column(1)):
                    h, doc = tokens(block)
                    at = W.bounds(doc, len(block))
                    for (d, i), runs in own.matches(h, doc).items():
                        item, a = own.tokens[i], int(at[d])
                        runs.t = runs.t - a
                        found = tile(item, h[a : at[d + 1]], runs, min(least, len(item)))
                        covered = sum(n for _, _, n in found) / len(item)
                        if covered >= threshold:
                            rows.append((batch.column(0)[block.first + d].as_py(), own.ids[i], covered, len(found), [{"item_start": p, "doc_start": t, "length": n} for p, t, n in sorted(found)]))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.list_(pa.struct([(x, pa.int32()) for x in ("item_start", "doc_start", "length")]))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "coverage", "n_tiles", "tiles"])

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, tests: DataFrame, **options) -> DataFrame:
    """The documents that hold no test item, all columns unchanged; a null doc_id or text is kept."""
    bad = contamination(docs, tests, **options).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
