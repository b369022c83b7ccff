"""Threads of sessions that fit a task's memory: many sessions are solved at once, in chunks of sorted rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tracewell.operators.ordered import _changes

#: Rows that are solved at once.
CHUNK = 1 << 17


def _parents(group: np.ndarray, node: pa.Array, parent: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows that count, the last of each node, in their order, and for each the place of its parent among them, or -1."""
    codes = pa.chunked_array([node, parent]).combine_chunks().dictionary_encode()
    width = len(codes.dictionary) + 1
    codes = np.asarray(pc.fill_null(codes.indices, -1), np.int64)
    own, above = codes[: len(node)], codes[len(node) :]
    key = group * width + own
    known, back = np.unique(key[::-1], return_index=True)
    kept = len(key) - 1 - back
    rank = np.empty(len(kept), np.int64)
    order = np.argsort(kept)
    rank[order] = np.arange(len(kept))
    kept = kept[order]
    wanted = group[kept] * width + above[kept]
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return kept, np.where((above[kept] >= 0) & (known[at] == wanted), rank[at], -1)


def _tour(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Root, depth, first and last visit of each row, and whether it stands on or below a cycle; siblings are visited in the order of the rows."""
    n = len(parent)
    has = np.flatnonzero(parent >= 0)
    has = has[np.argsort(parent[has], kind="stable")]
    same = parent[has[1:]] == parent[has[:-1]]
    # Visits: row i is entered at i and left at n + i; 2 n is the end of every tour.
    to = np.concatenate([np.arange(n) + n, np.where(parent >= 0, parent + n, 2 * n), [2 * n]])
    to[n + has[:-1][same]] = has[1:][same]
    eldest = has[np.append(True, ~same)[: len(has)]]
    to[parent[eldest]] = eldest
    steps = np.append(np.ones(2 * n, np.int64), 0)
    net = np.concatenate([np.ones(n, np.int64), np.full(n, -1), [0]])
    end = np.concatenate([np.arange(n), np.arange(n), [-1]])
    for _ in range((2 * n).bit_length() + 1):
        going = to < 2 * n
        if not going.any():
            break
        steps, net, end, to = steps + steps[to], net + net[to], np.where(going, end[to], end), to[to]
    return end[:n], -net[:n], -steps[:n], -steps[n : 2 * n], to[:n] < 2 * n


def _solved(batch: pa.RecordBatch, group: np.ndarray, k: int, schema: pa.Schema) -> pa.RecordBatch:
    node = batch.column(k)
    kept, parent = _parents(group, node, batch.column(k + 1))
    root, depth, first, last, cyclic = _tour(parent)
    own = [batch.column(i).take(pa.array(kept)) for i in range(k + 1)]
    numbers = [pa.array(x, mask=cyclic) for x in (depth, first, last)]
    return pa.RecordBatch.from_arrays([*own, own[k].take(pa.array(root, mask=cyclic)), *numbers, pa.array(cyclic)], schema=schema)


def local_trees(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by, node, root, depth, first, last, on_cycle) of rows (by, node, parent, ..), as links.thread_tree says them.

    One shuffle by session and one sort by order inside it. A task takes chunks of whole
    sessions, so none may have more rows than its memory bears; thread_tree sees to that.
    Columns are of plain types.
    """
    k = len(by)
    node = rows.schema["node"].dataType
    fields = [StructField("root", node), *[StructField(c, LongType()) for c in ("depth", "first", "last")], StructField("on_cycle", BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n < CHUNK:
                continue
            found, rest = solve(held, False)
            yield from found
            held, n = [rest], rest.num_rows
        if n:
            yield from solve(held, True)[0]

    def solve(held: list[pa.RecordBatch], ended: bool) -> tuple[list[pa.RecordBatch], pa.RecordBatch]:
        """What whole sessions give, and the rows of the last one, which may go on."""
        every = pa.concat_batches(held)
        new = _changes([every.column(i) for i in range(k)], None)
        cut = every.num_rows if ended else int(np.flatnonzero(new)[-1])
        schema = pa.schema([*[every.schema.field(i) for i in range(k + 1)], pa.field("root", every.schema.field(k).type), *[pa.field(c, pa.int64()) for c in ("depth", "first", "last")], pa.field("on_cycle", pa.bool_())])
        return [_solved(every.slice(0, cut), np.cumsum(new[:cut]), k, schema)] if cut else [], every.slice(cut)

    own = rows.repartition(*by).sortWithinPartitions(*by, *order).select(*by, "node", "parent")
    return own.mapInArrow(run, StructType([rows.schema[c] for c in (*by, "node")] + fields))
