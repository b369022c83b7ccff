"""Passes over sorted rows that carry a little state: what a window function can't say, and no array should hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType


def _changes(columns: list[pa.Array], before: list[pa.Scalar] | None) -> np.ndarray:
    """Where a row's key differs from the row before; the first row is compared with the last one of the batch before."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    out[0] = before is None or any(not (a.equals(b) if a.is_valid and b.is_valid else a.is_valid == b.is_valid) for a, b in zip((c[0] for c in columns), before, strict=True))
    for c in columns:
        a, b = c.slice(1), c.slice(0, n - 1)
        differs = pc.fill_null(pc.not_equal(a, b), False)
        out[1:] |= np.asarray(pc.or_(differs, pc.xor(pc.is_null(a), pc.is_null(b))))
    return out


def _jumps(t: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """For each row the first row of its group with t + width or more, else where the next group begins."""
    ends = np.append(np.flatnonzero(np.diff(group)) + 1, len(t))
    out = np.empty(len(t), np.int64)
    low, reach = int(t.min()), int(t.max()) - int(t.min()) + width + 1
    if reach * (int(group[-1]) + 1) < 1 << 62:
        place = group.astype(np.int64) * reach + (t - low)
        return np.minimum(np.searchsorted(place, place + width, "left"), ends[group])
    for a, b in zip(np.append(0, ends[:-1]), ends, strict=True):
        out[a:b] = a + np.searchsorted(t[a:b], t[a:b] + width, "left")
    return out


def anchored(points: DataFrame, by: list[str], t: str, width: int) -> DataFrame:
    """points with anchor: the t from which a greedy window of their key was opened.

    The first row of a key opens a window; each row that is width or more after the
    latest anchor opens the next. points has one row for each (by, t), both of plain
    types and t a long without nulls; other columns pass through.

    One shuffle by key and one sort; then each task runs over its rows once and carries
    the last key and anchor, so a key of any length takes no more memory than a batch.
    Successors of a whole batch come from one binary search, and a chain of pointers is
    followed from anchor to anchor.
    """
    rest = [c for c in points.columns if c not in (*by, t)]
    schema = StructType([points.schema[c] for c in (*by, t, *rest)] + [StructField("anchor", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_at = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, times = [batch.column(i) for i in range(len(by))], np.asarray(batch.column(len(by)), np.int64)
            new = _changes(keys, key) if by else np.arange(len(times)) < (key is None)
            group = np.cumsum(new)
            group -= group[0]
            after = _jumps(times, group, width).tolist()
            anchor, i = np.full(len(times), -1, np.int64), 0
            if not new[0]:
                first_end = int(np.searchsorted(group, 0, "right"))
                i = int(np.searchsorted(times[:first_end], open_at + width, "left"))
            while i < len(times):
                anchor[i] = i
                i = after[i]
            latest = np.maximum.accumulate(anchor)
            found = np.where(latest < 0, open_at, times[np.maximum(latest, 0)])
            key, open_at = [k[-1] for k in keys], int(found[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, "anchor"])

    own = points.select(*by, t, *rest)
    dealt = own.repartition(*by) if by else own.repartition(1)
    return dealt.sortWithinPartitions(*by, t).mapInArrow(run, schema)


def with_anchor(rows: DataFrame, by: list[str], t: str, width: int) -> DataFrame:
    """rows (any number for a key and time) with anchor; null where t is null. A key is thinned to its distinct times before it moves."""
    spans = anchored(rows.where(F.col(t).isNotNull()).select(*by, F.col(t).cast("long").alias("_t")).distinct(), by, "_t", width)
    left, right = rows.withColumn("_t", F.col(t).cast("long")).alias("r"), spans.alias("s")
    same = F.col("r._t") == F.col("s._t")
    for c in by:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}"))
    return left.join(right, same, "left").select(*[F.col(f"r.{c}") for c in rows.columns], "s.anchor")
