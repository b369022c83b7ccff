"""Sharding along a Hilbert curve over several metadata dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tracewell.llm.store import free_name, keep

BITS = 6


def _log(c: Column) -> Column:
    """An order-preserving number of a number; null and NaN are null."""
    x = c.cast("double")
    return F.signum(x) * F.log1p(F.abs(F.when(~F.isnan(x), x)))


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """Index along the Hilbert curve through a grid of 2^bits cells on each axis, for axes of integer cell numbers.

    The curve's transform works on bit planes from the highest: where an axis has
    the bit, the lower bits of the first axis are inverted, else they are exchanged
    with those of the axis; then Gray decoding, and the planes interleave. The state
    is an array, so no expression grows with the number of steps.
    """
    n = len(axes)
    planes = F.sequence(F.lit(bits - 1), F.lit(1), F.lit(-1)) if bits > 1 else F.expr("array()").cast("array<int>")
    each = F.sequence(F.lit(0), F.lit(n - 1))
    start = F.array(*[a.cast("int") for a in axes])

    def step(x: Column, plane: Column, axis: Column) -> Column:
        low = F.pow(F.lit(2), plane).cast("int") - 1
        own, first = F.element_at(x, axis + 1), F.element_at(x, F.lit(1))
        has = own.bitwiseAND(low + 1) != 0
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        new_first = F.when(has, first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(swap))
        return F.transform(x, lambda v, i: F.when(i == 0, new_first).when((i == axis) & ~has, own.bitwiseXOR(swap)).otherwise(v))

    turned = F.aggregate(planes, start, lambda x, plane: F.aggregate(each, x, lambda y, axis: step(y, plane, axis)))
    # Gray decode: each axis takes over the one before it, and all are flipped by the parity of the last one's higher planes.
    gray = F.aggregate(F.slice(turned, 2, n - 1) if n > 1 else F.expr("array()").cast("array<int>"), F.slice(turned, 1, 1), lambda out, v: F.concat(out, F.array(v.bitwiseXOR(F.element_at(out, -1)))))
    flips = lambda g: F.aggregate(planes, F.lit(0), lambda t, plane: F.when(F.element_at(g, -1).bitwiseAND(F.pow(F.lit(2), plane).cast("int")) != 0, t.bitwiseXOR(F.pow(F.lit(2), plane).cast("int") - 1)).otherwise(t))
    both = F.transform(F.array(gray), lambda g: F.transform(g, lambda v: v.bitwiseXOR(flips(g))))[0]
    every = F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)) if bits > 1 else F.array(F.lit(0))
    bit = lambda v, plane: F.pmod(F.floor(v / F.pow(F.lit(2), plane)), F.lit(2)).cast("long")
    return F.transform(F.array(both), lambda x: F.aggregate(every, F.lit(0).cast("long"), lambda h, plane: F.aggregate(x, h, lambda k, v: k * 2 + bit(v, plane))))[0]


def numbered(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """df with each row's number in the given order, from 0, as _n; and the count of rows.

    Needs no single task: rows are dealt by range, sorted in their task and written; a
    task's rows are then numbered from the sum of the counts before.
    """
    placed = keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    task, nth = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(task.alias("task")).agg(F.count("*").alias("n")).orderBy("task").collect()  # a row for each task
    total, starts = 0, []
    for r in counts:
        starts.append((r["task"], total))
        total += r["n"]
    base = placed.sparkSession.createDataFrame(starts, "_task long, _base long")
    return placed.join(F.broadcast(base), task == F.col("_task")).withColumn("_n", F.col("_base") + nth).drop("_at", "_task", "_base"), total


def _edges(values: DataFrame, steps: int) -> list[str]:
    """The least value of each cell but the first, where cells hold equal numbers (v) of distinct values: fewer than steps of them."""
    ranked, total = numbered(values.where("v is not null").distinct(), ["v"])
    cell = lambda n: f"(({n}) * {steps}L div {max(total, 1)}L)"
    return sorted(r["v"] for r in ranked.where(f"_n > 0 and {cell('_n')} > {cell('_n - 1')}").select("v").collect())


def cells(df: DataFrame, dims: list[str], bits: int = BITS) -> list[Column]:
    """The cell of each row on each dimension; null lies in cell 0.

    Numbers: equal steps of the logarithm between the least and the largest of the
    table. Other values: equal numbers of distinct values, in the order of their
    text, so up to 2^bits values have a cell each, whatever they begin with.
    """
    is_number = {d: isinstance(df.schema[d].dataType, T.NumericType) for d in dims}
    logs = [_log(F.col(d)).alias(f"c{k}") for k, d in enumerate(dims) if is_number[d]]
    # One row with two numbers for each dimension.
    ends = df.select(*logs).agg(*[f(F.col(f"c{k}")).alias(f"{n}{k}") for k, d in enumerate(dims) if is_number[d] for n, f in (("lo", F.min), ("hi", F.max))]).first() if logs else None
    steps, out = 1 << bits, []
    for k, d in enumerate(dims):
        if is_number[d]:
            lo, hi = ends[f"lo{k}"], ends[f"hi{k}"]
            cell = F.lit(0) if lo is None or hi <= lo else F.least(F.floor((_log(F.col(d)) - F.lit(lo)) / F.lit(hi - lo) * steps).cast("int"), F.lit(steps - 1))
        else:
            value = F.col(d).cast("string")
            cell = F.lit(0)
            for at, edge in enumerate(_edges(df.select(value.alias("v")), steps), 1):
                cell = F.when(value >= edge, at).otherwise(cell)
        out.append(F.coalesce(cell, F.lit(0)))
    return out


def shard_by_hilbert(docs: DataFrame, dims: tuple[str, ...] = ("lang", "source", "n_chars"), shards: int = 40, bits: int = BITS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert) for each row of docs.

    Rows are ordered by curve index, then by the text's CRC, size and doc_id, so equal
    texts of equal metadata are neighbours, and the order is cut into runs: shard
    counts differ by one at most (law "rows"); slot is the place inside a shard.
    size is the UTF-8 bytes of the text plus 16. Null texts count as empty, null
    metadata as the lowest cell, dimensions that the table lacks are left out; rows
    that repeat have a slot each. An empty table gives no rows.
    """
    there = [d for d in dims if d in docs.columns]
    index = hilbert_index(cells(docs, there, bits), bits) if there else F.lit(0).cast("long")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), index.alias("hilbert"))
    # Written first: the range partitioner samples its input, so that texts would be read twice.
    out, total = numbered(keep(rows, "hilbert"), ["hilbert", "text_crc32", "size", "doc_id"])
    # Whole numbers throughout: shard k begins at number ceil(k * total / shards).
    shard = f"((_n * {shards}L) div {max(total, 1)}L)"
    begin = f"(({shard} * {max(total, 1)}L + {shards - 1}L) div {shards}L)"
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.expr(shard).cast("int").alias("shard"), (F.col("_n") - F.expr(begin)).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Writes the documents, one folder for each shard, sorted along the curve: readers prune files by the least and largest values of each dimension.

    The folders' column is shard, or the first free of shard_1, shard_2 ... where docs
    has that itself; all own columns, of whatever name, are written unchanged.
    """
    placed = shard_by_hilbert(docs, **options).select("doc_id", "text_crc32", "size", "shard", "slot").dropDuplicates(["doc_id", "text_crc32", "size"])
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.crc32(text).alias("own_crc"), (F.octet_length(text) + 16).cast("long").alias("own_size"))
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_crc") == F.col("text_crc32")) & (F.col("own_size") == F.col("size"))
    own = keyed.join(placed, same, "left").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    folder = free_name(docs.columns, "shard")
    own.select("row.*", F.col("shard").alias(folder)).write.partitionBy(folder).parquet(path)
