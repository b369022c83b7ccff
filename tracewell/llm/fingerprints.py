"""Exact dedup: composable polynomial fingerprints, then a comparison of the texts chunk by chunk.

Texts are compared after each run of white space (0x20, 0x09-0x0D) became one space.
The fingerprint of a byte string is the sum of byte[i] * B^i modulo 2^61 - 1, so two
pieces combine by h(xy) = h(x) + B^|x| * h(y): texts longer than a part are cut, their
parts are hashed by different tasks, and shifted sums make the whole.

Equal fingerprints only propose. The candidates' texts meet chunk by chunk: for each
(fingerprint, length, chunk) Spark keeps the least and the greatest bytes, with partial
aggregation, so of a group of any size each task ships two chunks at most. Where they
are the same the group is one text; where they differ its rows are hashed again with
another base, until every group is one text.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from tracewell.llm import words as W
from tracewell.llm.store import free_name, is_empty, keep

P = (1 << 61) - 1
#: Bytes of normalised text in a part of a long text, and in a chunk that is compared.
PART_BYTES = 1 << 18
#: Bits of the filter that tells which texts may have a copy; 8 MB whatever the input.
FILTER_BITS = 1 << 26


def base(seed: int) -> int:
    """A multiplier for each round."""
    return int.from_bytes(hashlib.sha256(f"base {seed}".encode()).digest()[:7], "big") | 1 << 56


@functools.lru_cache(maxsize=2)
def _powers(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """High and low 32 bits of B^i, and B^-i, for each place in a block."""
    b, inverse = base(seed), pow(base(seed), -1, P)
    up, down = np.empty(PART_BYTES + 1, W.U), np.empty(PART_BYTES + 1, W.U)
    x = y = 1
    for i in range(PART_BYTES + 1):
        up[i], down[i] = x, y
        x, y = x * b % P, y * inverse % P
    return up >> W.U(32), up & W.U(0xFFFFFFFF), down


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts with one space for each run of white space."""
    if not len(data):
        return data, offsets
    space = W._SPACE[data]
    keep_it = ~space
    keep_it[0] = True
    keep_it[1:] |= ~space[:-1]
    keep_it[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    at = np.concatenate([[0], np.cumsum(keep_it)])
    return np.where(space, np.uint8(0x20), data)[keep_it], at[offsets]


def hashes(data: np.ndarray, offsets: np.ndarray, seed: int) -> list[int]:
    """Fingerprint of each piece of a block of PART_BYTES at most.

    Powers are split in two halves of 32 bits, so the prefix sums of a block stay below
    2^61; the factor B^-start takes a piece back to the place 0.
    """
    hi, lo, down = _powers(seed)
    sums = [np.concatenate([np.zeros(1, W.U), np.cumsum(data * p[: len(data)], dtype=W.U)])[offsets] for p in (hi, lo)]
    high, low = (np.diff(s).tolist() for s in sums)
    return [((h << 32) + x) * d % P for h, x, d in zip(high, low, down[offsets[:-1]].tolist(), strict=True)]


def shifted(h: int, place: int, seed: int) -> int:
    """What a piece at a place adds to the fingerprint of the whole."""
    return h * pow(base(seed), place, P) % P


def parts_of(data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The normalised bytes of one long text, size at a time (the last may be shorter), without holding more than three of them."""
    rest, after_space = np.zeros(0, np.uint8), False
    for a in range(0, len(data), size):
        piece = data[a : a + size]
        clean, _ = normalise(piece, np.array([0, len(piece)]))
        if after_space and W._SPACE[piece[0]]:
            clean = clean[1:]
        after_space = bool(W._SPACE[piece[-1]])
        rest = np.concatenate([rest, clean])
        while len(rest) >= size:
            yield rest[:size]
            rest = rest[size:]
    if len(rest):
        yield rest


def _pieces(schema: StructType, seed: int, mask: int, part_bytes: int):
    """mapInArrow function: one row a text with its fingerprint; for a long text one row without it, and its parts."""

    def run(batches):
        for batch in batches:
            for block in W.blocks(batch.column(1), part_bytes):
                ids = batch.column(0).slice(block.first, len(block))
                if len(block.data) > part_bytes:
                    tag, digest, n, no = uuid.uuid4().hex, hashlib.sha256(), 0, 0
                    for part in parts_of(block.data, part_bytes):
                        digest.update(part)
                        yield _batch(schema, [ids, [None], [None], [None], [tag], [no], [part.tobytes()]])
                        n, no = n + len(part), no + 1
                    yield _batch(schema, [ids, [n], [None], [digest.digest()], [tag], [None], [None]])
                    continue
                data, offsets = normalise(block.data, block.offsets)
                view, ends = memoryview(data), offsets.tolist()
                shas = [hashlib.sha256(view[a:b]).digest() for a, b in zip(ends, ends[1:], strict=False)]
                none = [None] * len(block)
                yield _batch(schema, [ids, np.diff(offsets), [h & mask for h in hashes(data, offsets, seed)], shas, none, none, none])

    return run


def _batch(schema: StructType, columns: list) -> pa.RecordBatch:
    kinds = {LongType: pa.int64(), IntegerType: pa.int32(), StringType: pa.string(), BinaryType: pa.binary()}
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, kinds[type(f.dataType)]) for c, f in zip(columns, schema.fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema.names)


def fingerprints(docs: DataFrame, seed: int = 0, bits: int = 61, part_bytes: int = PART_BYTES) -> tuple[DataFrame, DataFrame | None]:
    """(row, doc_id, n_bytes, fp, sha) for each row of docs, and the parts of the long texts (fp, n_bytes, chunk, bytes), or None.

    n_bytes and sha (SHA-256) are those of the normalised text. row tells apart rows that
    repeat an id; the table is written, so it stays the same.
    """
    id_type = docs.schema["doc_id"].dataType
    schema = StructType([StructField("doc_id", id_type), StructField("n_bytes", LongType()), StructField("fp", LongType()), StructField("sha", BinaryType()), StructField("tag", StringType()), StructField("part", IntegerType()), StructField("bytes", BinaryType())])
    mask = (1 << bits) - 1
    rows = docs.select("doc_id", "text").mapInArrow(_pieces(schema, seed, mask, part_bytes), schema)
    rows = keep(rows.withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    own = ["row", "doc_id", "n_bytes", "fp", "sha"]
    short, parts = rows.where("tag is null").select(own), rows.where("part is not null").select("tag", "part", "bytes")
    if is_empty(parts.select("tag")):
        # Long texts of white space only can't be: one space is a part as well.
        return short, None

    def run(batches):
        for batch in batches:
            for tag, part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                h = hashes(data, np.array([0, len(data)]), seed)[0]
                yield pa.RecordBatch.from_arrays([pa.array([tag]), pa.array([shifted(h, part * part_bytes, seed)])], ["tag", "h"])

    spread = parts.repartition("tag", "part").mapInArrow(run, "tag string, h long")
    whole = spread.groupBy("tag").agg(F.expr(f"cast((sum(cast(h as decimal(38, 0))) % {P}) as long)").alias("fp")).withColumn("fp", F.col("fp").bitwiseAND(mask))
    long = keep(rows.where("tag is not null and part is null").drop("fp").join(whole, "tag"), "long-texts")
    chunks = parts.join(long.select("tag", "fp", "n_bytes"), "tag").select("fp", "n_bytes", F.col("part").alias("chunk"), "bytes")
    return short.unionByName(long.select(own)), chunks


def _filter(groups: DataFrame, bits: int) -> np.ndarray:
    """A bit set: bit fp mod bits of each group's fingerprint. Its size is bits / 8 bytes at most."""
    at = groups.select(F.col("fp").bitwiseAND(bits - 1).alias("at")).select(F.expr("at div 64").alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit"))
    found = at.groupBy("word").agg(F.bit_or("bit").alias("set")).toArrow()
    out = np.zeros(max(1, bits // 64), np.int64)
    out[found["word"].to_numpy()] = found["set"].to_numpy()
    return out.view(np.uint64)


def differing(docs: DataFrame, groups: DataFrame, parts: DataFrame | None, seed: int = 0, bits: int = 61, part_bytes: int = PART_BYTES, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(fp, n_bytes) of the groups that hold more than one text, by comparing all of their chunks.

    The filter only spares the texts that have no candidate; those that pass it without
    one are compared with themselves.
    """
    known = docs.sparkSession.sparkContext.broadcast(_filter(groups, filter_bits))
    mask = (1 << bits) - 1

    def run(batches):
        some = known.value
        for batch in batches:
            for block in W.blocks(batch.column(0), part_bytes):
                if len(block.data) > part_bytes:
                    continue  # its parts are at hand
                data, offsets = normalise(block.data, block.offsets)
                fp = np.array([h & mask for h in hashes(data, offsets, seed)], np.int64)
                at = fp & (filter_bits - 1)
                take = np.flatnonzero(some[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1))
                texts = pa.Array.from_buffers(pa.binary(), len(block), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
                yield pa.RecordBatch.from_arrays([pa.array(fp[take]), pa.array(np.diff(offsets)[take]), pa.array(np.zeros(len(take), np.int32)), texts.take(pa.array(take))], ["fp", "n_bytes", "chunk", "bytes"])

    chunks = docs.select("text").mapInArrow(run, "fp long, n_bytes long, chunk int, bytes binary")
    if parts is not None:
        chunks = chunks.unionByName(parts)
    ends = chunks.groupBy("fp", "n_bytes", "chunk").agg(F.min("bytes").alias("least"), F.max("bytes").alias("greatest"))
    return ends.where("least <> greatest").select("fp", "n_bytes").distinct()


def exact_duplicates(docs: DataFrame, bits: int = 61, part_bytes: int = PART_BYTES, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of docs (doc_id, text, ...).

    Rows whose normalised texts are the same make a group; the one with the smallest
    doc_id stays (null ids come last, of rows that repeat an id one stays). Null texts
    are empty, and all empty texts are one group; a text of white space only is a single
    space, not empty. Columns other than these two may have any name. bits < 61 cuts the
    first round's fingerprints (later rounds double them); results are the same at any
    value, as at any part_bytes.
    """
    table, parts = fingerprints(docs, 0, bits, part_bytes)
    seed, out = 0, []
    while True:
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
        groups = keep(table.groupBy("fp", "n_bytes").agg(F.count("*").alias("n"), first).where("n > 1"), "groups")
        mixed = None if is_empty(groups) else keep(differing(docs, groups, parts, seed, bits, part_bytes, filter_bits), "mixed-groups")
        if mixed is None or is_empty(mixed):
            out.append(table.join(groups, ["fp", "n_bytes"], "left"))
            break
        key = ["fp", "n_bytes"]
        out.append(table.join(mixed, key, "left_anti").join(groups.join(mixed, key, "left_anti"), key, "left"))
        open_rows = keep(table.join(mixed, key, "left_semi").select("doc_id", "n_bytes", "sha").distinct(), "open-rows")
        seed, bits = seed + 1, min(61, 2 * bits)
        table, parts = fingerprints(docs, seed, bits, part_bytes)
        same = table["doc_id"].eqNullSafe(open_rows["doc_id"]) & (table["n_bytes"] == open_rows["n_bytes"]) & (table["sha"] == open_rows["sha"])
        table = keep(table.join(open_rows, same, "left_semi"), "open")
    one = functools.reduce(DataFrame.unionByName, out)
    return one.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).alias("group_size"),
        (F.col("n").isNull() | (F.col("row") == F.col("first.row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def remove_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that exact_duplicates keeps, with all of their columns."""
    stays, text, sha, number = (free_name(docs.columns, c) for c in ("stays", "normalised", "text_sha256", "number"))
    found = exact_duplicates(docs, **options).where("kept").select(F.col("doc_id").alias(stays), F.col("text_sha256").alias(sha + "_kept")).distinct()
    normal = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
    marked = docs.withColumn(sha, F.sha2(normal.cast("binary"), 256))
    own = [F.col(f"`{c}`") for c in docs.columns]
    left = marked.join(found, marked["doc_id"].eqNullSafe(found[stays]) & (marked[sha] == found[sha + "_kept"]), "left_semi")
    # Rows that repeat id and text are few; only these are made one.
    again = keep(left.groupBy("doc_id", sha).count().where("count > 1").select(F.col("doc_id").alias(stays), F.col(sha).alias(text)), "repeated")
    is_again = left["doc_id"].eqNullSafe(again[stays]) & (left[sha] == again[text])
    once = left.join(again, is_again, "left_semi").dropDuplicates(["doc_id", sha])
    return left.join(again, is_again, "left_anti").select(own).unionByName(once.select(own))
