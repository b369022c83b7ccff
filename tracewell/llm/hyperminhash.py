"""Near-duplicates by HyperMinHash sketches, banding and full verification.

A document's set holds its distinct n-word shingles, hashed to 64 bits. Of each
hash the top 7 bits choose one of 128 registers; the least rest in a register is
kept as its leading-zero count (6 bits) and the next 10 bits (mantissa), so a
sketch takes 256 bytes at any length. A register that no shingle chose takes over
the value of another one that is in use, the first in an order of its own (one
permutation hashing, made dense), so sets of any size have 128 registers, each of
which two sets share with a probability of about their similarity. Four
neighbouring registers make a band, whose compressed value is exactly one long.
Sets that share a band are candidates: a pair as similar as the threshold misses
all 32 with a probability of (1 - 0.8^4)^32 = 5e-8 at 0.8, and 6e-11 at 0.85.

No group is paired with itself:
1. Equal sets are one class; its smallest document stands for it from there on.
2. Each band value links its documents to its most central one only. A pair is
   verified if the collision-corrected estimate comes near the threshold, and
   kept if the full sets pass.
3. Only band values whose documents still lie in different components matter any
   more. A document of theirs that has a link to another component shares enough
   of its shingles with documents of other components; one that doesn't is done
   (an exact bound, from counts of shingles). What is left is compared across
   components, in groups of bounded size, and gives out likely links only: no link
   that could join two components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracewell.llm import words as W
from tracewell.llm.components import connected_components
from tracewell.llm.store import is_empty, keep

REGISTERS, BANDS, MANTISSA = 128, 32, 10
#: Documents of one band value that meet in one group at most, twice.
BLOCK = 1024
#: Shingles of a group's documents that are looked up at once in one document's set; they bound the memory of a comparison.
COMPARED = 500_000
EMPTY = 0xFFFF
U = np.uint64
#: _RANK[i, j]: which place register j has in the order in which an empty register i looks for a value.
_RANK = W.mix(np.arange(REGISTERS * REGISTERS, dtype=U) + U(1)).reshape(REGISTERS, REGISTERS).argsort(1).argsort(1)


def shingle_sets(column, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z are lower-cased. With fewer than n words, the whole sequence is one shingle."""
    for block in W.blocks(column):
        starts, ends, doc = block.words()
        h = W.span(block.sums(lower=True), starts, ends)
        g, at = W.grams(h, doc, n)
        word, gram = W.bounds(doc, len(block)), W.bounds(doc[at], len(block))
        for i in range(len(block)):
            a, b = word[i], word[i + 1]
            if gram[i] < gram[i + 1]:
                yield np.unique(g[gram[i] : gram[i + 1]])
            elif a < b:
                yield W.grams(h[a:b], doc[a:b], int(b - a))[0]
            else:
                yield np.zeros(0, U)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 128 16-bit registers for each sorted set, none empty unless the set is."""
    least = np.full((len(sets), REGISTERS), np.iinfo(U).max, U)
    there = np.zeros(least.shape, bool)
    numbers = np.arange(REGISTERS, dtype=U)
    for row, own, u in zip(least, there, sets, strict=True):
        at = np.searchsorted(u, numbers << U(57))
        full = at < len(u)
        row[full] = u[at[full]]
        own[full] = (row[full] >> U(57)) == numbers[full]
    rest = (least & U((1 << 57) - 1)) + U(1)
    bits = rest.astype(np.float64).view(U)
    zeros = U(57 + 1023) - (bits >> U(52))
    packed = (zeros << U(MANTISSA)) | ((bits >> U(52 - MANTISSA)) & U((1 << MANTISSA) - 1))
    out = np.where(there, packed, U(EMPTY)).astype(np.uint16)
    for row, own in zip(out, there, strict=True):
        if not own.all() and own.any():
            full = np.flatnonzero(own)
            row[~own] = row[full[_RANK[~own][:, full].argmin(1)]]
    return out


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers, for sets of n and m elements: the share of equal registers less the expected chance collisions."""
    same = ((a == b) & (a != EMPTY)).sum(1)
    ratio = np.maximum(n, m) / np.maximum(1, np.minimum(n, m))
    chance = 0.169919487159739093975 * 2.0 ** (7 - MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(0, same - chance) / REGISTERS


def margin(n: np.ndarray, threshold: float) -> np.ndarray:
    """The estimate from which a pair whose smaller set has n elements is looked at in full: five standard deviations below the threshold. Where fewer registers have a value of their own, the estimate is coarser."""
    own = REGISTERS * (1 - (1 - 1 / REGISTERS) ** n)
    return threshold - 5 * np.sqrt(threshold * (1 - threshold) / own * (2 - own / REGISTERS))


def band_keys(bands: np.ndarray) -> np.ndarray:
    """A value for each band (rows of 32 longs) that says its place as well."""
    with np.errstate(over="ignore"):
        return W.mix(W.mix(bands) + np.arange(BANDS, dtype=U))


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, fp1, fp2, bands): two additive fingerprints name the whole set; bands has the registers, four to a long."""

    def run(batches):
        for batch in batches:
            ids, sets = batch.column(0), []
            done = 0
            for u in shingle_sets(batch.column(1), n):
                sets.append(u)
                if len(sets) == 2000:
                    yield rows(ids.slice(done, len(sets)), sets)
                    done, sets = done + len(sets), []
            if sets:
                yield rows(ids.slice(done, len(sets)), sets)

    def rows(ids, sets):
        with np.errstate(over="ignore"):
            fp1 = np.array([W.mix(u + U(1)).sum() for u in sets], U).view(np.int64)
            fp2 = np.array([W.mix(u ^ U(0xA5A5A5A5A5A5A5A5)).sum() for u in sets], U).view(np.int64)
        flat = np.ascontiguousarray(registers(sets)).view(np.int64).ravel()
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), pa.array(flat))
        size = pa.array(np.array([len(u) for u in sets], np.int64))
        return pa.RecordBatch.from_arrays([ids, size, pa.array(fp1), pa.array(fp2), bands], ["doc_id", "n_shingles", "fp1", "fp2", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>")


def _banded(reps: DataFrame) -> DataFrame:
    """(doc_id, key) for each band of each sketch."""

    def run(batches):
        for batch in batches:
            bands = np.asarray(batch.column(1).flatten()).view(U).reshape(-1, BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column(0)), BANDS)), pa.array(band_keys(bands).ravel().view(np.int64))], ["doc_id", "key"])

    return reps.select("doc_id", "bands").mapInArrow(run, "doc_id long, key long")


def _verified(pairs: DataFrame, reps: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (u, v), those whose full sets reach the threshold."""
    side = lambda x: reps.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("bands").alias(f"b_{x}"))
    whole = lambda x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"s_{x}"))
    percent = int(round(threshold * 100))

    def near(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {k: batch.column(k) for k in batch.schema.names}
            a, b = (np.asarray(col[f"b_{x}"].flatten()).view(np.uint16).reshape(batch.num_rows, REGISTERS) for x in "uv")
            n, m = (np.asarray(col[f"n_{x}"]) for x in "uv")
            ok = estimate(a, b, n, m) >= margin(np.minimum(n, m), threshold)
            yield pa.RecordBatch.from_arrays([col["u"].filter(pa.array(ok)), col["v"].filter(pa.array(ok))], ["u", "v"])

    def check(batches):
        for batch in batches:
            su, sv = batch.column("s_u"), batch.column("s_v")
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a, b = np.frombuffer(su[i].as_buffer(), U), np.frombuffer(sv[i].as_buffer(), U)
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok[i] = 100 * both >= percent * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok)) for k in ("u", "v")], ["u", "v"])

    sized = pairs.join(side("u"), "u").join(side("v"), "v").where(F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * percent)
    likely = keep(sized.mapInArrow(near, "u long, v long"), "likely")
    return keep(likely.join(whole("u"), "u").join(whole("v"), "v").select("u", "v", "s_u", "s_v").mapInArrow(check, "u long, v long"), "links")


def _unfinished(loose: DataFrame, reps: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The rows of loose (key, doc_id, c) whose document can still have a link to another component: enough of its shingles stand in documents of other components."""
    percent = int(round(threshold * 100))

    def run(batches):
        for batch in batches:
            for doc_id, c, data in zip(*batch.columns, strict=True):
                u = np.frombuffer(data.as_buffer(), np.int64)
                for part in range(0, len(u), 100_000):
                    s = u[part : part + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(np.full(len(s), doc_id.as_py())), pa.array(np.full(len(s), c.as_py()))], ["s", "doc_id", "c"])

    docs = loose.select("doc_id", "c").distinct()
    each = keep(docs.join(sets, "doc_id").select("doc_id", "c", "shingles").mapInArrow(run, "s long, doc_id long, c long"), "shingles")
    met = keep(each.groupBy("s").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("s"), "met")
    shared = each.join(met, "s").groupBy("doc_id").agg(F.count("*").alias("shared")).join(reps.select("doc_id", "n_shingles"), "doc_id")
    return loose.join(shared.where(F.col("shared") * 100 >= F.col("n_shingles") * percent).select("doc_id"), "doc_id", "left_semi")


def _open(rows: DataFrame) -> DataFrame:
    """The rows (key, doc_id, c) of keys with more than one component, and how many rows their key has."""
    found = rows.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("members")).where("c0 < c1")
    return rows.select("key", "doc_id", "c").join(keep(found.select("key", "members"), "open"), "key")


def _across(loose: DataFrame, reps: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (u, v) between different components among the unfinished documents of each band value: loose has (key, doc_id, c, members).

    A value's documents are dealt to blocks by hash, and each two blocks meet in a
    group of their own, so none grows with the value; inside a group all pairs are
    looked at, but only likely links are given out. A pair that shares several
    values is looked at for the least of them. The groups hold the upper halves of
    the hashes, which can only overrate a pair; the full sets decide at the end.
    """
    percent = int(round(threshold * 100))

    def run(key, table):
        own = key[0].as_py()
        ids, c, n, block = (np.asarray(table.column(k).combine_chunks()) for k in ("doc_id", "c", "n_shingles", "block"))
        flat = table.column("bands").combine_chunks().flatten()
        regs = np.asarray(flat).view(np.uint16).reshape(len(ids), REGISTERS)
        tokens = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("halves")]
        lists = table.column("keys").combine_chunks()
        values, owner = np.asarray(lists.flatten()), np.repeat(np.arange(len(ids)), np.diff(np.asarray(lists.offsets)))
        # Documents of each lesser value, and the lesser values of each document: lists, as most values have few.
        less = values < own
        _, column = np.unique(values[less], return_inverse=True)
        order = np.argsort(column, kind="stable")
        holders, begins = owner[less][order], np.searchsorted(column[order], np.arange(int(column.max(initial=-1)) + 2))
        at = np.searchsorted(owner[less], np.arange(len(ids) + 1))
        elsewhere = np.zeros(len(ids), bool)
        out_u, out_v = [], []
        for i in range(len(ids)):
            ok = (ids > ids[i]) & (c != c[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
            if key[1].as_py() != key[2].as_py():
                ok &= block != block[i]
            for k in column[at[i] : at[i + 1]]:
                elsewhere[holders[begins[k] : begins[k + 1]]] = True
            some = np.flatnonzero(ok & ~elsewhere)
            elsewhere[:] = False
            if not len(some):
                continue
            some = some[estimate(regs[some], regs[i][None], n[some], n[i]) >= margin(np.minimum(n[some], n[i]), threshold)]
            if not len(some):
                continue
            both = np.zeros(len(some), np.int64)
            for part in np.split(np.arange(len(some)), np.flatnonzero(np.diff(np.cumsum(n[some]) // COMPARED)) + 1):
                joined = np.concatenate([tokens[j] for j in some[part]])
                there = np.minimum(np.searchsorted(tokens[i], joined), len(tokens[i]) - 1)
                both[part] = np.add.reduceat((tokens[i][there] == joined).astype(np.int64), np.cumsum(n[some[part]]) - n[some[part]])
            linked = some[100 * both >= percent * (n[i] + n[some] - both)]
            out_u += [ids[i]] * len(linked)
            out_v += ids[linked].tolist()
        return pa.table({"u": pa.array(out_u, pa.int64()), "v": pa.array(out_v, pa.int64())})

    docs = loose.groupBy("doc_id").agg(F.first("c").alias("c"), F.collect_list(F.struct("key", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))).alias("open"))

    def halve(batches):
        for batch in batches:
            short = [(np.frombuffer(x.as_buffer(), U) >> U(32)).astype(np.uint32).tobytes() for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(short, pa.binary()), *batch.columns[1:]], ["halves", *batch.schema.names[1:]])

    docs = docs.join(reps.select("doc_id", "n_shingles", "bands"), "doc_id").join(sets, "doc_id")
    docs = docs.select("shingles", "doc_id", "c", "n_shingles", "bands", "open").mapInArrow(halve, "halves binary, doc_id long, c long, n_shingles long, bands array<long>, open array<struct<key:bigint,blocks:int>>")
    each = docs.select("doc_id", "c", "n_shingles", "bands", "halves", F.transform("open", lambda x: x["key"]).alias("keys"), F.explode("open").alias("k"))
    block = F.pmod(F.xxhash64("doc_id"), F.col("k.blocks")).cast("int")
    met = each.select("*", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("k.blocks") - 1)).alias("other"))
    grouped = met.select(F.col("k.key").alias("key"), F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "doc_id", "c", "n_shingles", "bands", "halves", "keys", "block")
    likely = grouped.groupBy("key", "lo", "hi").applyInArrow(run, "u long, v long")
    return _verified(keep(likely.distinct(), "across"), reps, sets, threshold)


def _link_components(members: DataFrame, links: DataFrame, reps: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """links, with those that join components of documents which share a band value; members has (key, doc_id)."""
    component = connected_components(links)
    placed = members.join(component.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("c"))
    rows = keep(_open(keep(placed, "placed")), "loose")
    if is_empty(rows):
        return links
    rows = keep(_open(keep(_unfinished(rows, reps, sets, threshold), "unfinished")), "loose")
    return links if is_empty(rows) else links.unionByName(_across(rows, reps, sets, threshold))


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of documents (doc_id, text).

    component_id is the smallest doc_id reachable over links of the threshold or
    more, itself included; kept is doc_id = component_id. Texts without words (null
    and empty ones) have no set and link with nothing. Rows that repeat a doc_id are
    one document with the set of each row; a null doc_id is its own component (null)
    and is kept. Other columns are ignored. An empty table gives an empty one.
    """
    found = keep(sketches(docs, n), "sketches")
    real = found.where("n_shingles > 0 and doc_id is not null")
    set_id = ["fp1", "fp2", "n_shingles"]
    classes = keep(real.groupBy(*set_id).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), "classes")
    reps = real.join(classes, set_id, "left").where("rep is null or rep = doc_id").select("doc_id", "n_shingles", "bands")
    reps = keep(reps, "reps")

    banded = _banded(reps)
    shared = banded.groupBy("key").agg(F.count("*").alias("members"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    shared = keep(shared.where("a < b").select("key", "members"), "shared")
    members = keep(banded.join(shared, "key"), "members")

    central = members.groupBy("doc_id").agg(F.sum("members").alias("weight"))
    leaders = members.join(central, "doc_id").groupBy("key").agg(F.max_by("doc_id", F.struct("weight", -F.col("doc_id"))).alias("leader"))
    leaders = keep(leaders, "leaders")
    pairs = members.join(leaders, "key").where("doc_id <> leader")
    pairs = keep(pairs.select(F.least("doc_id", "leader").alias("u"), F.greatest("doc_id", "leader").alias("v")).distinct(), "pairs")

    def sets_of(batches):
        for batch in batches:
            done = 0
            held: list[bytes] = []
            for u in shingle_sets(batch.column(1), n):
                held.append(u.tobytes())
                if len(held) == 500:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(held)), pa.array(held, pa.binary())], ["doc_id", "shingles"])
                    done, held = done + len(held), []
            if held:
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(held)), pa.array(held, pa.binary())], ["doc_id", "shingles"])

    asked = members.select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(asked, "doc_id", "left_semi")
    sets = keep(texts.mapInArrow(sets_of, "doc_id long, shingles binary"), "sets")

    links = _link_components(members.select("key", "doc_id").distinct(), _verified(pairs, reps, sets, threshold), reps, sets, threshold)
    component = keep(connected_components(links), "components")
    # Copies get the label of their class with it, by the set; the others have their own id's. So no join has a class as its key.
    labelled = classes.join(component.withColumnRenamed("node", "rep"), "rep", "left")
    labelled = keep(labelled.select(*set_id, F.coalesce("component", "rep").alias("class_label")), "labelled")
    out = found.drop("bands").join(labelled, set_id, "left").join(component.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = out.withColumn("component_id", F.when(linked, F.coalesce("class_label", "component", "doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"))
