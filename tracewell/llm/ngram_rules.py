"""Quality rules: counts of each text, and a hashed n-gram log-likelihood ratio."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracewell.llm import words as W

BUCKETS = 1 << 14
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _per_text(doc: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weight, n).astype(np.int64)


def counts(block: W.Block, words) -> list[np.ndarray]:
    """COUNTS of each text of a block whose (starts, ends, doc, hashes) are words."""
    (starts, ends, doc, h), n = words, len(block)
    sums = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    letters = sums((block.data & 0xC0) != 0x80)
    symbols = sums(_SYMBOL[block.data])
    a, b, owner = block.lines()
    at = sums(np.isin(np.arange(len(block.data)), starts, assume_unique=True)) if len(a) else sums([])
    full = at[b] > at[a]
    line = W.mix(W.span(block.sums(lower=False), a[full], b[full]) + owner[full].astype(W.U) * W.U(0x9E3779B97F4A7C15))
    first = np.zeros(len(line), bool)
    first[np.unique(line, return_index=True)[1]] = True
    g, where = W.grams(h, doc, 8)
    window = W.mix(g + doc[where].astype(W.U) * W.U(0x9E3779B97F4A7C15))
    _, back, times = np.unique(window, return_inverse=True, return_counts=True)
    twice = where[times[back] > 1]
    steps = np.bincount(twice, minlength=len(h) + 9) - np.bincount(twice + 8, minlength=len(h) + 9)
    repeated = np.cumsum(steps)[: len(h)] > 0
    return [
        _per_text(doc, n),
        _per_text(doc, n, letters[ends] - letters[starts]),
        symbols[block.offsets[1:]] - symbols[block.offsets[:-1]],
        _per_text(owner[full][~first], n),
        _per_text(doc[repeated], n),
    ]


def words_of(block: W.Block):
    starts, ends, doc = block.words()
    return starts, ends, doc, W.span(block.sums(lower=False), starts, ends)


def features(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and the pairs of neighbours, and the text of each."""
    g, at = W.grams(h, doc, 2)
    shift = W.U(64 - BUCKETS.bit_length() + 1)
    return np.concatenate([W.mix(h) >> shift, g >> shift]).astype(np.int64), np.concatenate([doc, doc[at]])


def bucket_counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(bucket, raw, target): how often each bucket stands in all documents, and in the trusted ones.

    trusted (doc_id) must have a size bound; it is broadcast. Each task counts its
    documents and gives one row for each bucket, and Spark adds those up.
    """

    def run(batches):
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            good = np.asarray(batch.column(1))
            for block in W.blocks(batch.column(0)):
                _, _, doc, h = words_of(block)
                f, owner = features(h, doc)
                total[0] += np.bincount(f, minlength=BUCKETS)
                total[1] += np.bincount(f[good[block.first + owner] > 0], minlength=BUCKETS)
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0][some]), pa.array(total[1][some])], ["bucket", "raw", "target"])

    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(trusted.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(1).alias("good"))), "doc_id", "left")
    per_task = marked.select("text", F.coalesce("good", F.lit(0)).alias("good")).mapInArrow(run, "bucket long, raw long, target long")
    return per_task.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def ratios(rows) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw), with add-one smoothing; 0 throughout without any target."""
    total = np.zeros((2, BUCKETS), np.int64)
    for r in rows:
        total[:, r["bucket"]] = r["raw"], r["target"]
    if not total[1].any():
        return np.zeros(BUCKETS)
    p = (total + 1) / (total.sum(1, keepdims=True) + BUCKETS)
    return np.log(p[1]) - np.log(p[0])


def trusted_sample(labels: DataFrame, fit_rows: int) -> DataFrame:
    """doc_ids of at most fit_rows labelled rows of good quality that aren't toxic, the same ones each time: those with the least hashes."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = -0.06, fit_rows: int = 20_000, max_repeat: int = 30, min_words: int = 20) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) for each document.

    score is the mean log-likelihood ratio of a text's words and word pairs between
    the trusted target (at most fit_rows labelled rows, a documented bound) and all
    documents; kept texts pass the base rules and score the threshold or more. The
    corpus is counted over all rows. Null, empty and blank texts have no words and
    fail; rows that repeat are judged each; a null doc_id is passed through.
    Without trusted rows every score is 0.
    """
    table = bucket_counts(docs, trusted_sample(labels, fit_rows)).collect()  # BUCKETS rows at most
    weight = docs.sparkSession.sparkContext.broadcast(ratios(table))
    kinds = [("doc_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("base_failed", pa.bool_()), ("score", pa.float64()), ("kept", pa.bool_())]

    def run(batches):
        w = weight.value
        for batch in batches:
            for block in W.blocks(batch.column(1)):
                words = words_of(block)
                own = counts(block, words)
                f, owner = features(words[3], words[2])
                used = np.bincount(owner, minlength=len(block))
                score = np.bincount(owner, w[f], len(block)) / np.maximum(1, used)
                failed = (own[0] < min_words) | (100 * own[4] > max_repeat * own[0])
                ids = batch.column(0).slice(block.first, len(block))
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, own), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))], schema=pa.schema(kinds))

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
