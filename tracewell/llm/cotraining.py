"""Quality classifier by co-training of a text view and a metadata view.

The text view sees which words a document has, and its shares of repeats, marks and
capitals; the metadata view never sees a word: it has language, source, size, and
the shape of the page (shares of repeated lines and words, of marks, digits and
capitals, lengths of lines and words). In each
round both score every document without a label, and the surest of each class,
picked from all of them by an exact top-k, teach the other view. A document is bad
for one reason or another, each of which one view may see alone, so a view's sure
"bad" always teaches, its "good" only where the other one doesn't say "bad"; and the
combination of the calibrated views leans on the lesser of the two.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tracewell.llm import words as W
from tracewell.llm.store import free_name, keep as write

BITS = 18
SPACE = 1 << BITS
#: Bytes of text whose features are made at once; a byte takes some hundred bytes of arrays meanwhile.
FEATURE_BYTES = 1 << 17
#: Rows of a fit that must have a feature.
LEAST_ROWS = 5
#: Features of a sample's rows that a fit takes at once, so that it needs little more than the features themselves.
PART = 1 << 16
_SYMBOL, _UPPER, _LETTER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in ".,;:'\"()-"]] = True
_UPPER[65:91] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_TOKEN = _LETTER.copy()
_TOKEN[128:] = True
_TOKEN[48:58] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def text_features(block: W.Block, shape: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each text, and the text of each: words, the first five bytes of longer words, and four measures of shape."""
    starts, ends, doc = block.pieces(_TOKEN[block.data])
    sums = block.sums(lower=True)
    long = ends - starts > 5
    stem = W.mix(W.span(sums, starts[long], starts[long] + 5) + W.U(77))
    own = [_steps(k, shape[k]) for k in (0, 2, 4, 6)]
    every = np.concatenate([(np.concatenate([W.span(sums, starts, ends), stem]) >> W.U(64 - BITS)).astype(np.int64), *own])
    both = np.unique(np.concatenate([doc, doc[long], *[np.arange(len(block))] * len(own)]).astype(np.int64) * SPACE + every)
    return both % SPACE, both // SPACE


def _steps(k: int, steps: np.ndarray) -> np.ndarray:
    """The hashed features of measure k in steps."""
    return (W.mix(steps.astype(W.U) + W.U(1000 * (k + 1))) >> W.U(64 - BITS)).astype(np.int64)


def shape_of(block: W.Block) -> list[np.ndarray]:
    """For each text in steps: words, lines, shares of distinct words and lines, of marks, digits and capitals, words a line, bytes a word."""
    n, data = len(block), block.data
    sums = block.sums(lower=True)

    def distinct(starts, ends, doc):
        own = np.unique(W.mix(W.span(sums, starts, ends) + doc.astype(W.U) * W.U(0x9E3779B97F4A7C15)), return_index=True)[1]
        return np.bincount(doc, minlength=n), np.bincount(doc[own], minlength=n)

    words, own_words = distinct(*block.words())
    lines, own_lines = distinct(*block.lines())
    size = np.diff(block.offsets)
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask[data])])[block.offsets])
    step = lambda a, b, k: np.minimum(31, k * a // np.maximum(1, b))
    log = lambda x: np.log2(x + 1).astype(np.int64)
    return [log(words), log(lines), step(own_words, words, 10), step(own_lines, lines, 10), step(count(_SYMBOL), words, 10), step(count(_DIGIT), words, 10), step(count(_UPPER), count(_LETTER), 20), log(words // np.maximum(1, lines)), step(size, words, 1)]


def metadata_features(columns: list[list], shape: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """One hashed feature for each metadata column, each measure of shape, and all columns of text together, of each row; numbers count by their power of two, null is a value of its own."""
    out = np.zeros((n, len(columns) + len(shape) + 1), np.int64)
    seen: dict[str, int] = {}

    def at(key: str) -> int:
        if key not in seen:
            seen[key] = zlib.crc32(key.encode()) % SPACE
        return seen[key]

    for i in range(n):
        named = [c[i] for c in columns]
        values = [int(math.log2(abs(v) + 1)) if isinstance(v, int | float) and math.isfinite(v) else v for v in named]
        out[i, : len(columns)] = [at(f"{k}:{v}") for k, v in enumerate(values)]
        out[i, -1] = at("both:" + ":".join(str(v) for v in named if v is None or isinstance(v, str)))
    for k, steps in enumerate(shape):
        out[:, len(columns) + k] = _steps(k, steps)
    return out.ravel(), np.repeat(np.arange(n), out.shape[1])


@dataclass
class Sparse:
    """The features of rows: f[at[i]:at[i + 1]] are those of row i."""

    f: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
        """Features, and the row of each, of the rows a to b - 1, some whole rows at a time; a and b."""
        a = 0
        while a < len(self):
            b = max(a + 1, int(np.searchsorted(self.at, self.at[a] + PART, "right")) - 1)
            yield self.f[self.at[a] : self.at[b]], np.repeat(np.arange(a, b), np.diff(self.at[a : b + 1])), a, b
            a = b


def sparse(rows: list[np.ndarray], keep: np.ndarray | None = None) -> Sparse:
    """The rows' features, or those of them that keep says, copied once."""
    at = np.cumsum([0, *(len(r) if keep is None else np.count_nonzero(keep[r]) for r in rows)])
    f = np.zeros(at[-1], np.int32)
    for i, r in enumerate(rows):
        f[at[i] : at[i + 1]] = r if keep is None else r[keep[r]]
    return Sparse(f, at)


@dataclass
class Linear:
    """Logistic regression over the hashed features that tell the classes apart, calibrated on held-out rows."""

    weight: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, f: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(row, self.weight[f], n) + self.bias

    def logit(self, f: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        return self.slope * self.raw(f, row, n) + self.shift

    def raw_of(self, rows: Sparse) -> np.ndarray:
        """raw() of each row."""
        return np.concatenate([np.zeros(0), *[self.raw(f, row - a, b - a) for f, row, a, b in rows.parts()]])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_linear(samples: list[Sparse], y: np.ndarray, counts: np.ndarray | None = None, most: int = 4096, least_chi: float = 12.0, rounds: int = 300) -> Linear:
    """Fits on the rows of all samples, one after the other, which count as much as counts says; only the features of the largest chi-squares (least_chi or more, most at most) get a weight.

    np.add.at adds in the order of the features, so results don't depend on PART.
    """
    counts = np.ones(len(y)) if counts is None else counts
    n, good = float(counts.sum()), float(counts @ y)
    weight = np.zeros(SPACE)
    bias = math.log((good + 0.5) / (n - good + 0.5))
    if not 0 < good < n:
        return Linear(weight, bias)
    first = np.cumsum([0, *map(len, samples)])
    with_f, good_f, counts_y = np.zeros(SPACE), np.zeros(SPACE), counts * y
    for k, rows in enumerate(samples):
        for f, row, _, _ in rows.parts():
            np.add.at(with_f, f, counts[row + first[k]])
            np.add.at(good_f, f, counts_y[row + first[k]])
    expected = with_f * good / n
    chi = (good_f - expected) ** 2 / np.maximum(1e-9, expected * (1 - good / n) * (1 - np.minimum(with_f, n - 1) / n))
    chosen = np.argsort(-chi, kind="stable")[:most]
    chosen = chosen[(chi[chosen] >= least_chi) & (with_f[chosen] >= LEAST_ROWS)]
    place = np.full(SPACE, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    # The chosen features and their rows, in the narrowest types.
    inside, per = [], 1
    for k, rows in enumerate(samples):
        for f, row, a, _ in rows.parts():
            there = place[f] >= 0
            inside.append((place[f[there]].astype(np.min_scalar_type(len(chosen))), (row[there] + first[k]).astype(np.min_scalar_type(len(y)))))
            per = max(per, int(np.bincount(row[there] - a).max(initial=0)) + 1)
    w, b, vw, vb = np.zeros(len(chosen)), bias, np.zeros(len(chosen)), 0.0
    # Accelerated gradient steps, scaled for each feature by how many rows have it.
    rate = 4.0 / (per * np.maximum(1, with_f[chosen]) * 0.5 + 4.0)
    pw, pb = w, b
    for k in range(rounds):
        m = k / (k + 3)
        vw, vb = w + m * (w - pw), b + m * (b - pb)
        z, slope = np.zeros(len(y)), np.zeros(len(chosen))
        for col, row in inside:
            np.add.at(z, row, vw[col])
        g = counts * (_sigmoid(z + vb) - y)
        for col, row in inside:
            np.add.at(slope, col, g[row])
        pw, pb = w, b
        w = vw - rate * (slope + 0.02 * vw)
        b = vb - 4.0 * g.sum() / (n * per)
    weight[chosen] = w
    return Linear(weight, float(b))


def calibrate(view: Linear, rows: Sparse, y: np.ndarray) -> None:
    """Platt scaling by Newton steps, with smoothed targets; a view that tells nothing ends near the prior."""
    n = len(y)
    if not n or not 0 < y.sum() < n:
        return
    x, good = view.raw_of(rows), y.sum()
    t = np.where(y > 0, (good + 1) / (good + 2), 1 / (n - good + 2))
    a, b = 0.0, math.log(good / (n - good))
    for _ in range(50):
        p = _sigmoid(a * x + b)
        g, s = p - t, p * (1 - p) + 1e-9
        h = np.array([[(s * x * x).sum() + 1e-3, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-3]])
        d = np.linalg.solve(h, [(g * x).sum(), g.sum()])
        a, b = a - d[0], b - d[1]
        if abs(d).max() < 1e-8:
            break
    view.slope, view.shift = float(a), float(b)


def combined(w: np.ndarray, t: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Log-odds from those of both views."""
    return w[0] + w[1] * t + w[2] * m + w[3] * np.minimum(t, m)


def fit_combination(t: np.ndarray, m: np.ndarray, y: np.ndarray, hold: float = 4.0) -> np.ndarray:
    """Weights of combined(), by Newton steps on held-out rows, held to the lesser of both views as by `hold` rows."""
    start = np.array([0.0, 0.0, 0.0, 1.0])
    if not len(y) or not 0 < y.sum() < len(y):
        return start
    x, w = np.stack([np.ones(len(y)), t, m, np.minimum(t, m)], 1), start.copy()
    for _ in range(50):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold * np.eye(4), x.T @ (p - y) + hold * (w - start))
        w = w - step * min(1.0, 2.0 / max(1e-9, abs(step).max()))
        if abs(step).max() < 1e-9:
            break
    return w


@dataclass
class CoTrained:
    """exchanged: how many labels the text view and the metadata view gave away in each round that was kept; threshold: of the score, from held-out rows."""

    text: Linear
    meta: Linear
    weights: np.ndarray
    threshold: float
    exchanged: list[tuple[int, int]]
    held_out_loss: list[float]


def best_threshold(p: np.ndarray, y: np.ndarray, cost: float = 5.0) -> float:
    """The score from which documents stay, where held-out rows cost least: a good one that goes counts cost times a bad one that stays. The middle of the widest such stretch; 0.5 without rows of both classes."""
    if not len(y) or not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(p, kind="stable")
    # Laplace's rule for what no held-out row shows: in both classes one more row, of the class's mean.
    cuts = np.concatenate([[0.0], p[order], [1.0]])
    lost = np.concatenate([[0.0], np.cumsum(y[order])]) * cost
    stays = (1 - y).sum() - np.concatenate([[0.0], np.cumsum(1 - y[order])])
    total = lost + stays
    wide = np.where(total <= total.min() + 1e-9, np.diff(cuts), -1.0)
    k = int(wide.argmax())
    return float(min(0.5, max(0.02, (cuts[k] + cuts[k + 1]) / 2)))


class Trainer:
    """Both views, the labelled rows with their features, and what the views gave each other so far."""

    def __init__(self, train: list[Sparse], test: list[Sparse], y: np.ndarray, held: np.ndarray, weight: float) -> None:
        """train and test have the features of both views of the rows that aren't held and of those that are."""
        self.train, self.test, self.weight = train, test, weight
        self.y, self.held_y = y[~held].astype(float), y[held].astype(float)
        #: For each view, what it learnt from the other one, a sample and its labels for each round.
        self.given: list[list[tuple[Sparse, np.ndarray]]] = [[], []]

    def fit(self, rounds: int) -> list[Linear]:
        views = []
        for train, test, given in zip(self.train, self.test, self.given, strict=True):
            y = np.concatenate([self.y, *[labels for _, labels in given]])
            counts = np.concatenate([np.ones(len(train)), np.full(len(y) - len(train), self.weight)])
            view = fit_linear([train, *[rows for rows, _ in given]], y, counts, rounds=rounds)
            calibrate(view, test, self.held_y)
            views.append(view)
        return views

    def combination(self, views: list[Linear]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(weights, scores, labels) on the held-out rows."""
        t, m = (view.slope * view.raw_of(rows) + view.shift for rows, view in zip(self.test, views, strict=True))
        w = fit_combination(t, m, self.held_y)
        return w, _sigmoid(combined(w, t, m)), self.held_y

    def losses(self, views: list[Linear]) -> np.ndarray:
        """The log-loss of each held-out row."""
        _, p, y = self.combination(views)
        p = np.clip(p, 1e-6, 1 - 1e-6)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p))


def _mean(x: np.ndarray) -> float:
    return float(x.mean()) if len(x) else 0.0


def is_worse(after: np.ndarray, before: np.ndarray) -> bool:
    """Whether the held-out losses rose by more than one standard error of their differences."""
    d = after - before
    return len(d) > 1 and d.mean() > d.std() / math.sqrt(len(d)) + 1e-9


def _features(batch: pa.RecordBatch, first_meta: int):
    for block in W.blocks(batch.column(1), FEATURE_BYTES):
        n = len(block)
        meta = [batch.column(k).slice(block.first, n).to_pylist() for k in range(first_meta, batch.num_columns)]
        shape = shape_of(block)
        yield block, text_features(block, shape), metadata_features(meta, shape, n)


def _known(labels: DataFrame) -> DataFrame:
    """(doc_id, y): 1 for quality 1 and not toxic; of repeated labels the worst counts."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(good.cast("int")).alias("y"))


def _fetch(docs: DataFrame, chosen: DataFrame, metadata: list[str]) -> tuple[np.ndarray, np.ndarray, list]:
    """(ids, y, features of both views) of the chosen (doc_id, y), a bounded table. Of rows that repeat an id the one with the least hash of its text counts, picked before anything reaches the driver."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(F.col("text").alias("text"), *[F.col(f"`{c}`").alias(f"m{k}") for k, c in enumerate(metadata)]).alias("row"))
    one = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by("row", F.xxhash64("row")).alias("row"), F.min("y").alias("y"))

    def run(batches):
        for batch in batches:
            for block, text, meta in _features(batch, 3):
                own = [pa.Array.from_buffers(pa.binary(), len(block), [None, pa.py_buffer((4 * W.bounds(owner, len(block))).astype(np.int32)), pa.py_buffer(f.astype(np.int32))]) for f, owner in (text, meta)]
                part = batch.slice(block.first, len(block))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *own], ["doc_id", "y", "t", "m"])

    got = one.select("doc_id", "row.text", "y", *[f"row.m{k}" for k in range(len(metadata))]).mapInArrow(run, "doc_id long, y int, t binary, m binary").toArrow()
    ids, y = (np.concatenate([np.zeros(0, np.int64), *map(np.asarray, got.column(name).chunks)]).astype(np.int64) for name in ("doc_id", "y"))
    order = np.argsort(ids)
    features = []
    for name in "tm":
        every = [np.frombuffer(x.as_buffer(), np.int32) for x in got.column(name)]  # views, no copies
        features.append([every[i] for i in order])
    return ids[order], y[order], features


def _samples(features: list[list[np.ndarray]], held: np.ndarray) -> tuple[list[Sparse], list[Sparse]]:
    """Both views of the rows that aren't held, and of those that are, without what fewer than LEAST_ROWS rows have: it gets no weight in any fit."""
    train, test = [], []
    for view in features:
        seen = np.zeros(SPACE, np.int32)
        for f in view:
            np.add.at(seen, f, 1)
        for sample, own in ((train, ~held), (test, held)):
            sample.append(sparse([view[i] for i in np.flatnonzero(own)], seen >= LEAST_ROWS))
    return train, test


def _scored(docs: DataFrame, metadata: list[str], views: list[Linear]) -> DataFrame:
    """(doc_id, h, t, m): the log-odds of both views for every document; h is the hash of the row that _fetch goes by."""
    shared = docs.sparkSession.sparkContext.broadcast(views)
    named = [F.col(f"`{c}`").alias(f"m{k}") for k, c in enumerate(metadata)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.struct(F.col("text").alias("text"), *named)).alias("h"), *named)

    def run(batches):
        text_view, meta_view = shared.value
        for batch in batches:
            for block, text, meta in _features(batch, 3):
                n = len(block)
                part = batch.slice(block.first, n)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(text_view.logit(*text, n)), pa.array(meta_view.logit(*meta, n))], ["doc_id", "h", "t", "m"])

    return rows.where("doc_id is not null").mapInArrow(run, "doc_id long, h long, t double, m double")


def _surest(pool: DataFrame, grow: int, confident: float) -> list[tuple[str, int, int]]:
    """(view, doc_id, label): of the pool (doc_id, t, m) the grow surest documents of each view and class, if confident; ties by the hash of the id."""
    least = math.log(confident / (1 - confident))
    lists = []
    for view, other in ("tm", "mt"):
        for label, sure in ((1, F.col(view)), (0, -F.col(view))):
            top = pool.where((sure >= least) & ((F.col(other) >= 0) | F.lit(label == 0))).orderBy(sure.desc(), F.xxhash64("doc_id"), "doc_id").limit(grow)
            lists.append(top.select(F.lit(view).alias("view"), "doc_id", F.lit(label).alias("label")))
    every = lists[0]
    for other in lists[1:]:
        every = every.unionByName(other)
    return [(r["view"], r["doc_id"], r["label"]) for r in every.collect()]


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 12_000, metadata: tuple[str, ...] = ("lang", "source", "n_chars"), rounds: int = 2, confident: float = 0.9, grow: int = 400, weight: float = 0.25) -> CoTrained:
    """Co-trains both views on at most fit_rows labelled documents (a documented bound), those of the least hashes of their ids.

    Good means quality 1 and not toxic. A fifth of the labelled rows is held out, to
    calibrate the views and to set the threshold. Each of the rounds scores every
    document without a label in Spark; the grow surest of each view and class
    (confident or more) teach the other view, counting weight of a labelled row each,
    so that rounds * grow * 2 rows at most join a view's sample. What a view learnt in
    a round is undone if the held-out loss is worse with it, by more than a standard
    error. Only the features of
    the labelled sample and of what is exchanged come to the driver: at most 2^18
    numbers for a row, a few hundred for usual texts.
    """
    there = [c for c in metadata if c in docs.columns]
    known = _known(labels)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    ids, y, parts = _fetch(docs, chosen, there)
    held = W.mix(ids.astype(W.U)) % W.U(5) == 0
    trainer = Trainer(*_samples(parts, held), y, held, weight)
    del parts
    views = trainer.fit(300)
    lost, exchanged, taken = [trainer.losses(views)], [], {}
    for k in range(rounds if 0 < y.sum() < len(y) else 0):
        scored = _scored(docs, there, views).groupBy("doc_id").agg(F.min_by(F.struct("t", "m"), "h").alias("x"))
        pool = write(scored.join(known, "doc_id", "left_anti").select("doc_id", "x.t", "x.m"), "pool")
        if taken:
            gone = docs.sparkSession.createDataFrame([(d,) for d in taken], "doc_id long")
            pool = pool.join(F.broadcast(gone), "doc_id", "left_anti")
        found = _surest(pool, grow, confident)
        says: dict[str, dict[int, int]] = {v: {d: label for view, d, label in found if view == v} for v in "tm"}
        new = {d for own in says.values() for d in own}
        if not new:
            break
        got, _, features = _fetch(docs, docs.sparkSession.createDataFrame([(d, 0) for d in sorted(new)], "doc_id long, y int"), there)
        before = list(trainer.given)
        for side, teacher in ((0, "m"), (1, "t")):
            rows = [i for i, d in enumerate(got.tolist()) if d in says[teacher]]
            labels_of = np.array([says[teacher][int(got[i])] for i in rows], float)
            trainer.given[side] = [*trainer.given[side], (sparse([features[side][i] for i in rows]), labels_of)]
        del features
        after = list(trainer.given)
        for kept in ((True, True), (False, True), (True, False)):
            trainer.given = [now if k else was for k, now, was in zip(kept, after, before, strict=True)]
            tried = trainer.fit(300)
            loss = trainer.losses(tried)
            if not is_worse(loss, lost[-1]):
                break
        else:
            trainer.given = before
            break
        views = tried
        lost.append(loss)
        exchanged.append((len(says["t"]) if kept[1] else 0, len(says["m"]) if kept[0] else 0))
        taken |= dict.fromkeys(new)
    w, p, held_y = trainer.combination(views)
    return CoTrained(*views, w, best_threshold(p, held_y), exchanged, [_mean(x) for x in lost])


SCORES = ("text_logit", "meta_logit", "quality_score", "quality_kept")


def classify(docs: DataFrame, labels: DataFrame, threshold: float | None = None, metadata: tuple[str, ...] = ("lang", "source", "n_chars"), **options) -> DataFrame:
    """All columns of docs, with text_logit, meta_logit, quality_score and quality_kept (score >= threshold) for each row.

    Every document is scored, over its whole text; the threshold is that of the
    held-out labels unless one is given. Null and empty texts have no words and the
    shape of an empty page and are scored too; rows that repeat are scored each;
    missing metadata columns are left out. Without labels of both classes all scores
    lie at the prior. Columns of docs pass unchanged: if one has a name of SCORES,
    the new column has the name that added_columns() says.
    """
    there = [c for c in metadata if c in docs.columns]
    model = fit(docs, labels, metadata=metadata, **options)
    limit = model.threshold if threshold is None else threshold
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = added_columns(docs.columns)
    at = [docs.columns.index(c) for c in there]
    first, text_at = docs.columns.index("doc_id"), docs.columns.index("text")

    def run(batches):
        own = shared.value
        for batch in batches:
            view = pa.RecordBatch.from_arrays([batch.column(first), batch.column(text_at), *[batch.column(k) for k in at]], [f"c{k}" for k in range(2 + len(at))])
            for block, text, meta in _features(view, 2):
                n = len(block)
                t, m = own.text.logit(*text, n), own.meta.logit(*meta, n)
                p = _sigmoid(combined(own.weights, t, m))
                part = batch.slice(block.first, n)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(t), pa.array(m), pa.array(p), pa.array(p >= limit)], [*part.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.DoubleType()) for c in names[:3]], T.StructField(names[3], T.BooleanType())])
    return docs.mapInArrow(run, schema)


def added_columns(columns: list[str]) -> list[str]:
    """The names under which classify() adds its four columns to those."""
    names: list[str] = []
    for name in SCORES:
        names.append(free_name([*columns, *names], name))
    return names
