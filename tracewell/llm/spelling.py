"""Spelling variants: words that differ by one code point, found in a bit-sliced position index.

The vocabulary is dealt into blocks so that words one edit apart meet: of two such words
the shorter has length m, the edit lies in one of two ranges of its places, and what is
outside that range is equal in both. A block's key is that rest (the start before the
range, the end behind it). A block of more than MOST words is dealt again by half of its
range; a range of one place holds at most 90 + 90 * 90 words over this alphabet, so no
block stays larger.

In a block 64 words make one slice, and B[place][letter] is a bit set over a slice. A
query word is run through its block's slices by the recurrences of approximate bit-
parallel matching, for all queries and slices at once: Z holds the words that agree so
far, S those with one replaced letter (same place), I those with one letter more (their
next letters stand one place further) and D those with one letter less.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracewell.llm.store import is_empty, keep

#: A word of the contract: letters of ASCII and of Latin-1. 26 + 64 letters, once A-Z are lower-cased.
LETTERS = "A-Za-zÀ-ÿ"
ALPHABET = 26 + 64
#: Words in a block: what a range of one place can hold at most, rounded up.
MOST = 8192
#: Distinct words that a task holds before it passes their counts on.
HELD = 300_000
#: Pairs of a query and a slice that are run at once.
LANES = 1 << 17
#: Letters of the blocks that are indexed together (a larger block stands alone): they bound the bit sets and the lanes' states.
CELLS = 300_000
U = np.uint64


def word_counts(docs: DataFrame, min_length: int = 7, every: int = 31) -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased, where every-th run by crc32 of "<doc_id>:<run>" loses the letter crc32 % length."""
    runs = re.compile(f"[{LETTERS}]{{{min_length},}}")

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                prefix = zlib.crc32(f"{doc_id.as_py() or ''}:".encode())
                # bytes.lower() changes A-Z only.
                for word, n in Counter(runs.findall(text.as_buffer().to_pybytes().lower().decode())).items():
                    h = zlib.crc32(word.encode(), prefix)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < min_length:
                            continue
                    total[word] += n
            if len(total) > HELD:
                yield _pairs(total)
                total = Counter()
        yield _pairs(total)

    own = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _pairs(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])


_OWN = ["m", "lo", "hi", "word", "n"]


def _keyed(ranges: DataFrame) -> DataFrame:
    """ranges (m, lo, hi, word, n) with the key of what lies outside: the first lo and the last m - hi letters.

    The key is a hash; where two keys collide their blocks are one, which gives no
    wrong pair, as whole words are compared.
    """
    rest = [F.expr("substring(word, 1, lo)"), F.expr("substring(word, char_length(word) - (m - hi) + 1, m - hi)")]
    return ranges.withColumn("key", F.xxhash64("m", "lo", "hi", *rest))


def _halves(ranges: DataFrame) -> DataFrame:
    """Each range as its two halves; their gaps between letters overlap in the middle, so nothing falls between."""
    parts = "array(struct(lo as lo, lo + (hi - lo) div 2 as hi), struct(lo + (hi - lo) div 2 as lo, hi as hi))"
    cut = ranges.select("m", "word", "n", F.explode(F.expr(parts)).alias("r")).select("m", F.col("r.lo").cast("int").alias("lo"), F.col("r.hi").cast("int").alias("hi"), "word", "n")
    return cut.where("hi > lo")


def blocks(words: DataFrame, min_length: int = 7, most: int = MOST) -> DataFrame:
    """(m, lo, hi, words: list of (word, n)): at least two words that agree outside the places lo to hi of the shorter's m.

    A list has `most` words at most, and 32 * most letters, unless hi - lo is 1.
    """
    length = F.char_length("word")
    # As the shorter (or equal) word, and as the one with a letter more.
    both = F.explode(F.array(length, length - 1)).alias("m")
    level = words.select(both, "word", "n").where(F.col("m") >= min_length).select("m", F.lit(0).alias("lo"), F.col("m").alias("hi"), "word", "n")
    level, done = _keyed(_halves(level)), []
    while True:
        group = ["key", "m", "lo", "hi"]
        large = (F.col("count") > most) | (F.col("count") * F.col("m") > 32 * most)
        hot = keep(level.groupBy(group).count().where(large & (F.col("hi") - F.col("lo") > 1)).select(group), "hot-blocks")
        if is_empty(hot):
            done.append(level)
            break
        done.append(level.join(hot, group, "left_anti"))
        level = _keyed(_halves(keep(level.join(hot, group, "left_semi").select(*_OWN), "hot-words")))
    rows = functools.reduce(DataFrame.unionByName, [d.select("key", *_OWN) for d in done])
    found = rows.groupBy("key", "m", "lo", "hi").agg(F.collect_list(F.struct("word", "n")).alias("words"))
    return found.where(F.size("words") > 1).select("m", "lo", "hi", "words")


def codes(words: list[str], width: int) -> np.ndarray:
    """A row for each word: its letters as 1 to ALPHABET, and 0 behind its end."""
    raw = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("latin-1"), np.uint8).reshape(len(words), width)
    return np.where(raw == 0, 0, np.where(raw < 128, raw - 96, raw - 192 + 27)).astype(np.uint8)


class Index:
    """B[place][letter] over words that are cut into slices of 64, a slice never across two groups."""

    def __init__(self, x: np.ndarray, lengths: np.ndarray, group: np.ndarray):
        self.x, self.lengths = x, lengths
        size = np.bincount(group)
        self.begin = np.concatenate([[0], np.cumsum(size)])
        self.slices = -(-size // 64)
        self.first_slice = np.concatenate([[0], np.cumsum(self.slices)])
        inside = np.arange(len(group)) - self.begin[group]
        self.slice, self.bit = self.first_slice[group] + inside // 64, inside % 64

    def _sets(self, at: np.ndarray, width: int, mask: np.ndarray | None = None) -> np.ndarray:
        """Bit sets over (slice, value): bits of words with the value. Bits are distinct, so their sum is their union; halves of 32 bits are exact as doubles."""
        take = slice(None) if mask is None else mask
        where, bit = (self.slice * width + at)[take], self.bit[take]
        n = int(self.first_slice[-1]) * width
        low = np.bincount(where, np.where(bit < 32, 2.0 ** (bit % 32), 0), n).astype(U)
        high = np.bincount(where, np.where(bit >= 32, 2.0 ** (bit % 32), 0), n).astype(U)
        return low | high << U(32)

    def place(self, i: int) -> np.ndarray:
        """B[i], flat: slice * (ALPHABET + 1) + letter; without any word beyond the ends."""
        if 0 <= i < self.x.shape[1]:
            return self._sets(self.x[:, i], ALPHABET + 1, self.x[:, i] > 0)
        return np.zeros(int(self.first_slice[-1]) * (ALPHABET + 1), U)

    def at_least(self, n: int) -> np.ndarray:
        """Slices' words of n letters or more."""
        return self._sets(np.zeros(len(self.slice), np.int64), 1, self.lengths >= n)


def near(x: np.ndarray, lengths: np.ndarray, group: np.ndarray, m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, other): all pairs of words of one group that are one edit apart and not both longer than m; groups are contiguous and lengths m or m + 1."""
    index, width = Index(x, lengths, group), ALPHABET + 1
    many = index.slices[group]
    reach = np.concatenate([[0], np.cumsum(many)])
    lanes = [(a, min(len(group), max(a + 1, int(np.searchsorted(reach, reach[a] + LANES, "right")) - 1))) for a in _starts(reach)]
    queries = [np.repeat(np.arange(a, b), many[a:b]) for a, b in lanes]
    slices = [np.arange(len(q)) - np.repeat(reach[a:b] - reach[a], many[a:b]) + index.first_slice[group[q]] for q, (a, b) in zip(queries, lanes, strict=True)]
    exact_m, longer = index.at_least(m) & ~index.at_least(m + 1), index.at_least(m + 1)
    sets = [index.place(-1), index.place(0), index.place(1)]
    state = [[(exact_m | longer)[s], *(np.zeros(len(s), U) for _ in range(3))] for s in slices]
    for i in range(m + 1):
        before, here, after = sets
        present = index.at_least(i + 1)
        for k, (q, s) in enumerate(zip(queries, slices, strict=True)):
            letter = x[q, i].astype(np.int64)
            z, sub, ins, dele = state[k]
            at, has = s * width + letter, present[s]
            now = here[at]
            ended = letter == 0  # a word of m letters has read its end: its states stay
            state[k] = [
                np.where(ended, z, z & now),
                np.where(ended, sub, (sub & now) | (z & ~now & has)),
                np.where(ended, ins | (z & has), (ins | (z & has)) & after[at]),
                np.where(ended, dele, (dele & before[at]) | z),
            ]
        sets = [here, after, index.place(i + 2)]
    for (q, s), (z, sub, ins, dele) in zip(zip(queries, slices, strict=True), state, strict=True):
        short = lengths[q] == m
        found = np.where(short, (sub & exact_m[s]) | (ins & longer[s]), dele & exact_m[s])
        some = np.flatnonzero(found)
        if len(some):
            bits = np.unpackbits(found[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            lane, bit = np.nonzero(bits)
            lane = some[lane]
            yield q[lane], index.begin[group[q[lane]]] + 64 * (s[lane] - index.first_slice[group[q[lane]]]) + bit


def _starts(reach: np.ndarray) -> list[int]:
    """Where runs of queries with about LANES lanes begin."""
    out, a = [], 0
    while a < len(reach) - 1:
        out.append(a)
        a = max(a + 1, int(np.searchsorted(reach, reach[a] + LANES, "right")) - 1)
    return out


def _links(batches):
    """For rows of blocks(): each word's near words of its block, as their number and the best of them."""
    for batch in batches:
        m, lo, hi = (np.asarray(batch.column(i)) for i in range(3))
        lists = batch.column(3)
        ends = np.asarray(lists.offsets, np.int64)
        words, counts = lists.values.field(0).to_pylist(), np.asarray(lists.values.field(1))
        out: list[tuple[str, int, int, str]] = []
        for length in np.unique(m):
            rows = np.flatnonzero(m == length)
            for some in np.split(rows, np.flatnonzero(np.diff(np.cumsum(ends[rows + 1] - ends[rows]) * (int(length) + 1) // CELLS)) + 1):
                out += _block_links([words[ends[r] : ends[r + 1]] for r in some], [counts[ends[r] : ends[r + 1]] for r in some], int(length), lo[some], hi[some])
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "form_n", "form"])


def _block_links(groups: list[list[str]], counts: list[np.ndarray], m: int, lo: np.ndarray, hi: np.ndarray) -> list[tuple[str, int, int, str]]:
    words, n = [w for g in groups for w in g], np.concatenate(counts)
    group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    lengths = np.array([len(w) for w in words])
    x = codes(words, m + 1)
    pairs = list(near(x, lengths, group, m))
    if not pairs:
        return []
    q, v = (np.concatenate(c) for c in zip(*pairs, strict=True))
    # A pair counts in the one block whose range has its first difference.
    edit = np.concatenate([np.argmax(x[q[a : a + 100_000]] != x[v[a : a + 100_000]], axis=1) for a in range(0, len(q), 100_000)])
    own = (edit >= lo[group[q]]) & ((edit < hi[group[q]]) | ((edit == m) & (hi[group[q]] == m)))
    q, v = q[own], v[own]
    best: dict[int, tuple[int, int, str]] = {}
    for a, b in zip(q.tolist(), v.tolist(), strict=True):
        key = (-int(n[b]), words[b])
        times, least, form = best.get(a, (0, 1, ""))
        best[a] = (times + 1, *min((least, form), key)) if times else (1, *key)
    return [(words[a], times, -least, form) for a, (times, least, form) in best.items()]


def _roots(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root): the end of each word's chain of forms; each round doubles what is followed."""
    reached = keep(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max(0, steps - 1).bit_length()):
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        reached = keep(reached.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return reached


def variants(docs: DataFrame, min_length: int = 7, min_count: int = 2, factor: int = 10, most: int = MOST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of min_length letters or more that occurs min_count times or more.

    n_near counts the words one inserted, deleted or replaced code point away; form is
    the one of them with the largest n (the first in code-point order, if several), if
    that is factor times the word's own n or more, else null, and form_n its n; root is
    where the chain of forms ends, the word itself without one. docs has doc_id and text;
    null texts have no words, a null id counts as '' in the hash, repeated rows count
    again, and other columns may have any name. An empty table gives no row.
    """
    words = keep(word_counts(docs, min_length).where(F.col("n") >= min_count), "vocabulary")
    links = blocks(words, min_length, most).mapInArrow(_links, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    found = links.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.less") >= factor * F.col("n")
    all_words = keep(
        words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")),
        "forms",
    )
    largest = words.agg(F.max("n")).first()[0] or 1
    # Counts grow by the factor with each step of a chain.
    steps = 1
    while min_count * factor**steps <= largest:
        steps += 1
    roots = _roots(all_words.where("form is not null"), steps)
    return all_words.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
