"""Search in transcripts: what can be found, where it occurs, and the best hits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tracewell.functions import text as X
from tracewell.operators.sessions import mark_runs


def searchable(rows: DataFrame, by: tuple[str, ...] = ("session",), pos: str = "pos") -> DataFrame:
    """(.., pos, kind, text): user rows' shown text, and of each ai run the last row that has text; needs category and text."""
    runs = mark_runs(rows, by=by, pos=pos)
    users = runs.where("category = 'user'").select(*by, pos, F.lit("user").alias("kind"), X.sanitize(F.col("text")).alias("text"))
    ai = runs.where("category = 'ai' and text <> ''").groupBy(*by, "run").agg(F.max(pos).alias("pos"), F.max_by("text", pos).alias("text"))
    return users.unionByName(ai.select(*by, F.col("pos").alias(pos), F.lit("ai").alias("kind"), "text")).where("text <> ''")


#: Matches that a Python worker holds as objects before it packs them, and from which it gives out a batch.
_PACK = 4096
_PLACE = pa.struct([("offset", pa.int32()), ("matched", pa.string()), ("context", pa.string())])


def _matches(text: str, query: str, around: int) -> Iterator[tuple[int, str, str]]:
    """(offset, matched, context) of each place, in one pass over a text, in time that follows its length and its matches."""
    n, low, at = len(query), text.lower(), 0
    while (at := low.find(query, at)) >= 0:
        begin, end = max(at - around, 0), min(at + n + around, len(text))
        yield at, text[at : at + n], ("..." if begin else "") + text[begin:end] + ("..." if end < len(text) else "")
        at += n


def _lists(texts: Iterator[pa.Array], query: str, around: int, pack: int = _PACK) -> Iterator[pa.Array]:
    """The places of each text as lists, some texts at a time: a list of results ends with the text that brings it to pack matches, and what is found is packed as Arrow that often, within a text too."""
    for batch in texts:
        packed, lengths, held = [], [0], []
        for scalar in batch:
            n = 0
            for n, place in enumerate(_matches(scalar.as_py() or "", query, around), 1):  # noqa: B007
                held.append(place)
                if len(held) >= pack:
                    packed.append(_packed(held))
                    held = []
            lengths.append(lengths[-1] + n)
            if lengths[-1] >= pack:
                yield _list(packed, lengths, held)
                packed, lengths, held = [], [0], []
        if len(lengths) > 1 or not len(batch):
            yield _list(packed, lengths, held)


def _packed(held: list[tuple]) -> pa.Array:
    columns = zip(*held, strict=True) if held else ((), (), ())
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PLACE, strict=True)], fields=list(_PLACE))


def _list(packed: list[pa.Array], lengths: list[int], held: list[tuple]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.concat_arrays([*packed, _packed(held)]))


def _occurrences(query: str, around: int = 50):
    """A function from texts to lists of (offset, matched, context). A worker holds a batch of texts and the matches of a few of them, whatever the input's size."""

    @F.arrow_udf("array<struct<offset:int,matched:string,context:string>>")
    def find(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _lists(texts, query, around)

    return find


def hits(entries: DataFrame, query: str, text: str = "text", trim: bool = True) -> DataFrame:
    """Each non-overlapping occurrence of query in a text, case ignored: match_no from 0, offset, and 50 characters round it.

    Texts without the query are filtered before. The places are found in one pass over a
    text (Arrow; as column expressions the sum of lengths before each match would be
    quadratic), and the text isn't carried to its matches unless it is asked for. Inside
    a session (trim=False) white space round the query counts; a blank query finds nothing.
    """
    q = (query.strip() if trim else query).lower()
    if not q.strip():
        q, entries = " ", entries.limit(0)
    found = entries.where(F.lower(text).contains(q))
    places = found.withColumn("_places", _occurrences(q)(F.col(text)))
    return places.select(*entries.columns, F.posexplode("_places").alias("match_no", "_m")).select(*entries.columns, "match_no", "_m.*")


def capped(found: DataFrame, order: list, by: tuple[str, ...] = ("session",), most: int = 500) -> DataFrame:
    """The first matches of each session in the order of its items, most at most, with their index, and is_capped where there were more."""
    w = Window.partitionBy(*by).orderBy(*order)
    ranked = found.withColumn("index", F.row_number().over(w) - 1).where(F.col("index") <= most)
    more = ranked.where(F.col("index") == most).select(*by, F.lit(True).alias("_more"))
    return ranked.where(F.col("index") < most).join(more, list(by), "left").withColumn("is_capped", F.coalesce("_more", F.lit(False))).drop("_more")


def top_hits(found: DataFrame, order: list, limit: int = 50) -> DataFrame:
    """The newest hits over all projects: an exact top-k, at most 200."""
    return found.orderBy(*order).limit(min(limit, 200))


def titles(entries: DataFrame, by: tuple[str, ...] = ("session",), pos: str = "pos") -> DataFrame:
    return entries.where("kind = 'user'").groupBy(*by).agg(F.min_by("text", pos).substr(1, 100).alias("title"))


def preceding(rows: DataFrame, by: tuple[str, ...] = ("session",), pos: str = "pos") -> DataFrame:
    """For each ai row the position of the nearest user row before it in the same run of rows."""
    w = Window.partitionBy(*by).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("user_pos", F.last(F.when(F.col("category") == "user", F.col(pos)), True).over(w)).where("category = 'ai'")


def preceding_command(items: DataFrame, by: tuple[str, ...] = ("session",), pos: str = "pos") -> DataFrame:
    """(.., pos, user_pos, name, args) for each ai item whose nearest user item before it, with no other ai item between, is a command; items has item and text."""
    w = Window.partitionBy(*by).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    user = F.last(F.when(F.col("item") == "user", F.struct(F.col(pos).alias("pos"), F.col("text").alias("text"))), True).over(w)
    other = F.last(F.when(F.col("item") == "ai", F.col(pos)), True).over(w)
    seen = items.withColumn("_user", user).withColumn("_ai", other).where("item = 'ai'")
    near = seen.where(F.col("_ai").isNull() | (F.col("_user.pos") > F.col("_ai")))
    said = F.col("_user.text")
    return near.where(X.is_command(said)).select(*by, pos, F.col("_user.pos").alias("user_pos"), X.slash_name(said).alias("name"), X.slash_args(said).alias("args")).where("name is not null")
