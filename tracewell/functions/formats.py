"""Numbers, durations, dates and model names as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of model names.
MODEL_PREFIX = "claude"
FAMILIES = ("sonnet", "opus", "haiku")


def one_decimal(x: Column) -> Column:
    """Half up on the shown digit, through decimals, so that engines agree."""
    return F.round(x.cast("decimal(30,6)"), 1).cast("decimal(30,1)").cast("string")


def format_tokens(n: Column) -> Column:
    """999, 9.9k, 10k"""
    return F.when(n < 1000, n.cast("string")).when(n < 10000, F.concat(one_decimal(n / 1000), F.lit("k"))).otherwise(F.concat(F.floor(n / 1000 + 0.5).cast("string"), F.lit("k")))


def format_tokens_compact(n: Column) -> Column:
    """999, 1.0k, 1.0M"""
    return F.when(n >= 1_000_000, F.concat(one_decimal(n / 1_000_000), F.lit("M"))).when(n >= 1000, F.concat(one_decimal(n / 1000), F.lit("k"))).otherwise(n.cast("string"))


def format_tokens_detailed(n: Column) -> Column:
    return F.format_number(n, 0)


def format_duration(ms: Column) -> Column:
    """999ms, 59.9s, 2m 3s"""
    s = ms / 1000
    return F.when(ms < 1000, F.concat(F.floor(ms + 0.5).cast("string"), F.lit("ms"))).when(s < 60, F.concat(one_decimal(s), F.lit("s"))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m "), F.floor(s % 60 + 0.5).cast("string"), F.lit("s")))


def format_duration_whole(ms: Column) -> Column:
    """999ms, 59s, 2m 3s: everything rounded down."""
    s = F.floor(ms / 1000)
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))


def percentage(part: Column, total: Column) -> Column:
    """Share in percent with one decimal, 100.0 at most; 0.0 of nothing."""
    return F.when(total == 0, "0.0").otherwise(one_decimal(F.least(part / total * 100, F.lit(100.0))))


def date_bucket(ts: Column, as_of: Column) -> Column:
    """Today, Yesterday, Previous 7 Days (whole days of 24 h), Older."""
    days = F.datediff(as_of, ts)
    whole = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(86_400_000_000))
    return F.when(days == 0, "Today").when(days == 1, "Yesterday").when(whole <= 7, "Previous 7 Days").otherwise("Older")


def parse_model(model: Column) -> Column:
    """(family, major, minor, name) of a model string in either layout, family first or version first; null if it is none."""
    parts = F.split(F.lower(F.trim(model)), "-")
    at = lambda i: F.get(parts, i)
    number = lambda s: F.when(s.rlike("^[0-9]+$"), s.try_cast("int"))
    tail = F.slice(parts, 2, F.size(parts))
    known = F.filter(tail, lambda p: p.isin(*FAMILIES))
    other = F.filter(tail, lambda p: ~p.rlike("^[0-9]+$") & (F.length(p) > 1))
    family = F.coalesce(F.get(known, F.lit(0)), F.get(other, F.lit(0)))
    place = F.array_position(tail, family)
    first = place == 1
    major = F.when(first, number(at(F.lit(2)))).otherwise(number(at(F.lit(1))))
    minor = F.when(first, F.when(F.length(at(F.lit(3))) <= 2, number(at(F.lit(3))))).when(place > 2, number(at(F.lit(2))))
    ok = (at(F.lit(0)).startswith(MODEL_PREFIX)) & (F.size(parts) >= F.when(first, 4).otherwise(3)) & family.isNotNull() & major.isNotNull()
    version = F.concat(major.cast("string"), F.coalesce(F.concat(F.lit("."), minor.cast("string")), F.lit("")))
    return F.when(ok, F.struct(family.alias("family"), major.alias("major"), minor.alias("minor"), F.concat(family, version).alias("name")))


def format_seconds(ms: Column) -> Column:
    """12.3s"""
    return F.concat(one_decimal(ms / 1000), F.lit("s"))


def format_duration_short(ms: Column) -> Column:
    """999ms, 1.5s, 2m, 2m 3s: whole seconds from a minute on, rounded down."""
    minutes, rest = F.floor(ms / 60_000).cast("string"), F.floor(ms / 1000) % 60
    long = F.concat(minutes, F.lit("m"), F.when(rest > 0, F.concat(F.lit(" "), rest.cast("string"), F.lit("s"))).otherwise(""))
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < 60_000, format_seconds(ms)).otherwise(long)
