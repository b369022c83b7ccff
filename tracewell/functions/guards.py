"""Checks of ids, names, queries and limits that come from outside."""

from __future__ import annotations

import math
import posixpath
import re

from pyspark.sql import Column

# Forms and limits of ids and requests.
ID = r"^[a-zA-Z0-9][a-zA-Z0-9._-]{0,127}$"
MOST_QUERY, MOST_RESULTS, MOST_PAGE = 512, 200, 200
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def is_id(value: Column) -> Column:
    return value.rlike(ID)


def is_encoded_path(name: Column) -> Column:
    """An encoded folder: a dash first, or an old drive form; one colon at most, after a drive letter."""
    old = name.rlike(r"^[a-zA-Z]--[a-zA-Z0-9_.\s-]+$")
    plain = name.rlike(r"^-[a-zA-Z0-9_.\s-]+$")
    drive = name.rlike(r"^-[a-zA-Z]:[a-zA-Z0-9_.\s-]*$")
    return old | plain | drive


def is_project_id(value: Column) -> Column:
    """An encoded folder, or one with "::" and eight hexadecimal digits."""
    from pyspark.sql import functions as F

    base, part = F.substring_index(value, "::", 1), F.substr(value, F.length(F.substring_index(value, "::", 1)) + 3)
    return F.when(value.contains("::"), is_encoded_path(base) & part.rlike("^[a-f0-9]{8}$")).otherwise(is_encoded_path(value))


def search_query(value: object) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValueError("a query must be a text that isn't blank")
    if len(value.strip()) > MOST_QUERY:
        raise ValueError(f"a query has {MOST_QUERY} characters at most")
    return value.strip()


def limit(value: object, default: int, most: int) -> int:
    """A whole number from 1 to most; anything else is the default."""
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value) or math.floor(value) <= 0:
        return default
    return min(math.floor(value), most)


def is_inside(path: str, folders: list[str]) -> bool:
    """Whether a path, after . and .. are worked out, lies in one of the folders."""
    own = posixpath.normpath(path)
    return any(own == (f := posixpath.normpath(x)) or own.startswith(f.rstrip("/") + "/") for x in folders)


def is_session_fragment(value: str) -> bool:
    return re.fullmatch("[0-9a-fA-F-]{4,36}", value) is not None
