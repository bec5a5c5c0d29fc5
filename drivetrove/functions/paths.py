"""Path expressions. Paths are '/'-separated; relative paths have no leading slash."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def components(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda c: c != "")


def prefixes(path: Column, include_self: bool = False, include_root: bool = False) -> Column:
    """Ancestor paths from the top down; ``""`` is the root."""
    parts = F.split(path, "/")
    n = F.size(parts) - (0 if include_self else 1)
    above = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                                      lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))) \
        .otherwise(F.array().cast("array<string>"))
    above = F.when(path == "", F.array().cast("array<string>")).otherwise(above)
    return F.concat(F.array(F.lit("")), above) if include_root else above


def parent(path: Column) -> Column:
    """Path of the containing folder, ``""`` at the top."""
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def url_path(url: Column) -> Column:
    """A URL as a storage path: host first, without scheme, query, fragment or trailing slash."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[?#].*\z", "")
    return F.regexp_replace(F.regexp_replace(bare, "/+", "/"), r"^/|/\z", "")
