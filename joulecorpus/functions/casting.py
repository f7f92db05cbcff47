"""Lenient casts of text fields."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a numeric text may look like; Spark alone would also admit suffixes like '1d'.
_FLOAT = r"(?i)^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|nan)$"
_INT = r"^[+-]?\d+$"


def _digits(c: Column) -> Column:
    """Trim, and drop single underscores between digits."""
    return F.regexp_replace(F.trim(c.cast("string")), r"(?<=\d)_(?=\d)", "")


def to_number(c: Column, kind: str = "double") -> Column:
    """Parse text as ``double`` or ``bigint``; null where it is not a number."""
    text = _digits(c)
    pattern = _FLOAT if kind == "double" else _INT
    return F.when(text.rlike(pattern), text).try_cast(kind)


def safe_cast(c: Column, kind: str, default: Any) -> Column:
    """Cast, or the default where the value cannot be cast."""
    if kind in ("double", "bigint"):
        return F.coalesce(to_number(c, kind), F.lit(default).cast(kind))
    return F.coalesce(c.try_cast(kind), F.lit(default).cast(kind))
