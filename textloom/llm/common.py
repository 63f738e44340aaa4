"""What the corpus operators share: word splitting, column helpers, and joins that survive hot keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.session import discard, fits, prepare, read, scratch, settle, small

__all__ = ["LOWER", "UPPER", "WORD", "ascii_lower", "discard", "fits", "look_up", "prepare", "read", "scratch", "settle", "small", "without", "word_count"]

#: A word is a run of anything but ASCII white space. ``bytes.split()`` splits at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty. Texts in ASCII take the JVM's byte-wise path."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drops input columns that carry the name of a result column; the operator's own result takes the name."""
    names = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in names])


def look_up(df: DataFrame, table: DataFrame, keys: list[str], how: str = "left", limit: int | None = None) -> DataFrame:
    """Joins a settled table that has one row per key: by broadcast if it is counted to be small, else by shuffle. There
    adaptive execution splits the rows of a hot key over several tasks and gives each the key's one row; ``df`` has to
    come to the join without an aggregation by the same keys, as it does in this package."""
    return df.join(small(table, limit), keys, how)
