"""Typed id columns: one bigint column for each level, named after its type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Deepest nesting of id levels that is accepted.
MOST_LEVELS = 10


def id_column(column: Column | str, null_id: str = "zero") -> Column:
    """An id as bigint. A null id is 0 ('zero'), stays null ('keep') or fails the job ('error'); text that is no number fails the job."""
    c = (F.col(column) if isinstance(column, str) else column).cast("bigint")
    if null_id == "zero":
        return F.coalesce(c, F.lit(0).cast("bigint"))
    if null_id == "error":
        return F.when(c.isNull(), F.raise_error(F.lit("null id")).cast("bigint")).otherwise(c)
    if null_id == "keep":
        return c
    raise ValueError(f"null_id must be zero, keep or error, not {null_id}")


def render_id(kind: str, column: Column | str) -> Column:
    """An id as text: its type, a hyphen, its number."""
    return F.concat_ws("-", F.lit(kind), (F.col(column) if isinstance(column, str) else column).cast("string"))


def numeric_text(column: Column | str) -> Column:
    """A number as the record streams write it: without its fraction; null stays null."""
    return (F.col(column) if isinstance(column, str) else column).cast("bigint").cast("string")


def timestamp_text(column: Column | str) -> Column:
    """A timestamp as yyyy-MM-dd HH:mm:ss.S."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.S")
