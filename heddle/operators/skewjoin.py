"""Left join of many rows with a side that is unique by key, safe for hot keys.

Keys with at least ``share`` of the rows are at most 2/share many. Their rows
get a salt, and the one row that the other side has for each of them is
repeated for every salt, so that a hot key is spread over ``salts`` tasks of
one ordinary shuffled join; all other keys have the salt 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.operators.salted import heavy_hashes, is_heavy
from heddle.session import row_salt


def lookup_join(
    left: DataFrame, unique: DataFrame, keys: Sequence[str], *, share: float = 0.005, salts: int = 32, heavy: Sequence[int] | None = None
) -> DataFrame:
    """``left`` LEFT JOIN ``unique`` on ``keys``.

    ``unique`` must hold each key at most once. Null keys match nothing. Rows
    of ``left`` are kept one to one; an empty side is allowed. ``heavy``: the
    ``heavy_hashes`` of left, where they are known; else ``left`` is read once
    more for them. Rows of a hot key that are equal in all columns and stand in
    one partition share a salt.
    """
    keys = list(keys)
    kinds = [dict(left.dtypes)[k] for k in keys]
    if heavy is None:
        heavy = heavy_hashes(left, keys, share)
    if not heavy:
        return left.join(unique, keys, "left")
    salted = left.withColumn("__salt", F.when(is_heavy(left, keys, heavy), row_salt(left, salts)).otherwise(F.lit(0)))
    few = F.when(is_heavy(unique, keys, heavy, kinds), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(unique.withColumn("__salt", F.explode(few)), [*keys, "__salt"], "left").drop("__salt")
