"""Two-stage salted aggregation for keys that hold most of the rows.

Stage one groups by (key, salt), where heavy keys get a salt in [0, salts) and
all other keys the salt 0; stage two merges the partial results by key. No task
of stage one gets more than about 1/salts of a heavy key's rows, however many
of them stand in one input partition, and stage two sees at most ``salts`` rows
a key from each of them.

Which keys are heavy is read off a mergeable frequency sketch, which takes one
pass over the key columns and sends a few thousand counters a task, not a row a
key; the sketch never misses a heavy key, and a key that it takes for heavy by
mistake is salted to no harm.

Nulls are an ordinary key value. Repeated rows count each time. An empty input
gives an empty result. Columns of the input that are neither key nor aggregated
are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.session import row_salt, stored

KINDS = ("count", "sum", "min", "max", "avg", "count_distinct")
#: Counters a sketch keeps for each heavy key there can be; the sketch is off by less than 3.5/counters of all rows.
COUNTERS = 8
#: Groups of input partitions whose sketches are merged first, so that no task merges those of all.
FAN_IN = 128


@dataclass(frozen=True)
class Agg:
    """One result column: ``kind`` over ``column`` (None: count of rows)."""

    name: str
    kind: str = "count"
    column: str | None = None

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown aggregate {self.kind}; one of {', '.join(KINDS)}")
        if self.column is None and self.kind != "count":
            raise ValueError(f"{self.kind} needs a column")


def key_hash(frame: DataFrame, keys: Sequence[str], kinds: Sequence[str] | None = None) -> Column:
    """One number for a key, nulls included; ``kinds``: the types to hash as, where two sides must agree."""
    own = dict(frame.dtypes)
    return F.xxhash64(*[F.col(f"`{k}`").cast(kinds[i] if kinds else own[k]) for i, k in enumerate(keys)])


def heavy_hashes(frame: DataFrame, keys: Sequence[str], share: float) -> list[int]:
    """The hashes of the keys with at least ``share`` of all rows, from one pass; a few others near that share may be among them, never more than 2/share in all."""
    if not 0 < share <= 1:
        raise ValueError("a share is above 0 and at most 1")
    tracked = min(1_000_000, math.ceil(COUNTERS / share))
    hashed = frame.select(key_hash(frame, keys).alias("h"), F.pmod(F.spark_partition_id(), F.lit(FAN_IN)).alias("part"))
    # one entry that counts for nothing: sketches of no rows at all cannot be merged
    hashed = hashed.withColumn("one", F.lit(1)).unionByName(frame.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("h"), F.lit(0).alias("part"), F.lit(0).alias("one")))
    parts = hashed.groupBy("part").agg(F.expr(f"approx_top_k_accumulate(h, {tracked})").alias("s"), F.sum("one").alias("n"))
    row = parts.agg(F.expr(f"approx_top_k_combine(s, {tracked})").alias("s"), F.sum("n").alias("n")).select(
        F.expr(f"approx_top_k_estimate(s, {min(tracked, math.ceil(2 / share))})").alias("top"), "n"
    ).first()
    return [x["item"] for x in row["top"] if x["count"] >= row["n"] * share] if row["n"] else []


def is_heavy(frame: DataFrame, keys: Sequence[str], heavy: Sequence[int], kinds: Sequence[str] | None = None) -> Column:
    return key_hash(frame, keys, kinds).isin(*heavy) if heavy else F.lit(False)


def _partial(aggs: Sequence[Agg]) -> tuple[list[Column], list[Column], list[Column]]:
    """Partial results, the same merged once (under their own names), and merged to the end."""
    partial, again, last = [], [], []
    for i, a in enumerate(aggs):
        c = F.col(f"`{a.column}`") if a.column else F.lit(1)
        if a.kind == "avg":
            partial += [F.sum(c).alias(f"__s{i}"), F.count(c).alias(f"__c{i}")]
            again += [F.sum(f"__s{i}").alias(f"__s{i}"), F.sum(f"__c{i}").alias(f"__c{i}")]
            last.append((F.sum(f"__s{i}") / F.sum(f"__c{i}")).alias(a.name))
        else:
            first, merge = {"count": (F.count, F.sum), "sum": (F.sum, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}[a.kind]
            partial.append(first(c).alias(f"__p{i}"))
            again.append(merge(f"__p{i}").alias(f"__p{i}"))
            last.append(merge(f"__p{i}").alias(a.name))
    return partial, again, last


def salted_aggregate(
    frame: DataFrame,
    keys: Sequence[str],
    aggs: Sequence[Agg],
    *,
    salts: int = 32,
    heavy_share: float = 0.005,
    heavy: Sequence[int] | None = None,
    row: str | None = None,
) -> DataFrame:
    """``aggs`` per key, by salted partial results of heavy keys.

    heavy_share bounds what counts as heavy (and the list of heavy keys);
    ``heavy`` gives the list of ``heavy_hashes`` when it is known already.
    ``row``: a column that tells rows apart and is the same when a lost task
    runs again, such as ``session.with_row`` adds; without it the salt is a
    hash of the columns used and the input partition, and rows equal in all of
    these share one.

    A count of distinct values is taken in the same pass: its salt is the hash
    of the value, so that the salts of a key hold disjoint values and their
    counts add up. Further distinct columns take a pass each.
    """
    keys = list(keys)
    if heavy is None:
        heavy = heavy_hashes(frame, keys, heavy_share)
    group = [F.col(f"`{k}`") for k in keys]
    hot = is_heavy(frame, keys, heavy)
    distinct = list(dict.fromkeys(a.column for a in aggs if a.kind == "count_distinct"))
    plain = [a for a in aggs if a.kind != "count_distinct"]
    partial, again, last = _partial(plain)
    cols = list(dict.fromkeys([*keys, *(a.column for a in aggs if a.column)]))
    if not distinct:
        salted = frame.select(
            *[F.col(f"`{c}`") for c in cols],
            F.when(hot, row_salt(frame.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*cols, *([row] if row else [])])]), salts, row)).otherwise(F.lit(0)).alias("__salt"),
        )
        out = salted.groupBy(*group, "__salt").agg(*partial).groupBy(*group).agg(*last)
    else:
        v = F.col(f"`{distinct[0]}`")
        salted = frame.select(*[F.col(f"`{c}`") for c in cols], v.alias("__v"), F.when(hot, F.pmod(F.xxhash64(v), F.lit(salts))).otherwise(F.lit(0)).alias("__salt"))
        by_value = salted.groupBy(*group, "__salt", "__v").agg(*partial or [F.lit(1).alias("__x")])
        counted = by_value.groupBy(*group, "__salt").agg(F.count("__v").alias("__d"), *again)
        out = counted.groupBy(*group).agg(*last, *[F.sum("__d").alias(a.name) for a in aggs if a.kind == "count_distinct" and a.column == distinct[0]])
        for column in distinct[1:]:
            more = [a for a in aggs if a.kind == "count_distinct" and a.column == column]
            right = salted_aggregate(frame, keys, more, salts=salts, heavy=heavy)
            right = right.select(*[F.col(f"`{k}`").alias(f"__k{j}") for j, k in enumerate(keys)], *[F.col(f"`{a.name}`") for a in more])
            on = F.lit(True)
            for j, k in enumerate(keys):
                on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"__k{j}"))
            out = out.join(right, on, "left").drop(*[f"__k{j}" for j in range(len(keys))])
    return out.select(*group, *[F.col(f"`{a.name}`") for a in aggs])


def share_of_rows(counts: DataFrame, within: str, count: str, least: float) -> DataFrame:
    """Rows of ``counts`` whose ``count`` is at least ``least`` of the sum over their ``within`` group.

    ``counts`` is stored, so that what made it runs once; the totals have one
    row for each value of ``within`` and are joined by it.
    """
    counts = stored(counts, "counts")
    totals = counts.groupBy(within).agg(F.sum(count).alias("__total"))
    return counts.join(totals, within).filter(F.col(count) >= F.col("__total") * F.lit(least)).drop("__total")
