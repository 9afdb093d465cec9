"""References to records that do not exist, and what hangs below them.

Tables are nodes of a foreign-key graph. ``direct_orphans`` finds the
references whose parent is deleted, missing or arrived later; ``cascade``
walks the graph downwards with semi-joins until no new record is reached, so
that children of orphans come out as inherited orphans.

All tables are read once: what counts of them (record, reference, first and
last receipt) is combined, stored, and read again by the joins. Tables go by
small numbers until the result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.operators.salted import heavy_hashes
from heddle.operators.skewjoin import lookup_join
from heddle.session import stored


@dataclass(frozen=True)
class ForeignKey:
    """child_table.child_key identifies the row that refers by ``column`` to parent_table's key."""

    child_table: str
    child_key: str
    column: str
    parent_table: str


@dataclass(frozen=True)
class Keyed:
    """A table with its key; key None: no table refers to it."""

    frame: DataFrame
    key: str | None
    received: str = "extracted_at"


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _number(i: int) -> Column:
    return F.lit(i).cast("tinyint")


class _Graph:
    """The kinds of records, numbered: a table with the key that names its records."""

    def __init__(self, tables: Mapping[str, Keyed], fks: Sequence[ForeignKey]):
        self.tables, self.fks = tables, list(fks)
        kinds = {(fk.child_table, fk.child_key): None for fk in fks}
        for fk in fks:
            if tables[fk.parent_table].key is None:
                raise ValueError(f"{fk.parent_table} is referred to and has no key")
            kinds[fk.parent_table, tables[fk.parent_table].key] = None
        self.kinds = {k: i for i, k in enumerate(kinds)}

    def parent(self, fk: ForeignKey) -> int:
        return self.kinds[fk.parent_table, self.tables[fk.parent_table].key]

    def child(self, fk: ForeignKey) -> int:
        return self.kinds[fk.child_table, fk.child_key]

    def table(self, kind: Column) -> Column:
        """The table's name of a number."""
        names = [t for t, _ in self.kinds]
        return F.element_at(F.array(*[F.lit(n) for n in names]), kind.cast("int") + 1)

    def pairs(self) -> DataFrame:
        """(kind, id, parent_kind, parent_id, first, last), stored: every record with each distinct parent it has had, null for none, and when it was received so. Null keys are no record; null and 0 parents are none."""
        parts = []
        for (table, key), i in self.kinds.items():
            t = self.tables[table]
            own = [fk for fk in self.fks if self.child(fk) == i]
            up = [F.struct(_number(self.parent(fk)).alias("parent_kind"), F.nullif(F.col(f"`{fk.column}`").cast("bigint"), F.lit(0)).alias("parent_id")) for fk in own]
            none = F.struct(F.lit(None).cast("tinyint").alias("parent_kind"), F.lit(None).cast("bigint").alias("parent_id"))
            what = F.array(*up) if up else F.array(none)
            one = t.frame.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{t.received}`").cast("timestamp_ntz").alias("at"), (what[0] if len(up) < 2 else F.explode(what)).alias("up"))
            parts.append(one.select(_number(i).alias("kind"), "id", "up.parent_kind", "up.parent_id", "at"))
        seen = _union(parts).filter("id IS NOT NULL").withColumn("parent_kind", F.expr("if(parent_id IS NULL, NULL, parent_kind)"))
        return stored(seen.groupBy("kind", "id", "parent_kind", "parent_id").agg(F.min("at").alias("first"), F.max("at").alias("last")), "pairs")

    def records(self, pairs: DataFrame, deletions: DataFrame) -> DataFrame:
        """(kind, id, first, last, deleted, there) of every record that has a row or a deletion."""
        gone = []
        for (table, key), i in self.kinds.items():
            if self.tables[table].key == key:
                gone.append(deletions.filter(F.col("table") == table).select(
                    _number(i).alias("kind"), F.col("rec_id").cast("bigint").alias("id"), F.lit(None).cast("timestamp_ntz").alias("first"), F.lit(None).cast("timestamp_ntz").alias("last"),
                    F.col("deleted_at").cast("timestamp_ntz").alias("deleted"), F.lit(False).alias("there")))
        rows = pairs.select("kind", "id", "first", "last", F.lit(None).cast("timestamp_ntz").alias("deleted"), F.lit(True).alias("there"))
        return _union([rows, *gone]).filter("id IS NOT NULL").groupBy("kind", "id").agg(
            F.min("first").alias("first"), F.max("last").alias("last"), F.max("deleted").alias("deleted"), F.bool_or("there").alias("there"))

    def references(self, pairs: DataFrame, records: DataFrame) -> DataFrame:
        """(kind, id, parent_kind, parent_id, first_at): the distinct references with the child's first receipt over all its rows."""
        return pairs.filter("parent_id IS NOT NULL").drop("first", "last").join(records.select("kind", "id", F.col("first").alias("first_at")), ["kind", "id"])

    def named(self, refs: DataFrame, *more: Column | str) -> DataFrame:
        return refs.select(self.table(F.col("kind")).alias("child_table"), F.col("id").alias("child_id"), self.table(F.col("parent_kind")).alias("parent_table"), "parent_id", *more)


UP = ["parent_kind", "parent_id"]


def _orphaned(refs: DataFrame, records: DataFrame, heavy: Sequence[int]) -> DataFrame:
    """The references with the reason why they are orphans, by one join with all parents; parents with many children are salted."""
    parents = records.select(F.col("kind").alias("parent_kind"), F.col("id").alias("parent_id"), F.col("first").alias("parent_first"), F.col("last").alias("parent_last"), "deleted", "there")
    exists = F.coalesce(F.col("there"), F.lit(False))
    reason = (
        F.when(F.col("deleted").isNotNull() & (~exists | (F.col("deleted") >= F.col("parent_last"))), "deleted")
        .when(~exists, "missing")
        .when(F.col("parent_first") > F.col("first_at"), "late")
    )
    return lookup_join(refs, parents, UP, heavy=heavy).withColumn("reason", reason).filter("reason IS NOT NULL").select("kind", "id", *UP, "first_at", "reason")


def _period() -> Column:
    return F.date_format("first_at", "yyyy-MM").alias("period")


def _start(tables, fks, deletions, share: float):
    graph = _Graph(tables, fks)
    pairs = graph.pairs()
    heavy = heavy_hashes(pairs.filter("parent_id IS NOT NULL"), UP, share)
    return graph, pairs, graph.records(pairs, deletions), heavy


def direct_orphans(tables: Mapping[str, Keyed], fks: Sequence[ForeignKey], deletions: DataFrame, *, share: float = 0.005) -> DataFrame:
    """(child_table, child_id, parent_table, parent_id, reason, period) of every orphan reference.

    deletions: (table, rec_id, deleted_at). Reason 'deleted' when the latest
    deletion is at or after the parent's last receipt or the parent has no row,
    else 'missing' without a row, else 'late' when the parent's first receipt
    is after the child's. period: 'yyyy-MM' of the child's first receipt, null
    if that is unknown. Null child keys are no record; null and 0 parents are
    no reference. Repeated rows count once. Parents with ``share`` of all
    references are salted in the join.
    """
    graph, pairs, records, heavy = _start(tables, fks, deletions, share)
    return graph.named(_orphaned(graph.references(pairs, records), records, heavy), "reason", _period())


def _depth(fks: Sequence[ForeignKey]) -> int | None:
    """Longest chain of foreign keys between tables; None if they form a cycle."""
    below: dict[str, set[str]] = {}
    for fk in fks:
        below.setdefault(fk.parent_table, set()).add(fk.child_table)

    def walk(t: str, path: tuple) -> int:
        if t in path:
            raise RecursionError
        return max([0, *(1 + walk(c, (*path, t)) for c in below.get(t, ()))])

    try:
        return max([0, *(walk(t, ()) for t in below)])
    except RecursionError:
        return None


def cascade(tables: Mapping[str, Keyed], fks: Sequence[ForeignKey], deletions: DataFrame, *, share: float = 0.005) -> DataFrame:
    """Direct and inherited orphans: the columns of direct_orphans and kind ('direct', 'inherited'), level (0 for direct), one row each.

    An inherited orphan refers to a record that is itself an orphan; its reason
    is 'inherited'. A reference that is a direct orphan is not repeated as an
    inherited one, and a record's references are followed once. The references
    are stored once and read by every round; acyclic foreign keys end after as
    many rounds as their longest chain, with cycles the loop ends at the first
    round that reaches nothing new. Orphans with many children are salted in
    the semi-joins.
    """
    graph, pairs, records, heavy = _start(tables, fks, deletions, share)
    refs = stored(graph.references(pairs, records), "references")
    direct = stored(_orphaned(refs, records, heavy), "orphans")
    rounds = [direct.select(*refs.columns, "reason", F.lit("direct").alias("how"), F.lit(0).alias("level"))]
    fresh, taken = direct, direct.select("kind", "id", *UP)
    depth, level = _depth(fks), 0
    while depth is None or level < depth - 1:
        level += 1
        reached = fresh.select(F.col("kind").alias("parent_kind"), F.col("id").alias("parent_id")).distinct().withColumn("reached", F.lit(True))
        step = lookup_join(refs, reached, UP, heavy=heavy).filter("reached").drop("reached").join(taken, ["kind", "id", *UP], "left_anti")
        fresh = stored(step, "orphans")
        if fresh.isEmpty():
            break
        rounds.append(fresh.select(*refs.columns, F.lit("inherited").alias("reason"), F.lit("inherited").alias("how"), F.lit(level).alias("level")))
        taken = taken.unionByName(fresh.select(taken.columns))
    every = _union(rounds)
    return graph.named(every, "reason", _period(), F.col("how").alias("kind"), "level")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """(child_table, parent_table, period, kind, reason, n_refs): the orphans of ``cascade`` by table and month."""
    return orphans.groupBy("child_table", "parent_table", "period", "kind", "reason").agg(F.count(F.lit(1)).alias("n_refs"))
