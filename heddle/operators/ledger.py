"""Processing only new or changed records: a work-item ledger.

``WorkLedger`` keeps work items in a folder all executors share. An item is
*pending* until a worker leases it, *leased* until the lease expires or the
work is committed, then *done*. What happens to an item is a numbered log:
every change is the entry after the last one, and an entry is published whole
and once, so of several writers that saw the same last entry one succeeds and
the others are told. The number of a lease's entry is its fencing token: a
commit is the entry right behind its lease, which another lease has taken if
the first one was overtaken. Output goes to a path made of item and token, and
the commit names that path: an attempt that broke off leaves nothing visible,
a retry of the same attempt overwrites itself.

``changed_records`` tells which records of a source a run has to process, from
the rows received and the log of earlier runs, whose rows are read as work
items of the same kind: an acknowledged delivery is done, one that was never
acknowledged is an expired lease and pending again, and the deliveries of a
rolled back run carry a fenced token and count for nothing.

``process_changed`` puts the two together: the pending records of a load are
cut into ranges of key hashes, each a work item at a path that follows from the
load, and workers lease, process and commit them side by side. A run that broke
off is taken up where it stood; a second one finds nothing to do.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PENDING, LEASED, DONE = "pending", "leased", "done"


class StaleLease(RuntimeError):
    """A commit by a worker whose lease was taken over."""


@dataclass(frozen=True)
class Lease:
    item: str
    fence: int
    expires: float
    path: str


class WorkLedger:
    """Ledger below ``root``, on any file system Spark's Hadoop client knows.

    An item's log is a folder of small JSON files, named by their numbers. An
    entry is written under a name of its own and then given its number, by a
    hard link on local disks and by a rename that replaces nothing elsewhere;
    both are atomic, so that a crash leaves no half entry and no number is
    given twice. The clock is a parameter for tests.
    """

    def __init__(self, spark: SparkSession, root: str, *, lease_seconds: float = 3600, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.lease_seconds, self.clock = spark, root.rstrip("/"), lease_seconds, clock
        self._jvm = spark._jvm
        there = self._path(self.root)
        self._fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
        self._local = self._fs.getUri().getScheme() == "file"
        if not self._local:
            self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())

    def _path(self, where: str):
        return self._jvm.org.apache.hadoop.fs.Path(where)

    def _publish(self, where: str, content: dict) -> bool:
        """The whole content under a name that is free; False when it is taken."""
        own = f"{where.rpartition('/')[0]}/_{uuid.uuid4().hex}"
        if self._local:
            own, where = (self._path(x).toUri().getPath() for x in (own, where))
            os.makedirs(os.path.dirname(own), exist_ok=True)
            with open(own, "w", encoding="utf-8") as f:
                json.dump(content, f)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(own, where)
            except FileExistsError:
                return False
            finally:
                os.unlink(own)
            return True
        out = self._fs.create(self._path(own), True)
        out.write(json.dumps(content).encode())
        out.close()
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        none = self.spark.sparkContext._gateway.new_array(rename, 1)
        none[0] = rename.NONE
        try:
            self._context.rename(self._path(own), self._path(where), none)
        except Exception as e:  # the JVM's FileAlreadyExistsException
            self._fs.delete(self._path(own), False)
            if "already exists" in str(e) or "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def _read(self, where: str) -> dict:
        stream = self._fs.open(self._path(where))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _home(self, item: str) -> str:
        return f"{self.root}/items/{item}"

    def add(self, items: Iterable[str]) -> None:
        """Registers items; one that is known keeps its state."""
        for item in items:
            if not item or "/" in item or item[0] in "._":
                raise ValueError(f"no name of an item: {item!r}")
            self._publish(f"{self._home(item)}/{0:08d}", {"item": item})

    def items(self) -> list[str]:
        home = self._path(f"{self.root}/items")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(home)) if self._fs.exists(home) else []

    def _last(self, item: str) -> tuple[int, dict]:
        """Number and content of an item's last entry."""
        numbers = [int(n) for s in self._fs.listStatus(self._path(self._home(item))) if (n := s.getPath().getName()).isdigit()]
        if not numbers:
            return -1, {}
        return max(numbers), self._read(f"{self._home(item)}/{max(numbers):08d}")

    def _state(self, entry: dict) -> str:
        if "path" in entry:
            return DONE
        return LEASED if entry.get("expires", 0) > self.clock() else PENDING

    def state(self, item: str) -> str:
        return self._state(self._last(item)[1])

    def lease(self, item: str, owner: str = "driver") -> Lease | None:
        """A lease with the next token, or None when the item is done, leased, or was just taken by another worker."""
        number, entry = self._last(item)
        if self._state(entry) != PENDING:
            return None
        fence, expires = number + 1, self.clock() + self.lease_seconds
        if not self._publish(f"{self._home(item)}/{fence:08d}", {"owner": owner, "expires": expires}):
            return None
        return Lease(item, fence, expires, f"{self.root}/out/{item}/{fence:08d}")

    def commit(self, lease: Lease) -> None:
        """Marks the item done with the output of ``lease``; raises StaleLease if another entry stands behind the lease."""
        where = f"{self._home(lease.item)}/{lease.fence + 1:08d}"
        if not self._publish(where, {"fence": lease.fence, "path": lease.path}) and self._read(where).get("fence") != lease.fence:
            raise StaleLease(f"{lease.item}: token {lease.fence} is fenced off")

    def give_back(self, lease: Lease) -> None:
        """Ends a lease whose work failed, so that others need not wait until it expires; nothing happens if it was overtaken."""
        self._publish(f"{self._home(lease.item)}/{lease.fence + 1:08d}", {"given_back": lease.fence})

    def output(self, item: str) -> str | None:
        return self._last(item)[1].get("path")

    def outputs(self) -> list[str]:
        """The paths of all done items."""
        return [p for item in self.items() if (p := self.output(item))]

    def run(self, compute: Callable[[str], DataFrame], owner: str = "driver", workers: int = 4) -> list[str]:
        """Leases the pending items, ``workers`` at a time, writes compute(item) to the lease's path and commits; the items done by this call.

        A failure is raised when the other workers are through; its item is
        given back and pending for the next run. Where the whole driver dies,
        its items are pending again when their leases expire.
        """

        def one(item: str) -> str | None:
            lease = self.lease(item, owner)
            if lease is None:
                return None
            try:
                compute(item).write.mode("overwrite").parquet(lease.path)
            except Exception:
                self.give_back(lease)
                raise
            self.commit(lease)
            return item

        with ThreadPoolExecutor(workers) as pool:
            jobs = [pool.submit(one, item) for item in self.items()]
        return [item for job in jobs if (item := job.result())]


def stamp(*columns: str) -> Column:
    """The latest of several date strings as timestamp; blanks around it, 'T' between date and time and any number of fraction digits are accepted, what is no date is null."""
    parsed = [F.expr(f"try_cast(trim(`{c}`) AS timestamp_ntz)") for c in columns]
    return F.greatest(*parsed) if len(parsed) > 1 else parsed[0]


#: Before all dates; stands for "without any date" in comparisons.
LEAST_STAMP = "0001-01-01 00:00:00"


def changed_records(
    rows: DataFrame,
    runs: DataFrame,
    deliveries: DataFrame,
    *,
    src: str,
    key: str,
    stamps: Sequence[str],
    received: str = "extracted_at",
) -> DataFrame:
    """The pending work of ``src``: (src, rec_id, change_stamp).

    A record is pending when it has rows received after the greatest cutoff of
    a succeeded run, the greatest stamp of these is greater than that of its
    earlier rows (or it has none), and no acknowledged delivery of a run that
    was not rolled back has a stamp at or after it. Rows without date count as
    older than all dates, in the result their change_stamp is null. Without a
    succeeded run all rows are new. Rows whose key or time of receipt is null
    are no record and give nothing. One row for each record, however often its
    rows are repeated; one aggregation with map-side combination by key, so
    keys with many rows cost no task more.
    """
    least = F.lit(LEAST_STAMP).cast("timestamp_ntz")
    done_runs = runs.filter((F.col("src") == src) & (F.col("run_status") == "succeeded"))
    # one row; the cutoff is a value of the plan, not a join
    cutoff = done_runs.agg(F.max(F.col("cutoff_at").cast("timestamp_ntz")).alias("c")).first()["c"]
    got = F.col(f"`{received}`").cast("timestamp_ntz")
    new = got > F.lit(cutoff).cast("timestamp_ntz") if cutoff is not None else F.lit(True)
    seen = rows.filter(F.col(f"`{key}`").isNotNull() & F.col(f"`{received}`").isNotNull()).select(
        F.col(f"`{key}`").cast("bigint").alias("rec_id"), F.coalesce(stamp(*stamps), least).alias("s"), new.alias("new")
    )
    candidates = (
        seen.groupBy("rec_id")
        .agg(F.max(F.when(F.col("new"), F.col("s"))).alias("s"), F.max(F.when(~F.col("new"), F.col("s"))).alias("before"))
        .filter(F.col("s").isNotNull() & (F.col("before").isNull() | (F.col("s") > F.col("before"))))
    )
    return candidates.join(settled(runs, deliveries, src, least), "rec_id", "left").filter(
        F.col("upto").isNull() | (F.col("upto") < F.col("s"))
    ).select(F.lit(src).alias("src"), "rec_id", F.when(F.col("s") > least, F.col("s")).alias("change_stamp"))


def settled(runs: DataFrame, deliveries: DataFrame, src: str, least: Column) -> DataFrame:
    """(rec_id, upto): up to which stamp a record is done by acknowledged deliveries of runs whose token was not fenced off by a rollback."""
    fenced = runs.filter((F.col("src") == src) & (F.col("run_status") == "rolled_back")).select("run_id").distinct()
    return (
        deliveries.filter((F.col("src") == src) & F.col("acked"))
        .join(fenced, "run_id", "left_anti")
        .groupBy("rec_id")
        .agg(F.max(F.coalesce(F.col("change_stamp").cast("timestamp_ntz"), least)).alias("upto"))
    )


def delivery_states(runs: DataFrame, deliveries: DataFrame) -> DataFrame:
    """(src, rec_id, change_stamp, run_id, state) of the log read as ledger: done, pending (expired lease) or fenced (its run was rolled back).

    Repeated rows give one; of several for a record and run, an acknowledged one decides.
    """
    status = runs.groupBy("run_id", "src").agg(F.max(F.col("run_status") == "rolled_back").alias("fenced"))
    return (
        deliveries.groupBy("src", "rec_id", "change_stamp", "run_id").agg(F.max(F.coalesce("acked", F.lit(False))).alias("acked"))
        .join(status, ["run_id", "src"], "left")
        .select("src", "rec_id", "change_stamp", "run_id",
                F.when(F.coalesce("fenced", F.lit(False)), "fenced").when(F.col("acked"), DONE).otherwise(PENDING).alias("state"))
    )



def fingerprint(*frames: DataFrame) -> str:
    """A name for what the files behind ``frames`` hold: it follows from their paths, sizes and times of change."""
    digest = hashlib.sha256()
    for frame in frames:
        spark = frame.sparkSession
        for path in sorted(frame.inputFiles()):
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            status = there.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(there)
            digest.update(f"{path} {status.getLen()} {status.getModificationTime()}\n".encode())
    return digest.hexdigest()[:32]


def process_changed(
    pending: Callable[[], DataFrame],
    root: str,
    key: str,
    spark: SparkSession,
    *,
    ranges: int = 4,
    process: Callable[[DataFrame], DataFrame] = lambda frame: frame,
    owner: str = "driver",
    workers: int = 4,
    **options,
) -> tuple[WorkLedger, list[str]]:
    """Processes the pending records of one load through the ledger at ``root``; the ledger and the items that this call did.

    The records of ``pending()`` are worked out once a load, as the first item
    of the ledger, ``plan``: its committed output lies in ``ranges`` folders by
    key hash. Each of these is an item then; its rows go through ``process``
    and are committed. Whatever was committed is not computed again.
    """
    ledger = WorkLedger(spark, root, **options)
    plan, rooms = WorkLedger(spark, f"{root}/plan", **options), [f"range-{i:05d}" for i in range(ranges)]
    plan.add(["pending"])
    lease = plan.lease("pending", owner)
    if lease:
        try:
            placed = pending().withColumn("range", F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(ranges)).cast("int"))
            placed.write.mode("overwrite").partitionBy("range").parquet(lease.path)
        except Exception:
            plan.give_back(lease)
            raise
        plan.commit(lease)
    found = plan.output("pending")
    if found is None:
        raise RuntimeError("another worker is planning this load")
    ledger.add(rooms)
    rows = spark.read.parquet(found)
    done = ledger.run(lambda item: process(rows.filter(F.col("range") == int(item.rpartition("-")[2])).drop("range")), owner, workers)
    return ledger, done


__all__ = ["Lease", "StaleLease", "WorkLedger", "changed_records", "delivery_states", "fingerprint", "process_changed", "settled", "stamp"]
