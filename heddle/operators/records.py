"""Record streams: split, concatenate, nest, transform, tee, pivot.

Order is data: records carry their place (document, position), windows and
sinks go by it, and no operator relies on the order of a DataFrame.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from heddle.session import stored


def _offsets(records: DataFrame, document: Sequence[str], position: str, what: Column) -> DataFrame:
    """Adds __sum: the running sum of ``what`` (0 or more, per record) within a document, by position.

    Records are range-partitioned by document and position; each task sums its
    own records of each document, and the few sums of (task, document) are
    added up to offsets, so that no document is numbered by one task alone.
    """
    ordered = records.withColumn("__what", what).repartitionByRange(*[F.col(c) for c in [*document, position]]).sortWithinPartitions(*document, position)
    # stored, for the partition a record is in must be the same in both uses
    tagged = stored(ordered.withColumn("__part", F.spark_partition_id()), "split")
    inside = Window.partitionBy("__part", *document).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    numbered = tagged.withColumn("__own", F.sum("__what").over(inside))
    sums = tagged.groupBy("__part", *document).agg(F.sum("__what").alias("__n"))
    before = Window.partitionBy(*document).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    keyed = offsets.select(F.col("__part").alias("__p"), F.struct(F.lit(0), *document).alias("__d"), "__before")
    joined = numbered.join(keyed, (F.col("__part") == F.col("__p")) & F.struct(F.lit(0), *document).eqNullSafe(F.col("__d")), "left")
    return joined.withColumn("__sum", F.col("__before") + F.col("__own"))


def split_chunks(records: DataFrame, document: Sequence[str], position: str, size: int = 100) -> DataFrame:
    """Adds chunk_no: every ``size`` records of a document, by position, from 0. Every document begins a chunk."""
    if size < 1:
        raise ValueError("a chunk has one record at least")
    return _offsets(records, document, position, F.lit(1)).withColumn("chunk_no", F.expr(f"(__sum - 1) div {size}")).select(*records.columns, "chunk_no")


def split_at(records: DataFrame, document: Sequence[str], position: str, boundary: Column) -> DataFrame:
    """Adds chunk_no, counted up at each record where ``boundary`` holds; null holds not. The first record's chunk is 0 or, at a boundary, 1."""
    return _offsets(records, document, position, F.coalesce(boundary, F.lit(False)).cast("int")).withColumn("chunk_no", F.col("__sum")).select(*records.columns, "chunk_no")


def concat_all(frames: Sequence[DataFrame]) -> DataFrame:
    """All records of all documents as one, with doc_pos of each input; columns one of them lacks are null."""
    out = None
    for i, frame in enumerate(frames):
        part = frame.withColumn("doc_pos", F.lit(i).cast("bigint"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("nothing to concatenate")
    return out


def concat_runs(documents: DataFrame, system_id: str, position: str, tie: Sequence[str] = ()) -> DataFrame:
    """Adds run_no to a list of documents: documents next to each other with the same system id make one output document, later ones do not join it.

    ``position`` orders the documents (with ``tie`` where it is not unique). The
    first document of a task is compared with the last one of the task before
    it, of which there is one a task; nothing else is gathered.
    """
    order = [position, *tie]
    ordered = documents.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    tagged = stored(ordered.withColumn("__part", F.spark_partition_id()), "runs")
    inside = Window.partitionBy("__part").orderBy(*order)
    named = tagged.withColumns({"__lag": F.lag(F.struct(F.col(system_id).alias("s"))).over(inside), "__no": F.row_number().over(inside)})
    # of each task its last document; tasks without documents are not there
    ends = tagged.groupBy("__part").agg(F.max_by(F.struct(F.col(system_id).alias("s")), F.struct(*order)).alias("__end"))
    across = ends.select((F.lead("__part").over(Window.orderBy("__part"))).alias("__next"), F.col("__end"))
    met = named.join(across, (F.col("__part") == F.col("__next")) & (F.col("__no") == 1), "left")
    last = F.coalesce(F.col("__lag"), F.col("__end"))
    change = F.when(last.isNull(), 1).otherwise((~F.col(system_id).eqNullSafe(last["s"])).cast("int"))
    flagged = met.withColumn("__what", change).select(*documents.columns, "__part", "__what")
    sums = flagged.groupBy("__part").agg(F.sum("__what").alias("__n"))
    before = sums.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.sum("__what").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return flagged.withColumn("__own", own).join(before, F.col("__part") == F.col("__p")).withColumn("run_no", F.col("__before") + F.col("__own") - 1).select(*documents.columns, "run_no")


def nest(rows: DataFrame, ids: Sequence[str], position: str | None = None) -> DataFrame:
    """Rows nested by their ids: one row for each first id, deeper levels as arrays ordered by id.

    Rows with the same full path are one record, their fields in a list
    ``rows``, ordered by ``position`` or else by value. Ids count as 0 when null.
    """
    from heddle.ids import id_column

    ids = list(ids)
    payload = [c for c in rows.columns if c not in ids and c != position]
    keyed = rows.select(*[id_column(c).alias(c) for c in ids], F.struct(*([position] if position else []), *payload).alias("__row"))
    out = keyed.groupBy(*ids).agg(F.array_sort(F.collect_list("__row")).alias("rows"))
    for depth in range(len(ids) - 1, 0, -1):
        inner = [c for c in out.columns if c not in ids[:depth]]
        out = out.groupBy(*ids[:depth]).agg(F.array_sort(F.collect_list(F.struct(*inner))).alias(f"{ids[depth]}_list"))
    return out


def token_batches(tokens: DataFrame, position: str, size: int, source: Sequence[str] = ()) -> DataFrame:
    """Adds batch_no: tokens in batches of ``size``, per source if one is given, by their place in the order of ``position``, which need not be dense."""
    return split_chunks(tokens, list(source), position, size).withColumnRenamed("chunk_no", "batch_no")


def transform_records(records: DataFrame, function: Callable[[dict], dict], schema: str, keep: Sequence[str] = ()) -> DataFrame:
    """Every record through a Python function, failures kept apart: the columns of ``schema``, ``keep`` and error.

    A record whose function raises has nulls and the error's text; what the
    function returns is data, null or not. Order is kept by the columns kept.
    """
    from pyspark.sql.types import StructType

    made = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kinds = [f for f in records.schema if f.name in keep]
    out = StructType([*kinds, *made.fields]).add("error", "string")

    target = to_arrow_schema(out)

    names = [f.name for f in made]

    def failed(base: dict, e: Exception) -> dict:
        return {**base, **dict.fromkeys(names), "error": f"{type(e).__name__}: {e}"}

    def fitting(row: dict) -> dict:
        """The row, or its failure if what the function gave does not fit the schema."""
        try:
            pa.RecordBatch.from_pylist([row], schema=target)
            return row
        except (pa.ArrowException, TypeError, ValueError) as e:
            return failed({k: row[k] for k in keep}, e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                base = {k: row[k] for k in keep}
                try:
                    given = function(row)
                    rows.append({**base, **{n: given.get(n) for n in names}, "error": None})
                except Exception as e:  # the function is the user's
                    rows.append(failed(base, e))
            try:
                yield pa.RecordBatch.from_pylist(rows, schema=target)
            except (pa.ArrowException, TypeError, ValueError):
                yield pa.RecordBatch.from_pylist([fitting(row) for row in rows], schema=target)

    return records.mapInArrow(run, out)


def drop_failed_chunks(records: DataFrame, chunk: Sequence[str], failed: Column) -> DataFrame:
    """Without subdividing, one failure drops its whole chunk."""
    w = Window.partitionBy(*chunk)
    return records.withColumn("__bad", F.max(F.coalesce(failed, F.lit(False))).over(w)).filter(~F.col("__bad")).drop("__bad")


def isolate(records: DataFrame, failed: Column) -> tuple[DataFrame, DataFrame]:
    """(good, failed): with subdividing, exactly the records that fail alone are lost, which is where halving chunks again and again ends."""
    bad = F.coalesce(failed, F.lit(False))
    return records.filter(~bad), records.filter(bad)


def bisect(items: list, works: Callable[[list], bool]) -> tuple[list, list]:
    """(good, bad) of a chunk that only works as a whole: a failing chunk is halved, (n + 1) // 2 first, until single items fail."""
    if not items or works(items):
        return list(items), []
    if len(items) == 1:
        return [], list(items)
    half = (len(items) + 1) // 2
    a, b = bisect(items[:half], works), bisect(items[half:], works)
    return a[0] + b[0], a[1] + b[1]


def failure_log(failed: DataFrame, record_id: str, chunk: Sequence[str] | None = None) -> DataFrame:
    """The ids of failed records: one row for each, or with ``chunk`` one row for each chunk and its ids in order."""
    if chunk is None:
        return failed.select(F.col(record_id).cast("string").alias("record_id"))
    return failed.groupBy(*chunk).agg(F.array_join(F.array_sort(F.collect_list(F.col(record_id).cast("string"))), ",").alias("record_ids"))


def tee(records: DataFrame, write: Callable[[DataFrame], None]) -> DataFrame:
    """Writes a copy and passes the records on; they are computed once, stored in the shared folder, and hold no executor's memory."""
    kept = stored(records, "tee")
    write(kept)
    return kept


def pivot(upstream: DataFrame, token: str, downstream: DataFrame, key: str) -> DataFrame:
    """Downstream rows whose key is among the upstream tokens (the list parameter of a second query). Repeated tokens count once."""
    asked = upstream.select(F.col(f"`{token}`").cast(dict(downstream.dtypes)[key]).alias(key)).filter(F.col(key).isNotNull()).distinct()
    return downstream.join(asked, key, "left_semi")


def pivot_batches(upstream: DataFrame, token: str, position: str, size: int, downstream: DataFrame, key: str) -> DataFrame:
    """As pivot, once for each batch of ``size`` tokens: a token repeated in a batch counts once, in another batch again. Adds batch_no."""
    numbered = token_batches(upstream.select(F.col(f"`{token}`").alias("__token"), F.col(f"`{position}`").alias("__position")), "__position", size)
    asked = numbered.select(F.col("__token").cast(dict(downstream.dtypes)[key]).alias(key), "batch_no").filter(F.col(key).isNotNull()).distinct()
    return downstream.join(asked, key, "inner")


def in_order(frame: DataFrame, batch: str | None, ids: Sequence[str]) -> DataFrame:
    """The rows in the order of their batch, then of their ids, nulls first: what a sink that keeps order is given. Sorted over all tasks by ranges."""
    return frame.orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in [*([batch] if batch else []), *ids]])


def first_texts(records: DataFrame, record: str, position: str, column: str) -> DataFrame:
    """The first value of each record, one a line: what a pipeline hands on as parameter list."""
    return records.groupBy(record).agg(F.min_by(column, position).alias("value"))


def xpath_of(path: str) -> str:
    """A simple absolute path as XPath 1.0: local names whatever their prefix, [@k=v] with or without quotation marks, a last [@k] or /@k for an attribute's value."""
    steps = [p for p in path.split("/") if p]
    if not path.startswith("/") or not steps:
        raise ValueError(f"not an absolute path: {path}")
    out = ""
    for i, step in enumerate(steps):
        m = _STEP.fullmatch(step)
        if m is None:
            raise ValueError(f"not a step of a path: {step}")
        if m["attr"]:
            if i != len(steps) - 1:
                raise ValueError("an attribute ends a path")
            return out + f"/@*[local-name()='{m['attr'].rpartition(':')[2]}']"
        name = m["name"].rpartition(":")[2]
        out += "/*" if name == "*" else f"/*[local-name()='{name}']"
        if m["key"]:
            key = f"@*[local-name()='{m['key'].rpartition(':')[2]}']"
            if m["value"] is None:
                if i != len(steps) - 1:
                    raise ValueError("[@name] without a value ends a path")
                return out + "/" + key
            value = m["value"].strip("'\"")
            if "'" in value and '"' in value:
                raise ValueError("a value with both quotation marks")
            quote = '"' if "'" in value else "'"
            out += f"[{key}={quote}{value}{quote}]"
    return out


_STEP = re.compile(r"@(?P<attr>[\w.:-]+)|(?P<name>\*|[\w.:-]+)(?:\[@(?P<key>[\w.:-]+)(?:=(?P<value>'[^']*'|\"[^\"]*\"|[^\]]*))?\])?")


def record_ids(records: DataFrame, xml: str, path: str, name: str = "record_id", required: bool = False) -> DataFrame:
    """Adds the id of each record: the attribute or trimmed text at ``path`` of its XML; null without one, or an error if ``required``. XML that is not well-formed fails the job."""
    found = F.nullif(F.trim(F.xpath_string(F.col(f"`{xml}`"), F.lit(xpath_of(path)))), F.lit(""))
    if required:
        found = F.coalesce(found, F.raise_error(F.lit(f"no value at {path}")).cast("string"))
    return records.withColumn(name, found)
