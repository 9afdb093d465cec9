"""Writing records: file names, XML documents with a prolog of their own, index documents."""

from __future__ import annotations

import gzip
import json
import os
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.text import sanitize


def incrementing_name(base: Column | str, number: Column | str, suffix_length: int = 5, extension: str = "", gz: bool = False) -> Column:
    """base-00000 and so on, then the extension and .gz."""
    n = (F.col(number) if isinstance(number, str) else number).cast("string")
    b = F.lit(base) if isinstance(base, str) else base
    return F.concat(b, F.lit("-"), F.when(F.length(n) >= suffix_length, n).otherwise(F.lpad(n, suffix_length, "0")), F.lit(extension + (".gz" if gz else "")))


def relative_name(system_id: Column, input_base: str, output_base: str, extension: str = "", gz: bool = False) -> Column:
    """The output path of an input: its path below the input base, below the output base."""
    below = F.when(system_id.startswith(input_base.rstrip("/") + "/"), F.substring(system_id, F.lit(len(input_base.rstrip("/")) + 2), F.length(system_id))).otherwise(F.regexp_replace(system_id, "^/+", ""))
    return F.concat(F.lit(output_base.rstrip("/") + "/"), below, F.lit(extension + (".gz" if gz else "")))


def output_paths(documents: DataFrame, system_id: str, number: str, *, output: str, is_directory: bool, input_base: str = "", base_name: str | None = None, suffix_length: int = 5,
                 extension: str | None = None, gz: bool = False, grouped: bool = False) -> DataFrame:
    """Adds ``path``, where each document goes; ``number`` is its place among all documents, from 0.

    A base name: numbered files of that name (below ``output`` if that is a
    directory). ``output`` '-': the screen, path '-'. No directory: one file,
    which the last document keeps. A directory: the input's path below
    ``input_base``, one file for each input where documents are ``grouped`` by
    it, else numbered from 0 for each input, with the input's extension or the
    one given.
    """
    from heddle.functions import text

    end = ".gz" if gz else ""
    if base_name is not None:
        base = f"{output.rstrip('/')}/{base_name}" if is_directory else base_name
        return documents.withColumn("path", incrementing_name(base, number, suffix_length, extension or "", gz))
    if output == "-":
        return documents.withColumn("path", F.lit("-"))
    if not is_directory:
        last = documents.agg(F.max(number).alias("n")).first()["n"]
        return documents.filter(F.col(number) == F.lit(last)).withColumn("path", F.lit(output + end))
    sid = F.col(system_id)
    if grouped:
        return documents.withColumn("path", relative_name(sid, input_base, output, "", gz))
    own = text.extension(sid)
    kept = F.lit(extension) if extension is not None else own
    stem = F.when(own != "", F.substring(sid, F.lit(1), F.length(sid) - F.length(own))).otherwise(sid) if extension is None else sid
    # the documents of an input are numbered by offsets, not by one task
    from heddle.operators.records import split_chunks

    below = relative_name(stem, input_base, output)
    renamed = documents.withColumnsRenamed({"chunk_no": "__chunk"})
    numbered = split_chunks(renamed, [system_id], "__chunk" if number == "chunk_no" else number, 1)
    return numbered.withColumn("path", F.concat(incrementing_name(below, "chunk_no", suffix_length), kept, F.lit(end))).drop("chunk_no").withColumnsRenamed({"__chunk": "chunk_no"})


def write_documents(records: DataFrame, path: str, xml: str, order: list[str], root: str = "root", namespaces: dict[str, str] | None = None) -> list[str]:
    """One file for each value of ``path``, its records in order of ``order`` between the root's tags; gzip for names that end in .gz.

    The rows of a file lie next to each other in one sorted partition and are
    written as they come, a batch at a time. A file is written under another
    name and renamed, so that a task that runs again leaves one whole file.
    The paths must be on disks that all executors share. Returns the paths.
    """
    attrs = "".join(f' xmlns:{p}="{u}"' for p, u in (namespaces or {}).items())
    rows = records.select(F.col(path).alias("path"), F.struct(*order).alias("o"), F.coalesce(sanitize(xml), F.lit("")).alias("xml"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, file, temporary, done = None, None, None, []

        def close() -> None:
            file.write(f"</{root.split()[0]}>\n")
            file.close()
            os.replace(temporary, target)
            done.append(target)

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != target:
                    if file is not None:
                        close()
                    target = name
                    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
                    temporary = f"{target}.{uuid.uuid4().hex}.part"
                    file = (gzip.open if target.endswith(".gz") else open)(temporary, "wt", encoding="utf-8")
                    file.write(f'<?xml version="1.0" encoding="UTF-8"?>\n<{root}{attrs}>\n')
                file.write(text + "\n")
        if file is not None:
            close()
        yield pa.RecordBatch.from_pydict({"path": pa.array(done, pa.string())})

    ordered = rows.filter("path IS NOT NULL").repartition("path").sortWithinPartitions("path", "o").select("path", "xml")
    return [r["path"] for r in ordered.mapInArrow(write, "path string").collect()]


def index_lines(documents: DataFrame, record_id: str, fields: str) -> DataFrame:
    """(value): one JSON object for each index document, its fields as lists in order; written with .write.text."""
    many = F.transform(F.array_distinct(F.transform(fields, lambda f: f["name"])), lambda n: F.struct(
        n.alias("key"), F.transform(F.filter(fields, lambda f: f["name"] == n), lambda f: f["value"]).alias("value")))
    return documents.select(F.to_json(F.struct(F.col(record_id).cast("string").alias("id"), F.map_from_entries(many).alias("fields"))).alias("value"))


def post_documents(documents: DataFrame, url: str, batch: int = 100, send=None, *, retries: int = 3, commit: bool = False) -> None:
    """Posts index lines to a service in batches, each tried ``retries`` times more, and a commit when all are through; ``send(url, body)`` can replace the HTTP request. A document that is sent again replaces itself by its id."""

    def run(rows):
        out, call = [], send or _request
        for row in rows:
            out.append(json.loads(row["value"]))
            if len(out) == batch:
                _tried(call, url, json.dumps(out), retries)
                out = []
        if out:
            _tried(call, url, json.dumps(out), retries)

    documents.foreachPartition(run)
    if commit:
        _tried(send or _request, url, json.dumps({"commit": {}}), retries)


def _request(to: str, body: str) -> None:
    import urllib.request

    urllib.request.urlopen(urllib.request.Request(to, body.encode(), {"Content-Type": "application/json"}), timeout=60).read()


def _tried(call, url: str, body: str, retries: int) -> None:
    for attempt in range(retries + 1):
        try:
            return call(url, body)
        except OSError:
            if attempt == retries:
                raise
            time.sleep(0.1 * 2**attempt)
