"""Never-ending drops of record files: the batch operators inside foreachBatch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def process_drops(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, fmt: str = "parquet", **options):
    """Runs ``work`` on every new set of files in ``source`` and stores the result of batch n in target/batch=n.

    A batch that is run again after a failure overwrites its own folder, so
    nothing is stored twice. Returns the query when all files present are done.
    """

    def one(frame: DataFrame, number: int) -> None:
        work(frame).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.format(fmt).schema(schema).options(**options).load(source)
    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
