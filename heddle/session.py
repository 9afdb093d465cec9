"""Session helpers: reading test tables and finding the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the executors' Python workers, once for each application; they may have no path to it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    home = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="heddle-")) / "heddle.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def load(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame | list[DataFrame]:
    """The tables ``names`` of ``sf_dir`` (one DataFrame for one name)."""
    ship(spark)
    frames = [spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names]
    return frames[0] if len(frames) == 1 else frames


def with_row(frame: DataFrame, name: str = "__row") -> DataFrame:
    """``frame``, as read from files, with a number for each row made of its file and its place there: other rows have others, a retry has the same."""
    return frame.withColumn(name, F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index")))


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir. Where that is unset a temporary one is made in local mode; on a cluster, whose machines do not see each other's folders, it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="heddle-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, used for one call only; it is removed when the application ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    # the file system's own hook: it removes the path when the driver's JVM ends in order
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def stored(frame: DataFrame, label: str) -> DataFrame:
    """``frame`` written to the shared folder and read again: lineage is cut and the rows survive the loss of executors."""
    spark = frame.sparkSession
    path = scratch(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def row_salt(frame: DataFrame, salts: int | Column, row: str | None = None) -> Column:
    """A pseudo-random salt in [0, salts) that is the same when a lost task runs again.

    ``rand()`` draws by row order, so a recomputed map task could move rows to
    other salts after a reducer has read the first attempt. ``row`` names a
    column that tells rows apart (see ``with_row``); its hash is the salt.
    Without it the salt is a hash over the row's columns and its input
    partition; maps cannot be hashed and are left out.
    """
    if row is not None:
        return F.pmod(F.xxhash64(F.col(f"`{row}`")), F.lit(salts) if isinstance(salts, int) else salts).cast("int")
    usable = [F.col(f"`{c}`") for c, kind in frame.dtypes if "map<" not in kind and kind != "variant"]
    return F.pmod(F.xxhash64(*usable, F.spark_partition_id()), F.lit(salts) if isinstance(salts, int) else salts).cast("int")
