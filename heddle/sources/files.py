"""Reading XML documents, parameter lists, lists of files, lookup tables and directory trees."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FS_SCHEMA = "path string, parent_path string, name string, kind string, depth int, length bigint, last_modified bigint, symlink boolean, symlink_target string"


def read_xml(spark: SparkSession, paths: str | list[str], row_tag: str, schema: str | None = None, **options) -> DataFrame:
    """Records of XML files, one row for each ``row_tag`` element, with system_id (the file). A document that is not well-formed fails the job."""
    reader = spark.read.format("xml").options(rowTag=row_tag, mode="FAILFAST", ignoreNamespace="true", **options)
    frame = (reader.schema(schema) if schema else reader).load(paths)
    return frame.withColumn("system_id", F.col("_metadata.file_path"))


def read_params(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """(pos, value) of a delimited token file, in order; delimiter None: lines. An empty last token is none."""
    text = spark.read.text(path, wholetext=True)
    mark = F.lit("\\n" if delimiter is None else "\\Q" + delimiter + "\\E")
    tokens = text.select(F.posexplode(F.split("value", mark)).alias("pos", "value"), F.size(F.split("value", mark)).alias("n"))
    return tokens.filter(~((F.col("pos") == F.col("n") - 1) & (F.col("value") == ""))).select(F.col("pos").cast("bigint").alias("pos"), "value")


def is_content(first: str) -> bool:
    """Whether an input is XML itself rather than a list of files: its first character tells."""
    return first[:1] == "<"


def first_sign(spark: SparkSession, path: str) -> str:
    """The first character of a file, '' of an empty one; for a directory or pattern that of its first file."""
    row = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim("value"), 1, 1).alias("c")).filter("c <> ''").limit(1).collect()
    return row[0]["c"] if row else ""


def read_listed(spark: SparkSession, listed: DataFrame, row_tag: str, schema: str | None = None, **options) -> DataFrame:
    """The records of the files in a (pos, value) list, with doc_pos, the place of their file in it; a file that is listed twice counts at its first place."""
    places = listed.groupBy("value").agg(F.min("pos").alias("doc_pos"))
    paths = [r["value"] for r in places.orderBy("doc_pos").collect()]  # a list of files, given by hand
    clean = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    frame = read_xml(spark, paths, row_tag, schema, **options)
    return frame.join(places.select(clean(F.col("value")).alias("__at"), "doc_pos"), clean(F.col("system_id")) == F.col("__at"), "left").drop("__at")


def read_lookup(spark: SparkSession, path: str, row_tag: str, key: str, value: str) -> DataFrame:
    """(key, value) of a lookup document."""
    return spark.read.format("xml").options(rowTag=row_tag).load(path).select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{value}`").cast("string").alias("value"))


class _Subtree(InputPartition):
    def __init__(self, path: str, depth: int, deep: bool):
        super().__init__(path)
        self.path, self.depth, self.deep = path, depth, deep


class TreeReader(DataSourceReader):
    """One partition for each directory below the root, and one for the root's own entries."""

    def __init__(self, root: str, follow: bool, strict: bool):
        self.root, self.follow, self.strict = root, follow, strict

    def partitions(self):
        subs = sorted(e.path for e in os.scandir(self.root) if e.is_dir(follow_symlinks=self.follow))
        return [_Subtree(self.root, 0, False), *[_Subtree(p, 1, True) for p in subs]]

    def read(self, partition: _Subtree) -> Iterator[tuple]:
        if not partition.deep:
            yield self._row(partition.path, 0, "dir")
            for e in sorted(os.scandir(partition.path), key=lambda e: e.name):
                if not e.is_dir(follow_symlinks=self.follow):
                    yield self._row(e.path, 1, "symlink" if e.is_symlink() and not self.follow else "file")
        else:
            yield from self._walk(partition.path, partition.depth, {os.path.realpath(self.root)})

    def _walk(self, path: str, depth: int, above: set[str]) -> Iterator[tuple]:
        real = os.path.realpath(path)
        if real in above:  # a link to a directory it is in
            yield self._row(path, depth, "symlink")
            return
        try:
            entries = sorted(os.scandir(path), key=lambda e: e.name)
        except PermissionError:
            if self.strict:
                raise
            yield self._row(path, depth, "unreadable")
            return
        yield self._row(path, depth, "dir")
        for e in entries:
            if e.is_dir(follow_symlinks=self.follow):
                yield from self._walk(e.path, depth + 1, above | {real})
            else:
                yield self._row(e.path, depth + 1, "symlink" if e.is_symlink() and not self.follow else "file")

    def _row(self, path: str, depth: int, kind: str) -> tuple:
        s = os.lstat(path)
        link = stat.S_ISLNK(s.st_mode)
        return (path, os.path.dirname(path), os.path.basename(path), kind, depth, s.st_size, int(s.st_mtime * 1000), link, os.readlink(path) if link else None)


class TreeSource(DataSource):
    """spark.read.format("heddle_tree").load(directory): one row for each entry of a directory tree."""

    @classmethod
    def name(cls) -> str:
        return "heddle_tree"

    def schema(self) -> str:
        return FS_SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"], self.options.get("follow", "false") == "true", self.options.get("strict", "false") == "true")


def read_tree(spark: SparkSession, root: str, follow: bool = False, strict: bool = False) -> DataFrame:
    from heddle.session import ship

    ship(spark)
    spark.dataSource.register(TreeSource)
    return spark.read.format("heddle_tree").options(follow=str(follow).lower(), strict=str(strict).lower()).load(root)


def object_trees(entries: DataFrame, marker: str = "0=dflat") -> DataFrame:
    """The entries at or below directories with a child whose name begins with ``marker``, with object_id, the name of that directory."""
    homes = entries.filter(F.col("name").startswith(marker)).select(F.col("parent_path").alias("home")).distinct()
    up = entries.withColumn("__parts", F.split("path", "/")).withColumn("__above", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("__parts")), lambda i: F.array_join(F.slice("__parts", F.lit(1), i), "/"))))
    found = up.join(homes, F.col("__above") == F.col("home"))
    return found.withColumn("object_id", F.regexp_extract("home", r"([^/]*)$", 1)).drop("__parts", "__above", "home")


def with_contents(spark: SparkSession, entries: DataFrame, root: str, suffixes: tuple[str, ...] = (".xml", ".txt", ".log")) -> DataFrame:
    """Entries with the text of files of some kinds, illegal characters replaced; null for others."""
    from heddle.functions.text import sanitize

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(
        F.regexp_replace("path", r"^file:/+", "/").alias("path"), sanitize(F.decode("content", "UTF-8")).alias("content")
    ).filter(F.col("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))
    return entries.join(files, "path", "left")
