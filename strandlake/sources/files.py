"""Lines of text files in their order, and record sources over byte ranges."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """file, block, at, value: text lines; (block, at) is their order within a file."""
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def carried(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` of lines with the last non-null ``value`` at or before each line of a file. Lines are sorted within the block that a task reads; what earlier blocks hand on is a row each."""
    marked = df.withColumn("__v", value)
    inside = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ends = marked.where(F.col("__v").isNotNull()).groupBy(F.col("file").alias("__f"), F.col("block").alias("__b")).agg(F.max_by("__v", "at").alias("__e"))
    blocks = marked.select(F.col("file").alias("__f"), F.col("block").alias("__b")).distinct().join(ends, ["__f", "__b"], "left")
    before = blocks.withColumn("__before", F.last("__e", ignorenulls=True).over(Window.partitionBy("__f").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).drop("__e")
    rows = marked.withColumn("__own", F.last("__v", ignorenulls=True).over(inside))
    joined = rows.join(before, (F.col("file") == F.col("__f")) & (F.col("block") == F.col("__b")))
    return joined.withColumn(name, F.coalesce("__own", "__before")).drop("__v", "__own", "__f", "__b", "__before")


def fields(df: DataFrame, names: list[str], pattern: str = "\t", limit: int = -1) -> DataFrame:
    """Columns of the split lines; missing ones are null."""
    parts = F.split("value", pattern, limit)
    return df.withColumn("__p", parts).select(*[c for c in df.columns if c != "value"], *(F.get("__p", F.lit(k)).alias(n) for k, n in enumerate(names)))


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns cast where they can be, else null; ``.`` and ``NA`` are null."""
    return df.withColumns({c: F.when(~F.col(c).isin(".", "NA", "nan", ""), F.col(c)).try_cast(kind) for c, kind in kinds.items()})


def filesystem(path: str):
    """(file system, path in it) of a local path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """Files at a path or in a folder, with their sizes."""
    from pyarrow import fs

    system, inner = filesystem(path)
    info = system.get_file_info(inner)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return sorted((prefix + x.path, x.size) for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))


def opened(path: str, start: int = 0) -> io.BufferedIOBase:
    """A binary stream from ``start``; gzip is told by its first bytes."""
    system, inner = filesystem(path)
    stream = system.open_input_file(inner)
    if stream.read(2) == b"\x1f\x8b":
        stream.seek(0)
        return gzip.GzipFile(fileobj=stream)  # also reads the joined members of BGZF
    stream.seek(start)
    return io.BufferedReader(stream)


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int | None):
        self.path, self.start, self.end = path, start, end


class RangeReader(DataSourceReader):
    """One partition for each ``splitBytes`` of a plain file, one for a compressed file."""

    def __init__(self, options: dict, records, splits: bool = True):
        self.options, self.records, self.splits = dict(options), records, splits

    def partitions(self) -> list[Range]:
        size, out = int(self.options.get("splitBytes", 128 << 20)), []
        for path, n in listed(self.options["path"]):
            if self.splits and opened(path).__class__ is not gzip.GzipFile:
                out += [Range(path, k, min(n, k + size)) for k in range(0, max(n, 1), size)]
            else:
                out.append(Range(path, 0, None))
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.records(partition, self.options)


class RecordSource(DataSource):
    """Base of the sources: subclasses give ``short``, ``columns`` and ``records``."""

    short, columns, splits = "", "", True

    @classmethod
    def name(cls) -> str:
        return cls.short

    def schema(self) -> str:
        return self.columns

    def reader(self, schema) -> DataSourceReader:
        return RangeReader(self.options, type(self).records, type(self).splits)
