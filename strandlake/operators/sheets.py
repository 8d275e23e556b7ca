"""Checks of sample sheets and designs: rows of check, status, n_bad and an example."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _row(df: DataFrame, name: str, level: str, example: str) -> DataFrame:
    """One row for the failing rows of a check."""
    found = df.agg(F.count("*").alias("n_bad"), F.min(F.col(example).cast("string")).alias("example"))
    return found.select(F.lit(name).alias("check"), F.when(F.col("n_bad") > 0, level).otherwise("Success").alias("status"), "n_bad", "example")


def _repeated(df: DataFrame, columns: list[str], name: str, level: str) -> DataFrame:
    whole = F.concat_ws("+", *columns).alias("x")
    return _row(df.groupBy(whole).agg(F.count("*").alias("c")).where("c > 1"), name, level, "x")


def sample_sheet(samples: DataFrame, lanes: int = 8) -> DataFrame:
    """Sample_ID, index and, if there, index2 and Lane of the data section."""
    has = lambda c: c in samples.columns
    lane = ["Lane"] if has("Lane") else []
    indices = ["index", "index2"] if has("index2") else ["index"]
    found = [_repeated(samples, [*lane, "Sample_ID"], "unique sample ids", "Error"), _repeated(samples, [*lane, *indices], "unique indices", "Error")]
    for column in indices:
        found.append(_row(samples.where(~F.col(column).rlike("^[ACGTN]+$")), f"letters of {column}", "Error", column))
        lengths = samples.select(F.length(column).alias("x")).distinct()
        found.append(_row(lengths.join(lengths.agg(F.min("x").alias("m")), F.col("x") != F.col("m")), f"one length of {column}", "Warning", "x"))
    found.append(_row(samples.where(~F.col("Sample_ID").rlike("^[A-Za-z0-9_-]+$")), "letters of sample ids", "Error", "Sample_ID"))
    if has("Lane"):
        found.append(_row(samples.where(~F.coalesce(F.col("Lane").try_cast("int").between(1, lanes), F.lit(False))), "lanes", "Error", "Lane"))
    return reduce(DataFrame.union, found)


def design(samples: DataFrame, label: str = "label", condition: str = "condition") -> DataFrame:
    """Unique labels, at least two conditions, and two samples of each."""
    sizes = samples.groupBy(condition).agg(F.count("*").alias("n"))
    few = sizes.agg(F.count("*").alias("n"), F.min(condition).alias("x")).where("n < 2")
    return reduce(DataFrame.union, [_repeated(samples, [label], "unique labels", "Error"), _row(few, "two conditions", "Error", "x"), _row(sizes.where("n < 2"), "two samples a condition", "Error", condition)])


def is_valid(checks: DataFrame) -> DataFrame:
    """One row, valid: no check failed with an error."""
    return checks.agg((F.count_if(F.col("status") == "Error") == 0).alias("valid"))
