"""Sampling; every random choice has a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.tracks import dense_positions


def random_rows(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """``n`` rows, those with the least hash of ``key`` and ``seed``: the same ones whatever the partitions."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def to_coverage(df: DataFrame, length: str, genome: int, coverage: float, key: str, seed: int) -> DataFrame:
    """Rows by hash of their key, as many as give ``coverage`` on average."""
    total = df.agg(F.sum(length)).first()[0] or 0
    share = min(1.0, coverage * genome / total) if total else 0.0
    return df.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))


def every(df: DataFrame, stride: int, shift: int, key: str, order: list[str], block: Column) -> DataFrame:
    """Each ``stride``-th row of a key, from row ``shift``."""
    return dense_positions(df, key, order, block, "__n").where((F.col("__n") - 1) % stride == shift).drop("__n")


def per_group(df: DataFrame, keys: list[str], n: int, key: str, seed: int, parts: int = 32) -> DataFrame:
    """At most ``n`` rows of each group, by hash; first of each of ``parts`` shares of a group, so no group is sorted as a whole."""
    h = F.xxhash64(key, F.lit(seed))
    rows = df.withColumn("__h", h).withColumn("__p", F.pmod(F.col("__h"), F.lit(parts)))
    first = rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys, "__p").orderBy("__h", key))).where(F.col("__k") <= n)
    return first.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy("__h", key))).where(F.col("__k") <= n).drop("__h", "__p", "__k")
