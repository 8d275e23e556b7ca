"""Peaks, grids and orders: local maxima, replicated peaks, threshold grids, sortedness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def local_maxima(df: DataFrame, key: str, pos: str, value: str, least: float) -> DataFrame:
    """Rows above ``least`` and above both neighbours."""
    w = Window.partitionBy(key).orderBy(pos)
    return df.withColumn("__a", F.lag(value).over(w)).withColumn("__b", F.lead(value).over(w)).where((F.col(value) > least) & (F.col(value) > F.col("__a")) & (F.col(value) > F.col("__b"))).drop("__a", "__b")


def replicated(df: DataFrame, keys: list[str], source: str, start: str = "start", end: str = "end") -> DataFrame:
    """Unions of overlapping peaks: keys, start, end, n and sources (the least and, if others are in it, ``both``)."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = df.withColumn("__reach", reach).withColumn("__run", F.sum(F.coalesce(F.col(start) >= F.col("__reach"), F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "__run").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n"), F.when(F.min(source) == F.max(source), F.min(source)).otherwise("both").alias("sources")).drop("__run")


def idr_score(idr: Column) -> Column:
    """-125 log2 of the rate, cut to an integer of at most 1000; 1000 for 0."""
    return F.when(idr <= 0, 1000).otherwise(F.least((-125 * F.log2(idr)).cast("int"), F.lit(1000)))


def idr_of_score(score: Column) -> Column:
    return F.pow(F.lit(2.0), -score / 125)


def above_grid(df: DataFrame, value: str, grid: list[float]) -> DataFrame:
    """threshold, percentage of rows above it, for each point of a grid, in one pass."""
    counts = df.agg(F.array(*(F.struct(F.lit(float(g)).alias("threshold"), (100.0 * F.count_if(F.col(value) > g) / F.nullif(F.count(value), F.lit(0))).alias("percentage")) for g in grid)).alias("x"))
    return counts.select(F.explode("x").alias("x")).select("x.*")


def is_sorted(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """key, in_order: values never fall along ``order``."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__before", F.lag(value).over(w)).groupBy(key).agg(F.coalesce(F.bool_and(F.col("__before").isNull() | (F.col(value) >= F.col("__before"))), F.lit(True)).alias("in_order"))


def repeats(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, column, repeated: values minus distinct values of each column."""
    cells = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select(*keys, "x.column", "x.value").where("value is not null")
    counts = cells.groupBy(*keys, "column", "value").agg(F.count("*").alias("c"))
    return counts.groupBy(*keys, "column").agg((F.sum("c") - F.count("*")).alias("repeated"))


def comparisons(df: DataFrame, condition: str) -> DataFrame:
    """Pairs a < b of conditions that have at least two samples each."""
    known = df.groupBy(condition).agg(F.count("*").alias("n")).where("n >= 2").select(condition)
    return known.select(F.col(condition).alias("a")).join(known.select(F.col(condition).alias("b")), F.col("a") < F.col("b"))


def reaching(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """keys, n: how many of the greatest values make up ``share`` of the sum."""
    histogram = df.groupBy(*keys, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    rows = histogram.withColumn("__s", F.coalesce(F.sum(F.col("c") * F.col(value)).over(w), F.lit(0))).withColumn("__k", F.coalesce(F.sum("c").over(w), F.lit(0))).withColumn("__need", share * F.sum(F.col("c") * F.col(value)).over(Window.partitionBy(*keys)))
    hit = rows.where((F.col("__s") < F.col("__need")) & (F.col("__s") + F.col("c") * F.col(value) >= F.col("__need")))
    return hit.groupBy(*keys).agg(F.min(F.col("__k") + F.ceil((F.col("__need") - F.col("__s")) / F.col(value))).cast("bigint").alias("n"))
