"""Depth tracks: positions, running medians, z-scores, regions of interest and their clusters.

A track has one row a position: a key (contig), pos (from 1, dense) and a value.
Windows run over blocks of positions with the rows around them repeated, so one
long contig is not one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 100_000


def dense_positions(df: DataFrame, key: str, order: list[str], block: Column, name: str = "pos") -> DataFrame:
    """Number rows from 1 in each key by ``order``. ``block`` rises with the order: rows are numbered within it and blocks get their offsets from a small table of counts."""
    rows = df.withColumn("__block", block)
    counts = rows.groupBy(key, "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy(key, "__block").orderBy(*order))
    return rows.join(offsets, [key, "__block"]).withColumn(name, (F.col("__before") + inside).cast("bigint")).drop("__block", "__before")


def _dealt(df: DataFrame, pos: str, half: int, block: int) -> DataFrame:
    """``df`` dealt to blocks of ``block`` positions, with the ``half`` rows around each repeated: __block, and __own, the block a row belongs to."""
    first, last = F.floor((F.col(pos) - 1 - half) / block), F.floor((F.col(pos) - 1 + half) / block)
    return df.withColumn("__own", F.floor((F.col(pos) - 1) / block)).withColumn("__block", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))


def sliding_medians(values: np.ndarray, width: int) -> np.ndarray:
    """Median of the ``width`` values around each place that has them, NaN for others; NaN values don't count. One sorted list slides along, so a wide window costs hardly more."""
    half, n = width // 2, len(values)
    out, held = np.full(n, np.nan), sorted(values[: min(width, n)][~np.isnan(values[: min(width, n)])].tolist())
    for k in range(half, n - half):
        if held:
            m = len(held) // 2
            out[k] = held[m] if len(held) % 2 else (held[m - 1] + held[m]) / 2
        if k + half + 1 < n:
            if (old := values[k - half]) == old:
                del held[bisect_left(held, old)]
            if (new := values[k + half + 1]) == new:
                insort(held, new)
    return out


def running_median(df: DataFrame, key: str, pos: str, value: str, width: int, name: str = "rm", block: int = BLOCK) -> DataFrame:
    """Median of ``width`` (odd) rows around each; the first and last ``width // 2`` rows keep their value. Null values don't count, a window of nulls gives null."""
    if width % 2 == 0:
        raise ValueError("the width of a running median must be odd")
    half = width // 2
    dealt = _dealt(df.select(key, pos, F.col(value).cast("double").alias("__v")), pos, half, max(block, width))

    def medians(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(pos)
        mine = (rows["__own"] == rows["__block"]).to_numpy()
        found = sliding_medians(rows["__v"].to_numpy(dtype=float, na_value=np.nan), width)
        place, last = np.arange(len(rows)), len(rows) - 1
        full = (place >= half) & (place <= last - half)
        return pd.DataFrame({key: rows[key].to_numpy()[mine], pos: rows[pos].to_numpy()[mine], "__m": found[mine], "__full": full[mine]})

    kinds = f"{key} {df.schema[key].dataType.simpleString()}, {pos} {df.schema[pos].dataType.simpleString()}, __m double, __full boolean"
    found = dealt.groupBy(key, "__block").applyInPandas(medians, kinds)
    found = found.withColumnsRenamed({key: "__k", pos: "__p"})
    joined = df.join(found, F.col(key).eqNullSafe(F.col("__k")) & (F.col(pos) == F.col("__p")))
    return joined.withColumn(name, F.when(F.col("__full"), F.nanvl("__m", F.lit(None).cast("double"))).otherwise(F.col(value).cast("double"))).drop("__k", "__p", "__m", "__full")


def framed_sums(df: DataFrame, key: str, pos: str, half: int, values: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """``df`` with the sums of ``values`` (never null), and __n, over ``half`` rows to both sides, from differences of running sums: a wide window costs no more than a narrow one."""
    own = Window.partitionBy(key, "__block").orderBy(pos)
    halo = _dealt(df, pos, half, max(block, 2 * half + 1)).withColumns({f"__r_{name}": F.sum(v).over(own.rowsBetween(Window.unboundedPreceding, 0)) for name, v in (values | {"__n": F.lit(1)}).items()})

    def framed(name: str) -> Column:
        run = F.col(f"__r_{name}")
        return F.coalesce(F.lead(run, half).over(own), F.last(run).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))) - F.coalesce(F.lag(run, half + 1).over(own), F.lit(0))

    out = halo.withColumns({name: framed(name) for name in (*values, "__n")})
    return out.where("__own = __block").drop("__own", "__block", *(f"__r_{name}" for name in (*values, "__n")))


def moving_average(df: DataFrame, key: str, pos: str, value: str, width: int, name: str = "ma", block: int = BLOCK) -> DataFrame:
    """Mean of full windows of ``width`` (odd) rows around each, of the values that aren't null; null at the edges."""
    known = F.col(value).isNotNull()
    rows = framed_sums(df, key, pos, width // 2, {"__s": F.coalesce(F.col(value).cast("double"), F.lit(0.0)), "__c": known.cast("int")}, block)
    return rows.withColumn(name, F.when(F.col("__n") == width, F.col("__s") / F.nullif(F.col("__c"), F.lit(0)))).drop("__s", "__c", "__n")


def zscores(df: DataFrame, value: str, rm: str, mu: float, sigma: float, low: float) -> DataFrame:
    """scale = value / rm and its z-score under a normal model; null becomes 0, zero depth at most low - 0.01."""
    scale = F.col(value) / F.nullif(F.col(rm), F.lit(0.0))
    z = F.coalesce((scale - mu) / sigma, F.lit(0.0)) if sigma else F.lit(0.0)
    return df.withColumn("scale", scale).withColumn("zscore", F.when(F.col(value) == 0, F.least(F.lit(low - 0.01), z)).otherwise(z))


def regions(df: DataFrame, key: str, pos: str, value: str, *, low: float = -4.0, high: float = 4.0, low_ratio: float = 0.5, high_ratio: float = 0.5) -> DataFrame:
    """Double-threshold regions: runs of neighbouring positions beyond the weak thresholds, of one sign, cut to the first and last beyond the strong ones.

    start and end are 1-based and half open. A key's kept rows are sorted in one
    task; they are the few beyond the weak thresholds.
    """
    kept = df.where((F.col("zscore") > high_ratio * high) | (F.col("zscore") < low_ratio * low))
    w = Window.partitionBy(key).orderBy(pos)
    fresh = (F.lag(pos).over(w) != F.col(pos) - 1) | (F.signum(F.lag("zscore").over(w)) != F.signum("zscore"))
    runs = kept.withColumn("__new", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    strong = (F.col("zscore") > high) | (F.col("zscore") < low)
    inside = Window.partitionBy(key, "run")
    cut = runs.withColumn("__a", F.min(F.when(strong, F.col(pos))).over(inside)).withColumn("__b", F.max(F.when(strong, F.col(pos))).over(inside)).where(F.col(pos).between(F.col("__a"), F.col("__b")))
    mean_cov, mean_rm = F.avg(value), F.avg("rm")
    out = cut.groupBy(key, F.col("__a").alias("start"), (F.col("__b") + 1).alias("end")).agg((F.max(pos) - F.min(pos) + 1).alias("size"), mean_cov.alias("mean_cov"), F.max(value).alias("max_cov"), mean_rm.alias("mean_rm"), F.avg("zscore").alias("mean_zscore"), F.when(F.avg("zscore") >= 0, F.max("zscore")).otherwise(F.min("zscore")).alias("max_zscore"))
    return out.withColumn("log2_ratio", F.when((F.col("mean_cov") != 0) & (F.col("mean_rm") != 0), F.log2(F.col("mean_cov") / F.col("mean_rm"))))


def clusters(found: DataFrame, key: str, delta: int) -> DataFrame:
    """Chains of regions less than ``delta`` apart and of one sign: key, start, end, n_regions, size."""
    w = Window.partitionBy(key).orderBy("start")
    fresh = (F.col("start") - F.lag("end").over(w) >= delta) | (F.lag("max_zscore").over(w) * F.col("max_zscore") < 0)
    chained = found.withColumn("chain", F.sum(F.coalesce(fresh, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return chained.groupBy(key, "chain").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_regions")).withColumn("size", F.col("end") - F.col("start"))


def depth_statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """DOC, STD, CV, BOC (percentage above 0), median and MAD of each key; the median comes from a first, partial aggregation over values."""
    base = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("doc"), F.stddev_samp(value).alias("std"), (100.0 * F.count_if(F.col(value) > 0) / F.count(value)).alias("boc"), F.percentile(value, F.lit(0.5)).alias("median"))
    spread = df.join(base.select(*keys, "median"), keys).groupBy(*keys).agg(F.percentile(F.abs(F.col(value) - F.col("median")), F.lit(0.5)).alias("mad"))
    return base.join(spread, keys).withColumn("cv", F.col("std") / F.nullif(F.col("doc"), F.lit(0.0)))


def evenness(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """1 - (n - sum / C) / N: C is the mean of the N values, rounded half to even, n and sum are of the values up to C; 1 where none is. Null values don't count; keys may be null."""
    mean = df.groupBy(*keys).agg(F.bround(F.avg(value)).alias("__m")).withColumnsRenamed({k: f"__{k}" for k in keys})
    low = F.col(value) <= F.col("__m")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    share = (F.count_if(low) - F.sum(F.when(low, F.col(value))) / F.nullif(F.first("__m"), F.lit(0.0))) / F.count(value)
    return df.join(mean, same).groupBy(*keys).agg(F.when((F.count_if(low) == 0) & (F.count(value) > 0), 1.0).otherwise(1 - share).alias("evenness"))


def binned(df: DataFrame, key: str, pos: str, value: str, width: int) -> DataFrame:
    """Mean, and rows, of each run of ``width`` positions."""
    return df.groupBy(key, F.floor((F.col(pos) - 1) / width).alias("bin")).agg(F.avg(value).alias("mean_value"), F.count("*").alias("n"))
