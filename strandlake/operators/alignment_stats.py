"""Statistics of alignments in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.alignment import cigar_length, has_flag


def summary(df: DataFrame, flag: str = "flag") -> DataFrame:
    """total (without secondary and supplementary), mapped, unmapped, proper_pairs, duplicates, secondary, qc_fail."""
    bit = lambda n: has_flag(F.col(flag), n)
    first = ~bit("secondary") & ~bit("supplementary")
    return df.agg(F.count_if(first).alias("total"), F.count_if(first & ~bit("unmapped")).alias("mapped"), F.count_if(first & bit("unmapped")).alias("unmapped"), F.count_if(first & bit("proper_pair")).alias("proper_pairs"), F.count_if(bit("duplicate")).alias("duplicates"), F.count_if(bit("secondary")).alias("secondary"), F.count_if(bit("qc_fail")).alias("qc_fail"))


def by_first_reason(df: DataFrame, mapq: int, flag: str = "flag", quality: str = "mapq") -> DataFrame:
    """reason, n: each record under the first of qc_fail, duplicate, secondary, unmapped and low_quality that holds, else used."""
    bit = lambda n: has_flag(F.col(flag), n)
    reason = F.when(bit("qc_fail"), "qc_fail").when(bit("duplicate"), "duplicate").when(bit("secondary"), "secondary").when(bit("unmapped"), "unmapped").when(F.col(quality) < mapq, "low_quality").otherwise("used")
    return df.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def insert_size(df: DataFrame, low: int, high: int, size: str = "tlen") -> DataFrame:
    """mean, median and deviation (population) of absolute sizes between the bounds."""
    x = F.abs(F.col(size))
    return df.where(x.between(low, high)).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"), F.stddev_pop(x).alias("std"))


def operation_totals(df: DataFrame, cigar: str = "cigar") -> DataFrame:
    """Bases of each CIGAR operation."""
    return df.agg(*(F.sum(cigar_length(F.col(cigar), op)).alias(name) for op, name in (("M", "matched"), ("I", "inserted"), ("D", "deleted"), ("N", "skipped"), ("S", "soft_clipped"))))


def per_reference(df: DataFrame, sample: str, flag: str = "flag", reference: str = "rname") -> DataFrame:
    """sample, reference, n of primary mapped records."""
    bit = lambda n: has_flag(F.col(flag), n)
    return df.where(~bit("unmapped") & ~bit("secondary") & ~bit("supplementary")).groupBy(sample, reference).agg(F.count("*").alias("n"))
