"""Reads and contigs as tables: filters, parts, collapses, quality summaries and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import quality, sequence


def of_length(df: DataFrame, seq: str, least: int | None = None, most: int | None = None) -> DataFrame:
    """Reads of ``least`` to ``most`` letters, both included; null sequences go."""
    n = F.length(seq)
    return df.where(n.isNotNull() & (n >= (least or 0)) & ((n <= most) if most is not None else F.lit(True)))


def strictly_between(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Rows with low < value < high, as for lengths and mapping qualities of long reads."""
    return df.where((F.col(value) > low) & (F.col(value) < high))


def named(df: DataFrame, name: str, names: DataFrame, keep: bool = True) -> DataFrame:
    """Reads whose name is in the one column of ``names``, or isn't; a null name is in no list."""
    wanted = names.toDF("__name").where("__name is not null").distinct()
    return df.join(wanted, F.col(name) == F.col("__name"), "left_semi" if keep else "left_anti")


def part_of(number: Column, parts: int) -> Column:
    """Part of the record with a running number from 0: round robin, so that parts differ by one record at most."""
    return F.pmod(number, F.lit(parts))


def chunk_of(number: Column, size: int) -> Column:
    """File of the record with a running number from 0, ``size`` records a file."""
    return F.floor(number / size)


def complete_records(lines: DataFrame, per_record: int = 4) -> DataFrame:
    """n_records and ``complete``: whether the number of lines is a multiple of ``per_record``; one row, also for no lines."""
    return lines.agg(F.count("*").alias("n")).select(F.floor(F.col("n") / per_record).alias("n_records"), (F.col("n") % per_record == 0).alias("complete"))


def renamed_contigs(df: DataFrame, project: str, seq: str, number: Column, old: Column, least: int = 500) -> DataFrame:
    """header and sequence of contigs of at least ``least`` letters: ``project_k old name``."""
    return df.where(F.length(seq) >= least).select(F.concat(F.lit(f"{project}_"), number.cast("string"), F.lit(" "), old).alias("header"), F.col(seq).alias("sequence"))


def collapsed(df: DataFrame, keys: list[str], order: list[str], seq: str) -> DataFrame:
    """One sequence for each key: its contigs one behind the other by ``order``; null contigs are left out."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(seq).alias("__s"))))
    return df.where(F.col(seq).isNotNull()).groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["__s"]), "").alias("sequence"), F.count("*").alias("n"))


def gc_and_length(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """gc (percentage of C, G and S, both cases) and length of each read; null for empty reads."""
    s = F.col(seq)
    return df.select(*keys, (100.0 * sequence.count_of(s, "CGScgs") / F.nullif(F.length(s), F.lit(0))).alias("gc"), F.length(s).alias("length"))


def read_statistics(df: DataFrame, keys: list[str], seq: str, qual: str, offset: int = 33) -> DataFrame:
    """One row a key: n_reads, letters A, C, G, T, N, total_bases (their sum), gc (mean of the reads' percentages), mean, least and greatest length, mean_quality (mean of the reads' means) and base_quality (over all bases). Empty reads are left out."""
    s, n = F.col(seq), F.length(seq)
    rows = df.where(n > 0).select(*keys, n.alias("__len"), (100.0 * sequence.count_of(s, "GC") / n).alias("__gc"), *(sequence.count_of(s, c).alias(f"__{c}") for c in "ACGTN"), F.aggregate(quality.phred_values(F.col(qual), offset), F.lit(0).cast("long"), lambda a, x: a + x).alias("__q"))
    total = sum((F.sum(f"__{c}") for c in "CGTN"), F.sum("__A"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n_reads"), *(F.sum(f"__{c}").alias(c.lower()) for c in "ACGTN"), total.alias("total_bases"), F.avg("__gc").alias("gc"), F.avg("__len").alias("mean_length"), F.min("__len").alias("min_length"), F.max("__len").alias("max_length"), F.avg(F.col("__q") / F.col("__len")).alias("mean_quality"), (F.sum("__q") / F.nullif(total, F.lit(0))).alias("base_quality"))


def quality_by_position(df: DataFrame, keys: list[str], qual: str, offset: int = 33) -> DataFrame:
    """keys, pos (from 1), n, mean and quartiles of the scores at each position of the reads."""
    rows = df.where(F.length(qual) > 0).select(*keys, F.posexplode(quality.phred_values(F.col(qual), offset)).alias("pos", "q"))
    return rows.groupBy(*keys, (F.col("pos") + 1).cast("bigint").alias("pos")).agg(F.count("*").alias("n"), F.avg("q").alias("mean"), *(F.percentile("q", F.lit(share)).alias(name) for name, share in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))))


def same_reads(left: DataFrame, right: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """One row: whether two ordered sets of reads are equal, read by read, and how many places differ. A place that only one has differs."""
    a, b = left.select(*order, F.struct(*columns).alias("__a")), right.select(*order, F.struct(*columns).alias("__b"))
    both = a.join(b, order, "full")
    return both.agg(F.count_if(~F.col("__a").eqNullSafe(F.col("__b"))).alias("n_different")).withColumn("equal", F.col("n_different") == 0)


def letters_of_kmers(counts: DataFrame, kmer: str, count: str) -> DataFrame:
    """Lines of a krona text: the count and one column a letter, by tabs."""
    return counts.select(F.concat_ws("\t", F.col(count).cast("string"), F.regexp_replace(kmer, "(.)(?=.)", "$1\t")).alias("line"))


def old_illumina_identifier(identifier: Column) -> Column:
    """Struct of the parts of a read name before version 1.8 (``a:lane:tile:x:y#index/member``); missing ones are null."""
    parts = F.split(F.translate(F.substring_index(identifier, " ", 1), "#/", "::"), ":")
    names = ["instrument", "lane", "tile", "x", "y", "index", "member"]
    return F.struct(*((F.concat(F.lit("#"), F.get(parts, F.lit(k))) if n == "index" else F.get(parts, F.lit(k))).alias(n) for k, n in enumerate(names)))


def pair_distance(df: DataFrame) -> DataFrame:
    """pos1, pos2 and mode of first reads whose mate is mapped, from the columns start, end, reverse and mate_start, mate_end, mate_reverse: mode 1 if the read is reversed, 2 if its mate is, else 3 with -1 for both."""
    own, mate = F.col("reverse"), F.col("mate_reverse")
    pos1 = F.when(own, F.col("mate_start")).when(mate, F.col("start")).otherwise(-1)
    pos2 = F.when(own, F.col("end")).when(mate, F.col("mate_end")).otherwise(-1)
    return df.withColumns({"pos1": pos1, "pos2": pos2, "mode": F.when(own, 1).when(mate, 2).otherwise(3)})

