"""Tables of reports: coverage summaries, barcodes, adapters, histograms, assembly and cell statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def centralness(rois: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """key and centralness: 1 less the share of a contig in its regions of interest; 1 without any. lengths: key, length."""
    sums = rois.groupBy(key).agg(F.sum("size").alias("__s"))
    return lengths.join(sums, key, "left").select(key, (1 - F.coalesce("__s", F.lit(0)) / F.nullif(F.col("length"), F.lit(0))).alias("centralness"))


def in_range(rois: DataFrame, start: int | None, end: int | None, sign: str | None = None) -> DataFrame:
    """Regions that reach into (start, end); ``low``: those of negative greatest z-score, ``high``: the others."""
    out = rois if start is None else rois.where((F.col("end") > start) & (F.col("start") < end))
    return out if sign is None else out.where(F.col("max_zscore") < 0 if sign == "low" else F.col("max_zscore") >= 0)


def coverage_summary(stats: DataFrame, rois: DataFrame, key: str) -> DataFrame:
    """``stats`` of contigs with the number of their regions: roi, roi_low and roi_high."""
    counts = rois.groupBy(key).agg(F.count("*").alias("roi"), F.count_if(F.col("max_zscore") < 0).alias("roi_low"), F.count_if(F.col("max_zscore") >= 0).alias("roi_high"))
    return stats.join(counts, key, "left").fillna(0, ["roi", "roi_low", "roi_high"])


def merged_summaries(chunks: DataFrame, keys: list[str], weighted: list[str], plain: list[str], summed: list[str], length: str = "length") -> DataFrame:
    """One summary of several chunks: means weighted by length, plain means, and sums; length is their sum."""
    n = F.sum(length)
    return chunks.groupBy(*keys).agg(n.alias(length), *((F.sum(F.col(c) * F.col(length)) / n).alias(c) for c in weighted), *(F.avg(c).alias(c) for c in plain), *(F.sum(c).alias(c) for c in summed))


def annotated_regions(rois: DataFrame, features: DataFrame, key: str, unwanted: tuple[str, ...] = ()) -> DataFrame:
    """Regions joined with the features that they overlap (start, stop closed), without those of ``unwanted`` types; a region without a feature has one row with nulls."""
    from strandlake.operators.intervals import overlaps

    genes = features.where(~F.col("type").isin(*unwanted)) if unwanted else features
    genes = genes.withColumns({"start": F.col("start"), "end": F.col("stop") + 1})
    pairs = overlaps(rois.select(key, "start", "end"), genes.select(key, "start", "end", "type", "gene"), [key], 1000, suffixes=("", "_gene"))
    found = pairs.select(key, "start", "end", F.col("start_gene").alias("gene_start"), (F.col("end_gene") - 1).alias("gene_end"), F.col("type_gene").alias("type"), F.col("gene_gene").alias("gene"))
    return rois.join(found, [key, "start", "end"], "left")


def cumulated(df: DataFrame, keys: list[str], value: str, width: float) -> DataFrame:
    """keys, bin, n and share of the values at or above the bin."""
    bins = df.where(F.col(value).isNotNull()).groupBy(*keys, (F.floor(F.col(value) / width) * width).alias("bin")).agg(F.count("*").alias("n"))
    up = Window.partitionBy(*keys).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    return bins.withColumn("share", F.sum("n").over(up) / F.sum("n").over(Window.partitionBy(*keys)))


def trailing_mean(df: DataFrame, key: str, order: str, value: str, n: int) -> DataFrame:
    """Mean of each row and the n - 1 before it; the first n - 1 rows of a key go. Sums run over blocks of ``order``, a dense number from 1, with the rows before them repeated."""
    block = max(100_000, n)
    own = F.floor((F.col(order) - 1) / block)
    halo = df.withColumn("__own", own).withColumn("__block", F.explode(F.sequence(own, F.floor((F.col(order) + n - 2) / block))))
    w = Window.partitionBy(key, "__block").orderBy(order).rowsBetween(-(n - 1), 0)
    rows = halo.withColumns({"__k": F.count("*").over(w), "mean": F.avg(value).over(w)})
    return rows.where((F.col("__own") == F.col("__block")) & (F.col("__k") == n)).drop("__own", "__block", "__k")


def interval_edges(edges: list[float]) -> list[tuple[float, float | None]]:
    """Intervals between edges, from 0 and to no end."""
    inner = edges if 0 in edges else [0, *edges]
    return list(zip(inner, [*inner[1:], None], strict=True))


def counts_of_intervals(cumulated_counts: Column, total: Column) -> Column:
    """Counts in the intervals of descending cumulative counts: total - a1, a1 - a2, ..., aN."""
    ends = F.concat(F.array(total), cumulated_counts, F.array(F.lit(0).cast("bigint")))
    return F.transform(F.slice(ends, F.lit(1), F.size(ends) - 1), lambda x, k: x - F.get(ends, k + 1))


def distance_range(text: Column) -> Column:
    """(start, end) of ``a-b`` or ``a+``, whose end is null; null for other texts."""
    start, end = F.regexp_extract(text, "^(\\d+)(?:-\\d+|\\+)$", 1).try_cast("bigint"), F.regexp_extract(text, "^\\d+-(\\d+)$", 1).try_cast("bigint")
    return F.when(start.isNotNull(), F.struct(start.alias("start"), end.alias("end")))


def middle_of_range(text: Column) -> Column:
    """Middle of ``10-15``, or the number itself; null for other texts."""
    parts = F.split(text, "-")
    a, b = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    return F.when(F.size(parts) == 2, (a + b) / 2).when(F.size(parts) == 1, a)


def spades_header(name: Column) -> Column:
    """(node, length, coverage) of ``NODE_1_length_200_cov_3.5``."""
    at = lambda k: F.regexp_extract(name, "^NODE_([^_]+)_length_(\\d+)_cov_([0-9.]+)", k)
    return F.struct(F.nullif(at(1), F.lit("")).alias("node"), at(2).try_cast("bigint").alias("length"), at(3).try_cast("double").alias("coverage"))


def tagged(comment: Column, key: str) -> Column:
    """Value of ``key=value`` in a header's comment; null if it isn't there."""
    return F.nullif(F.regexp_extract(comment, f"(?:^|\\s){key}=(\\S+)", 1), F.lit(""))


def top_barcodes(df: DataFrame, barcode: str, count: str, most: int) -> DataFrame:
    """rank, barcode and total over lanes of the most frequent ones."""
    totals = df.groupBy(barcode).agg(F.sum(count).alias("total")).orderBy(F.desc("total"), barcode).limit(most)
    return totals.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), barcode)))  # of the few rows kept


def adapter_share(df: DataFrame, sample: str, trimmed: str, total: str) -> DataFrame:
    """sample and percentage: the mean, over its one or two files, of the share of reads with an adapter."""
    return df.groupBy(sample).agg(F.avg(100.0 * F.col(trimmed) / F.nullif(F.col(total), F.lit(0))).alias("percentage"))


def paired_histogram(df: DataFrame, length: str, counts: list[str]) -> DataFrame:
    """Histograms of both ends of an adapter, summed by length."""
    return df.groupBy(length).agg(*(F.sum(c).alias(c) for c in counts))


def log_values(lines: DataFrame, patterns: dict[str, str], keys: list[str], text: str = "value") -> DataFrame:
    """A column for each pattern: the number in its first group on the first line, in the order of ``at``, that matches; null where none does. One pass over the lines of each key."""
    def first(pattern: str) -> Column:
        number = F.regexp_extract(text, pattern, 1)
        return F.min_by(F.when(number != "", F.replace(number, F.lit(","), F.lit("")).try_cast("double")), F.when(number != "", F.col("at")))

    return lines.groupBy(*keys).agg(*(first(p).alias(name) for name, p in patterns.items()))


def kmer_totals(histogram: DataFrame, kmer: str, count: str) -> DataFrame:
    """distinct (sum of counts) and total (sum of multiplicity times count) of a histogram of k-mers; one row."""
    return histogram.agg(F.sum(count).alias("distinct"), F.sum(F.col(kmer) * F.col(count)).alias("total"))


def group_sizes(members: DataFrame, group: str, species: str) -> DataFrame:
    """species, groups that it is in, and its genes in them."""
    return members.groupBy(species).agg(F.countDistinct(group).alias("groups"), F.count("*").alias("genes"))


def cell_statistics(df: DataFrame, keys: list[str], cell: str, length: str, low: int, high: int) -> DataFrame:
    """keys, cells (distinct, whose reads reach from ``low`` to ``high``), the median length of a cell's reads averaged over cells, and passes (reads of a cell less one) averaged."""
    cells = df.groupBy(*keys, cell).agg(F.percentile(length, F.lit(0.5)).alias("m"), F.count("*").alias("n"), F.min(length).alias("a"), F.max(length).alias("b"))
    return cells.groupBy(*keys).agg(F.count_if((F.col("a") >= low) & (F.col("b") <= high)).alias("cells"), F.avg("m").alias("mean_median"), F.avg(F.col("n") - 1).alias("mean_passes"))


def length_by_class(df: DataFrame, status: str, length: str) -> DataFrame:
    """status, n and quartiles of read lengths of classified and unclassified reads."""
    return df.groupBy(status).agg(F.count("*").alias("n"), *(F.percentile(length, F.lit(p)).alias(name) for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))))


def stitched(reads: DataFrame, key: str, start: str, seq: str, name: str = "reference") -> DataFrame:
    """One sequence for each key from reads at known places (0-based), each adding the letters beyond those before it; a gap is filled with N. Reads of a key, an amplicon's few dozen, are folded in one row."""
    rows = reads.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(start).cast("int").alias("at"), F.col(seq).alias("s")))).alias("x"))

    def add(out: Column, r: Column) -> Column:
        gap = F.greatest(r["at"] - F.length(out), F.lit(0))
        fresh = F.greatest(F.length(out) - r["at"], F.lit(0))
        return F.concat(out, F.repeat(F.lit("N"), gap), F.substr(r["s"], fresh + 1, F.length(r["s"])))

    return rows.select(key, F.aggregate("x", F.lit(""), add).alias(name))


def populations(df: DataFrame, position: str, bases: list[str], least: float) -> DataFrame:
    """Positions where at least two bases have more than the share ``least`` of the reads: position and those bases, in order."""
    total = reduce(lambda a, b: a + b, (F.col(b) for b in bases))
    found = F.array_compact(F.array(*(F.when(F.col(b) / F.nullif(total, F.lit(0)) > least, F.lit(b)) for b in bases)))
    return df.select(position, F.array_join(found, ",").alias("bases"), F.size(found).alias("n")).where("n >= 2")


def called_deletions(df: DataFrame, ref: str, alt: str, score: str, depth: str, least_score: float, least_depth: float) -> DataFrame:
    """Calls against an assembly whose alternate is longer than its reference, letters that the assembly has lost, of at least the score and depth."""
    return df.where((F.length(alt) > F.length(ref)) & (F.col(score) >= least_score) & (F.col(depth) >= least_depth))


def pair_differences(calls: DataFrame, site: list[str], sample: str, value: str, tolerance: float = 0.3, relative: float = 1e-5) -> DataFrame:
    """a, b, n, n_different: pairs of samples and their common sites whose values are further apart than tolerance + relative * |value of b|."""
    x = calls.select(*site, F.col(sample).alias("a"), F.col(value).alias("__x"))
    y = calls.select(*site, F.col(sample).alias("b"), F.col(value).alias("__y"))
    apart = F.abs(F.col("__x") - F.col("__y")) > tolerance + relative * F.abs("__y")
    return x.join(y, site).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.count_if(apart).alias("n_different"))


def first_allele_frequencies(calls: DataFrame, site: list[str], sample: str, samples: list[str], alternates: str, depth: str, quality: str, least: float) -> DataFrame:
    """Sites of a joint call set above a quality: a column for each sample with the share of its first alternate; 0 where it has no call."""
    kept = calls.where(F.col(quality) > least)
    share = F.coalesce(F.get(alternates, F.lit(0)) / F.nullif(F.col(depth), F.lit(0)), F.lit(0.0))
    return kept.groupBy(*site).pivot(sample, samples).agg(F.max(share)).fillna(0.0, samples)
