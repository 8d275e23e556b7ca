"""Counts of genes and samples: transcripts to genes, replicate filters, orthogroups, assemblies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def genes_from_transcripts(quantities: DataFrame, mapping: DataFrame) -> DataFrame:
    """gene, reads, length: reads summed, lengths weighted by TPM (plainly, where all TPM are 0). quantities: transcript, reads, tpm, effective_length; mapping: transcript, gene."""
    joined = quantities.join(mapping, "transcript")
    weight = F.sum("tpm")
    return joined.groupBy("gene").agg(F.sum("reads").alias("reads"), F.when(weight > 0, F.sum(F.col("tpm") * F.col("effective_length")) / weight).otherwise(F.avg("effective_length")).alias("length"))


def expressed(counts: DataFrame, design: DataFrame, least: float) -> DataFrame:
    """Rows of (gene, sample, n) of genes with a mean of at least ``least`` in some condition, samples without a row being 0. design: sample, condition."""
    sizes = design.groupBy("condition").agg(F.count("*").alias("size"))
    means = counts.join(design, "sample").groupBy("gene", "condition").agg(F.sum("n").alias("s")).join(sizes, "condition")
    kept = means.where(F.col("s") / F.col("size") >= least).select("gene").distinct()
    return counts.join(kept, "gene", "left_semi")


def orthogroup_members(wide: DataFrame, group: str = "Orthogroup") -> DataFrame:
    """group, species, gene of a table with a column of comma-separated genes for each species."""
    species = [c for c in wide.columns if c != group]
    long = wide.unpivot([group], species, "species", "genes").where("genes is not null")
    return long.select(F.col(group).alias("group"), "species", F.explode(F.split("genes", ",\\s*")).alias("gene")).where("gene != ''")


def assembly_summary(busco: DataFrame) -> DataFrame:
    """status, n, percentage over ids, each counted once."""
    ids = busco.select("ID", "Status").distinct()
    counts = ids.groupBy(F.col("Status").alias("status")).agg(F.count("*").alias("n"))
    total = ids.agg(F.count("*").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("status", "n", (100.0 * F.col("n") / F.col("total")).alias("percentage"))


def size_factors(counts: DataFrame) -> DataFrame:
    """sample, factor: the median, over genes present in all samples, of counts over the gene's geometric mean."""
    samples = counts.agg(F.countDistinct("sample").alias("total"))  # one row
    means = counts.where("n > 0").groupBy("gene").agg(F.avg(F.log("n")).alias("m"), F.count("*").alias("k")).crossJoin(F.broadcast(samples)).where("k = total")
    ratios = counts.where("n > 0").join(means.select("gene", "m"), "gene").withColumn("r", F.log("n") - F.col("m"))
    return ratios.groupBy("sample").agg(F.exp(F.percentile("r", F.lit(0.5))).alias("factor"))


def cross_counts(stats: DataFrame, separator: str = "/") -> DataFrame:
    """name, part, value of a key/value table whose keys are paths: the first step and the rest."""
    steps = F.split("key", separator, 2)
    return stats.select(steps[0].alias("name"), F.get(steps, F.lit(1)).alias("part"), F.col("value").try_cast("double").alias("value"))
