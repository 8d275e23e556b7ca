"""Taxa: ranks of lineages and tables of classified reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.tables import lineage

# The ranks of a table of taxa, in order.
RANKS = ["kingdom", "phylum", "class", "order", "family", "genus", "species"]


def ranked(nodes: DataFrame, depth: int = 64) -> DataFrame:
    """taxon and a column for each of RANKS (one blank where a lineage has none): superkingdom counts as kingdom, subkingdom where there is no kingdom. nodes: taxon, parent (null or itself at the root), rank, name."""
    tree = nodes.withColumn("parent", F.when(F.col("parent") != F.col("taxon"), F.col("parent")))
    paths = lineage(tree.select(F.col("taxon").alias("id"), "parent"), depth)
    steps = paths.select(F.col("id").alias("taxon"), F.explode("path").alias("step")).join(nodes.select(F.col("taxon").alias("step"), "rank", "name"), "step")
    at = lambda *names: F.coalesce(*(F.max(F.when(F.col("rank") == n, F.col("name"))) for n in names), F.lit(" "))
    return steps.groupBy("taxon").agg(at("superkingdom", "kingdom", "subkingdom").alias("kingdom"), *(at(r).alias(r) for r in RANKS[1:]))


def abundance(reads: DataFrame, taxon: str = "taxon") -> DataFrame:
    """taxon, n, percentage; reads without a taxon (0 or null) are taxon -1."""
    counts = reads.groupBy(F.coalesce(F.nullif(F.col(taxon), F.lit(0)), F.lit(-1)).cast("bigint").alias("taxon")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("taxon", "n", (100.0 * F.col("n") / F.col("total")).alias("percentage"))


def by_rank(samples: DataFrame, rank: str, names: list[str]) -> DataFrame:
    """A row for each value of ``rank``, a column of percentages for each sample; blanks are Unclassified. samples: sample, percentage and the rank's column."""
    value = F.when(F.trim(rank) == "", "Unclassified").otherwise(F.col(rank))
    return samples.groupBy(value.alias(rank)).pivot("sample", names).agg(F.sum("percentage")).fillna(0.0, subset=names)
