"""Differential results over comparisons, count matrices as long rows, and tables of enriched terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total_table(results: DataFrame, comparisons: list[str], values: list[str], alpha: float = 0.05) -> DataFrame:
    """One row a gene: a column ``comparison_value`` for each, how many comparisons have padj < ``alpha`` and which (an array). results: comparison, gene, padj and the values."""
    cells = [F.max(F.when(F.col("comparison") == c, F.col(v))).alias(f"{c}_{v}") for c in comparisons for v in values]
    hit = F.when(F.col("padj") < alpha, F.col("comparison"))
    return results.where(F.col("comparison").isin(comparisons)).groupBy("gene").agg(*cells, F.count(hit).alias("n_significant"), F.array_sort(F.collect_set(hit)).alias("significant"))


def summary(results: DataFrame, alpha: float, least_fc: float) -> DataFrame:
    """comparison, up, down, all: genes with padj <= ``alpha`` and a fold change of at least ``least_fc``; a comparison without one has zeros."""
    good = (F.col("padj") <= alpha) & (F.abs("log2_fc") >= least_fc)
    return results.groupBy("comparison").agg(F.count_if(good & (F.col("log2_fc") > 0)).alias("up"), F.count_if(good & (F.col("log2_fc") < 0)).alias("down"), F.count_if(good).alias("all"))


def gene_lists(results: DataFrame, alpha: float, least_fc: float, most: int | None = None) -> DataFrame:
    """comparison, direction (up, down, all), rank and gene; with ``most``, the genes of greatest absolute fold change of each list."""
    good = results.where((F.col("padj") <= alpha) & (F.abs("log2_fc") >= least_fc))
    side = F.when(F.col("log2_fc") > 0, "up").when(F.col("log2_fc") < 0, "down")
    rows = good.select("comparison", "gene", "log2_fc", F.explode(F.array_compact(F.array(side, F.lit("all")))).alias("direction"))
    w = Window.partitionBy("comparison", "direction").orderBy(F.desc(F.abs("log2_fc")), "gene")
    ranked = rows.withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= most) if most else ranked


def compared(left: DataFrame, right: DataFrame, gene: str = "gene") -> DataFrame:
    """gene, place (common, first, second) of the genes of two lists; the values of both sides, null where a side hasn't the gene. Other columns get the suffixes _1 and _2."""
    a = left.select(gene, *(F.col(c).alias(f"{c}_1") for c in left.columns if c != gene), F.lit(True).alias("__a"))
    b = right.select(gene, *(F.col(c).alias(f"{c}_2") for c in right.columns if c != gene), F.lit(True).alias("__b"))
    return a.join(b, gene, "full").withColumn("place", F.when(F.col("__a") & F.col("__b"), "common").when(F.col("__a"), "first").otherwise("second")).drop("__a", "__b")


def with_names(df: DataFrame, annotation: DataFrame, gene: str, name: str) -> DataFrame:
    """``df`` with ``label``: the annotated name of its gene, or the gene itself. The greatest name counts where a gene has several."""
    names = annotation.groupBy(F.col(gene).alias("__g")).agg(F.max(name).alias("__n"))
    return df.join(names, F.col(gene) == F.col("__g"), "left").withColumn("label", F.coalesce("__n", F.col(gene).cast("string"))).drop("__g", "__n")


def last_of_each(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Distinct rows, of which each key keeps the last by ``order``."""
    columns = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__x")).select(key, *(F.col(f"__x.{c}") for c in columns))


def library_sizes(counts: DataFrame, genes: int | None = None) -> DataFrame:
    """sample, total, n_null and percentage_null of a count matrix in rows (gene, sample, n); genes without a row of a sample are null ones."""
    total = F.lit(genes) if genes is not None else None
    every = counts.agg(F.countDistinct("gene").alias("__genes"))  # one row
    found = counts.groupBy("sample").agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("__some")).crossJoin(F.broadcast(every))
    n = total if total is not None else F.col("__genes")
    return found.select("sample", "total", (n - F.col("__some")).alias("n_null"), (100.0 * (n - F.col("__some")) / F.nullif(n, F.lit(0))).alias("percentage_null"))


def most_expressed(counts: DataFrame, samples: int, most: int = 20) -> DataFrame:
    """rank, gene, mean: the genes with the greatest mean count over ``samples``."""
    means = counts.groupBy("gene").agg((F.sum("n") / samples).alias("mean")).orderBy(F.desc("mean"), "gene").limit(most)
    return means.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean"), "gene")))  # of the few rows of a report


def most_present(counts: DataFrame) -> DataFrame:
    """sample, gene, percentage: the gene that makes up most of each sample's reads; the least gene of equal ones."""
    total = counts.groupBy("sample").agg(F.sum("n").alias("__t"), F.max(F.struct(F.col("n"), (-F.col("gene")).alias("g"))).alias("__x"))
    return total.select("sample", (-F.col("__x.g")).alias("gene"), (100.0 * F.col("__x.n") / F.nullif(F.col("__t"), F.lit(0))).alias("percentage"))


def centred(counts: DataFrame, value: Column, genes: DataFrame) -> DataFrame:
    """gene, sample and the value less its gene's mean over samples, for the ``genes`` of a table."""
    rows = counts.join(genes.select("gene").distinct(), "gene", "left_semi").withColumn("__v", value)
    means = rows.groupBy("gene").agg(F.avg("__v").alias("__m"))
    return rows.join(means, "gene").select("gene", "sample", (F.col("__v") - F.col("__m")).alias("centred"))


def most_variable(counts: DataFrame, most: int) -> DataFrame:
    """Genes with the greatest standard deviation over samples: rank, gene, std."""
    found = counts.groupBy("gene").agg(F.stddev_samp("n").alias("std")).where("std is not null").orderBy(F.desc("std"), "gene").limit(most)
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("std"), "gene")))  # of the few rows kept


def conditions(samples: DataFrame, label: str = "label") -> DataFrame:
    """label and condition: the longest common start of the labels with the same first letter, without underscores at its end; a lone label is its own condition."""
    first = F.left(label, F.lit(1))
    ends = samples.groupBy(first.alias("__f")).agg(F.min(label).alias("a"), F.max(label).alias("b"))
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length("a"), F.lit(1))), lambda k: F.substr("a", F.lit(1), k) == F.substr("b", F.lit(1), k)))
    starts = ends.select("__f", F.rtrim(F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.substr("a", F.lit(1), same)), F.lit("_")).alias("condition"))
    return samples.join(starts, first == F.col("__f")).select(label, "condition")


def consensus_strand(samples: DataFrame, strand: str) -> DataFrame:
    """One row: the most frequent strand over samples, the least of equal ones; ``undecided`` without any."""
    counts = samples.where(F.col(strand).isNotNull()).groupBy(strand).agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.min_by(strand, F.struct(-F.col("n"), F.col(strand))), F.lit("undecided")).alias("strand"))


def adjusted_terms(terms: DataFrame, alpha: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Terms with their Bonferroni-free step-up p-values (see ``tables.benjamini_hochberg``) as ``padj``, a score -log10 and whether it is significant."""
    from strandlake.operators.tables import benjamini_hochberg

    found = benjamini_hochberg(terms, list(keys), "p")
    return found.withColumns({"score": -F.log10(F.greatest("padj", F.lit(1e-300))), "significant": F.col("padj") <= alpha})


def term_report(terms: DataFrame, fdr: float, roots: list[str], most: int) -> DataFrame:
    """The ``most`` terms of greatest fold enrichment (-log10 p) with padj <= ``fdr``, without the ``roots``: rank, term, fold_enrichment and its log2."""
    fold = -F.log10(F.greatest("p", F.lit(1e-300)))
    kept = terms.where((F.col("padj") <= fdr) & ~F.col("term").isin(roots)).select("term", fold.alias("fold_enrichment")).where("fold_enrichment > 0")
    top = kept.orderBy(F.desc("fold_enrichment"), "term").limit(most)
    return top.select(F.row_number().over(Window.orderBy(F.desc("fold_enrichment"), "term")).alias("rank"), "term", "fold_enrichment", F.log2("fold_enrichment").alias("log2_fold_enrichment"))  # of the few rows kept


def members_by_term(annotation: DataFrame, gene: str, terms: str, pattern: str = ";\\s*") -> DataFrame:
    """term and gene from lists of terms as text; blanks go."""
    return annotation.select(F.explode(F.split(terms, pattern)).alias("term"), gene).select(F.trim("term").alias("term"), gene).where("term != ''").distinct()


def pathway_members(pathways: DataFrame, results: DataFrame, alpha: float = 0.05) -> DataFrame:
    """term, gene, type (+, - or =), padj score and fold change of the genes of pathways; names meet in lower case, genes without a significant result are =."""
    own = results.select(F.lower("gene").alias("__g"), "log2_fc", "padj")
    rows = pathways.join(own, F.lower("gene") == F.col("__g"), "left").drop("__g")
    good = F.coalesce(F.col("padj") <= alpha, F.lit(False))
    return rows.select("term", "gene", F.when(good & (F.col("log2_fc") > 0), "+").when(good & (F.col("log2_fc") < 0), "-").otherwise("=").alias("type"), (-F.log10("padj")).alias("score"), "log2_fc")


def terms_of(pathways: DataFrame, gene: str) -> DataFrame:
    """Terms whose members include ``gene``, whatever its case."""
    return pathways.where(F.lower("gene") == gene.lower()).select("term").distinct()


def ontology_counts(terms: DataFrame, members: DataFrame, hits: DataFrame) -> DataFrame:
    """term, ontology, number_in_reference, number_in_list, expected and fold: members: term, gene; hits: gene."""
    found = hits.select("gene").distinct().withColumn("__hit", F.lit(1))
    pairs = members.select("term", "gene").distinct()
    totals = pairs.select("gene").distinct().join(found, "gene", "left").agg(F.count("*").alias("__all"), F.count("__hit").alias("__list"))  # one row
    counts = pairs.join(found, "gene", "left").groupBy("term").agg(F.count("*").alias("number_in_reference"), F.count("__hit").alias("number_in_list"))
    rows = terms.join(counts, "term").crossJoin(F.broadcast(totals)).withColumn("expected", F.col("number_in_reference") * F.col("__list") / F.col("__all"))
    return rows.withColumn("fold", F.col("number_in_list") / F.nullif(F.col("expected"), F.lit(0.0))).drop("__all", "__list")
