"""Taxa as a forest, classified reads over samples and databases, and small models over samples."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.models import Mixture, fit_mixture
from strandlake.operators.tables import lineage


def with_ancestors(nodes: DataFrame, wanted: DataFrame, depth: int = 64, *, node: str = "id", parent: str = "parent") -> DataFrame:
    """Rows of ``nodes`` that are in the one column of ``wanted``, or above one that is."""
    paths = lineage(nodes, depth, node=node, parent=parent)
    kept = paths.join(wanted.toDF("id").distinct(), "id", "left_semi").select(F.explode("path").alias("__id")).distinct()
    return nodes.join(kept, F.col(node) == F.col("__id"), "left_semi")


def parents_of(nodes: DataFrame, wanted: DataFrame, *, node: str = "id", parent: str = "parent") -> DataFrame:
    """id and parent of the wanted nodes; null for a root, no row for an unknown one."""
    return nodes.select(F.col(node).alias("id"), F.col(parent).alias("parent")).join(wanted.toDF("id").distinct(), "id", "left_semi")


def rank_counts(nodes: DataFrame, rank: str = "rank") -> DataFrame:
    return nodes.where(F.col(rank).isNotNull()).groupBy(rank).agg(F.count("*").alias("n"))


def named_like(nodes: DataFrame, text: str, name: str = "name") -> DataFrame:
    """Nodes whose name contains ``text``, whatever its case."""
    return nodes.where(F.lower(name).contains(text.lower()))


def names_per_node(names: DataFrame, node: str = "id") -> DataFrame:
    """One row: the mean number of names of a node."""
    counts = names.groupBy(node).agg(F.count("*").alias("n"))
    return counts.agg(F.avg("n").alias("mean"))


def merged_counters(counters: list[DataFrame], label: str, count: str) -> DataFrame:
    """Sums of counts by label over several tables."""
    return reduce(DataFrame.unionByName, counters).groupBy(label).agg(F.sum(count).alias(count))


def first_classified(databases: list[DataFrame], read: str, taxon: str) -> DataFrame:
    """read, taxon and database (from 0): the first database of the sequence that knows a read; 0 and null where none does. One aggregation over all outputs, whatever their number."""
    rows = reduce(DataFrame.unionByName, [df.select(read, taxon, F.lit(k).alias("__k")) for k, df in enumerate(databases)])
    hit = F.when(F.coalesce(F.col(taxon), F.lit(0)) != 0, F.struct(F.col("__k").alias("k"), F.col(taxon).alias("t")))
    return rows.groupBy(read).agg(F.min(hit).alias("__h")).select(read, F.coalesce("__h.t", F.lit(0)).alias(taxon), F.col("__h.k").alias("database"))


def sample_summary(reads: DataFrame, sample: str, database: str, databases: list) -> DataFrame:
    """sample, nreads, unclassified and a percentage of its reads for each database, to two decimals."""
    n = F.count("*")
    shares = [F.round(100.0 * F.count_if(F.col(database) == d) / n, 2).alias(f"db_{d}") for d in databases]
    return reads.groupBy(sample).agg(n.alias("nreads"), F.round(100.0 * F.count_if(F.col(database).isNull()) / n, 2).alias("unclassified"), *shares)


def with_others(df: DataFrame, keys: list[str], label: str, count: str, least: float = 0.5) -> DataFrame:
    """keys, label, percentage of all counts; labels below ``least`` percent of the whole are folded into others."""
    sums = df.groupBy(*keys, label).agg(F.sum(count).alias("__n"))
    total = sums.agg(F.sum("__n").alias("__t"))  # one row
    shares = sums.crossJoin(F.broadcast(total)).withColumn("percentage", 100.0 * F.col("__n") / F.col("__t"))
    folded = F.when(F.col("percentage") >= least, F.col(label).cast("string")).otherwise("others")
    return shares.groupBy(*keys, folded.alias(label)).agg(F.sum("percentage").alias("percentage"))


def members_of_rank(nodes: DataFrame, rank: str) -> DataFrame:
    return nodes.where(F.col("rank") == rank)


def sample_products(counts: DataFrame, item: str, sample: str, value: str) -> DataFrame:
    """a, b and the sum over items of the products of both samples' centred values: what principal components of samples need. Items are centred on their mean over the samples that have them."""
    means = counts.groupBy(item).agg(F.avg(value).alias("__m"))
    rows = counts.join(means, item).select(item, F.col(sample).alias("s"), (F.col(value) - F.col("__m")).alias("x"))
    pairs = rows.select(item, F.col("s").alias("a"), F.col("x").alias("__x")).join(rows.select(item, F.col("s").alias("b"), F.col("x").alias("__y")), item)
    return pairs.where("a <= b").groupBy("a", "b").agg(F.sum(F.col("__x") * F.col("__y")).alias("product"))


def principal_components(products: DataFrame, n: int = 2) -> tuple[list, np.ndarray, np.ndarray]:
    """(samples, coordinates, share of the variance) from ``sample_products``: a matrix of a few dozen samples goes to the driver."""
    rows = products.collect()
    names = sorted({r["a"] for r in rows} | {r["b"] for r in rows})
    at = {name: k for k, name in enumerate(names)}
    matrix = np.zeros((len(names), len(names)))
    for r in rows:
        matrix[at[r["a"]], at[r["b"]]] = matrix[at[r["b"]], at[r["a"]]] = r["product"]
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values)
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    return names, vectors[:, :n] * np.sqrt(values[:n]), values[:n] / max(values.sum(), 1e-300)


def sample_distances(counts: DataFrame, item: str, sample: str, value: str, items: DataFrame | None = None) -> DataFrame:
    """a, b and the Euclidean distance of samples over items, an absent value being 0."""
    rows = counts if items is None else counts.join(items, item, "left_semi")
    squares = rows.groupBy(sample).agg(F.sum(F.col(value) * F.col(value)).alias("q"))
    x, y = rows.select(item, F.col(sample).alias("a"), F.col(value).alias("__x")), rows.select(item, F.col(sample).alias("b"), F.col(value).alias("__y"))
    dot = x.join(y, item).where("a < b").groupBy("a", "b").agg(F.sum(F.col("__x") * F.col("__y")).alias("p"))
    grid = squares.select(F.col(sample).alias("a"), F.col("q").alias("qa")).join(squares.select(F.col(sample).alias("b"), F.col("q").alias("qb")), F.col("a") < F.col("b"))
    return grid.join(dot, ["a", "b"], "left").select("a", "b", F.sqrt(F.greatest(F.col("qa") + F.col("qb") - 2 * F.coalesce("p", F.lit(0.0)), F.lit(0.0))).alias("distance"))


def clustered(distances: np.ndarray, method: str = "average") -> np.ndarray:
    """Agglomerative clustering of a distance matrix of a few dozen samples: rows (cluster, cluster, height, size), new clusters numbered on from the samples. Methods: single, complete, average, weighted; the first of equal pairs merges."""
    d = np.array(distances, dtype=float)
    np.fill_diagonal(d, np.inf)
    names, sizes, out = list(range(len(d))), [1] * len(d), []
    for step in range(len(d) - 1):
        i, j = sorted(divmod(int(d.argmin()), len(d)))
        out.append((*sorted((names[i], names[j])), d[i, j], sizes[i] + sizes[j]))
        weights = {"average": (sizes[i], sizes[j]), "weighted": (1, 1)}.get(method)
        row = (weights[0] * d[i] + weights[1] * d[j]) / sum(weights) if weights else np.minimum(d[i], d[j]) if method == "single" else np.maximum(d[i], d[j])
        d[i], d[:, i], d[i, i] = row, row, np.inf
        keep = [k for k in range(len(d)) if k != j]
        names[i], sizes[i] = len(distances) + step, sizes[i] + sizes[j]
        d, names, sizes = d[np.ix_(keep, keep)], [names[k] for k in keep], [sizes[k] for k in keep]
    return np.array(out)


def variance_pairs(df: DataFrame, group: str, value: str) -> DataFrame:
    """a, b and f of a one-way analysis of variance between each pair of groups, from their sums."""
    s = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    a, b = (s.select(*(F.col(c).alias(f"{c}_{k}") for c in ("n", "m", "v")), F.col(group).alias(k)) for k in ("a", "b"))
    rows = a.join(b, F.col("a") < F.col("b"))
    n, x, y = F.col("n_a") + F.col("n_b"), F.col("m_a"), F.col("m_b")
    between = F.col("n_a") * F.col("n_b") / n * (x - y) * (x - y)
    within = (F.col("n_a") * F.col("v_a") + F.col("n_b") * F.col("v_b")) / F.nullif(n - 2, F.lit(0))
    return rows.select("a", "b", (between / F.nullif(within, F.lit(0.0))).alias("f"))


def chosen_mixture(values: np.ndarray, least: int = 2, most: int = 5) -> Mixture:
    """The mixture, of ``least`` to ``most`` components, with the least Akaike criterion."""
    fits = [fit_mixture(values, k) for k in range(least, most + 1)]
    return min(fits, key=lambda m: 2 * (3 * len(m.means) - 1) - 2 * m.log_likelihood)


def main_depth(mixture: Mixture, reach: float = 1.2) -> float:
    """Mean of the heaviest component and of those near it (closer than ``reach`` times both deviations), by weight."""
    c = mixture.central
    near = [k for k in range(len(mixture.means)) if k == c or abs(mixture.means[k] - mixture.means[c]) < reach * (mixture.sigmas[k] + mixture.sigmas[c])]
    return sum(mixture.means[k] * mixture.weights[k] for k in near) / sum(mixture.weights[k] for k in near)


def ploidy(windows: DataFrame, keys: list[str], depth: str, diploid: float) -> DataFrame:
    """keys, median depth and somy: twice the median over the depth of two copies."""
    return windows.groupBy(*keys).agg(F.percentile(depth, F.lit(0.5)).alias("median")).withColumn("somy", 2 * F.col("median") / diploid)


def usual_positions(tags: DataFrame, keys: list[str], position: str, trim: float = 1e-3, z: float = 5.0) -> DataFrame:
    """Tags without those of positions that are over-represented: more often than the mean of the least frequent 1 - ``trim`` of the positions by z deviations."""
    counts = tags.groupBy(*keys, position).agg(F.count("*").alias("__n"))
    histogram = counts.groupBy("__n").agg(F.count("*").alias("__c"))
    up = Window.orderBy("__n").rowsBetween(Window.unboundedPreceding, -1)  # over distinct counts, which are few
    whole = Window.partitionBy(F.lit(1))
    kept = histogram.withColumns({"__before": F.coalesce(F.sum("__c").over(up), F.lit(0)), "__all": F.sum("__c").over(whole)})
    kept = kept.withColumn("__c", F.greatest(F.least(F.col("__c"), F.floor(F.col("__all") * (1 - trim)) - F.col("__before")), F.lit(0)))
    n, x = F.sum("__c"), F.sum(F.col("__c") * F.col("__n"))
    var = (F.sum(F.col("__c") * F.col("__n") * F.col("__n")) - x * x / n) / F.nullif(n - 1, F.lit(0))
    limit = kept.agg(F.greatest(F.lit(1.0), F.ceil(x / n + z * F.sqrt(F.coalesce(var, F.lit(0.0)) + 0.1))).alias("__limit"))  # one row
    usual = counts.crossJoin(F.broadcast(limit)).where(F.col("__n") <= F.col("__limit")).select(*keys, position)
    return tags.join(usual, [*keys, position], "left_semi")


def interpolated(x: Column, points: list[float], values: list[float]) -> Column:
    """Piecewise linear value at ``x``; the ends' values beyond them."""
    out = F.when(x <= points[0], values[0])
    for (a, b), (u, v) in zip(zip(points, points[1:]), zip(values, values[1:]), strict=True):
        out = out.when(x <= b, u + (x - a) * ((v - u) / (b - a)))
    return out.otherwise(values[-1])
