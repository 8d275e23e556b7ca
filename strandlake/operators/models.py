"""Models: Gaussian mixtures, strand cross-correlation, divergence of letter distributions, analysis of variance."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values that a mixture is fitted on, at most: a bounded sample with a fixed seed.
SAMPLE = 100_000


@dataclass(frozen=True)
class Mixture:
    means: tuple[float, ...]
    sigmas: tuple[float, ...]
    weights: tuple[float, ...]
    log_likelihood: float

    @property
    def central(self) -> int:
        """The heaviest component."""
        return max(range(len(self.weights)), key=self.weights.__getitem__)


def fit_mixture(x: np.ndarray, k: int = 2, steps: int = 100) -> Mixture:
    """Expectation maximisation from evenly spaced means, one deviation for all and equal weights; a fixed number of steps, so the result is reproducible."""
    low, span = float(x.min()), float(x.max() - x.min())
    mu = low + span * np.arange(1, k + 1) / (k + 1)
    sigma = np.full(k, max(span / (k + 1) / 2, 1e-12))
    pi = np.full(k, 1 / k)

    def densities() -> np.ndarray:
        return pi[:, None] * np.exp(-((x[None, :] - mu[:, None]) ** 2) / (2 * sigma[:, None] ** 2)) / (sigma[:, None] * math.sqrt(2 * math.pi))

    for _ in range(steps):
        p = densities()
        share = p / np.maximum(p.sum(axis=0), 1e-300)
        total = np.maximum(share.sum(axis=1), 1e-12)
        mu = (share * x).sum(axis=1) / total
        sigma = np.maximum(np.sqrt((share * (x[None, :] - mu[:, None]) ** 2).sum(axis=1) / total), 1e-12)
        pi = total / len(x)
    return Mixture(tuple(mu.tolist()), tuple(sigma.tolist()), tuple(pi.tolist()), float(np.log(np.maximum(densities().sum(axis=0), 1e-300)).sum()))


def mixture_of(df: DataFrame, value: str, k: int = 2, *, seed: int = 1, limit: int = SAMPLE) -> Mixture | None:
    """Mixture of the non-null values of a column, null if there is none. Of more than ``limit`` values a sample is fitted."""
    known = df.select(F.col(value).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    n = known.count()
    if n > limit:
        known = known.sample(limit / n, seed)
    x = np.array([r["x"] for r in known.limit(2 * limit).collect()])
    return fit_mixture(x, k) if len(x) else None


def fitted_zscores(df: DataFrame, scale: str, *, most: float = 4.0, k: int = 2, seed: int = 1) -> DataFrame:
    """zscore of ``scale`` under the heaviest component of a mixture fitted on values in (0, most]; 0 for null or without a fit."""
    model = mixture_of(df.where((F.col(scale) > 0) & (F.col(scale) <= most)), scale, k, seed=seed)
    if model is None or not model.sigmas[model.central]:
        return df.withColumn("zscore", F.lit(0.0))
    return df.withColumn("zscore", F.coalesce((F.col(scale) - model.means[model.central]) / model.sigmas[model.central], F.lit(0.0)))


def cross_correlation(tags: DataFrame, chrom: str, position: str, strand: str, shifts: list[int], bin_width: int, lengths: DataFrame) -> DataFrame:
    """chrom, shift, correlation of the binned counts of + tags with those of - tags ``shift`` bins ahead.

    Over all bins of a contig, the empty ones included: sums of products come from
    a join of occupied bins, the rest from totals. ``lengths``: chrom, bins.
    """
    counts = tags.groupBy(chrom, strand, F.floor(F.col(position) / bin_width).alias("b")).agg(F.count("*").alias("c"))
    plus, minus = counts.where(F.col(strand) == "+"), counts.where(F.col(strand) == "-")
    moments = lambda d, p: d.groupBy(chrom).agg(F.sum("c").alias(f"{p}1"), F.sum(F.col("c") * F.col("c")).alias(f"{p}2"))
    moved = minus.select(chrom, F.col("c").alias("d"), F.explode(F.array(*(F.struct(F.lit(s).alias("shift"), (F.col("b") - s).alias("b")) for s in shifts))).alias("x")).select(chrom, "d", "x.shift", "x.b")
    products = plus.select(chrom, "b", "c").join(moved, [chrom, "b"]).groupBy(chrom, "shift").agg(F.sum(F.col("c") * F.col("d")).alias("xy"))
    grid = lengths.select(chrom, "bins", F.explode(F.array(*(F.lit(s) for s in shifts))).alias("shift"))
    joined = grid.join(moments(plus, "p"), chrom).join(moments(minus, "m"), chrom).join(products, [chrom, "shift"], "left")
    n = F.col("bins")
    top = F.coalesce("xy", F.lit(0)) / n - F.col("p1") / n * F.col("m1") / n
    bottom = F.sqrt((F.col("p2") / n - F.pow(F.col("p1") / n, 2)) * (F.col("m2") / n - F.pow(F.col("m1") / n, 2)))
    return joined.select(chrom, "shift", (top / F.nullif(bottom, F.lit(0.0))).alias("correlation"))


def position_frequencies(df: DataFrame, context: str, letters: str = "ACGT") -> DataFrame:
    """position (from 1), letter, n, share: the letters at each place of equally long strings."""
    cells = df.select(F.posexplode(F.split(context, "")).alias("p", "letter")).where(F.col("letter").isin(*letters))
    counts = cells.groupBy((F.col("p") + 1).alias("position"), "letter").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("position")))


def divergence(p: DataFrame, q: DataFrame, keys: list[str]) -> DataFrame:
    """keys without the last, kl: sum of p log2(p / q), absent shares as 1e-12."""
    tiny = F.lit(1e-12)
    both = p.select(*keys, F.col("share").alias("p")).join(q.select(*keys, F.col("share").alias("q")), keys, "full")
    a, b = F.coalesce("p", F.lit(0.0)) + tiny, F.coalesce("q", F.lit(0.0)) + tiny
    return both.groupBy(*keys[:-1]).agg(F.sum(a * F.log2(a / b)).alias("kl"))


# IUPAC letters by the bases that they stand for.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "AG": "R", "CT": "Y", "CG": "S", "AT": "W", "GT": "K", "AC": "M", "CGT": "B", "AGT": "D", "ACT": "H", "ACG": "V", "ACGT": "N"}


def consensus(frequencies: DataFrame, least: float = 0.25) -> Column:
    """One row: the IUPAC letters of all bases with at least ``least`` at each position, in order."""
    kept = frequencies.where(F.col("share") >= least).groupBy("position").agg(F.array_join(F.array_sort(F.collect_set("letter")), "").alias("set"))
    table = F.create_map(*(F.lit(x) for pair in IUPAC.items() for x in pair))
    return kept.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", table[F.col("set")].alias("x")))), lambda r: r["x"]), "").alias("consensus"))


def analysis_of_variance(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """keys, f, df_between, df_within of a one-way analysis, from sums per group."""
    sums = df.where(F.col(value).isNotNull()).groupBy(*keys, group).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    total = sums.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.count("*").alias("__k"))
    between = F.col("b") - F.col("s") * F.col("s") / F.col("n")
    within = F.col("ss") - F.col("b")
    a, b = F.col("__k") - 1, F.col("n") - F.col("__k")
    return total.select(*keys, ((between / a) / F.nullif(within / b, F.lit(0.0))).alias("f"), a.alias("df_between"), b.alias("df_within"))


def metropolis(bins: np.ndarray, weights: np.ndarray, n: int, burn: int, step: float, seed: int) -> np.ndarray:
    """Metropolis-Hastings sample from an empirical histogram: a chain is sequential, so it runs where it is called."""
    rng = np.random.default_rng(seed)
    density = np.asarray(weights, dtype=float) / np.sum(weights)
    at = lambda x: density[min(max(np.searchsorted(bins, x, side="right") - 1, 0), len(density) - 1)] if bins[0] <= x < bins[-1] else 0.0
    x = float(bins[int(density.argmax())])
    out = []
    for k in range(n + burn):
        y = x + rng.normal(0, step)
        if rng.random() * max(at(x), 1e-300) < at(y):
            x = y
        if k >= burn:
            out.append(x)
    return np.array(out)
