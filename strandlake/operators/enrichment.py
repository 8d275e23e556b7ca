"""Over-representation: hypergeometric tails in logarithms, and Fisher's exact test."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, inf, lgamma

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def log_choose(n: int, k: int) -> float:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) if 0 <= k <= n else -inf


def hypergeometric_tail(overlap: int, size: int, drawn: int, total: int) -> float:
    """P(X >= overlap) when ``drawn`` of ``total`` are taken and ``size`` of them are marked. Terms after the largest fall fast; the sum stops where they no longer count."""
    if overlap <= 0:
        return 1.0
    whole, out = log_choose(total, drawn), 0.0
    for k in range(overlap, min(size, drawn) + 1):
        term = exp(log_choose(size, k) + log_choose(total - size, drawn - k) - whole)
        out += term
        if k * total > size * drawn and term < 1e-17 * out:
            break
    return min(1.0, out)


def fisher_exact(a: int, b: int, c: int, d: int, tail: str = "two-sided") -> float:
    """p-value of a 2 x 2 table: less, greater or two-sided (tables at most as likely)."""
    row, column, total = a + b, a + c, a + b + c + d
    whole = log_choose(total, row)
    weight = lambda k: log_choose(column, k) + log_choose(total - column, row - k) - whole
    every = range(max(0, row + column - total), min(row, column) + 1)
    if tail == "greater":
        return min(1.0, sum(exp(weight(k)) for k in every if k >= a))
    if tail == "less":
        return min(1.0, sum(exp(weight(k)) for k in every if k <= a))
    return min(1.0, sum(exp(weight(k)) for k in every if weight(k) <= weight(a) + 1e-7))


def over_representation(terms: DataFrame, hits: DataFrame, term: str, gene: str) -> DataFrame:
    """term, size, overlap, p (hypergeometric, upper tail) and odds (sample odds ratio) of each gene set, against all genes of ``terms``.

    The overlap is an aggregation over a join; only the few numbers of a term go to Python.
    """
    pairs = terms.select(term, gene).distinct()
    found = hits.select(gene).distinct().withColumn("__hit", F.lit(1))
    counts = pairs.join(found, gene, "left").groupBy(term).agg(F.count("*").alias("size"), F.count("__hit").alias("overlap"))
    universe = pairs.select(gene).distinct().join(found, gene, "left").agg(F.count("*").alias("total"), F.count("__hit").alias("drawn"))

    @F.pandas_udf("double")
    def tail(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([hypergeometric_tail(*map(int, x)) for x in zip(*part, strict=True)], dtype="float64")

    rows = counts.crossJoin(F.broadcast(universe))  # one row
    a, b, c = F.col("overlap"), F.col("size") - F.col("overlap"), F.col("drawn") - F.col("overlap")
    odds = (a * (F.col("total") - F.col("drawn") - b)) / F.nullif(b * c, F.lit(0))
    return rows.select(term, "size", "overlap", tail("overlap", "size", "drawn", "total").alias("p"), odds.alias("odds"))
