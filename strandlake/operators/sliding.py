"""Sliding windows along sequences, on exploded bases in blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.scans import bases
from strandlake.operators.tracks import framed_sums


def base_windows(df: DataFrame, name: str, sequence: str, half: int) -> DataFrame:
    """name, pos, base and, over ``half`` bases to both sides: gc, gc_skew, at_skew and entropy (bits). Edges use the bases there are."""
    counted = {c: (F.coalesce(F.col("base"), F.lit("")) == c).cast("int") for c in "ACGT"}
    rows = framed_sums(bases(df, name, sequence), name, "pos", half, {f"__{c}": v for c, v in counted.items()})
    n, total = {c: F.col(f"__{c}") for c in "ACGT"}, F.nullif(F.col("__n"), F.lit(0)).cast("double")
    skew = lambda a, b: F.when(n[a] + n[b] == 0, 0.0).otherwise((n[a] - n[b]) / (n[a] + n[b]))
    bits = [F.when(n[c] > 0, -(n[c] / total) * F.log2(n[c] / total)).otherwise(0.0) for c in "ACGT"]
    columns = {"gc": (n["G"] + n["C"]) / total, "gc_skew": skew("G", "C"), "at_skew": skew("A", "T"), "entropy": reduce(lambda x, y: x + y, bits)}
    return rows.withColumns(columns).drop("__n", *(f"__{c}" for c in "ACGT"))


def motif_windows(df: DataFrame, name: str, sequence: str, motifs: list[str], half: int) -> DataFrame:
    """name, pos, hits: starts of any of the equally long ``motifs`` around each position."""
    from strandlake.functions.sequence import kmers

    words = df.select(name, F.posexplode(kmers(F.col(sequence), len(motifs[0]))).alias("p", "w")).select(name, (F.col("p") + 1).alias("pos"), F.col("w").isin(motifs).cast("int").alias("hit"))
    return framed_sums(words, name, "pos", half, {"hits": F.col("hit")}).drop("hit", "__n")


def telomeric(df: DataFrame, name: str, sequence: str, motif: str, share: float) -> DataFrame:
    """name, forward, reverse, telomeric: the share of letters under the motif, and under its reverse complement; telomeric from ``share`` on."""
    from strandlake.functions.sequence import reverse_complement

    size = F.nullif(F.length(sequence), F.lit(0))
    back = df.sparkSession.range(1).select(reverse_complement(F.lit(motif)).alias("x")).first()["x"]
    under = lambda m: F.regexp_count(sequence, F.lit(m)) * len(motif) / size
    return df.select(name, under(motif).alias("forward"), under(back).alias("reverse")).withColumn("telomeric", F.coalesce(F.greatest("forward", "reverse") >= share, F.lit(False)))
