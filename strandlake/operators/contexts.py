"""Start contexts: the letters around start codons, their frequencies, backgrounds, divergences and summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import sequence


def start_contexts(features: DataFrame, contigs: DataFrame, ident: Column, left: int = 100, right: int = 100) -> DataFrame:
    """chrom, id, strand, start, stop, codon, left and right letters of features (seqid, start, stop 1-based closed, strand), cut from ``contigs`` (seqid, sequence).

    On the minus strand, codon and letters are reverse complements, from the stop
    backwards. Features without all letters to both sides, and of other strands, go.
    """
    rows = features.join(contigs.select("seqid", F.upper("sequence").alias("__s")), "seqid")
    a, b, n = F.col("start").cast("int"), F.col("stop").cast("int"), F.length("__s")
    plus = F.struct(F.substr("__s", a, F.lit(3)).alias("codon"), F.substr("__s", a - left, F.lit(left)).alias("left"), F.substr("__s", a + 3, F.lit(right)).alias("right"))
    turned = lambda x: sequence.reverse_complement(x)
    minus = F.struct(turned(F.substr("__s", b - 2, F.lit(3))).alias("codon"), turned(F.substr("__s", b + 1, F.lit(left))).alias("left"), turned(F.substr("__s", b - 2 - right, F.lit(right))).alias("right"))
    inside = F.when(F.col("strand") == "+", (a - left >= 1) & (a + 2 + right <= n)).when(F.col("strand") == "-", (b + left <= n) & (b - 2 - right >= 1))
    cut = rows.where(F.coalesce(inside, F.lit(False))).withColumn("__x", F.when(F.col("strand") == "+", plus).otherwise(minus))
    return cut.select(F.col("seqid").alias("chrom"), ident.alias("id"), "strand", "start", "stop", "__x.codon", "__x.left", "__x.right")


def trimmed_contexts(contexts: DataFrame, left: int, right: int, codon: str | None = "ATG") -> DataFrame:
    """Contexts of one ``codon`` (or all) with ``left`` and ``right`` letters, their sequence and its share among all."""
    kept = contexts.where(F.col("codon") == codon) if codon else contexts
    rows = kept.withColumns({"left": F.right("left", F.lit(left)), "right": F.left("right", F.lit(right))}).withColumn("sequence", F.concat("left", "codon", "right"))
    counts = rows.groupBy("sequence").agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("__t"))  # one row
    return rows.join(counts.crossJoin(F.broadcast(total)).select("sequence", (F.col("__n") / F.col("__t")).alias("frequency")), "sequence")


def selected(contexts: DataFrame, strand: str | None = None, condition: Column | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Contexts of a strand, that meet a condition and whose id is in the one column of ``ids``."""
    out = contexts if strand is None else contexts.where(F.col("strand") == strand)
    out = out if condition is None else out.where(condition)
    return out if ids is None else out.join(ids.toDF("id").distinct(), "id", "left_semi")


def codon_share(contexts: DataFrame, codon: str = "ATG") -> DataFrame:
    """One row: the share of contexts with the codon; null without any."""
    return contexts.agg((F.count_if(F.col("codon") == codon) / F.nullif(F.count("*"), F.lit(0))).alias("share"))


def annotated_starts(features: DataFrame) -> DataFrame:
    """chrom and pos (1-based) of the first letter that is read of each feature."""
    return features.select(F.col("seqid").alias("chrom"), F.when(F.col("strand") == "-", F.col("stop") - 2).otherwise(F.col("start")).alias("pos")).distinct()


def genomic_contexts(contigs: DataFrame, annotated: DataFrame, codon: str, left: int, right: int) -> DataFrame:
    """chrom, pos, left, right of every occurrence of ``codon`` on the plus strand that is no annotated start and has all letters around it: the background to draw from."""
    s = F.upper("sequence")
    at = contigs.select(F.col("seqid").alias("chrom"), s.alias("__s"), F.explode(sequence.starts_of(s, codon)).alias("__i")).withColumn("pos", (F.col("__i") + 1).cast("bigint"))
    inside = at.where((F.col("__i") >= left) & (F.col("__i") + 3 + right <= F.length("__s"))).join(annotated, ["chrom", "pos"], "left_anti")
    return inside.select("chrom", "pos", F.substr("__s", (F.col("__i") - left + 1).cast("int"), F.lit(left)).alias("left"), F.substr("__s", (F.col("__i") + 4).cast("int"), F.lit(right)).alias("right"))


def drawn(df: DataFrame, key: Column, share: float, seed: int) -> DataFrame:
    """About ``share`` of the rows, chosen by a hash of ``key`` and the seed: the same rows whatever the partitions."""
    return df.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))


def uniform_background(ids: DataFrame, gc: float, length: int, seed: int) -> DataFrame:
    """id and a sequence of ``length`` independent letters with the given share of G and C, by hashes of the id (the one column) and the seed."""
    names = ids.toDF("id")

    def letter(k: Column) -> Column:
        u = F.pmod(F.xxhash64("id", F.lit(seed), k), F.lit(1 << 30)) / float(1 << 30)
        return F.when(u < (1 - gc) / 2, "A").when(u < 0.5, "C").when(u < (1 + gc) / 2, "G").otherwise("T")

    return names.select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), letter), "").alias("sequence"))


def shuffled(seq: Column, seed: int, *keys: Column) -> Column:
    """The letters of a sequence in an order drawn by hashes of the keys, the seed and the place."""
    cells = F.transform(F.split(seq, ""), lambda c, k: F.struct(F.xxhash64(F.lit(seed), *keys, k).alias("h"), k.alias("k"), c.alias("c")))
    return F.array_join(F.transform(F.array_sort(cells), lambda x: x["c"]), "")


def bootstrapped_divergence(frequencies: DataFrame, background: DataFrame, context: str, rounds: int = 500, size: int = 200, percent: float = 95.0, seed: int = 1) -> DataFrame:
    """position, mean, low and high of the divergence, in bits, from ``rounds`` samples of ``size`` background contexts, with replacement.

    The counts of letters by position decide a sample's, so it is drawn from those:
    one row a position goes to Python. frequencies: position, letter, share.
    """
    cells = background.select(F.posexplode(F.split(context, "")).alias("p", "letter")).where(F.col("letter").isin(*"ACGT"))
    table = cells.groupBy((F.col("p") + 1).alias("position")).pivot("letter", list("ACGT")).agg(F.count("letter")).fillna(0)
    own = frequencies.groupBy("position").pivot("letter", list("ACGT")).agg(F.sum("share")).fillna(0.0).toDF("position", "pA", "pC", "pG", "pT")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                rng = np.random.default_rng([seed, row.position])
                counts, p = np.array([row.A, row.C, row.G, row.T], dtype=float), np.array([row.pA, row.pC, row.pG, row.pT]) + 1e-12
                q = rng.multinomial(size, counts / counts.sum(), rounds) / size + 1e-12
                kl = (p * np.log2(p / q)).sum(axis=1)
                out.append((row.position, kl.mean(), *np.percentile(kl, [(100 - percent) / 2, 100 - (100 - percent) / 2])))
            yield pd.DataFrame(out, columns=["position", "mean", "low", "high"])

    return table.join(own, "position").mapInPandas(run, "position int, mean double, low double, high double")


def divergence_summary(kl: DataFrame, position: str = "position", value: str = "kl", width: int = 6) -> DataFrame:
    """One row: ksi (mean of the ``width`` positions before the start, which is 0), total (sum before the start), peak, its position (the least), concentration peak / total, iii root of peak * total, and power peak squared / total."""
    p, v = F.col(position), F.col(value)
    sums = kl.agg((F.sum(F.when((p < 0) & (p >= -width), v)) / width).alias("ksi"), F.sum(F.when(p < 0, v)).alias("total"), F.max(v).alias("peak"), F.min_by(p, F.struct(-v, p)).alias("peak_position"))
    peak, total = F.col("peak"), F.nullif(F.col("total"), F.lit(0.0))
    return sums.withColumns({"concentration": peak / total, "iii": F.sqrt(peak * F.col("total")), "power": peak * peak / total})


def information_content(frequencies: DataFrame) -> DataFrame:
    """position and bits: 2 less the entropy of its letters."""
    share = F.col("share")
    return frequencies.groupBy("position").agg((2 + F.sum(F.when(share > 0, share * F.log2(share)).otherwise(0.0))).alias("bits"))


def chi_squared(frequencies: DataFrame, gc: float) -> DataFrame:
    """position and chi2 of its letters' percentages against those that a share ``gc`` of G and C leads one to expect; three degrees of freedom."""
    cells = frequencies.groupBy("position").pivot("letter", list("ACGT")).agg(F.sum("share")).fillna(0.0)
    expected = {"A": 50 * (1 - gc), "C": 50 * gc, "G": 50 * gc, "T": 50 * (1 - gc)}
    total = sum(((100 * F.col(c) - e) * (100 * F.col(c) - e) / e for c, e in expected.items()), F.lit(0.0))
    return cells.select("position", total.alias("chi2"))


def consensus_letters(frequencies: DataFrame, mode: str = "majority", threshold: float = 0.25, relative: float = 0.8, strong: float = 0.6, majority: float = 0.5, info: float = 1.0) -> DataFrame:
    """position and letter by one of five rules.

    majority: the most frequent base if its share is at least ``majority``, else
    n. max_only: the most frequent base. threshold: the IUPAC letter of the bases with at
    least that share; relative: of those with that part of the greatest; both in
    lower case unless the greatest reaches ``strong``. information: as relative with 0.8, in
    upper case from ``info`` bits on. Of equal shares the base that comes first counts.
    """
    from strandlake.operators.models import IUPAC

    letters = F.create_map(*(F.lit(x) for pair in IUPAC.items() for x in pair))
    rows = frequencies.groupBy("position").agg(F.array_sort(F.collect_list(F.struct("letter", "share"))).alias("x"), F.max("share").alias("m"), F.min_by("letter", F.struct(-F.col("share"), F.col("letter"))).alias("top"), (2 + F.sum(F.when(F.col("share") > 0, F.col("share") * F.log2("share")).otherwise(0.0))).alias("bits"))

    def iupac(least: Column) -> Column:
        return letters[F.array_join(F.transform(F.filter("x", lambda c: c["share"] >= least), lambda c: c["letter"]), "")]

    m = F.col("m")
    rules = {
        "majority": F.when(m >= majority, F.col("top")).otherwise("n"),
        "max_only": F.col("top"),
        "threshold": F.when(m >= strong, iupac(F.lit(threshold))).otherwise(F.lower(iupac(F.lit(threshold)))),
        "relative": F.when(m >= strong, iupac(relative * m)).otherwise(F.lower(iupac(relative * m))),
        "information": F.when(F.col("bits") >= info, iupac(0.8 * m)).otherwise(F.lower(iupac(0.8 * m))),
    }
    if mode not in rules:
        raise ValueError(f"unknown mode {mode!r}")
    return rows.select("position", rules[mode].alias("letter"))


def all_consensus(frequencies: DataFrame) -> DataFrame:
    """mode and consensus of all five rules."""
    out = None
    for mode in ("majority", "threshold", "relative", "information", "max_only"):
        text = consensus_letters(frequencies, mode).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", F.coalesce("letter", F.lit("n")).alias("c")))), lambda x: x["c"]), "").alias("consensus"))
        row = text.select(F.lit(mode).alias("mode"), "consensus")
        out = row if out is None else out.union(row)
    return out


def kmers_by_strand(contexts: DataFrame, k: int) -> DataFrame:
    """kmer, plus, minus: k-mers of the letters before the start, by strand."""
    words = contexts.select("strand", F.explode(sequence.kmers(F.col("left"), k)).alias("kmer"))
    return words.groupBy("kmer").agg(F.count_if(F.col("strand") == "+").alias("plus"), F.count_if(F.col("strand") == "-").alias("minus"))


def holding(contexts: DataFrame, pattern: str) -> DataFrame:
    """Contexts with ``found``: whether the letters before the start match a regular expression."""
    return contexts.withColumn("found", F.col("left").rlike(pattern))


def gc_by_contig(contigs: DataFrame) -> DataFrame:
    return contigs.select(F.col("seqid").alias("chrom"), sequence.gc_content(F.upper("sequence")).alias("gc"))


def ranked_by(df: DataFrame, *order: Column) -> DataFrame:
    """The few rows of a report with their rank from 1."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
