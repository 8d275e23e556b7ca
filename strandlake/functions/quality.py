"""Quality strings, error probabilities and coverage mathematics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def phred_values(quality: Column, offset: int = 33) -> Column:
    """Scores of a quality string."""
    return F.transform(F.split(quality, ""), lambda c: F.ascii(c) - offset)


def mean_quality(quality: Column, offset: int = 33) -> Column:
    """Mean score; null for an empty string."""
    total = F.aggregate(phred_values(quality, offset), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(F.length(quality) > 0, total / F.length(quality))


def error_probability(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10)


def phred(p: Column) -> Column:
    """-10 log10(p); null outside (0, 1]."""
    return F.when((p > 0) & (p <= 1), -10 * F.log10(p))


def solexa_from_phred(q: Column) -> Column:
    """Score by odds instead of probability."""
    return 10 * F.log10(F.pow(F.lit(10.0), q / 10) - 1)


def phred_from_solexa(q: Column) -> Column:
    return 10 * F.log10(F.pow(F.lit(10.0), q / 10) + 1)


def fold_coverage(reads: Column, length: Column, genome: Column) -> Column:
    """Lander and Waterman's coverage N L / G."""
    return reads * length / genome


def share_covered(coverage: Column) -> Column:
    """Expected share of bases covered at least once."""
    return 1 - F.exp(-coverage)


def expected_contigs(reads: Column, coverage: Column) -> Column:
    return reads * F.exp(-coverage)


def reads_for(coverage: float, length: Column, genome: Column) -> Column:
    return coverage * genome / length


def anscombe(x: Column) -> Column:
    """Variance-stabilising transform of a Poisson variable."""
    return 2 * F.sqrt(x + 3.0 / 8)


def inverse_anscombe(y: Column) -> Column:
    """Closed form near the exact unbiased inverse; null for 0."""
    y = F.nullif(y.cast("double"), F.lit(0.0))
    half = math.sqrt(1.5)
    return y * y / 4 + half / 4 / y - 11.0 / 8 / (y * y) + 5.0 / 8 * half / (y * y * y) - 1.0 / 8


def generalized_anscombe(x: Column, mean: float, sigma: float, gain: float = 1.0) -> Column:
    """For Poisson counts with Gaussian noise; 0 where the root's argument is negative."""
    inner = gain * x + gain * gain * 3.0 / 8 + sigma * sigma - gain * mean
    return 2.0 / gain * F.sqrt(F.greatest(inner, F.lit(0.0)))


def aic(log_likelihood: Column, k: Column) -> Column:
    return 2 * k - 2 * log_likelihood


def aicc(log_likelihood: Column, k: Column, n: Column) -> Column:
    """AIC corrected for small samples."""
    return aic(log_likelihood, k) + 2 * k * (k + 1) / (n - k - 1)


def bic(log_likelihood: Column, k: Column, n: Column) -> Column:
    """With ln n - ln 2 pi as the penalty's factor."""
    return -2 * log_likelihood + k * (F.log(n) - math.log(2 * math.pi))


def clamped_phred(p: Column, most: int = 93) -> Column:
    """-10 log10 of a probability held within 1e-90 and 1, at most ``most``."""
    return F.least(-10 * F.log10(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-90))), F.lit(float(most)))


def clamped_solexa(p: Column) -> Column:
    """-10 log10 of the odds, within -5 and 62; -5 from 1 on."""
    return F.when(p >= 1, -5.0).otherwise(F.least(F.greatest(-10 * F.log10(F.greatest(p, F.lit(1e-90)) / (1 - p)), F.lit(-5.0)), F.lit(62.0)))


def quality_string(scores: Column, offset: int = 33) -> Column:
    """String of an array of scores."""
    return F.array_join(F.transform(scores, lambda q: F.char(q + offset)), "")


def required_coverage(missing: float = 0.01) -> float:
    """Coverage that leaves the share ``missing`` of bases uncovered."""
    return math.log(1 / missing)


def mean_contig_length(coverage: Column, length: Column) -> Column:
    return (F.exp(coverage) - 1) * length / coverage


def mean_reads_per_contig(coverage: Column) -> Column:
    return F.exp(coverage)


def normal_density(x: Column, mu: float, sigma: float) -> Column:
    return F.exp(-((x - mu) * (x - mu)) / (2 * sigma * sigma)) / (sigma * math.sqrt(2 * math.pi))


def geometric_mean(a: Column, b: Column) -> Column:
    """Root of the product; 0 if either is 0."""
    return F.sqrt(a * b)
