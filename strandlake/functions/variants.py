"""Variant records: allele balance and a small language of thresholds."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TERM = re.compile(r"\s*(<=|>=|==|!=|<|>)\s*(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)\s*")


def frequency(alternate: Column, depth: Column) -> Column:
    """Share of reads with the alternate; null without depth."""
    return alternate / F.nullif(depth, F.lit(0))


def strand_balance(forward: Column, reverse: Column) -> Column:
    """min / (forward + reverse): 0.5 is balanced; 0 without reads."""
    total = forward + reverse
    return F.when(total == 0, 0.0).otherwise(F.least(forward, reverse) / total)


def threshold(column: Column, text: str) -> Column:
    """``<10``, ``>=3``, ``>1&<5`` or ``<1|>9``: & binds closer than |. Other texts raise ValueError."""
    def term(part: str) -> Column:
        m = _TERM.fullmatch(part)
        if not m:
            raise ValueError(f"not a threshold: {part!r}")
        value = float(m[2])
        return {"<": column < value, "<=": column <= value, ">": column > value, ">=": column >= value, "==": column == value, "!=": column != value}[m[1]]

    out = None
    for alternative in text.split("|"):
        both = None
        for part in alternative.split("&"):
            both = term(part) if both is None else both & term(part)
        out = both if out is None else out | both
    return out


def kept(qual: Column, depth: Column, alternate: Column, forward: Column, reverse: Column, *, score: float, min_depth: float, min_forward: float, min_reverse: float, min_frequency: float, min_balance: float) -> Column:
    """The filter of single-sample call sets: a site stays with qual >= score, depth and strand counts above their limits, and frequency and balance at theirs or more."""
    return (qual >= score) & (depth > min_depth) & (forward > min_forward) & (reverse > min_reverse) & (frequency(alternate, depth) >= min_frequency) & (strand_balance(forward, reverse) >= min_balance)


def kind(ref: Column, alt: Column) -> Column:
    """snp, mnp, insertion or deletion, by lengths."""
    return F.when((F.length(ref) == 1) & (F.length(alt) == 1), "snp").when(F.length(ref) == F.length(alt), "mnp").when(F.length(ref) < F.length(alt), "insertion").otherwise("deletion")


def frequencies(alternates: Column, depth: Column) -> Column:
    """Share of each alternate of an array."""
    return F.transform(alternates, lambda x: frequency(x, depth))


def strand_balances(forward: Column, reverse: Column) -> Column:
    """Balance of each alternate; [0.5] where there is none."""
    return F.when(F.size(forward) > 0, F.zip_with(forward, reverse, strand_balance)).otherwise(F.array(F.lit(0.5)))


def valid_dp4(dp4: Column, least_depth: float, least_strand: float, least_ratio: float, polymorphic: Column) -> Column:
    """Reads of the called allele (the alternate at a ``polymorphic`` site) in (ref+, ref-, alt+, alt-): in all, on each strand, and their share of each strand's reads, which is 0 on a strand without reads. A site without counts passes."""
    def enough(strand: int) -> Column:
        called = F.when(polymorphic, dp4[2 + strand]).otherwise(dp4[strand])
        share = F.coalesce(called / F.nullif(dp4[strand] + dp4[2 + strand], F.lit(0)), F.lit(0.0))
        return (called >= least_strand) & (share >= least_ratio)

    depth = F.when(polymorphic, dp4[2] + dp4[3]).otherwise(dp4[0] + dp4[1])
    return dp4.isNull() | ((depth >= least_depth) & enough(0) & enough(1))


def valid_af1(af1: Column, polymorphic: Column, least: float = 0.95) -> Column:
    return F.when(polymorphic, af1 >= least).otherwise(af1 <= 1 - least)


def effect_fields(effect: Column) -> Column:
    """Struct of the parts of ``EFFECT(impact|class|codon|...|gene|...)``."""
    inner = F.split(F.regexp_extract(effect, "\\((.*)\\)", 1), "\\|")
    names = ["impact", "functional_class", "codon_change", "amino_acid_change", "amino_acid_length", "gene"]
    return F.struct(F.regexp_extract(effect, "^([^(]*)", 1).alias("effect"), *(F.get(inner, F.lit(k)).alias(n) for k, n in enumerate(names)))


def flattened(chrom: Column, pos: Column, ref: Column, alts: Column, depth: Column, qual: Column, alternates: Column, forward: Column, reverse: Column) -> Column:
    """Struct of a call as a report has it: chr, position, depth, reference, alternatives by semicolons, score, frequencies and strand balances of the alternates with three decimals, and kind by the first alternate."""
    three = lambda xs: F.array_join(F.transform(xs, lambda x: F.format_string("%.3f", x)), ";")
    return F.struct(chrom.alias("chr"), pos.alias("position"), depth.alias("depth"), ref.alias("reference"), F.array_join(alts, ";").alias("alternative"), qual.alias("score"), three(frequencies(alternates, depth)).alias("frequency"), three(strand_balances(forward, reverse)).alias("strand_balance"), kind(ref, F.get(alts, F.lit(0))).alias("type"))
