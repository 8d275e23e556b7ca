"""Structure of DNA words and windows: bendability, twist, flexibility, information, signatures, complexity."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.functions import sequence

# Flexibility of trinucleotides (Brukner), in the order of ACGT.
BENDABILITY = dict(zip((x + y + z for x in "ACGT" for y in "ACGT" for z in "ACGT"), (
    0.069, 0.055, 0.059, 0.063, 0.072, 0.054, 0.051, 0.058, 0.070, 0.056, 0.058, 0.064, 0.066, 0.053, 0.060, 0.065,
    0.073, 0.057, 0.061, 0.067, 0.070, 0.052, 0.050, 0.057, 0.069, 0.055, 0.056, 0.062, 0.065, 0.051, 0.059, 0.066,
    0.068, 0.054, 0.058, 0.064, 0.071, 0.053, 0.050, 0.057, 0.067, 0.055, 0.057, 0.063, 0.064, 0.052, 0.059, 0.065,
    0.067, 0.053, 0.060, 0.066, 0.069, 0.054, 0.052, 0.058, 0.068, 0.056, 0.059, 0.064, 0.065, 0.051, 0.060, 0.067,
), strict=True))
# Helix twist of dinucleotides, in degrees.
TWIST = {"AA": 36.0, "AC": 34.5, "AG": 36.6, "AT": 32.2, "CA": 35.6, "CC": 33.1, "CG": 30.0, "CT": 35.2, "GA": 35.7, "GC": 36.9, "GG": 32.8, "GT": 34.3, "TA": 34.0, "TC": 35.4, "TG": 36.1, "TT": 36.0}
# Flexibility angles of dinucleotides (Drew and Travers); N counts as the least of its partner.
ANGLES = {"AA": 7.6, "CA": 10.9, "AC": 14.6, "CC": 7.2, "AG": 8.2, "CG": 8.9, "AT": 25.0, "CT": 8.2, "GA": 8.8, "TA": 12.5, "GC": 11.1, "TC": 8.8, "GG": 7.2, "TG": 10.9, "GT": 14.6, "TT": 7.6, "CN": 7.2, "NC": 7.2, "GN": 7.2, "NG": 7.2, "NN": 7.2, "AN": 7.6, "NA": 7.6, "TN": 7.6, "NT": 7.6}
# Start and stop codons of bacteria, on the plus strand.
STARTS, STOPS = ("ATG", "TTG", "GTG"), ("TAG", "TGA", "TAA")


def scaled(seq: Column, scale: dict[str, float]) -> Column:
    """Array of the scale's value of each word of the sequence, in upper case; null where it has none."""
    width = len(next(iter(scale)))
    values = F.create_map(*(F.lit(x) for pair in scale.items() for x in pair))
    return F.transform(sequence.kmers(F.upper(seq), width), lambda w: F.try_element_at(values, w))


def bendability(seq: Column) -> Column:
    return scaled(seq, BENDABILITY)


def helix_twist(seq: Column) -> Column:
    return scaled(seq, TWIST)


def _means(x: np.ndarray, width: int) -> np.ndarray:
    """Sums of ``width`` neighbours."""
    total = np.concatenate(([0.0], np.cumsum(x)))
    return total[width:] - total[:-width] if len(x) >= width else np.empty(0)


def flexibility(window: int = 100):
    """A function of a sequence column: for each ``window`` dinucleotides, by their start, the sum of their angles over window - 1. Words with other letters count 0."""

    @F.pandas_udf("array<double>")
    def run(seqs: pd.Series) -> pd.Series:
        def one(s: str | None):
            if s is None:
                return None
            x = np.array([ANGLES.get(s[k : k + 2], 0.0) for k in range(len(s) - 1)])
            return _means(x, window) / (window - 1)

        return seqs.map(one)

    return run


def word_entropy(window: int = 500, width: int = 3):
    """A function of a sequence column: the entropy, in bits, of the overlapping words of ``width`` letters that begin in each window of ``window`` positions."""

    @F.pandas_udf("array<double>")
    def run(seqs: pd.Series) -> pd.Series:
        term = np.array([0.0] + [-(c / window) * np.log2(c / window) for c in range(1, window + 1)])

        def one(s: str | None):
            if s is None:
                return None
            words = [s[k : k + width] for k in range(len(s) - width + 1)]
            if len(words) < window:
                return np.empty(0)
            counts = Counter(words[:window])
            value = sum(term[c] for c in counts.values())
            out = [value]
            for old, new in zip(words, words[window:], strict=False):
                value -= term[counts[old]] + term[counts[new]] if old != new else 0.0
                counts[old] -= 1
                counts[new] += 1
                value += term[counts[old]] + term[counts[new]] if old != new else 0.0
                out.append(value)
            return np.array(out)

        return seqs.map(one)

    return run


def homopolymers(n: int, window: int = 100):
    """A function of a sequence column: runs of ``n`` equal letters of ACGT, not overlapping, in the window that begins at each position (shorter at the end)."""

    @F.pandas_udf("array<int>")
    def run(seqs: pd.Series) -> pd.Series:
        words = [c * n for c in "ACGT"]
        return seqs.map(lambda s: None if s is None else [sum(map(s[k : k + window].count, words)) for k in range(len(s))])

    return run


def signature_difference(window: int = 500):
    """A function of a sequence column: for each window, the sum over dinucleotides xy of |f(xy) / (f(x) f(y)) there less that of the whole sequence|, over 16. Words with other letters than ACGT don't count."""

    @F.pandas_udf("array<double>")
    def run(seqs: pd.Series) -> pd.Series:
        def one(s: str | None):
            if s is None or len(s) < window:
                return None if s is None else np.empty(0)
            single = {x: np.array([c == x for c in s], dtype=float) for x in "ACGT"}
            counts = {x: _means(single[x], window) / window for x in "ACGT"}
            whole = {x: single[x].mean() for x in "ACGT"}
            total = np.zeros(len(s) - window + 1)
            for x in "ACGT":
                for y in "ACGT":
                    pair = single[x][:-1] * single[y][1:]
                    here = _means(pair, window - 1) / (window - 1) / np.maximum(counts[x] * counts[y], 1e-9)
                    total += np.abs(here - pair.mean() / max(whole[x] * whole[y], 1e-9))
            return total / 16

        return seqs.map(one)

    return run


def quadruplex_windows(scores: Column, window: int = 20, least: float = 1.0) -> Column:
    """Starts of the windows of per-letter scores whose mean is at least ``least`` or at most its negative; one pass over the array."""

    @F.pandas_udf("array<int>")
    def run(found: pd.Series) -> pd.Series:
        return found.map(lambda x: None if x is None else np.flatnonzero(np.abs(_means(np.asarray(x, dtype=float), window) / window) >= least - 1e-12))

    return run(scores.cast("array<double>"))


def chained(starts: Column, window: int) -> Column:
    """(start, end, n) of runs of neighbouring window starts: where each follows the one before."""
    firsts = F.filter(F.transform(starts, lambda x, i: F.when((i == 0) | (x != F.get(starts, i - 1) + 1), F.struct(x.alias("at"), i.alias("i")))), lambda r: r.isNotNull())
    return F.transform(firsts, lambda r, k: F.struct(r["at"].alias("start"), (F.get(starts, F.coalesce(F.get(firsts, k + 1)["i"], F.size(starts)) - 1) + window).alias("end"), (F.coalesce(F.get(firsts, k + 1)["i"], F.size(starts)) - r["i"]).alias("n")))


def complexity(seqs: Column) -> Column:
    """New words of a scan that extends a word until it is new, over the length; null for empty sequences."""

    @F.pandas_udf("double")
    def run(found: pd.Series) -> pd.Series:
        def one(s: str | None):
            if not s:
                return None
            s, seen, n = s.upper(), set(), 1
            k, word = 1, s[0]
            while k < len(s):
                word += s[k]
                k += 1
                if word not in seen:
                    seen.add(word)
                    n += 1
                    word, k = s[k : k + 1], k + 1
            return n / len(s)

        return found.map(one)

    return run(seqs)


def most_pairs(seqs: Column) -> Column:
    """Negative of the greatest number of nested complementary pairs (A-U, A-T, G-C, G-U) of a sequence, by dynamic programming, quadratic in its length, so for short ones. 0 for an empty one."""

    @F.pandas_udf("int")
    def run(found: pd.Series) -> pd.Series:
        pairs = {"AU", "UA", "AT", "TA", "GC", "CG", "GU", "UG"}

        def one(s: str | None):
            if s is None:
                return None
            n = len(s)
            best = np.zeros((n + 1, n + 1), dtype=int)  # best[i, j]: of s[i:j]
            for size in range(2, n + 1):
                for i in range(n - size + 1):
                    j = i + size
                    best[i, j] = max(best[i + 1, j], best[i, j - 1], best[i + 1, j - 1] + 1 if s[i] + s[j - 1] in pairs else 0)
            return -int(best[0, n])

        return found.map(one)

    return run(seqs)


def nearest_codon(seq: Column, position: Column, codons: tuple[str, ...], strand: str = "+") -> Column:
    """(pos, codon) of the nearest of ``codons`` to a 0-based position; at equal distance the right one on the plus strand, the left one on the minus strand, where their reverse complements are sought. Null if there is none."""
    if strand == "-":
        codons = tuple("".join({"A": "T", "C": "G", "G": "C", "T": "A"}[c] for c in reversed(x)) for x in codons)
    side = 1 if strand == "+" else -1
    found = F.filter(F.transform(sequence.kmers(seq, 3), lambda w, i: F.struct(F.abs(i - position).alias("d"), (-side * F.signum(i - position)).alias("side"), i.alias("pos"), w.alias("codon"))), lambda x: x["codon"].isin(*codons))
    best = F.array_min(found)
    return F.when(best.isNotNull(), F.struct(best["pos"].alias("pos"), best["codon"].alias("codon")))


def is_valid(seq: Column, letters: str = "ACGTN") -> Column:
    """Whether a sequence has no other letters, in either case; an empty one is valid."""
    return F.length(F.translate(F.upper(seq), letters, "")) == 0


def reversed_sequence(seq: Column) -> Column:
    return F.reverse(seq)


def words_over(letters: str, length: int) -> Column:
    """Array of all words of ``length`` letters, the last letter changing first."""
    out = F.array(F.lit(""))
    alphabet = F.array(*map(F.lit, letters))
    for _ in range(length):
        out = F.flatten(F.transform(out, lambda w: F.transform(alphabet, lambda c: F.concat(w, c))))
    return out


def probe_lengths(length: Column, ranges: tuple[tuple[int, int, int, int], ...] = ((60, 40, 20, 10),)) -> Column:
    """(probe, space): the first, by falling probe and then space, with which probes and spaces fill a sequence exactly; each range (greatest probe, least less one, greatest space, least less one) is tried in turn. Null if none does."""
    tried = [F.struct(F.lit(p).alias("probe"), F.lit(s).alias("space")) for a, b, c, d in ranges for p in range(a, b, -1) for s in range(c, d, -1)]
    return F.get(F.filter(F.array(*tried), lambda x: F.pmod(length + x["space"], x["probe"] + x["space"]) == 0), F.lit(0))


#: Ranges of the widening search.
WIDENING = ((60, 40, 20, 10), (70, 40, 30, 10), (80, 40, 35, 10))


def simple_probe_lengths(length: Column) -> Column:
    """(probe, space) by length alone: 40 and 10 for 50 to 99 letters, else 50 and 15."""
    middle = (length >= 50) & (length < 100)
    return F.struct(F.when(middle, 40).otherwise(50).alias("probe"), F.when(middle, 10).otherwise(15).alias("space"))


def widening_probe_lengths(length: Column) -> Column:
    """(probe, space): of short sequences as the simple rule has them, of others by ever wider ranges."""
    return F.when(length < 100, simple_probe_lengths(length)).otherwise(probe_lengths(length, WIDENING))
