"""Sequence strings: composition, complements, k-mers, motifs. Column in, Column out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Nucleotide complements (IUPAC), and the standard genetic code in TCAG order.
PAIRS_FROM, PAIRS_TO = "ACGTURYKMBVDHacgturykmbvdh", "TGCAAYRMKVBHDtgcaayrmkvbhd"
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def count_of(seq: Column, letters: str) -> Column:
    """Characters of ``seq`` that are one of ``letters``."""
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def complement(seq: Column) -> Column:
    return F.translate(seq, PAIRS_FROM, PAIRS_TO)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def gc_content(seq: Column, others: str = "") -> Column:
    """Share of G and C (upper case) of the length without ``others``; null for an empty sequence."""
    return count_of(seq, "GC") / F.nullif(F.length(seq) - count_of(seq, others) if others else F.length(seq), F.lit(0))


def skew(seq: Column, a: str, b: str) -> Column:
    """(a - b) / (a + b), 0 where neither occurs."""
    x, y = count_of(seq, a), count_of(seq, b)
    return F.when(x + y == 0, 0.0).otherwise((x - y) / (x + y))


def entropy(seq: Column, letters: str = "ACGT") -> Column:
    """Shannon entropy, in nats, of the shares of ``letters`` among all characters."""
    n = F.nullif(F.length(seq), F.lit(0)).cast("double")
    terms = [F.when(count_of(seq, c) > 0, -(count_of(seq, c) / n) * F.log(count_of(seq, c) / n)).otherwise(0.0) for c in letters]
    return reduce(lambda x, y: x + y, terms)


def tm_wallace(seq: Column) -> Column:
    """Melting temperature of a short primer: 2 (A + T) + 4 (G + C)."""
    return 2 * count_of(seq, "AT") + 4 * count_of(seq, "GC")


def tm_salt_adjusted(seq: Column) -> Column:
    """Melting temperature of primers of more than 14 letters: 69.3 + 41 (G + C) / n - 650 / n; null for an empty sequence."""
    return 69.3 + (41.0 * count_of(seq, "GC") - 650.0) / F.nullif(F.length(seq), F.lit(0))


def restriction_sites(seq: Column, enzymes: dict[str, str]) -> Column:
    """Array of (enzyme, pos) of all recognition sites, overlaps included; letters are upper-cased, positions begin at 1."""
    def found(enzyme: str, site: str) -> Column:
        return F.transform(starts_of(F.upper(seq), site.upper()), lambda i: F.struct(F.lit(enzyme).alias("enzyme"), (i + 1).cast("bigint").alias("pos")))

    return F.concat(*(found(enzyme, site) for enzyme, site in enzymes.items()))


def translated(dna: Column, to_stop: bool = False) -> Column:
    """Protein of frame 0: X for codons with other letters, ``*`` for stops; with ``to_stop`` cut before the first stop. A rest under three letters is left."""
    codons = F.regexp_extract_all(F.upper(dna), F.lit("(?s)(...)"), 1)

    def letter(codon: Column) -> Column:
        x, y, z = (F.translate(F.substring(codon, k, 1), BASES, "0123") for k in (1, 2, 3))
        number = x.try_cast("int") * 16 + y.try_cast("int") * 4 + z.try_cast("int")
        return F.coalesce(F.substr(F.lit(AMINO_ACIDS), number + 1, F.lit(1)), F.lit("X"))

    protein = F.array_join(F.transform(codons, letter), "")
    return F.substring_index(protein, "*", 1) if to_stop else protein


def is_reverse_palindrome(seq: Column) -> Column:
    """Equal to its reverse complement."""
    return seq == reverse_complement(seq)


def kmers(seq: Column, k: int) -> Column:
    """All overlapping words of ``k`` letters, in order, in one linear scan; an empty array for shorter sequences."""
    return F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))"), 1)


def starts_of(seq: Column, motif: str) -> Column:
    """0-based starts of a plain motif, overlaps included."""
    return F.filter(F.transform(kmers(seq, len(motif)), lambda w, i: F.when(w == motif, i)), lambda i: i.isNotNull())


def windows_of(seq: Column, size: int, step: int) -> Column:
    """Array of (start, word) for full windows of ``size`` letters every ``step``, from chunks of ``step`` letters."""
    chunks = F.regexp_extract_all(seq, F.lit(f"(?s)(.{{1,{step}}})"), 1)
    covered = -(-size // step)

    def words(c: Column) -> Column:
        found = F.transform(c, lambda _, i: F.struct((i * step).alias("start"), F.substring(F.array_join(F.slice(c, i + 1, F.lit(covered)), ""), 1, size).alias("word")))
        return F.filter(found, lambda w: F.length(w["word"]) == size)

    return F.get(F.transform(F.array(chunks), words), F.lit(0))


def canonical_rotation(word: Column) -> Column:
    """The smallest rotation of a circular word; '' for ''."""
    turns = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda i: F.concat(F.substr(word, i, F.length(word)), F.substr(word, F.lit(1), i - 1)))
    return F.array_min(turns)


def runs_of_letters(seq: Column) -> Column:
    """Homopolymers, in order, as strings of one letter."""
    return F.regexp_extract_all(seq, F.lit("((.)\\2*)"), 1)


def cpg_ratio(seq: Column) -> Column:
    """Observed over expected CpG: CG * n / (C * G); null without C or G."""
    return (F.regexp_count(seq, F.lit("CG")) * F.length(seq)) / F.nullif(count_of(seq, "C") * count_of(seq, "G"), F.lit(0))


def linguistic_complexity(seq: Column, k: int) -> Column:
    """Distinct k-mers over the most there can be."""
    n = F.greatest(F.length(seq) - (k - 1), F.lit(0))
    return F.size(F.array_distinct(kmers(seq, k))) / F.nullif(F.least(n, F.lit(4**k)), F.lit(0))


def g4_scores(seq: Column) -> Column:
    """Per-letter quadruplex scores: each run of G counts its length, at most 4, for each of its letters, C runs the negative, others 0."""
    score = lambda run: F.when(F.startswith(run, F.lit("G")), F.least(F.length(run), F.lit(4))).when(F.startswith(run, F.lit("C")), -F.least(F.length(run), F.lit(4))).otherwise(0)
    return F.flatten(F.transform(runs_of_letters(seq), lambda run: F.array_repeat(score(run), F.length(run))))


def wrapped(seq: Column, width: int = 80) -> Column:
    """Lines of ``width`` letters, as in FASTA files."""
    return F.rtrim(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), F.lit("\n"))


def natural_key(name: Column) -> Column:
    """Sort key under which digit runs compare as numbers."""
    parts = F.regexp_extract_all(name, F.lit("(\\d+|\\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^\\d+$"), F.lpad(p, 20, "0")).otherwise(p)), "")


def motif_class(motif: str) -> str:
    """Regular expression of a motif in IUPAC letters."""
    # IUPAC nucleotide codes.
    codes = {"R": "[AG]", "Y": "[CT]", "S": "[CG]", "W": "[AT]", "K": "[GT]", "M": "[AC]", "B": "[CGT]", "D": "[AGT]", "H": "[ACT]", "V": "[ACG]", "N": "[ACGT]"}
    return "".join(codes.get(c, c) for c in motif.upper())
