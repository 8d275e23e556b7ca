"""Scans of sequences that make rows: motifs with offsets, reading frames, runs, windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import sequence as seqs

# Start and stop codons of the standard code.
STARTS, STOPS = ("ATG",), ("TAA", "TAG", "TGA")
Z_DNA, I_MOTIF, GAPS = "(?:CG){6,}", "(?i)(?:C{3,}[ATGC]{1,7}){3,}C{3,}", "[Nn]+"


def regex_scan(df: DataFrame, name: str, sequence: str, pattern: str) -> DataFrame:
    """name, start, end (0-based, half open), match of each match of ``pattern``, left to right without overlap. Offsets aren't to be had from built-in functions, so Arrow batches go through Python's re."""
    compiled = re.compile(pattern)

    @F.pandas_udf("array<struct<start: bigint, end: bigint, match: string>>")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda s: [(m.start(), m.end(), m[0]) for m in compiled.finditer(s or "")])

    return df.select(name, F.explode(found(sequence)).alias("x")).select(name, "x.start", "x.end", "x.match")


def hairpins(df: DataFrame, name: str, sequence: str, size: int) -> DataFrame:
    """name, start, word of each word of ``size`` letters equal to its reverse complement."""
    words = df.select(name, F.posexplode(seqs.kmers(F.col(sequence), size)).alias("start", "word"))
    return words.where(seqs.is_reverse_palindrome(F.col("word")))


def frames(df: DataFrame, name: str, sequence: str, least: int) -> DataFrame:
    """name, strand, frame, start, end of stretches between stop codons (or the ends) of at least ``least`` letters, on the strand they are read from."""
    both = df.select(name, F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col(sequence).alias("s")), F.struct(F.lit("-").alias("strand"), seqs.reverse_complement(F.col(sequence)).alias("s")))).alias("x")).select(name, "x.strand", "x.s")
    shifted = both.select(name, "strand", F.explode(F.array(*(F.struct(F.lit(k).alias("frame"), F.substring("s", k + 1, 1 << 30).alias("s")) for k in range(3)))).alias("x")).select(name, "strand", "x.frame", "x.s")
    marks = F.transform(F.regexp_extract_all("s", F.lit("(?s)(...)"), 1), lambda c: F.when(c.isin(*STOPS), "*").otherwise("x"))
    pieces = F.split(F.array_join(marks, ""), "\\*")
    ends = F.aggregate(pieces, F.array().cast("array<struct<a:int,b:int>>"), lambda acc, p: F.concat(acc, F.array(F.struct((F.coalesce(F.try_element_at(acc, F.lit(-1))["b"] + 1, F.lit(0))).alias("a"), (F.coalesce(F.try_element_at(acc, F.lit(-1))["b"] + 1, F.lit(0)) + F.length(p)).alias("b")))))
    rows = shifted.select(name, "strand", "frame", F.explode(ends).alias("x"))
    return rows.select(name, "strand", "frame", (F.col("frame") + 3 * F.col("x.a")).alias("start"), (F.col("frame") + 3 * F.col("x.b")).alias("end")).where(F.col("end") - F.col("start") >= least)


def bases(df: DataFrame, name: str, sequence: str) -> DataFrame:
    """name, pos (from 1), base."""
    return df.select(name, F.posexplode(seqs.kmers(F.col(sequence), 1)).alias("p", "base")).select(name, (F.col("p") + 1).alias("pos"), "base")


def motif_density(df: DataFrame, name: str, sequence: str, motif: str, window: int) -> DataFrame:
    """name, window, hits: starts of ``motif`` (overlaps included) in each run of ``window`` letters."""
    starts = df.select(name, F.explode(seqs.starts_of(F.col(sequence), motif)).alias("at"))
    return starts.groupBy(name, F.floor(F.col("at") / window).alias("window")).agg(F.count("*").alias("hits"))


def z_curve(df: DataFrame, name: str, sequence: str) -> DataFrame:
    """name, pos, x, y, z: running differences of purine/pyrimidine, amino/keto and weak/strong letters."""
    w = Window.partitionBy(name).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    step = lambda letters: F.sum(F.when(F.col("base").isin(*letters), 1).otherwise(-1)).over(w)
    return bases(df, name, sequence).where(F.col("base").isin(*"ACGT")).select(name, "pos", step("AG").alias("x"), step("AC").alias("y"), step("AT").alias("z"))


def merged_starts(df: DataFrame, keys: list[str], start: str, size: int) -> DataFrame:
    """keys, start, end, n of runs of words of ``size`` letters that overlap or touch."""
    from strandlake.operators.intervals import merged

    return merged(df.withColumn("__end", F.col(start) + size), keys, start=start, end="__end")


def probes(df: DataFrame, name: str, sequence: str, length: int, gap: int) -> DataFrame:
    """name, strand, start, probe: tiles of ``length`` letters every ``length + gap``; those of the other strand begin half a step later."""
    step = length + gap
    plus = df.select(name, F.lit("+").alias("strand"), F.explode(seqs.windows_of(F.col(sequence), length, step)).alias("w")).select(name, "strand", "w.start", F.col("w.word").alias("probe"))
    half = F.substring(F.col(sequence), step // 2 + 1, 1 << 30)
    minus = df.select(name, F.lit("-").alias("strand"), F.explode(seqs.windows_of(half, length, step)).alias("w")).select(name, "strand", (F.col("w.start") + step // 2).alias("start"), seqs.reverse_complement(F.col("w.word")).alias("probe"))
    return plus.union(minus)


def with_variants(contigs: DataFrame, variants: DataFrame, name: str, sequence: str, *, pos: str = "pos", ref: str = "ref", alt: str = "alt") -> DataFrame:
    """name, sequence with the variants (1-based) put in, and shifts (pos, running change of length).

    Variants of a contig are an ordered array next to its sequence, folded from
    left to right; one that overlaps an earlier one, or whose reference doesn't
    match, is left out.
    """
    lists = variants.groupBy(name).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).cast("bigint").alias("pos"), F.col(ref).alias("ref"), F.col(alt).alias("alt")))).alias("__v"))
    rows = contigs.select(name, sequence).join(lists, name, "left")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for contig, s, found in zip(batch[name], batch[sequence], batch["__v"], strict=True):
                parts, at, shift, shifts = [], 0, 0, []
                for v in found if found is not None else []:
                    p = int(v["pos"]) - 1
                    if p < at or s[p : p + len(v["ref"])] != v["ref"]:
                        continue
                    parts += [s[at:p], v["alt"]]
                    at = p + len(v["ref"])
                    shift += len(v["alt"]) - len(v["ref"])
                    shifts.append((p + 1, shift))
                out.append((contig, "".join([*parts, s[at:]]), shifts))
            yield pd.DataFrame(out, columns=[name, sequence, "shifts"])

    return rows.mapInPandas(fold, f"{name} string, {sequence} string, shifts array<struct<pos: bigint, shift: bigint>>")
