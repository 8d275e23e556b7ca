"""Alignment records: CIGAR strings and flag bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# SAM flag bits.
FLAGS = {"paired": 1, "proper_pair": 2, "unmapped": 4, "mate_unmapped": 8, "reverse": 16, "mate_reverse": 32, "first": 64, "second": 128, "secondary": 256, "qc_fail": 512, "duplicate": 1024, "supplementary": 2048}
QUERY_OPS, REFERENCE_OPS = "MIS=X", "MDN=X"


def cigar_ops(cigar: Column) -> Column:
    """Array of (len, op)."""
    return F.transform(F.regexp_extract_all(cigar, F.lit("(\\d+[MIDNSHP=X])"), 1), lambda x: F.struct(F.regexp_extract(x, "(\\d+)", 1).cast("int").alias("len"), F.right(x, F.lit(1)).alias("op")))


def cigar_length(cigar: Column, ops: str) -> Column:
    """Sum of the lengths of ``ops``."""
    found = F.regexp_extract_all(cigar, F.lit(f"(\\d+)[{ops}]"), 1)
    return F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def query_length(cigar: Column) -> Column:
    return cigar_length(cigar, QUERY_OPS)


def reference_length(cigar: Column) -> Column:
    return cigar_length(cigar, REFERENCE_OPS)


def clipped(cigar: Column) -> Column:
    return cigar_length(cigar, "SH")


def cigar_is_valid(cigar: Column) -> Column:
    return cigar.rlike("^(\\d+[MIDNSHP=X])+$")


def compressed(cigar: Column) -> Column:
    """Neighbouring equal operations merged."""
    step = lambda a, x: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["op"] == x["op"]), F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct((F.try_element_at(a, F.lit(-1))["len"] + x["len"]).alias("len"), x["op"].alias("op"))))).otherwise(F.concat(a, F.array(F.struct(x["len"].alias("len"), x["op"].alias("op")))))
    merged = F.aggregate(cigar_ops(cigar), F.array().cast("array<struct<len:int,op:string>>"), step)
    return F.array_join(F.transform(merged, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")


def has_flag(flag: Column, name: str) -> Column:
    return flag.bitwiseAND(FLAGS[name]) != 0


def blocks(start: Column, cigar: Column, op: str, advance: str = REFERENCE_OPS) -> Column:
    """(start, end), half open, of each ``op``, from ``start`` on; only the operations of ``advance`` move on."""
    step = lambda a, x: F.struct((a["at"] + F.when(F.lit(advance).contains(x["op"]), x["len"]).otherwise(0)).alias("at"), F.when(x["op"] == op, F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), (a["at"] + x["len"]).alias("end"))))).otherwise(a["out"]).alias("out"))
    zero = F.struct(start.cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))
    return F.aggregate(cigar_ops(cigar), zero, step)["out"]


def exons(start: Column, cigar: Column) -> Column:
    """Blocks of M; D, N and S move on as well."""
    return blocks(start, cigar, "M", "MDNS")


def clips(start: Column, cigar: Column) -> Column:
    """Blocks of S; M, D and N move on as well."""
    return blocks(start, cigar, "S", "MDNS")


def deletions(start: Column, cigar: Column) -> Column:
    """Blocks of D, behind what M, N and S moved on."""
    return blocks(start, cigar, "D", "MDNS")


def insertions(start: Column, cigar: Column) -> Column:
    """(start, size) of each I; it takes no place itself."""
    return F.transform(blocks(start, cigar, "I", "MDNS"), lambda x: F.struct(x["start"].alias("start"), (x["end"] - x["start"]).alias("size")))


def expanded(cigar: Column) -> Column:
    """One letter an operation's base: 2M1I is MMI."""
    return F.array_join(F.transform(cigar_ops(cigar), lambda x: F.repeat(x["op"], x["len"])), "")


def op_total(cigar: Column, op: str) -> Column:
    return cigar_length(cigar, op)


def cs_totals(cs: Column) -> Column:
    """Struct M, I, D, S of a cs tag (``:6*ag+gt-c``): matching, inserted and deleted bases, and substitutions."""
    letters = lambda sign: F.aggregate(F.regexp_extract_all(cs, F.lit(f"\\{sign}([a-z]+)"), 1), F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    matches = F.aggregate(F.regexp_extract_all(cs, F.lit(":(\\d+)"), 1), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return F.struct(matches.alias("M"), letters("+").alias("I"), letters("-").alias("D"), F.regexp_count(cs, F.lit("\\*[a-z]{2}")).cast("long").alias("S"))


def concordance(matches: Column, insertions: Column, deletions: Column, substitutions: Column) -> Column:
    """1 - (I + D + S) / (M + I + D + S); null without a base."""
    errors = insertions + deletions + substitutions
    return 1 - errors / F.nullif(matches + errors, F.lit(0))


def concordance_of_edits(cigar: Column, edits: Column) -> Column:
    """Concordance from a CIGAR string and the NM tag, whose edits beyond I and D are substitutions among the M."""
    i, d = op_total(cigar, "I"), op_total(cigar, "D")
    return concordance(op_total(cigar, "M"), i, d, edits - i - d)


def query_start(flag: Column, cigar: Column) -> Column:
    """Clipped bases before the alignment on the read's own strand."""
    lead, tail = (F.coalesce(F.regexp_extract(cigar, p, 1).try_cast("long"), F.lit(0)) for p in ("^(\\d+)[SH]", "(\\d+)[SH]$"))
    return F.when(has_flag(flag, "reverse"), tail).otherwise(lead)


def query_end(flag: Column, cigar: Column) -> Column:
    """Length of the read less the clipped bases behind the alignment on its own strand."""
    lead, tail = (F.coalesce(F.regexp_extract(cigar, p, 1).try_cast("long"), F.lit(0)) for p in ("^(\\d+)[SH]", "(\\d+)[SH]$"))
    return query_length(cigar) + cigar_length(cigar, "H") - F.when(has_flag(flag, "reverse"), lead).otherwise(tail)


def flag_meanings(flag: Column) -> Column:
    """Names of the bits that are set, least first."""
    return F.filter(F.array(*(F.when(has_flag(flag, name), F.lit(name)) for name in FLAGS)), lambda x: x.isNotNull())


def read_frame(df: DataFrame) -> DataFrame:
    """flag, rstart, rend, mapqs, rname, qname, qlen, qalen of alignments with SAM columns; positions are 0-based, half open."""
    start = F.col("pos") - 1
    return df.select("flag", start.alias("rstart"), (start + reference_length(F.col("cigar"))).alias("rend"), F.col("mapq").alias("mapqs"), "rname", "qname", query_length(F.col("cigar")).alias("qlen"), cigar_length(F.col("cigar"), "MI=X").alias("qalen"))


def introns(start: Column, cigar: Column) -> Column:
    """(start, end) on the reference of each N operation, half open."""
    return blocks(start, cigar, "N")
