"""Alignments: SAM text and BAM."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.sources.files import Range, RecordSource, fields, lines, opened, typed

COLUMNS = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
NUMBERS = {"flag": "int", "pos": "bigint", "mapq": "int", "pnext": "bigint", "tlen": "int"}


def sam(spark: SparkSession, path: str) -> DataFrame:
    """The eleven mandatory columns and tags (name -> value, without types). ``*`` stays."""
    rows = lines(spark, path).where(~F.col("value").startswith("@") & (F.col("value") != ""))
    rest = F.slice(F.split("value", "\t"), 12, 1 << 20)
    tags = F.map_from_entries(F.transform(rest, lambda x: F.struct(F.substring(x, 1, 2), F.substring(x, 6, 1 << 30))))
    return typed(fields(rows.withColumn("tags", tags), COLUMNS), NUMBERS).select(*COLUMNS, "tags")


class BamSource(RecordSource):
    """Alignments of BAM files, one partition a file."""

    short, splits = "bam", False
    columns = "qname string, flag int, rname string, pos bigint, mapq int, cigar string, rnext string, pnext bigint, tlen int, seq string, qual string"

    @staticmethod
    def records(part: Range, options: dict) -> Iterator[tuple]:
        with opened(part.path) as stream:
            if stream.read(4) != b"BAM\x01":
                raise ValueError(f"not a BAM file: {part.path}")
            stream.read(*struct.unpack("<i", stream.read(4)))
            names = []
            for _ in range(*struct.unpack("<i", stream.read(4))):
                names.append(stream.read(*struct.unpack("<i", stream.read(4)))[:-1].decode())
                stream.read(4)
            name_of = lambda k: names[k] if k >= 0 else "*"
            while size := stream.read(4):
                data = stream.read(*struct.unpack("<i", size))
                ref, pos, n_name, mapq, _, n_cigar, flag, n_seq, next_ref, next_pos, tlen = struct.unpack("<iiBBHHHiiii", data[:32])
                at = 32 + n_name
                ops = struct.unpack(f"<{n_cigar}I", data[at : at + 4 * n_cigar])
                at += 4 * n_cigar
                packed = data[at : at + (n_seq + 1) // 2]
                at += len(packed)
                qual = data[at : at + n_seq]
                seq = "".join("=ACMGRSVTWYHKDBN"[b >> 4] + "=ACMGRSVTWYHKDBN"[b & 15] for b in packed)[:n_seq]
                mate = "*" if next_ref < 0 else "=" if next_ref == ref else name_of(next_ref)
                yield data[32 : 32 + n_name - 1].decode(), flag, name_of(ref), pos + 1, mapq, "".join(f"{x >> 4}{'MIDNSHP=X'[x & 15]}" for x in ops) or "*", mate, next_pos + 1, tlen, seq or "*", "*" if not qual or qual[0] == 255 else bytes(q + 33 for q in qual).decode()


def bam(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("path", path).load()


def paf(spark: SparkSession, path: str) -> DataFrame:
    names = ["qname", "qlen", "qstart", "qend", "strand", "tname", "tlen", "tstart", "tend", "matches", "block", "mapq"]
    return typed(fields(lines(spark, path).where("value != ''").select("value"), names), {c: "bigint" for c in names if c not in ("qname", "strand", "tname")})


def mpileup(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, ref, coverage, bases, quals, and the counts of each base: reference matches are counted for the reference's letter; read starts with their quality, ends, and indels with their letters are taken out first."""
    rows = typed(fields(lines(spark, path).where("value != ''").select("value"), ["chrom", "pos", "ref", "coverage", "bases", "quals"]), {"pos": "bigint", "coverage": "int"})
    return rows.withColumns({f"n_{c.lower()}": F.regexp_count(plain_bases(F.col("bases"), F.col("ref")), F.lit(c)) for c in "ACGTN"} | {"n_del": F.regexp_count(plain_bases(F.col("bases"), F.col("ref")), F.lit("\\*"))})


def plain_bases(bases, ref):
    """Bases of a pileup column in upper case, without marks and indels. Behind each sign stand a length and so many letters of an indel."""
    parts = F.split(F.regexp_replace(F.regexp_replace(bases, "\\^.", ""), "\\$", ""), "[+-](?=[0-9])")

    def behind(part):
        digits = F.regexp_extract(part, "^([0-9]+)", 1)
        return F.substr(part, F.length(digits) + digits.cast("int") + 1)

    bare = F.array_join(F.transform(parts, lambda part, k: F.when(k == 0, part).otherwise(behind(part))), "")
    return F.upper(F.replace(F.replace(bare, F.lit("."), ref), F.lit(","), ref))
