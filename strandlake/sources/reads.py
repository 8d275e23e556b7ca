"""Reads and sequences: FASTQ and FASTA."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.sources.files import Range, RecordSource, lines, opened


class FastqSource(RecordSource):
    """Four-line records. A range begins at its first record: a line with @ whose second successor begins with +."""

    short, columns = "fastq", "identifier string, sequence string, quality string, file string, offset bigint"

    @staticmethod
    def records(part: Range, options: dict) -> Iterator[tuple]:
        with opened(part.path, part.start) as stream:
            at = part.start
            if at:
                stream.seek(at - 1)
                at += len(stream.readline()) - 1  # the rest of a line that began before
            held: list[bytes] = []
            started = part.start == 0
            while True:
                line = stream.readline()
                if not line:
                    break
                held.append(line)
                if not started and len(held) == 3:
                    if held[0][:1] == b"@" and held[2][:1] == b"+":
                        started = True
                    else:
                        at += len(held.pop(0))
                        if part.end is not None and at >= part.end:
                            return
                        continue
                if started and len(held) == 4:
                    if part.end is not None and at >= part.end:
                        return
                    name, sequence, plus, quality = (x.rstrip(b"\r\n").decode() for x in held)
                    if name[:1] != "@" or plus[:1] != "+":
                        raise ValueError(f"not a FASTQ record at byte {at} of {part.path}")
                    yield name[1:], sequence, quality, part.path, at
                    at += sum(map(len, held))
                    held = []


def fastq(spark: SparkSession, path: str, split_bytes: int = 128 << 20) -> DataFrame:
    """identifier, sequence, quality, file, offset; plain files are read in ranges, compressed ones whole. An incomplete last record is left out."""
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").option("path", path).option("splitBytes", split_bytes).load()


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, comment, sequence, file: records are cut where a line begins with ``>``, so a large file is read in ranges. A file begins with such a line."""
    records = lines(spark, path, "\n>").withColumn("value", F.regexp_replace("value", "^>", "")).where(F.trim("value") != "")
    header = F.regexp_extract("value", "^([^\\r\\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("value", "^[^\\r\\n]*", ""), "\\s", "")
    return records.select(F.regexp_extract(header, "^(\\S+)", 1).alias("name"), F.regexp_extract(header, "^\\S+\\s+(.*)$", 1).alias("comment"), body.alias("sequence"), "file")


def illumina_identifier(identifier):
    """Struct of the parts of an Illumina read name, new style (``a:b:c:d:e:f:g n:f:c:i``); parts that aren't there are null."""
    halves = F.split(identifier, " ", 2)
    left, right = F.split(halves[0], ":"), F.split(F.get(halves, F.lit(1)), ":")
    names = ["instrument", "run", "flowcell", "lane", "tile", "x", "y"]
    return F.struct(*(F.get(left, F.lit(k)).alias(n) for k, n in enumerate(names)), *(F.get(right, F.lit(k)).alias(n) for k, n in enumerate(["member", "filtered", "control", "barcode"])))
