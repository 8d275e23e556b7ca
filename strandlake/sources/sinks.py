"""Writers of text formats: each turns rows into lines and leaves the rest to Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.sequence import wrapped


def text(df: DataFrame, line: Column, path: str, compression: str | None = None) -> None:
    df.select(line.alias("value")).write.text(path, compression=compression)


def fasta(df: DataFrame, path: str, *, name: str = "name", comment: str | None = None, sequence: str = "sequence", width: int = 80, compression: str | None = None) -> None:
    head = F.concat_ws(" ", name, F.nullif(F.col(comment), F.lit(""))) if comment else F.col(name)
    text(df, F.concat(F.lit(">"), head, F.lit("\n"), wrapped(F.col(sequence), width)), path, compression)


def fastq(df: DataFrame, path: str, *, compression: str | None = None) -> None:
    text(df, F.concat(F.lit("@"), F.col("identifier"), F.lit("\n"), F.col("sequence"), F.lit("\n+\n"), F.col("quality")), path, compression)


def chrom_sizes(df: DataFrame, path: str, *, name: str = "name", sequence: str = "sequence") -> None:
    text(df, F.concat_ws("\t", name, F.length(sequence).cast("string")), path)


def _gff_line(attributes: Column) -> Column:
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    return F.concat_ws("\t", *(cell(c) for c in ("seqid", "source", "genetic_type", "start", "stop", "score", "strand", "phase")), attributes)


def gff(df: DataFrame, path: str) -> None:
    """Sorted by place; attributes as ``key=value`` with the separators coded."""
    coded = lambda x: F.replace(F.replace(F.replace(x, F.lit("%"), F.lit("%25")), F.lit(";"), F.lit("%3B")), F.lit("="), F.lit("%3D"))
    pairs = F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), coded(e["value"]))), ";")
    text(df.orderBy("seqid", "start", "stop", "genetic_type"), _gff_line(pairs), path)


def gtf(df: DataFrame, path: str, names: dict[str, str] | None = None) -> None:
    """Attributes as ``key "value";``, keys renamed by ``names``."""
    renamed = lambda k: F.coalesce(*(F.when(k == old, F.lit(new)) for old, new in (names or {}).items()), k)
    pairs = F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat(renamed(e["key"]), F.lit(' "'), e["value"], F.lit('";'))), " ")
    text(df.orderBy("seqid", "start", "stop"), _gff_line(pairs), path)


def bed(df: DataFrame, path: str, *, attribute: str = "ID") -> None:
    """Features (1-based closed) as six columns of BED (0-based, half open)."""
    text(df, F.concat_ws("\t", "seqid", (F.col("start") - 1).cast("string"), F.col("stop").cast("string"), F.coalesce(F.col("attributes")[attribute], F.lit(".")), F.lit("0"), F.coalesce("strand", F.lit("."))), path)


def split_reads(df: DataFrame, path: str, reads_per_file: int) -> None:
    """FASTQ files of at most so many reads."""
    line = F.concat(F.lit("@"), F.col("identifier"), F.lit("\n"), F.col("sequence"), F.lit("\n+\n"), F.col("quality"))
    df.select(line.alias("value")).write.option("maxRecordsPerFile", reads_per_file).text(path)


def by_status(df: DataFrame, path: str) -> None:
    """Alignments as FASTQ lines, in a folder for each of mapped/unmapped and first/second."""
    flag = F.col("flag")
    parts = df.withColumn("status", F.when(flag.bitwiseAND(4) != 0, "unmapped").otherwise("mapped")).withColumn("mate", F.when(flag.bitwiseAND(128) != 0, "R2").otherwise("R1"))
    line = F.concat(F.lit("@"), F.col("qname"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("qual"))
    parts.select("status", "mate", line.alias("value")).write.partitionBy("status", "mate").text(path)
