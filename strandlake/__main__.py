"""Command line: ``python -m strandlake COMMAND INPUT [--output FOLDER] ...``. Text and tables are written as Spark writes them, a file a partition; without --output, rows are shown."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake import session
from strandlake.functions import formats, sequence, structure
from strandlake.operators import features, reads, scans, sliding, tables
from strandlake.sources import alignments, annotations, files, reports
from strandlake.sources import reads as read_files

COMMANDS: dict[str, Callable[[SparkSession, argparse.Namespace], DataFrame]] = {}


def command(name: str):
    def add(f):
        COMMANDS[name] = f
        return f

    return add


def _lengths(df: DataFrame) -> DataFrame:
    rows = df.select(F.lit(1).alias("all"), F.length("sequence").cast("bigint").alias("length"))
    stats = rows.groupBy("all").agg(F.count("*").alias("n"), F.sum("length").alias("total"), F.avg("length").alias("mean"), F.min("length").alias("shortest"), F.max("length").alias("longest"))
    return stats.join(tables.n50(rows, ["all"], "length"), "all", "left").drop("all")


@command("fasta")
def fasta(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Counts, lengths, N50 and L50 of a FASTA file."""
    return _lengths(read_files.fasta(spark, args.input))


@command("fastq")
def fastq(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Counts, lengths, N50 and L50 of reads; with --head, the first records of each file."""
    rows = read_files.fastq(spark, args.input)
    return rows.orderBy("file", "offset").limit(args.head).drop("file", "offset") if args.head else _lengths(rows)


@command("fastq_split")
def fastq_split(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Reads with the number of their part, round robin in the order of the file."""
    from strandlake.operators.tracks import dense_positions

    numbered = dense_positions(read_files.fastq(spark, args.input), "file", ["offset"], F.floor(F.col("offset") / (64 << 20)), "number")
    return numbered.withColumn("part", reads.part_of(F.col("number") - 1, args.parts)).drop("number", "offset")


@command("g4hunter")
def g4hunter(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Quadruplex regions: windows of 20 letters with a mean score of 1 or more, joined."""
    rows = read_files.fasta(spark, args.input).select("name", structure.quadruplex_windows(sequence.g4_scores(F.upper("sequence"))).alias("starts"))
    return rows.select("name", F.explode(structure.chained(F.col("starts"), 20)).alias("r")).select("name", "r.*")


@command("gff")
def gff(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Features by type and contig."""
    return annotations.gff(spark, args.input).groupBy("seqid", "genetic_type").agg(F.count("*").alias("n"))


def _gff_lines(rows: DataFrame, quoted: bool) -> DataFrame:
    c = F.col
    return rows.select(formats.gff(c("seqid"), c("source"), c("genetic_type"), c("start"), c("stop"), c("score"), c("strand"), c("phase"), formats.gff_attributes(c("attributes"), quoted)).alias("line"))


@command("gff_to_gtf")
def gff_to_gtf(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Lines of a GTF file."""
    return _gff_lines(annotations.gff(spark, args.input), True)


@command("gff_to_light_gff")
def gff_to_light_gff(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Lines of the features of some types."""
    return _gff_lines(annotations.gff(spark, args.input).where(F.col("genetic_type").isin(args.types.split(","))), False)


@command("gtf_fixer")
def gtf_fixer(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Lines whose exons have unique ids."""
    rows = annotations.gff(spark, args.input)
    a = F.col("attributes")
    fixed = F.map_concat(F.map_filter(a, lambda k, v: k != "exon_id"), F.create_map(F.lit("exon_id"), formats.gtf_exon_id(a["exon_id"], a["transcript_version"], a["transcript_id"])))
    return _gff_lines(rows.withColumn("attributes", F.when((F.col("genetic_type") == "exon") & a["exon_id"].isNotNull(), fixed).otherwise(a)), True)


@command("blast_to_gff")
def blast_to_gff(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """A match feature for each tabular hit."""
    names = ["qseqid", "sseqid", "pident", "length", "mismatch", "gapopen", "qstart", "qend", "sstart", "send", "evalue", "bitscore"]
    hits = files.typed(files.fields(files.lines(spark, args.input).where("value != '' AND value NOT LIKE '#%'").select("value"), names), {"sstart": "bigint", "send": "bigint"})
    return hits.select(formats.gff_of_hit(*(F.col(c) for c in ("qseqid", "sseqid", "sstart", "send", "evalue", "bitscore"))).alias("line"))


@command("embl_to_fasta")
def embl_to_fasta(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """FASTA records of EMBL entries."""
    rows = annotations.embl(spark, args.input)
    return rows.select(formats.fasta(F.concat_ws(" ", F.col(rows.columns[0]), F.col("description") if "description" in rows.columns else F.lit(None)), F.col("sequence")).alias("line"))


@command("feature_counts")
def feature_counts(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Counts of a gene over all samples."""
    rows = reports.feature_counts(spark, args.input)
    return rows


@command("samplesheet")
def samplesheet(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Lines with commas for semicolons and without separators at their end."""
    return files.lines(spark, args.input).orderBy("file", "block", "at").select(formats.comma_separated(F.col("value")).alias("line"))


@command("telomark")
def telomark(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Share of each contig's letters under a motif and its reverse complement."""
    return sliding.telomeric(read_files.fasta(spark, args.input), "name", "sequence", args.motif, args.share)


@command("motif")
def motif(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Matches of a pattern with their places."""
    return scans.regex_scan(read_files.fasta(spark, args.input), "name", "sequence", args.motif)


@command("ribodesigner")
def ribodesigner(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Probe length and space for each sequence, by ever wider ranges."""
    found = structure.widening_probe_lengths(F.length("sequence"))
    return read_files.fasta(spark, args.input).select("name", F.length("sequence").alias("length"), found.alias("x")).select("name", "length", "x.probe", "x.space")


@command("taxonomy")
def taxonomy(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Rows of a table of taxa (id, parent, rank, scientific_name) whose name holds a text."""
    rows = spark.read.option("header", True).csv(args.input)
    return rows.where(F.lower("scientific_name").contains(args.text.lower()))


@command("rnaseq_compare")
def rnaseq_compare(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Genes of two differential tables: common, first and second."""
    from strandlake.operators import expression

    one, two = (spark.read.option("header", True).csv(p).where(F.col("padj").try_cast("double") <= args.alpha).select(F.col(args.gene).alias("gene"), "log2FoldChange", "padj") for p in (args.input, args.other))
    return expression.compared(one, two)


@command("summary")
def summary(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Statistics by the kind of file, told by its first bytes."""
    kind = sniffed(args.input)
    if kind in ("fasta", "fastq"):
        return COMMANDS[kind](spark, argparse.Namespace(input=args.input, head=0))
    if kind in ("sam", "bam"):
        from strandlake.operators import alignment_stats

        return alignment_stats.summary(getattr(alignments, kind)(spark, args.input))
    if kind == "gff":
        return gff(spark, args)
    raise ValueError(f"unknown kind of file: {args.input}")


@command("mapping_depth")
def mapping_depth(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Steps of constant depth of a SAM or BAM file's mapped reads."""
    from strandlake.functions import alignment
    from strandlake.operators import intervals

    rows = (alignments.bam if sniffed(args.input) == "bam" else alignments.sam)(spark, args.input).where(~alignment.has_flag(F.col("flag"), "unmapped"))
    return intervals.depth(rows.select("rname", (F.col("pos") - 1).alias("start"), (F.col("pos") - 1 + alignment.reference_length(F.col("cigar"))).alias("end")), ["rname"])


@command("feature_fasta")
def feature_fasta(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """FASTA records of the features of some types, cut from --other."""
    contigs = read_files.fasta(spark, args.other).select(F.col("name").alias("seqid"), "sequence")
    found = features.feature_sequences(annotations.gff(spark, args.input), contigs, args.types.split(","), F.col("attributes")["ID"], stranded=True)
    return found.select(formats.fasta(F.col("id"), F.col("sequence")).alias("line"))


def sniffed(path: str) -> str | None:
    """fastq, fasta, sam, bam, cram, vcf, gff or bed by the first lines of a file, else null."""
    with files.opened(files.listed(path)[0][0]) as stream:
        head = stream.read(4096)
    first = head.split(b"\n")
    if head[:4] == b"BAM\x01":
        return "bam"
    if head[:4] == b"CRAM":
        return "cram"
    if head[:1] == b"@":
        if len(first) > 2 and first[2].rstrip(b"\r") == b"+":
            return "fastq"
        return "sam" if head[:3] in (b"@HD", b"@SQ", b"@RG", b"@PG", b"@CO") else None
    if head[:1] == b">":
        return "fasta"
    if head.startswith(b"##fileformat=VCF"):
        return "vcf"
    lines = [x for x in first if x and not x.startswith(b"#")]
    columns = lines[0].split(b"\t") if lines else []
    if head.startswith(b"##gff-version") or len(columns) == 9 and columns[3].isdigit() and columns[4].isdigit():
        return "gff"
    return "bed" if len(columns) >= 3 and columns[1].isdigit() and columns[2].rstrip(b"\r").isdigit() else None


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="strandlake", description=__doc__)
    parser.add_argument("command", choices=sorted(COMMANDS))
    parser.add_argument("input")
    parser.add_argument("--output", help="a new folder")
    parser.add_argument("--other", help="a second input")
    parser.add_argument("--head", type=int, default=0)
    parser.add_argument("--parts", type=int, default=2)
    parser.add_argument("--types", default="gene")
    parser.add_argument("--motif", default="TTAGGG")
    parser.add_argument("--share", type=float, default=0.1)
    parser.add_argument("--text", default="")
    parser.add_argument("--gene", default="gene")
    parser.add_argument("--alpha", type=float, default=0.05)
    args = parser.parse_args(argv)
    spark = session.build(f"strandlake-{args.command}")
    found = COMMANDS[args.command](spark, args)
    if not args.output:
        found.show(50, truncate=False)
    elif found.columns == ["line"]:
        found.write.text(args.output)
    else:
        found.write.option("header", True).csv(args.output)


if __name__ == "__main__":
    main()
