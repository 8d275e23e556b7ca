"""Features and variants: GFF3, GTF, BED, VCF, GenBank and EMBL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.sources.files import carried, fields, lines, typed

GFF = ["seqid", "source", "genetic_type", "start", "stop", "score", "strand", "phase"]
# Characters that GFF3 writes by their code.
ESCAPES = {"%09": "\t", "%0A": "\n", "%0D": "\r", "%25": "%", "%3D": "=", "%26": "&", "%2C": ",", "%28": "(", "%29": ")"}


def attributes(text: Column) -> Column:
    """Map of ``key=value;`` (GFF3) or ``key "value";`` (GTF) pairs; codes are decoded, quotes go, the last of equal keys counts."""
    def decoded(x: Column) -> Column:
        for code, letter in ESCAPES.items():
            x = F.replace(x, F.lit(code), F.lit(letter))
        return x

    pairs = F.regexp_extract_all(F.concat(text, F.lit(";")), F.lit('\\s*([^\\s=;]+[= ](?:"[^"]*"|[^;"]*))\\s*;'), 1)
    entry = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, "^([^\\s=]+)[= ]", 1).alias("key"), decoded(F.trim(F.regexp_replace(F.regexp_replace(p, "^[^\\s=]+[= ]", ""), '"', ""))).alias("value")))
    last = F.filter(entry, lambda x, i: ~F.exists(F.slice(entry, i + 2, F.size(entry)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def gff(spark: SparkSession, path: str, skip_types: tuple[str, ...] = ()) -> DataFrame:
    """Records of nine columns, 1-based closed, up to a ``##FASTA`` line of their file."""
    text = carried(lines(spark, path), "fasta", F.when(F.col("value").startswith("##FASTA"), True))
    rows = text.where(F.col("fasta").isNull() & ~F.col("value").startswith("#") & (F.size(F.split("value", "\t")) == 9))
    out = typed(fields(rows.drop("fasta"), [*GFF, "attributes"]), {"start": "bigint", "stop": "bigint"})
    out = out.withColumn("strand", F.when(F.col("strand").isin("+", "-", ".", "?"), F.col("strand"))).withColumn("attributes", attributes(F.col("attributes")))
    return out.where(~F.col("genetic_type").isin(*skip_types)) if skip_types else out


def bed(spark: SparkSession, path: str) -> DataFrame:
    """BED of 3 to 12 columns; block starts become absolute."""
    names = ["chrom", "start", "end", "name", "score", "strand", "cds_start", "cds_end", "rgb", "block_count", "block_sizes", "block_starts"]
    rows = lines(spark, path).where(~F.col("value").rlike("^(#|track|browser)") & (F.trim("value") != ""))
    out = typed(fields(rows.select("value"), names), {c: "bigint" for c in ("start", "end", "cds_start", "cds_end")} | {"block_count": "int"})
    numbers = lambda c: F.filter(F.transform(F.split(c, ","), lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())
    return out.withColumn("block_sizes", numbers("block_sizes")).withColumn("block_starts", F.transform(numbers("block_starts"), lambda x: x + F.col("start")))


def depth(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, cov and, if there, cov of filtered reads."""
    return typed(fields(lines(spark, path).where("value != ''").select("value"), ["chrom", "pos", "cov", "mapq0"]), {"pos": "bigint", "cov": "int", "mapq0": "int"})


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, id, ref, alt (array), qual, filter, info (map; flags have an empty value), samples (map of name to map of key to value)."""
    text = carried(lines(spark, path), "header", F.when(F.col("value").startswith("#CHROM"), F.col("value")))
    rows = text.where(~F.col("value").startswith("#") & (F.col("value") != ""))
    cells, names = F.split("value", "\t"), F.slice(F.split("header", "\t"), 10, 1 << 20)
    sample = F.transform(F.slice(cells, 10, 1 << 20), lambda x: F.map_from_arrays(F.split(F.get(cells, F.lit(8)), ":"), F.transform(F.split(F.get(cells, F.lit(8)), ":"), lambda _, i: F.get(F.split(x, ":"), i))))
    out = rows.withColumn("samples", F.map_from_arrays(F.slice(names, F.lit(1), F.size(sample)), sample)).drop("header")
    out = typed(fields(out, ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info"]), {"pos": "bigint", "qual": "double"})
    info = F.map_from_entries(F.transform(F.split("info", ";"), lambda x: F.struct(F.split(x, "=", 2)[0], F.coalesce(F.get(F.split(x, "=", 2), F.lit(1)), F.lit("")))))
    return out.withColumn("alt", F.split("alt", ",")).withColumn("info", info).select("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "samples")


def genbank(spark: SparkSession, path: str) -> DataFrame:
    """locus, type, gene_start, gene_end, strand, qualifiers of each feature: a location is its first and last number, reverse if it begins with c."""
    text = carried(lines(spark, path), "locus", F.when(F.col("value").startswith("LOCUS"), F.regexp_extract("value", "^LOCUS\\s+(\\S+)", 1)))
    text = carried(text, "part", F.when(F.col("value").rlike("^[A-Z]"), F.regexp_extract("value", "^([A-Z]+)", 1)))
    body = text.where("part = 'FEATURES'").withColumn("key", F.regexp_extract("value", "^     (\\S+)\\s", 1))
    body = carried(body, "feature", F.when(F.col("key") != "", F.struct("block", "at"))).where("feature is not null")
    rows = body.groupBy("file", "locus", "feature").agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("x"))
    whole = F.array_join(F.transform("x", lambda r: F.trim(r["value"])), "\n")
    place = F.regexp_replace(F.regexp_extract(whole, "(?s)^\\S+\\s+(.*?)(?:\\n/|$)", 1), "\\s", "")
    found = F.regexp_extract_all(place, F.lit("(\\d+)"), 1)
    qualifiers = F.regexp_extract_all(F.concat(F.lit("\n"), whole), F.lit('(?s)\\n(/\\w+(?:=(?:"[^"]*"|[^\\n]*))?)'), 1)
    entries = F.transform(qualifiers, lambda q: F.struct(F.regexp_extract(q, "^/(\\w+)", 1).alias("key"), F.regexp_replace(F.regexp_replace(F.regexp_replace(q, "^/\\w+=?", ""), '"', ""), "\\n", " ").alias("value")))
    first = F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, F.lit(1), i), lambda y: y["key"] == x["key"]))
    return rows.select("locus", F.regexp_extract(whole, "^(\\S+)", 1).alias("type"), found[0].cast("bigint").alias("gene_start"), F.element_at(found, -1).cast("bigint").alias("gene_end"), F.when(place.startswith("c"), "-").otherwise("+").alias("strand"), F.map_from_entries(first).alias("qualifiers"))


def embl(spark: SparkSession, path: str) -> DataFrame:
    """id, accession, description, sequence of each record."""
    rows = lines(spark, path, "//\n").where(F.trim("value") != "")
    sequence = F.regexp_replace(F.regexp_extract("value", "(?s)\\nSQ [^\\n]*\\n(.*)$", 1), "[\\s\\d]", "")
    words = F.array_join(F.transform(F.regexp_extract_all("value", F.lit("(?m)^DE   (.*)$"), 1), lambda x: F.trim(x)), " ")
    return rows.select(F.regexp_extract("value", "(?m)^ID   ([^;\\s]+)", 1).alias("id"), F.regexp_extract("value", "(?m)^AC   ([^;\\s]+)", 1).alias("accession"), words.alias("description"), F.upper(sequence).alias("sequence"))


def wiggle(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, value of fixedStep and variableStep tracks."""
    text = carried(lines(spark, path), "head", F.when(F.col("value").rlike("^(fixed|variable)Step"), F.struct("value", "block", "at")))
    rows = text.where(F.col("value").rlike("^[-0-9.]"))
    head = F.col("head.value")
    option = lambda name, default: F.coalesce(F.nullif(F.regexp_extract(head, f"{name}=(\\d+)", 1), F.lit("")).cast("bigint"), F.lit(default))
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("file", "head").orderBy("block", "at")) - 1
    parts = F.split(F.trim("value"), "\\s+")
    fixed = head.startswith("fixed")
    return rows.select(F.regexp_extract(head, "chrom=(\\S+)", 1).alias("chrom"), F.when(fixed, option("start", 1) + number * option("step", 1)).otherwise(parts[0].try_cast("bigint")).alias("pos"), F.when(fixed, parts[0]).otherwise(F.get(parts, F.lit(1))).try_cast("double").alias("value"))
