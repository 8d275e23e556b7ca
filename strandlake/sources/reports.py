"""Tables that tools write: one reader for delimited formats, and the few with sections."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.sources.files import carried, fields, lines, typed

# Columns of the formats, with the types of those that aren't strings.
FORMATS: dict[str, tuple[str, str]] = {
    "narrowpeak": ("\t", "chr start:bigint stop:bigint name score:int strand fold_enrichment:double log10_p:double log10_q:double summit:bigint"),
    "broadpeak": ("\t", "chr start:bigint stop:bigint name score:int strand fold_enrichment:double log10_p:double log10_q:double"),
    "blast6": ("\t", "qseqid sseqid pident:double length:bigint mismatch:bigint gapopen:bigint qstart:bigint qend:bigint sstart:bigint send:bigint evalue:double bitscore:double staxid stitle ssciname"),
    "kraken": ("\t", "status read_id taxon:bigint length kmers"),
    "tagalign": ("\t", "ref start:bigint end:bigint dummy quality:bigint strand"),
    "krona": ("\t", "count:bigint label"),
    "cnvnator": ("\t", "type position size:double depth:double e1:double e2:double e3:double e4:double q0:double"),
    "frip": (",", "bamfile count:bigint in_peaks:bigint FRiP:double"),
    "domtblout": ("\\s+", "target_name target_accession tlen:bigint query_name query_accession qlen:bigint evalue:double score:double bias:double number:int of:int c_evalue:double i_evalue:double domain_score:double domain_bias:double hmm_from:bigint hmm_to:bigint ali_from:bigint ali_to:bigint env_from:bigint env_to:bigint acc:double description"),
    "cmsearch": ("\\s+", "target_name target_accession query_name query_accession mdl mdl_from:bigint mdl_to:bigint seq_from:bigint seq_to:bigint strand trunc pass gc:double bias:double score:double evalue:double inc description"),
}


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows of a headerless format of FORMATS; lines with # and blank ones are skipped. The last column takes the rest of a line."""
    pattern, columns = FORMATS[name]
    named = [c.partition(":") for c in columns.split()]
    rows = lines(spark, path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return typed(fields(rows.select("value"), [n for n, _, _ in named], pattern, len(named)), {n: kind for n, _, kind in named if kind})


def with_header(spark: SparkSession, path: str, separator: str = "\t", comment: str = "#") -> DataFrame:
    """A delimited table with a header, cells trimmed; an empty file gives no columns."""
    return spark.read.csv(path, sep=separator, header=True, comment=comment, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=False)


def feature_counts(spark: SparkSession, path: str) -> DataFrame:
    """Geneid, Length and sample counts as longs; locations are dropped and sample names stripped of folders and endings."""
    df = with_header(spark, path)
    samples = [c for c in df.columns if c not in ("Geneid", "Chr", "Start", "End", "Strand", "Length")]
    clean = lambda c: c.rpartition("/")[2].split(".")[0].split("_Aligned")[0]
    return df.select("Geneid", F.col("Length").try_cast("bigint").alias("Length"), *(F.col(f"`{c}`").try_cast("bigint").alias(clean(c)) for c in samples))


def design(spark: SparkSession, path: str) -> DataFrame:
    """Samples and their conditions, as strings."""
    return with_header(spark, path, ",")


def differential(spark: SparkSession, path: str) -> DataFrame:
    """A result table of a differential analysis: gene and doubles; NA is null."""
    df = with_header(spark, path, ",")
    return typed(df.withColumnRenamed(df.columns[0], "gene"), {c: "double" for c in df.columns[1:]})


def trf(spark: SparkSession, path: str) -> DataFrame:
    """Tandem repeats: rows of 15 fields under their ``Sequence:`` line."""
    names = ["start", "end", "period_size", "CNV", "size_consensus", "percent_matches", "percent_indels", "score", "A", "C", "G", "T", "entropy", "seq1", "seq2"]
    text = carried(lines(spark, path), "sequence_name", F.when(F.col("value").startswith("Sequence:"), F.regexp_extract("value", "^Sequence:\\s*(\\S+)", 1)))
    rows = text.where(F.size(F.split("value", " ")) == 15).select("sequence_name", "value")
    out = typed(fields(rows, names, " "), {c: "double" if c in ("CNV", "entropy") else "bigint" for c in names[:13]})
    return out.where("start is not null").withColumn("length", F.col("end") - F.col("start") + 1)


def sample_sheet(spark: SparkSession, path: str) -> DataFrame:
    """section, line_no, fields of a sectioned sheet."""
    from pyspark.sql import Window

    text = carried(lines(spark, path), "section", F.when(F.col("value").startswith("["), F.regexp_extract("value", "^\\[(.*?)\\]", 1)))
    rows = text.withColumn("line_no", F.row_number().over(Window.partitionBy("file").orderBy("block", "at"))).where(~F.col("value").startswith("[") & (F.regexp_replace("value", "[,;\\s]", "") != ""))
    return rows.select("section", "line_no", F.transform(F.split("value", ","), lambda x: F.trim(x)).alias("fields"))


def fastqc(spark: SparkSession, path: str) -> DataFrame:
    """module, fields of the rows of a FastQC data file."""
    text = carried(lines(spark, path), "module", F.when(F.col("value").startswith(">>") & (F.col("value") != ">>END_MODULE"), F.regexp_extract("value", "^>>([^\\t]*)", 1)))
    return text.where(~F.col("value").rlike("^(>>|#)") & (F.col("value") != "")).select("file", "module", F.split("value", "\t").alias("fields"))


def taxonomy(spark: SparkSession, names: str, nodes: str) -> DataFrame:
    """taxon, parent, rank, name from the two dumps, scientific names only."""
    cut = lambda path, columns: fields(lines(spark, path).where("value != ''").select(F.regexp_replace("value", "\\t\\|$", "").alias("value")), columns, "\\t\\|\\t")
    tree = typed(cut(nodes, ["taxon", "parent", "rank"]), {"taxon": "bigint", "parent": "bigint"})
    named = typed(cut(names, ["taxon", "name", "unique_name", "class"]), {"taxon": "bigint"}).where("class = 'scientific name'").select("taxon", "name")
    return tree.join(named, "taxon", "left")


def demultiplexed(spark: SparkSession, path: str) -> DataFrame:
    """lane, name, count of a conversion report, with a row for each lane's undetermined reads."""
    lanes = spark.read.option("multiLine", True).json(path).select(F.explode("ConversionResults").alias("r"))
    known = lanes.select(F.col("r.LaneNumber").alias("lane"), F.explode("r.DemuxResults").alias("d")).select("lane", F.col("d.SampleId").alias("name"), F.col("d.NumberReads").alias("count"))
    return known.union(lanes.select("r.LaneNumber", F.lit("Undetermined"), "r.Undetermined.NumberReads"))


# Columns of a completeness report.
COMPLETENESS = ["sample", "marker_lineage", "n_genomes", "n_markers", "n_marker_sets", "0", "1", "2", "3", "4", "5+", "completeness", "contamination", "heterogeneity"]


def completeness(spark: SparkSession, path: str) -> DataFrame:
    """One row a report: the fields of its fourth line, which two or more blanks part; reports of several files are rows of one table, those without such a line are left out."""
    numbered = lines(spark, path).withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("block", "at")))  # a report has a few lines
    fourth = numbered.where("k = 4").withColumn("value", F.trim("value"))
    rows = fields(fourth.select("file", "value"), COMPLETENESS, "\\s{2,}")
    return typed(rows, {c: "double" for c in COMPLETENESS[2:]})


def transfer_rnas(spark: SparkSession, path: str) -> DataFrame:
    """contig, kind, start, end, length, score and strand of the hits of a tRNA search, whose contigs stand on lines with ``>``."""
    rows = carried(lines(spark, path), "contig", F.nullif(F.regexp_extract("value", "^>(\\S+)", 1), F.lit("")))
    pattern = "^\\d+\\s+(tRNA-\\S+)\\s+(?:\\S*\\[)?(\\d+),(\\d+)\\]?\\s+([\\d.]+)"
    part = lambda k: F.regexp_extract("value", pattern, k)
    hits = rows.where(F.col("contig").isNotNull() & F.col("value").rlike(pattern))
    found = hits.select("contig", part(1).alias("kind"), part(2).cast("bigint").alias("start"), part(3).cast("bigint").alias("end"), part(4).cast("double").alias("score"), F.when(F.col("value").contains("c["), "-").otherwise("+").alias("strand"))
    return found.withColumn("length", F.col("end") - F.col("start"))


def ribosomal_rnas(spark: SparkSession, path: str) -> DataFrame:
    """Hits of a ribosomal RNA search in the old feature format: chrom, source, feature, start, stop, score, strand, frame, attributes."""
    names = ["chrom", "source", "feature", "start", "stop", "score", "strand", "frame", "attributes"]
    rows = lines(spark, path).where("value != '' AND value NOT LIKE '#%'").select("value")
    return typed(fields(rows, names), {"start": "bigint", "stop": "bigint", "score": "double"})


def quadruplexes(spark: SparkSession, path: str) -> DataFrame:
    """name, start, end, sequence, length, score and nbr (null in lines of five fields) of merged quadruplex tables, a section a sequence."""
    rows = carried(lines(spark, path), "name", F.nullif(F.regexp_extract("value", "^>(\\S+)", 1), F.lit("")))
    n = F.size(F.split("value", "\t"))
    body = rows.where(F.col("name").isNotNull() & ~F.col("value").startswith(">") & ~F.col("value").startswith("Start") & n.isin(5, 6))
    names = ["start", "end", "sequence", "length", "score", "nbr"]
    parsed = fields(body.select("name", "value"), names)
    return typed(parsed.select("name", *(F.trim(c).alias(c) for c in names)), {"start": "bigint", "end": "bigint", "length": "bigint", "score": "double", "nbr": "int"})


def base_counts(spark: SparkSession, path: str, least_depth: int = 0) -> DataFrame:
    """pos and counts a, c, g, t, n, del and ins of a table of base counts; where all are fewer than ``least_depth``, the position counts as N alone (n is 10,000)."""
    names = ["pos", "a", "c", "g", "t", "n", "del", "ins"]
    rows = typed(fields(lines(spark, path).where("value RLIKE '^[0-9]'").select("value"), names), {"pos": "bigint"} | {c: "double" for c in names[1:]})
    total = reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0.0)) for c in names[1:]))
    low = total < least_depth
    return rows.withColumns({c: F.when(low, 10_000.0 if c == "n" else 0.0).otherwise(F.col(c)) for c in names[1:]})


def assembly_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Segments (name, length, depth, null without a dp tag) and links (source, source_strand, target, target_strand, overlap) of an assembly graph."""
    rows = lines(spark, path).select("value")
    parts = F.split("value", "\t")
    depth = F.nullif(F.regexp_extract("value", "\\tdp:[if]:([0-9.]+)", 1), F.lit("")).cast("double")
    segments = rows.where(F.col("value").startswith("S\t")).select(F.get(parts, F.lit(1)).alias("name"), F.length(F.get(parts, F.lit(2))).alias("length"), depth.alias("depth"))
    links = rows.where(F.col("value").startswith("L\t")).select(*(F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(["source", "source_strand", "target", "target_strand", "overlap"], 1)))
    return segments, links


def newick_distances(spark: SparkSession, path: str) -> DataFrame:
    """file, leaves, and mean and variance of the distances between leaves of the tree in each file."""

    @F.pandas_udf("struct<leaves: int, mean: double, variance: double>")
    def measured(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([leaf_distances(t) for t in texts], columns=["leaves", "mean", "variance"])

    trees = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), measured("value").alias("x"))
    return trees.select("file", "x.*")


def leaf_distances(text: str) -> tuple[int, float, float]:
    """Number of leaves of a Newick tree, mean and variance of the distances of their pairs (0 without a pair)."""
    pairs: list[float] = []
    stack: list[list[list[float]]] = [[]]
    leaf = True
    for mark, name in re.findall(r"([(),;])|([^(),;]+)", text.strip().replace("\n", "")):
        if mark == "(":
            stack.append([])
        elif mark == ")":
            groups = stack.pop()
            pairs += [x + y for k, g in enumerate(groups) for other in groups[k + 1 :] for x in g for y in other]
            stack[-1].append([x for g in groups for x in g])
            leaf = False
            continue
        elif name:
            length = float(name.rsplit(":", 1)[1]) if ":" in name else 0.0
            if leaf:
                stack[-1].append([length])
            else:
                stack[-1][-1] = [x + length for x in stack[-1][-1]]
        leaf = True
    n = sum(len(g) for g in stack[0])
    mean = sum(pairs) / len(pairs) if pairs else 0.0
    return n, mean, sum((x - mean) ** 2 for x in pairs) / len(pairs) if pairs else 0.0
