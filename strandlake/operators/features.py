"""Annotation rows (seqid, source, genetic_type, start, stop, score, strand, phase, attributes): searches, children, maps and sequences. Positions are 1-based and closed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import sequence
from strandlake.operators import intervals

# Starts of names of transfer and ribosomal RNA.
RNA_STARTS = ("tRNA-", "28S", "5.8S", "18S", "5S")


def containing(df: DataFrame, text: str, columns: list[str] | None = None) -> DataFrame:
    """Rows with ``text`` in one of the columns, as strings; null holds nothing."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).contains(text) for c in columns or df.columns]
    return df.where(reduce(lambda a, b: a | b, cells))


def is_structural_rna(name: Column) -> Column:
    """Whether a name says transfer or ribosomal RNA; null doesn't."""
    return F.coalesce(reduce(lambda a, b: a | b, (name.startswith(s) for s in RNA_STARTS)) | (name == "tRNA"), F.lit(False))


def attribute_keys(df: DataFrame, keys: list[str], attributes: str = "attributes") -> DataFrame:
    """keys, attribute and n: in how many rows each attribute stands."""
    return df.select(*keys, F.explode(F.map_keys(attributes)).alias("attribute")).groupBy(*keys, "attribute").agg(F.count("*").alias("n"))


def sizes(df: DataFrame) -> DataFrame:
    """seqid and size: the stop of its region row, the greatest if there are several."""
    return df.where("genetic_type = 'region'").groupBy("seqid").agg(F.max("stop").alias("size"))


def children_of(df: DataFrame) -> DataFrame:
    """parent, children (sorted ids) and n, from the attributes ID and Parent; rows without one are left out."""
    rows = df.select(F.col("attributes")["Parent"].alias("parent"), F.col("attributes")["ID"].alias("id")).where("parent is not null and id is not null")
    return rows.groupBy("parent").agg(F.array_sort(F.collect_set("id")).alias("children")).withColumn("n", F.size("children"))


def with_transcripts(df: DataFrame, ident: str = "gene_id") -> DataFrame:
    """Each row, and behind each gene an mRNA and a CDS of its place: order is 0, 1 and 2, parent and id tell the lineage."""
    gene = F.col("attributes")[ident]
    own = F.struct(F.lit(0).alias("order"), F.col("genetic_type").alias("kind"), F.col("phase").cast("string").alias("ph"), F.col("attributes")["ID"].alias("id"), F.col("attributes")["Parent"].alias("parent"))
    mrna = F.struct(F.lit(1).alias("order"), F.lit("mRNA").alias("kind"), F.lit(".").alias("ph"), F.concat(gene, F.lit(".mRNA")).alias("id"), gene.alias("parent"))
    cds = F.struct(F.lit(2).alias("order"), F.lit("CDS").alias("kind"), F.lit("0").alias("ph"), F.concat(gene, F.lit(".CDS")).alias("id"), F.concat(gene, F.lit(".mRNA")).alias("parent"))
    rows = df.withColumn("__x", F.explode(F.when(F.col("genetic_type") == "gene", F.array(own, mrna, cds)).otherwise(F.array(own))))
    return rows.withColumns({"genetic_type": F.col("__x.kind"), "phase": F.col("__x.ph"), "order": F.col("__x.order"), "id": F.col("__x.id"), "parent": F.col("__x.parent")}).drop("__x")


def with_regions(df: DataFrame, regions: DataFrame) -> DataFrame:
    """The rows and, for each seqid of ``regions`` (seqid, start, stop) that has rows, a region row of the header."""
    used = regions.join(df.select("seqid").distinct(), "seqid", "left_semi")
    s = lambda c: F.col(c).cast("string")
    notes = F.create_map(F.lit("ID"), F.concat("seqid", F.lit(":"), s("start"), F.lit(".."), s("stop")), F.lit("Name"), F.col("seqid"), F.lit("chromosome"), F.col("seqid"))
    rows = used.select("seqid", F.lit("header").alias("source"), F.lit("region").alias("genetic_type"), "start", "stop", F.lit(None).alias("score"), F.lit("+").alias("strand"), F.lit(None).alias("phase"), notes.alias("attributes"))
    return df.unionByName(rows, allowMissingColumns=True)


def with_intergenic(df: DataFrame) -> DataFrame:
    """The rows and one of type intergenic for each stretch between genes of a seqid that no gene covers."""
    genes = df.where("genetic_type = 'gene'").select("seqid", "start", (F.col("stop") + 1).alias("end"))
    free = intervals.gaps(genes, ["seqid"]).select("seqid", F.lit("intergenic").alias("genetic_type"), "start", (F.col("end") - 1).alias("stop"))
    return df.unionByName(free, allowMissingColumns=True)


def feature_sequences(df: DataFrame, contigs: DataFrame, kinds: list[str], ident: Column, stranded: bool = False) -> DataFrame:
    """id and sequence of the features of ``kinds``, cut from ``contigs`` (seqid, sequence); with ``stranded``, those of the minus strand are reverse complements. Features of other contigs go."""
    rows = df.where(F.col("genetic_type").isin(kinds)).join(contigs.select("seqid", F.col("sequence").alias("__contig")), "seqid")
    cut = F.substr("__contig", F.col("start").cast("int"), (F.col("stop") - F.col("start") + 1).cast("int"))
    return rows.select(ident.alias("id"), (F.when(F.col("strand") == "-", sequence.reverse_complement(cut)).otherwise(cut) if stranded else cut).alias("sequence"))


def proteins(df: DataFrame, contigs: DataFrame, ident: Column) -> DataFrame:
    """id and protein of coding features, up to the first stop."""
    return feature_sequences(df, contigs, ["CDS"], ident, stranded=True).select("id", sequence.translated(F.col("sequence"), to_stop=True).alias("protein"))


def best_domains(df: DataFrame, query: str = "query_name", evalue: str = "i_evalue") -> DataFrame:
    """The row of each query with the least numeric e-value; rows without one are left out, ties go by all columns."""
    number = F.col(evalue).try_cast("double")
    columns = [c for c in df.columns if c != query]
    return df.where(number.isNotNull()).groupBy(query).agg(F.min(F.struct(number.alias("__e"), *columns)).alias("__row")).select(query, *(F.col(f"__row.{c}") for c in columns))


def annotated(df: DataFrame, hits: DataFrame, ident: Column, key: str, columns: dict[str, str]) -> DataFrame:
    """``df`` with columns of the hit whose ``key`` is the row's ``ident``; ``none`` where there is no hit."""
    found = hits.select(F.col(key).alias("__key"), *(F.col(c).alias(name) for name, c in columns.items()))
    return df.join(found, ident == F.col("__key"), "left").drop("__key").withColumns({name: F.coalesce(F.col(name).cast("string"), F.lit("none")) for name in columns})


def transcript_name(name: Column, chrom: Column, start: Column, end: Column) -> Column:
    return F.concat(name, F.lit(":"), chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def coding_blocks(blocks: Column, start: Column, end: Column) -> Column:
    """Blocks (start, end) of a transcript clipped to its coding range; those beside it go, those that touch it stay."""
    inside = F.filter(blocks, lambda b: (b["end"] >= start) & (b["start"] <= end))
    return F.transform(inside, lambda b: F.struct(F.greatest(b["start"], start).alias("start"), F.least(b["end"], end).alias("end")))


def directon_name(seqid: Column, strand: Column, number: Column, start: Column, stop: Column) -> Column:
    """seqid_p1_start_stop, m on the minus strand."""
    return F.concat(seqid, F.lit("_"), F.when(strand == "+", "p").otherwise("m"), number.cast("string"), F.lit("_"), start.cast("string"), F.lit("_"), stop.cast("string"))


def codons_at_ends(df: DataFrame, contigs: DataFrame, kind: str = "CDS") -> DataFrame:
    """strand, end (start or stop), codon and n: the first and last codons of features, read on their own strand. Features of fewer than three letters go."""
    cut = feature_sequences(df, contigs, [kind], F.struct("strand"), stranded=True).where(F.length("sequence") >= 3)
    ends = F.array(F.struct(F.lit("start").alias("end"), F.left("sequence", F.lit(3)).alias("codon")), F.struct(F.lit("stop").alias("end"), F.right("sequence", F.lit(3)).alias("codon")))
    return cut.select("id.strand", F.explode(ends).alias("x")).groupBy("strand", "x.end", "x.codon").agg(F.count("*").alias("n"))


def shifted(df: DataFrame, shifts: DataFrame, width: int = 100_000) -> DataFrame:
    """Features moved by the last shift (seqid, at, shift) at or before their start, and before their stop; 0 where there is none."""
    moved = intervals.as_of(df, shifts, ["seqid"], "start", "at", "shift", width).withColumnRenamed("shift", "__a")
    moved = intervals.as_of(moved, shifts, ["seqid"], "stop", "at", "shift", width).withColumnRenamed("shift", "__b")
    return moved.withColumns({"start": F.col("start") + F.coalesce("__a", F.lit(0)), "stop": F.col("stop") + F.coalesce("__b", F.lit(0))}).drop("__a", "__b")
