"""Lines of text formats from columns: GFF, GTF, BED, SAF, bedGraph, VCF, krona and others."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colours of strands in BED files.
STRAND_COLOURS = {"+": "255,0,0", "-": "0,0,255"}


def tabbed(*columns: Column, missing: str = ".") -> Column:
    """Columns by tabs; null is ``missing``."""
    return F.concat_ws("\t", *(F.coalesce(c.cast("string"), F.lit(missing)) for c in columns))


def gff_attributes(attributes: Column, quoted: bool = False) -> Column:
    """``key=value`` pairs (or ``key "value"``, as GTF has them) by semicolons, in the map's order; null values go."""
    pairs = F.filter(F.map_entries(attributes), lambda e: e["value"].isNotNull())
    one = (lambda e: F.concat(e["key"], F.lit(' "'), e["value"], F.lit('"'))) if quoted else (lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(F.transform(pairs, one), "; " if quoted else ";")


def gff(seqid: Column, source: Column, kind: Column, start: Column, stop: Column, score: Column, strand: Column, phase: Column, attributes: Column) -> Column:
    return tabbed(seqid, source, kind, start, stop, score, strand, phase, attributes)


def gff_of_hit(query: Column, subject: Column, start: Column, end: Column, evalue: Column, score: Column) -> Column:
    """A match feature of a tabular alignment hit: from the lesser to the greater end, on the strand that their order says."""
    low, high = F.least(start, end), F.greatest(start, end)
    s = lambda c: c.cast("string")
    notes = F.concat(F.lit("ID="), query, F.lit("_"), subject, F.lit("_"), s(low), F.lit("_"), s(high), F.lit(";Name="), query, F.lit(";Evalue="), s(evalue), F.lit(";Bitscore="), s(score))
    return gff(subject, F.lit("blastn"), F.lit("match"), low, high, score, F.when(start < end, "+").otherwise("-"), F.lit(None), notes)


def gff_of_domain(target: Column, query: Column, accession: Column, description: Column, start: Column, end: Column, evalue: Column, offset: Column | None = None) -> Column:
    """A protein_domain feature; with ``offset``, the start of its gene, in coordinates of the genome."""
    shift = F.lit(0) if offset is None else offset
    notes = F.concat(F.lit("ID="), query, F.lit(";Name="), F.replace(description, F.lit(" "), F.lit("_")), F.lit(";Pfam="), accession)
    return gff(target, F.lit("Pfam"), F.lit("protein_domain"), start + shift, end + shift, evalue, F.lit(None), F.lit(None), notes)


def bed(chrom: Column, start: Column, end: Column, *rest: Column) -> Column:
    return tabbed(chrom, start, end, *rest)


def bed9(chrom: Column, start: Column, end: Column, name: Column, score: Column, strand: Column) -> Column:
    """With thick ends and the strand's colour; 0,0,0 for other strands."""
    colour = F.when(strand == "+", STRAND_COLOURS["+"]).when(strand == "-", STRAND_COLOURS["-"]).otherwise("0,0,0")
    return bed(chrom, start, end, name, score, strand, start, end, colour)


def saf(name: Column, chrom: Column, start: Column, end: Column) -> Column:
    """A peak of a simplified annotation, on the plus strand."""
    return tabbed(name, chrom, start, end, F.lit("+"))


def bedgraph(chrom: Column, start: Column, end: Column, value: Column) -> Column:
    return tabbed(chrom, start, end, value)


def coloured(value: Column, low: float, high: float) -> Column:
    """r,g,b of a value on a scale from blue (``low``) over white to red (``high``); beyond, the end's colour."""
    x = F.greatest(F.least((value - low) / (high - low), F.lit(1.0)), F.lit(0.0))
    rise, fall = F.floor(F.least(2 * x, F.lit(1.0)) * 255).cast("string"), F.floor(F.least(2 - 2 * x, F.lit(1.0)) * 255).cast("string")
    return F.concat_ws(",", rise, F.floor(F.least(2 * x, 2 - 2 * x) * 255).cast("string"), fall)


def vcf(chrom: Column, pos: Column, ident: Column, ref: Column, alts: Column, qual: Column, status: Column, info: Column) -> Column:
    """Eight columns of a call; ``alts`` is an array, ``info`` a map, a key with a null or empty value is a flag."""
    entries = F.transform(F.map_entries(info), lambda e: F.when(F.coalesce(e["value"], F.lit("")) == "", e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"])))
    return tabbed(chrom, pos, ident, ref, F.nullif(F.array_join(alts, ","), F.lit("")), qual, status, F.nullif(F.array_join(entries, ";"), F.lit("")))


def krona(count: Column, lineage: Column) -> Column:
    """The count and the lineage's names (an array) by tabs; an empty lineage is Unclassified."""
    return F.concat_ws("\t", count.cast("string"), F.when(F.size(lineage) > 0, F.array_join(lineage, "\t")).otherwise("Unclassified"))


def fasta(header: Column, seq: Column, width: int = 80) -> Column:
    """A record: header, and the sequence in lines of ``width`` letters."""
    return F.concat(F.lit(">"), header, F.lit("\n"), F.rtrim(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), F.lit("\n")))


def meme_row(weights: Column) -> Column:
    """A row of a position weight matrix (an array), with six decimals."""
    return F.array_join(F.transform(weights, lambda w: F.format_number(w, "0.000000")), " ")


def envelope(name: str, sample: Column, data: Column, version: str = "1") -> Column:
    """JSON of a summary: its name, sample, version and data (a struct)."""
    return F.to_json(F.struct(F.lit(name).alias("name"), sample.alias("sample_name"), F.lit(version).alias("version"), data.alias("data")))


def gtf_exon_id(exon: Column, version: Column, transcript: Column) -> Column:
    """exon.version.transcript where the exon's id has no dot, so that ids are unique."""
    return F.when(exon.contains("."), exon).otherwise(F.concat_ws(".", exon, version, transcript))


def comma_separated(line: Column) -> Column:
    """A line of a sheet with semicolons as commas and without separators at its end."""
    return F.rtrim(F.replace(line, F.lit(";"), F.lit(",")), F.lit(","))
