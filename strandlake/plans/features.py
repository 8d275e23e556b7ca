"""Queries of annotations: ``lineitem`` rows as features, a contig a return flag."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import formats
from strandlake.operators import features, intervals
from strandlake.plans.common import Registry, table
from strandlake.plans.sequences import _DNA, dna

query = Registry()
_F = """f AS (SELECT l_returnflag AS seqid, 'db' AS source, ['gene', 'CDS', 'tRNA', 'region'][(l_linenumber % 4 + 1)::BIGINT] AS genetic_type, l_partkey + 1 AS "start", l_partkey + 1 + l_quantity::BIGINT AS stop, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand,
 l_orderkey || '.' || l_linenumber AS id, CASE WHEN l_linenumber > 1 THEN l_orderkey || '.' || (l_linenumber - 1) END AS parent, l_linenumber % 3 = 0 AS noted FROM lineitem)"""


def annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = F.col, lambda x: F.col(x).cast("string")
    kind = F.element_at(F.array(*map(F.lit, ("gene", "CDS", "tRNA", "region"))), (c("l_linenumber") % 4 + 1).cast("int"))
    ident = F.concat(s("l_orderkey"), F.lit("."), s("l_linenumber"))
    parent = F.when(c("l_linenumber") > 1, F.concat(s("l_orderkey"), F.lit("."), (c("l_linenumber") - 1).cast("string")))
    cells = {"ID": ident, "gene_id": F.concat(F.lit("g"), ident), "Parent": parent, "Note": F.when(c("l_linenumber") % 3 == 0, "x")}
    notes = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in cells.items())), lambda e: e["v"].isNotNull()))
    return table(spark, sf_dir, "lineitem").select(c("l_returnflag").alias("seqid"), F.lit("db").alias("source"), kind.alias("genetic_type"), (c("l_partkey") + 1).alias("start"), (c("l_partkey") + 1 + c("l_quantity").cast("bigint")).alias("stop"), F.lit(None).cast("string").alias("score"), F.when(c("l_linestatus") == "O", "+").otherwise("-").alias("strand"), F.lit(None).cast("string").alias("phase"), notes.alias("attributes"))


def _id():
    return F.col("attributes")["ID"]


@query(f"""WITH {_F} SELECT id, "start" FROM f WHERE contains(id, '77') OR contains("start"::VARCHAR, '77')""")
def feature_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = annotation(spark, sf_dir).select(_id().alias("id"), "start")
    return features.containing(rows, "77")


@query("SELECT p_partkey, NOT (starts_with(n, 'tRNA-') OR starts_with(n, '28S') OR starts_with(n, '5.8S') OR starts_with(n, '18S') OR starts_with(n, '5S') OR n = 'tRNA') AS kept FROM (SELECT p_partkey, ['tRNA-', '28S', '5S', 'tRNA', 'tRNAx', '15S'][(p_partkey % 6 + 1)::BIGINT] || CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END AS n FROM part)")
def structural_rna(spark: SparkSession, sf_dir: str) -> DataFrame:
    stems = F.array(*map(F.lit, ("tRNA-", "28S", "5S", "tRNA", "tRNAx", "15S")))
    name = F.concat(F.element_at(stems, (F.col("p_partkey") % 6 + 1).cast("int")), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_brand")))
    return table(spark, sf_dir, "part").select("p_partkey", (~features.is_structural_rna(name)).alias("kept"))


@query(f"""WITH {_F} SELECT genetic_type, a AS attribute, count(*) AS n FROM (SELECT genetic_type, unnest(list_filter(['ID', 'gene_id', CASE WHEN parent IS NOT NULL THEN 'Parent' END, CASE WHEN noted THEN 'Note' END], lambda x: x IS NOT NULL)) AS a FROM f) GROUP BY ALL""")
def attribute_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.attribute_keys(annotation(spark, sf_dir), ["genetic_type"])


@query(f"WITH {_F} SELECT seqid, max(stop) AS size FROM f WHERE genetic_type = 'region' GROUP BY seqid")
def contig_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.sizes(annotation(spark, sf_dir))


@query(f"WITH {_F} SELECT parent, array_to_string(list_sort(list(DISTINCT id)), ',') AS children, count(DISTINCT id)::INTEGER AS n FROM f WHERE parent IS NOT NULL GROUP BY parent")
def transcript_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.children_of(annotation(spark, sf_dir)).select("parent", F.array_join("children", ",").alias("children"), "n")


@query(f"""WITH {_F} SELECT genetic_type, 0 AS "order", id, parent, NULL::VARCHAR AS phase FROM f UNION ALL SELECT 'mRNA', 1, 'g' || id || '.mRNA', 'g' || id, '.' FROM f WHERE genetic_type = 'gene' UNION ALL SELECT 'CDS', 2, 'g' || id || '.CDS', 'g' || id || '.mRNA', '0' FROM f WHERE genetic_type = 'gene'""")
def synthetic_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.with_transcripts(annotation(spark, sf_dir)).select("genetic_type", "order", "id", "parent", "phase")


@query(f"""WITH {_F}, r AS (SELECT seqid, min("start") AS a, max(stop) AS b FROM f WHERE seqid <> 'A' GROUP BY seqid) SELECT seqid, source, genetic_type, "start", stop FROM f UNION ALL SELECT seqid, 'header', 'region', a, b FROM r""")
def header_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = annotation(spark, sf_dir)
    regions = rows.where("seqid != 'A'").groupBy("seqid").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).union(spark.createDataFrame([("none", 1, 9)], "seqid string, start bigint, stop bigint"))
    return features.with_regions(rows, regions).select("seqid", "source", "genetic_type", "start", "stop")


@query(f"""WITH {_F}, g AS (SELECT seqid, "start" AS a, stop + 1 AS b FROM f WHERE genetic_type = 'gene'), w AS (SELECT seqid, a, max(b) OVER (PARTITION BY seqid ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g)
 SELECT seqid, genetic_type, "start", stop FROM f UNION ALL SELECT seqid, 'intergenic', reach, a - 1 FROM w WHERE a > reach""")
def with_intergenic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.with_intergenic(annotation(spark, sf_dir)).select("seqid", "genetic_type", "start", "stop")


_CONTIGS = f"{_DNA}, contigs AS (SELECT ['A', 'N', 'R'][(row_number() OVER (ORDER BY doc_id))::BIGINT] AS seqid, s FROM dna WHERE length(s) >= 3000 ORDER BY doc_id LIMIT 3)"
_RC = "reverse(translate({}, 'ACGT', 'TGCA'))"


def _contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = dna(spark, sf_dir).where("length(s) >= 3000").orderBy("doc_id").limit(3)
    names = F.array(*map(F.lit, "ANR"))
    numbered = first.groupBy().agg(F.array_sort(F.collect_list(F.struct("doc_id", "s"))).alias("x")).select(F.posexplode("x").alias("k", "x"))
    return numbered.select(F.element_at(names, F.col("k") + 1).alias("seqid"), F.col("x.s").alias("sequence"))


@query(f"""WITH {_F}, {_CONTIGS} SELECT id, CASE WHEN strand = '-' THEN {_RC.format('substr(s, "start", stop - "start" + 1)')} ELSE substr(s, "start", stop - "start" + 1) END AS sequence FROM f JOIN contigs USING (seqid) WHERE genetic_type IN ('gene', 'tRNA')""")
def feature_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.feature_sequences(annotation(spark, sf_dir), _contigs(spark, sf_dir), ["gene", "tRNA"], _id(), stranded=True)


_AMINO = "substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', ((strpos('TCAG', c[1]) - 1) * 16 + (strpos('TCAG', c[2]) - 1) * 4 + strpos('TCAG', c[3]))::BIGINT, 1)"


@query(f"""WITH {_F}, {_CONTIGS}, cut AS (SELECT id, CASE WHEN strand = '-' THEN {_RC.format('substr(s, "start", stop - "start" + 1)')} ELSE substr(s, "start", stop - "start" + 1) END AS s FROM f JOIN contigs USING (seqid) WHERE genetic_type = 'CDS')
 SELECT id, split_part(array_to_string(list_transform(regexp_extract_all(s, '...'), lambda c: {_AMINO}), ''), '*', 1) AS protein FROM cut""")
def feature_proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.proteins(annotation(spark, sf_dir), _contigs(spark, sf_dir), _id())


_HITS = "h AS (SELECT 'q' || l_orderkey AS query_name, l_returnflag AS target_name, 'PF' || l_suppkey AS query_accession, l_linestatus || ' domain ' || l_linenumber AS description, l_partkey AS ali_start, l_partkey + 40 AS ali_end, l_discount::VARCHAR AS i_evalue, l_linenumber FROM lineitem)"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("q"), s("l_orderkey")).alias("query_name"), F.col("l_partkey").alias("ali_start"), F.col("l_returnflag").alias("target_name"), F.concat(F.lit("PF"), s("l_suppkey")).alias("query_accession"), F.concat("l_linestatus", F.lit(" domain "), s("l_linenumber")).alias("description"), (F.col("l_partkey") + 40).alias("ali_end"), s("l_discount").alias("i_evalue"))


_BEST = f"{_HITS}, b AS (SELECT DISTINCT ON (query_name) * FROM h ORDER BY query_name, i_evalue::DOUBLE, ali_start, target_name, query_accession, description)"


@query(f"WITH {_BEST} SELECT concat_ws(chr(9), target_name, 'Pfam', 'protein_domain', ali_start, ali_end, round(i_evalue::DOUBLE, 2), '.', '.', 'ID=' || query_name || ';Name=' || replace(description, ' ', '_') || ';Pfam=' || query_accession) AS line FROM b")
def domain_gff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    best = features.best_domains(_hits(spark, sf_dir))
    return best.select(formats.gff_of_domain(c("target_name"), c("query_name"), c("query_accession"), c("description"), c("ali_start"), c("ali_end"), F.round(c("i_evalue").cast("double"), 2)).alias("line"))


@query(f"WITH {_BEST} SELECT o_orderkey, coalesce(query_accession, 'none') AS pfam, coalesce(description, 'none') AS annot FROM orders LEFT JOIN b ON query_name = 'q' || (o_orderkey * 2)")
def domain_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = features.best_domains(_hits(spark, sf_dir))
    ident = F.concat(F.lit("q"), (F.col("o_orderkey") * 2).cast("string"))
    return features.annotated(table(spark, sf_dir, "orders").select("o_orderkey"), best, ident, "query_name", {"pfam": "query_accession", "annot": "description"})


@query("SELECT concat_ws(chr(9), l_returnflag, 'blastn', 'match', least(a, b), greatest(a, b), l_suppkey, CASE WHEN a < b THEN '+' ELSE '-' END, '.', 'ID=q' || l_orderkey || '_' || l_returnflag || '_' || least(a, b) || '_' || greatest(a, b) || ';Name=q' || l_orderkey || ';Evalue=' || l_linenumber || ';Bitscore=' || l_suppkey) AS line FROM (SELECT *, l_partkey AS a, l_suppkey * 7 AS b FROM lineitem)")
def hit_gff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select(formats.gff_of_hit(F.concat(F.lit("q"), c("l_orderkey").cast("string")), c("l_returnflag"), c("l_partkey"), c("l_suppkey") * 7, c("l_linenumber"), c("l_suppkey")).alias("line"))


@query("""WITH r AS (SELECT l_orderkey, l_partkey AS a, (l_orderkey % 5) + l_partkey AS cs, l_partkey + 30 + l_orderkey % 9 AS ce, unnest(range(0, 4)) AS k FROM lineitem WHERE l_linenumber = 1)
 SELECT l_orderkey, greatest(a + 12 * k, cs) AS "start", least(a + 12 * k + 7, ce) AS "end" FROM r WHERE a + 12 * k + 7 >= cs AND a + 12 * k <= ce""")
def coding_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("l_partkey")
    blocks = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct((a + 12 * k).alias("start"), (a + 12 * k + 7).alias("end")))
    found = features.coding_blocks(blocks, F.col("l_orderkey") % 5 + a, a + 30 + F.col("l_orderkey") % 9)
    return table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select("l_orderkey", F.explode(found).alias("x")).select("l_orderkey", "x.*")


@query(f"""WITH {_F}, w AS (SELECT *, CASE WHEN lag(strand) OVER o = strand THEN 0 ELSE 1 END AS fresh FROM f WHERE genetic_type = 'gene' WINDOW o AS (PARTITION BY seqid ORDER BY "start", stop, id)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY seqid ORDER BY "start", stop, id) AS run FROM w),
 d AS (SELECT seqid, strand, run, min("start") AS a, max(stop) AS b FROM r GROUP BY ALL)
 SELECT concat_ws(chr(9), seqid, a, b, seqid || '_' || CASE strand WHEN '+' THEN 'p' ELSE 'm' END || run || '_' || a || '_' || b, 1, strand, a, b, CASE strand WHEN '+' THEN '255,0,0' ELSE '0,0,255' END) AS line FROM d""")
def directon_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = annotation(spark, sf_dir).where("genetic_type = 'gene'").withColumn("id", _id())
    runs = intervals.directons(genes, ["seqid"], ["start", "stop", "id"], "strand", end="stop")
    c = F.col
    return runs.select(formats.bed9(c("seqid"), c("start"), c("end"), features.directon_name(c("seqid"), c("strand"), c("run"), c("start"), c("end")), F.lit(1), c("strand")).alias("line"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'E' || l_partkey || '.1' ELSE 'E' || l_partkey || '.' || l_linenumber || '.T' || l_suppkey END AS exon_id FROM lineitem")
def exon_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    exon = F.concat(F.lit("E"), F.col("l_partkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, ".1").otherwise(""))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", formats.gtf_exon_id(exon, F.col("l_linenumber").cast("string"), F.concat(F.lit("T"), F.col("l_suppkey").cast("string"))).alias("exon_id"))


@query(f"""WITH {_F} SELECT concat_ws(chr(9), seqid, source, genetic_type, "start", stop, '.', strand, '.', 'ID=' || id || ';gene_id=g' || id || coalesce(';Parent=' || parent, '') || CASE WHEN noted THEN ';Note=x' ELSE '' END) AS line FROM f WHERE genetic_type IN ('gene', 'CDS')""")
def light_gff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = annotation(spark, sf_dir).where(c("genetic_type").isin("gene", "CDS"))
    return rows.select(formats.gff(c("seqid"), c("source"), c("genetic_type"), c("start"), c("stop"), c("score"), c("strand"), c("phase"), formats.gff_attributes(c("attributes"))).alias("line"))


@query("SELECT concat_ws(chr(9), 'peak_' || l_orderkey || '_' || l_linenumber, l_returnflag, l_partkey, l_partkey + 100, '+') AS line FROM lineitem")
def peak_saf(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select(formats.saf(F.concat_ws("_", F.lit("peak"), c("l_orderkey").cast("string"), c("l_linenumber").cast("string")), c("l_returnflag"), c("l_partkey"), c("l_partkey") + 100).alias("line"))


@query("SELECT concat_ws(chr(9), l_returnflag, l_partkey, l_partkey + l_linenumber, l_suppkey) AS line FROM lineitem")
def repeat_bedgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select(formats.bedgraph(c("l_returnflag"), c("l_partkey"), c("l_partkey") + c("l_linenumber"), c("l_suppkey")).alias("line"))


@query("SELECT l_orderkey, l_linenumber, concat_ws(',', floor(least(2 * x, 1) * 255)::BIGINT, floor(least(2 * x, 2 - 2 * x) * 255)::BIGINT, floor(least(2 - 2 * x, 1) * 255)::BIGINT) AS colour FROM (SELECT *, greatest(least((l_quantity - 10) / 30, 1), 0) AS x FROM lineitem)")
def score_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", formats.coloured(F.col("l_quantity").cast("double"), 10.0, 40.0).alias("colour"))


@query("SELECT concat_ws(chr(9), l_returnflag, l_partkey, '.', 'A', CASE WHEN l_linenumber > 2 THEN 'C,G' ELSE 'C' END, l_suppkey, 'PASS', CASE WHEN l_linenumber = 1 THEN 'INDEL;' ELSE '' END || 'DP=' || l_orderkey) AS line FROM lineitem")
def vcf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    depth = F.create_map(F.lit("DP"), c("l_orderkey").cast("string"))
    info = F.when(c("l_linenumber") == 1, F.map_concat(F.create_map(F.lit("INDEL"), F.lit("")), depth)).otherwise(depth)
    return table(spark, sf_dir, "lineitem").select(formats.vcf(c("l_returnflag"), c("l_partkey"), F.lit(None), F.lit("A"), F.when(c("l_linenumber") > 2, F.array(F.lit("C"), F.lit("G"))).otherwise(F.array(F.lit("C"))), c("l_suppkey"), F.lit("PASS"), info).alias("line"))


@query("SELECT s_suppkey, regexp_replace(replace(s_name || ';' || s_nationkey || CASE WHEN s_suppkey % 2 = 0 THEN ';;;' ELSE '' END, ';', ','), ',+$', '') AS line FROM supplier")
def sheet_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat("s_name", F.lit(";"), F.col("s_nationkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, ";;;").otherwise(""))
    return table(spark, sf_dir, "supplier").select("s_suppkey", formats.comma_separated(line).alias("line"))


@query(f"""WITH {_F}, {_CONTIGS}, cut AS (SELECT strand, CASE WHEN strand = '-' THEN {_RC.format('substr(s, "start", stop - "start" + 1)')} ELSE substr(s, "start", stop - "start" + 1) END AS s FROM f JOIN contigs USING (seqid) WHERE genetic_type = 'CDS'),
 e AS (SELECT strand, 'start' AS "end", left(s, 3) AS codon FROM cut WHERE length(s) >= 3 UNION ALL SELECT strand, 'stop', right(s, 3) FROM cut WHERE length(s) >= 3) SELECT strand, "end", codon, count(*) AS n FROM e GROUP BY ALL""")
def codons_at_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.codons_at_ends(annotation(spark, sf_dir), _contigs(spark, sf_dir))


@query(f"""WITH {_F}, h AS (SELECT DISTINCT l_returnflag AS seqid, l_suppkey * 9 AS at_, l_suppkey % 5 - 2 AS shift FROM lineitem WHERE l_suppkey % 2 = 0), a AS (SELECT f.id, f.seqid, f."start", f.stop, h.shift AS x FROM f ASOF LEFT JOIN h ON f.seqid = h.seqid AND f."start" >= h.at_)
 SELECT a.id, a."start" + coalesce(x, 0) AS "start", a.stop + coalesce(h.shift, 0) AS stop FROM a ASOF LEFT JOIN h ON a.seqid = h.seqid AND a.stop >= h.at_""")
def shifted_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_suppkey")
    shifts = table(spark, sf_dir, "lineitem").where("l_suppkey % 2 = 0").select(F.col("l_returnflag").alias("seqid"), (k * 9).alias("at"), (k % 5 - 2).alias("shift")).distinct()
    rows = annotation(spark, sf_dir).select("seqid", _id().alias("id"), "start", "stop")
    return features.shifted(rows, shifts, 50).select("id", "start", "stop")
