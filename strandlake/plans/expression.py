"""Queries of differential results and enriched terms: market segments as samples, parts as genes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import expression
from strandlake.plans.common import Registry, r6, table
from strandlake.plans.counts import _MATRIX, SEGMENTS, matrix

query = Registry()
OTHERS = [s for s in SEGMENTS if s != "BUILDING"]
_RESULTS = f"""{_MATRIX}, x AS (SELECT gene, n FROM m WHERE sample = 'BUILDING'), y AS (SELECT sample AS comparison, gene, n FROM m WHERE sample <> 'BUILDING'),
 d AS (SELECT comparison, gene, log2((y.n + 1) / (x.n + 1)) AS log2_fc, exp(-abs(log2((y.n + 1) / (x.n + 1))) * 3) AS padj FROM y JOIN x USING (gene))"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matrix(spark, sf_dir)
    base = m.where("sample = 'BUILDING'").select("gene", F.col("n").alias("x"))
    fold = F.log2((F.col("n") + 1) / (F.col("x") + 1))
    return m.where("sample != 'BUILDING'").join(base, "gene").select(F.col("sample").alias("comparison"), "gene", fold.alias("log2_fc"), F.exp(-F.abs(fold) * 3).alias("padj"))


@query(f"""WITH {_RESULTS} SELECT gene, {', '.join(f"round(max(log2_fc) FILTER (comparison = '{c}'), 6) AS {c.lower()}" for c in OTHERS)}, count(*) FILTER (padj < 0.05) AS n_significant, coalesce(array_to_string(list_sort(list(comparison) FILTER (padj < 0.05)), ','), '') AS significant FROM d GROUP BY gene""")
def dge_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = expression.total_table(results(spark, sf_dir), OTHERS, ["log2_fc"])
    return found.select("gene", *(r6(f"{c}_log2_fc").alias(c.lower()) for c in OTHERS), "n_significant", F.array_join("significant", ",").alias("significant"))


@query(f"""WITH {_RESULTS} SELECT comparison, count(*) FILTER (padj <= 0.01 AND log2_fc >= 1) AS up, count(*) FILTER (padj <= 0.01 AND log2_fc <= -1) AS down, count(*) FILTER (padj <= 0.01 AND abs(log2_fc) >= 1) AS "all" FROM d GROUP BY comparison""")
def dge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expression.summary(results(spark, sf_dir), 0.01, 1.0)


@query(f"""WITH {_RESULTS}, g AS (SELECT comparison, gene, log2_fc, unnest([CASE WHEN log2_fc > 0 THEN 'up' ELSE 'down' END, 'all']) AS direction FROM d WHERE padj <= 0.05 AND abs(log2_fc) >= 1)
 SELECT comparison, direction, rank::INTEGER AS rank, gene FROM (SELECT *, row_number() OVER (PARTITION BY comparison, direction ORDER BY abs(log2_fc) DESC, gene) AS rank FROM g) WHERE rank <= 15""")
def dge_top_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expression.gene_lists(results(spark, sf_dir), 0.05, 1.0, 15).select("comparison", "direction", "rank", "gene")


@query(f"""WITH {_RESULTS}, a AS (SELECT gene, log2_fc FROM d WHERE comparison = 'FURNITURE' AND padj <= 0.1), b AS (SELECT gene, log2_fc FROM d WHERE comparison = 'MACHINERY' AND padj <= 0.1)
 SELECT gene, CASE WHEN a.gene IS NULL THEN 'second' WHEN b.gene IS NULL THEN 'first' ELSE 'common' END AS place, round(a.log2_fc, 6) AS x, round(b.log2_fc, 6) AS y FROM a FULL JOIN b USING (gene)""".replace("a.gene IS NULL", "a.log2_fc IS NULL").replace("b.gene IS NULL", "b.log2_fc IS NULL"))
def dge_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = results(spark, sf_dir).where("padj <= 0.1")
    a, b = (kept.where(F.col("comparison") == c).select("gene", "log2_fc") for c in ("FURNITURE", "MACHINERY"))
    return expression.compared(a, b).select("gene", "place", r6("log2_fc_1").alias("x"), r6("log2_fc_2").alias("y"))


@query("SELECT l_partkey AS gene, max(coalesce(p_name, l_partkey::VARCHAR)) AS label, count(*) AS n FROM lineitem LEFT JOIN (SELECT p_partkey, max(p_name) AS p_name FROM part WHERE p_size % 2 = 0 GROUP BY 1) ON p_partkey = l_partkey GROUP BY 1")
def gene_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("gene")).agg(F.count("*").alias("n"))
    names = table(spark, sf_dir, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("gene"), "p_name")
    return expression.with_names(counts, names, "gene", "p_name").select("gene", "label", "n")


@query("SELECT DISTINCT ON (l_partkey) l_partkey AS gene, l_orderkey AS id, l_suppkey AS x FROM lineitem ORDER BY l_partkey, l_orderkey DESC, l_suppkey DESC")
def last_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("gene"), F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("x"))
    return expression.last_of_each(rows, "gene", ["id", "x"])


@query(f"WITH {_MATRIX}, g AS (SELECT count(DISTINCT gene) AS g FROM m) SELECT sample, round(sum(n), 6) AS total, first(g) - count(*) AS n_null, round(100.0 * (first(g) - count(*)) / first(g), 6) AS percentage_null FROM m, g GROUP BY sample")
def library_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expression.library_sizes(matrix(spark, sf_dir)).select("sample", r6("total").alias("total"), "n_null", r6("percentage_null").alias("percentage_null"))


@query(f"WITH {_MATRIX}, g AS (SELECT gene, sum(n) / 5 AS mean FROM m GROUP BY gene) SELECT (row_number() OVER (ORDER BY mean DESC, gene))::INTEGER AS rank, gene, round(mean, 6) AS mean FROM g ORDER BY mean DESC, gene LIMIT 20")
def most_expressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expression.most_expressed(matrix(spark, sf_dir), 5).select("rank", "gene", r6("mean").alias("mean"))


@query(f"WITH {_MATRIX} SELECT sample, arg_max(gene, {{'n': n, 'g': -gene}}) AS gene, round(100.0 * max(n) / sum(n), 6) AS percentage FROM m GROUP BY sample")
def most_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expression.most_present(matrix(spark, sf_dir)).select("sample", "gene", r6("percentage").alias("percentage"))


@query(f"WITH {_RESULTS}, k AS (SELECT DISTINCT gene FROM d WHERE comparison = 'FURNITURE' AND padj < 0.05 AND abs(log2_fc) > 1), v AS (SELECT gene, sample, 2 * sqrt(n + 3.0 / 8) AS v FROM m WHERE gene IN (SELECT gene FROM k)) SELECT gene, sample, round(v - avg(v) OVER (PARTITION BY gene), 6) AS centred FROM v")
def centred_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.functions import quality

    genes = results(spark, sf_dir).where("comparison = 'FURNITURE' AND padj < 0.05 AND abs(log2_fc) > 1")
    return expression.centred(matrix(spark, sf_dir), quality.anscombe(F.col("n")), genes).select("gene", "sample", r6("centred").alias("centred"))


@query(f"WITH {_MATRIX}, s AS (SELECT gene, stddev_samp(n) AS std FROM m GROUP BY gene HAVING count(*) > 1) SELECT (row_number() OVER (ORDER BY std DESC, gene))::INTEGER AS rank, gene, round(std, 6) AS std FROM s ORDER BY std DESC, gene LIMIT 25")
def most_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expression.most_variable(matrix(spark, sf_dir), 25).select("rank", "gene", r6("std").alias("std"))


@query("""WITH l AS (SELECT DISTINCT p_type AS label FROM part), g AS (SELECT left(label, 1) AS f, min(label) AS a, max(label) AS b FROM l GROUP BY 1), s AS (SELECT f, CASE WHEN a = b THEN a ELSE list_max(list_filter(list_transform(range(1, length(a) + 1), lambda k: substr(a, 1, k)), lambda p: starts_with(b, p))) END AS c FROM g)
 SELECT label, rtrim(c, '_') AS condition FROM l JOIN s ON f = left(label, 1)""")
def guessed_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expression.conditions(table(spark, sf_dir, "part").select(F.col("p_type").alias("label")).distinct())


@query("SELECT coalesce((SELECT l_returnflag FROM lineitem WHERE l_quantity > 25 GROUP BY l_returnflag ORDER BY count(*) DESC, l_returnflag LIMIT 1), 'undecided') AS strand")
def consensus_strand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expression.consensus_strand(table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_returnflag").alias("strand")), "strand")


_TERMS = "t AS (SELECT l_suppkey AS term, avg(l_discount) AS p FROM lineitem GROUP BY 1), r AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k, count(*) OVER () AS n FROM t), a AS (SELECT term, p, least(1.0, min(p * n / k) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS padj FROM r)"


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("term")).agg(F.avg("l_discount").alias("p"))


@query(f"WITH {_TERMS} SELECT term, round(padj, 6) AS padj, round(-log10(padj), 6) AS score, padj <= 0.05 AS significant FROM a")
def adjusted_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expression.adjusted_terms(_terms(spark, sf_dir), 0.05).select("term", r6("padj").alias("padj"), r6("score").alias("score"), "significant")


@query("WITH t AS (SELECT l_suppkey AS term, avg(l_discount) AS p, avg(l_tax) AS padj FROM lineitem GROUP BY 1), k AS (SELECT term, -log10(p) AS f FROM t WHERE padj <= 0.041 AND term NOT IN (1, 2, 3)) SELECT (row_number() OVER (ORDER BY f DESC, term))::INTEGER AS rank, term, round(f, 6) AS fold_enrichment, round(log2(f), 6) AS log2_fold_enrichment FROM k WHERE f > 0 ORDER BY f DESC, term LIMIT 30")
def term_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("term")).agg(F.avg("l_discount").alias("p"), F.avg("l_tax").alias("padj"))
    found = expression.term_report(terms, 0.041, [1, 2, 3], 30)
    return found.select("rank", "term", r6("fold_enrichment").alias("fold_enrichment"), r6("log2_fold_enrichment").alias("log2_fold_enrichment"))


@query("SELECT DISTINCT p_partkey AS gene, trim(unnest(string_split(replace(p_type, ' ', ';'), ';'))) AS term FROM part")
def term_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene"), F.replace("p_type", F.lit(" "), F.lit(" ; ")).alias("terms"))
    return expression.members_by_term(rows, "gene", "terms", ";")


def _pathways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("term"), F.concat(F.lit("Gene"), F.col("p_partkey").cast("string")).alias("gene"))


@query(f"""WITH {_RESULTS}, f AS (SELECT 'GENE' || gene AS g, log2_fc, padj FROM d WHERE comparison = 'FURNITURE') SELECT p_brand AS term, 'Gene' || p_partkey AS gene, CASE WHEN padj <= 0.05 AND log2_fc > 0 THEN '+' WHEN padj <= 0.05 AND log2_fc < 0 THEN '-' ELSE '=' END AS type, round(-log10(padj), 6) AS score, round(log2_fc, 6) AS log2_fc
 FROM part LEFT JOIN f ON lower(g) = lower('Gene' || p_partkey)""")
def pathway_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = results(spark, sf_dir).where("comparison = 'FURNITURE'").select(F.concat(F.lit("GENE"), F.col("gene").cast("string")).alias("gene"), "log2_fc", "padj")
    found = expression.pathway_members(_pathways(spark, sf_dir), own)
    return found.select("term", "gene", "type", r6("score").alias("score"), r6("log2_fc").alias("log2_fc"))


@query("SELECT p_partkey AS gene_id, p_brand AS term FROM part WHERE p_partkey IN (7, 19)")
def pathways_of_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [expression.terms_of(_pathways(spark, sf_dir), f"GENE{k}").select(F.lit(k).cast("bigint").alias("gene_id"), "term") for k in (7, 19)]
    return reduce(DataFrame.union, found)


@query("""WITH p AS (SELECT p_brand AS term, p_partkey AS gene, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.08) AS hit FROM part), t AS (SELECT count(*) AS n, count(*) FILTER (hit) AS k FROM p)
 SELECT term, CASE WHEN term < 'Brand#33' THEN 'MF' ELSE 'BP' END AS ontology, count(*) AS number_in_reference, count(*) FILTER (hit) AS number_in_list, round(count(*) * first(k) / first(n), 6) AS expected, round(count(*) FILTER (hit) / nullif(count(*) * first(k) / first(n), 0), 6) AS fold FROM p, t GROUP BY term""")
def ontology_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "part").select(F.col("p_brand").alias("term"), F.col("p_partkey").alias("gene"))
    terms = members.select("term").distinct().withColumn("ontology", F.when(F.col("term") < "Brand#33", "MF").otherwise("BP"))
    hits = table(spark, sf_dir, "lineitem").where("l_quantity >= 50 AND l_discount >= 0.08").select(F.col("l_partkey").alias("gene"))
    found = expression.ontology_counts(terms, members, hits)
    return found.select("term", "ontology", "number_in_reference", "number_in_list", r6("expected").alias("expected"), r6("fold").alias("fold"))
