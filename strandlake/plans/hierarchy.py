"""Queries of taxa, classified reads and sample models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import hierarchy
from strandlake.plans.common import Registry, r6, table
from strandlake.plans.counts import _MATRIX, _TREE, matrix, tree

query = Registry()


@query(f"WITH RECURSIVE {_TREE}, up AS (SELECT id, parent FROM tree WHERE id >= 1000 AND id % 17 = 0 UNION SELECT t.id, t.parent FROM up JOIN tree t ON t.id = up.parent) SELECT DISTINCT id, parent FROM up")
def taxa_with_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree(spark, sf_dir)
    return hierarchy.with_ancestors(nodes, nodes.where("id >= 1000 AND id % 17 = 0").select("id"), 4)


@query(f"WITH {_TREE} SELECT id, parent FROM tree WHERE id % 5 = 0")
def taxa_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree(spark, sf_dir)
    return hierarchy.parents_of(nodes, nodes.where("id % 5 = 0").select("id"))


@query("SELECT c_mktsegment AS rank, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1")
def taxa_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.rank_counts(table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "rank"))


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'r#00000001') AND c_mktsegment = 'BUILDING'")
def taxa_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hierarchy.members_of_rank(table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "rank"), "BUILDING")
    return hierarchy.named_like(rows, "R#00000001", "c_name").select("c_custkey", "c_name")


@query("SELECT round(avg(n), 6) AS mean FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def names_per_taxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.names_per_node(table(spark, sf_dir, "orders"), "o_custkey").select(r6("mean").alias("mean"))


@query("SELECT label, sum(n)::BIGINT AS n FROM (SELECT l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT o_orderstatus, count(*) FROM orders GROUP BY 1) GROUP BY label")
def merged_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("label")).agg(F.count("*").alias("n"))
    return hierarchy.merged_counters([one, table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("label")).agg(F.count("*").alias("n"))], "label", "n")


_DBS = "c AS (SELECT event_id AS read, CASE WHEN user_id % 3 = 0 THEN user_id % 7 ELSE 0 END AS a, CASE WHEN user_id % 4 = 0 THEN user_id % 5 ELSE 0 END AS b, event_type AS sample FROM events), f AS (SELECT read, sample, CASE WHEN a <> 0 THEN a WHEN b <> 0 THEN b ELSE 0 END AS taxon, CASE WHEN a <> 0 THEN 0 WHEN b <> 0 THEN 1 END::INTEGER AS database FROM c)"


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumnRenamed("event_id", "read")
    databases = [rows.select("read", F.when(F.col("user_id") % k == 0, F.col("user_id") % m).otherwise(0).alias("taxon")) for k, m in ((3, 7), (4, 5))]
    return hierarchy.first_classified(databases, "read", "taxon")


@query(f"WITH {_DBS} SELECT read, taxon, database FROM f")
def first_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir)


@query(f"WITH {_DBS} SELECT sample, count(*) AS nreads, round(100.0 * count(*) FILTER (database IS NULL) / count(*), 2) AS unclassified, round(100.0 * count(*) FILTER (database = 0) / count(*), 2) AS db_0, round(100.0 * count(*) FILTER (database = 1) / count(*), 2) AS db_1 FROM f GROUP BY sample")
def sample_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = _classified(spark, sf_dir).join(table(spark, sf_dir, "events").select(F.col("event_id").alias("read"), F.col("event_type").alias("sample")), "read")
    return hierarchy.sample_summary(reads, "sample", "database", [0, 1])


@query("WITH s AS (SELECT p_type AS label, 100.0 * sum(p_size) / (SELECT sum(p_size) FROM part) AS p FROM part GROUP BY 1) SELECT CASE WHEN p >= 0.8 THEN label ELSE 'others' END AS label, round(sum(p), 6) AS percentage FROM s GROUP BY 1")
def small_taxa_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.with_others(table(spark, sf_dir, "part").withColumnRenamed("p_type", "label"), [], "label", "p_size", 0.8).select("label", r6("percentage").alias("percentage"))


@query(f"WITH {_MATRIX}, c AS (SELECT gene, sample, n - avg(n) OVER (PARTITION BY gene) AS x FROM m) SELECT x.sample AS a, y.sample AS b, round(sum(x.x * y.x), 0) AS product FROM c x JOIN c y ON x.gene = y.gene AND x.sample <= y.sample GROUP BY ALL")
def sample_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.sample_products(matrix(spark, sf_dir), "gene", "sample", "n").select("a", "b", F.round("product", 0).alias("product"))


@query(f"WITH {_MATRIX}, g AS (SELECT DISTINCT gene FROM m), s AS (SELECT DISTINCT sample FROM m), f AS (SELECT gene, sample, coalesce(n, 0) AS n FROM g, s LEFT JOIN m USING (gene, sample)) SELECT x.sample AS a, y.sample AS b, round(sqrt(sum(pow(x.n - y.n, 2))), 4) AS distance FROM f x JOIN f y ON x.gene = y.gene AND x.sample < y.sample GROUP BY ALL".replace("FROM g, s LEFT JOIN m USING (gene, sample)", "FROM (SELECT * FROM g, s) LEFT JOIN m USING (gene, sample)"))
def sample_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.sample_distances(matrix(spark, sf_dir), "gene", "sample", "n").select("a", "b", F.round("distance", 4).alias("distance"))


@query("WITH s AS (SELECT p_brand AS g, count(*) AS n, avg(p_retailprice) AS m, var_pop(p_retailprice) AS v FROM part GROUP BY 1) SELECT x.g AS a, y.g AS b, round(x.n * y.n / (x.n + y.n) * pow(x.m - y.m, 2) / nullif((x.n * x.v + y.n * y.v) / nullif(x.n + y.n - 2, 0), 0), 6) AS f FROM s x JOIN s y ON x.g < y.g")
def variance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("g"), "p_retailprice")
    return hierarchy.variance_pairs(rows, "g", "p_retailprice").select("a", "b", r6("f").alias("f"))


@query("SELECT l_returnflag AS chrom, round(quantile_cont(l_quantity, 0.5), 6) AS median, round(2 * quantile_cont(l_quantity, 0.5) / 25, 6) AS somy FROM lineitem GROUP BY 1")
def ploidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("chrom"), "l_quantity")
    return hierarchy.ploidy(rows, ["chrom"], "l_quantity", 25.0).select("chrom", r6("median").alias("median"), r6("somy").alias("somy"))


@query("""WITH c AS (SELECT l_returnflag AS k, l_suppkey * 2 + l_linenumber % 2 AS p, count(*) AS n FROM lineitem GROUP BY ALL), h AS (SELECT n, count(*) AS c FROM c GROUP BY n), w AS (SELECT n, c, coalesce(sum(c) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(c) OVER () AS t FROM h),
 q AS (SELECT n, greatest(least(c, floor(t * 0.9) - b), 0) AS c FROM w), l AS (SELECT greatest(1, ceil(sum(c * n) / sum(c) + 1.0 * sqrt((sum(c * n * n) - sum(c * n) * sum(c * n) / sum(c)) / nullif(sum(c) - 1, 0) + 0.1))) AS lim FROM q) SELECT k, p, n FROM c, l WHERE n <= lim""")
def usual_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("k"), (F.col("l_suppkey") * 2 + F.col("l_linenumber") % 2).alias("p"))
    return hierarchy.usual_positions(tags, ["k"], "p", 0.1, 1.0).groupBy("k", "p").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity <= 5 THEN 0.1 WHEN l_quantity <= 20 THEN 0.1 + (l_quantity - 5) * (0.7 - 0.1) / 15 WHEN l_quantity <= 45 THEN 0.7 + (l_quantity - 20) * (0.2 - 0.7) / 25 ELSE 0.2 END, 6) AS density FROM lineitem")
def interpolated_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = hierarchy.interpolated(F.col("l_quantity"), [5, 20, 45], [0.1, 0.7, 0.2])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(x).alias("density"))
