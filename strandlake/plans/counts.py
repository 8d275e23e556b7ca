"""Count-matrix queries: merges, differential tables, sets, ranks, taxa and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.operators import enrichment as enriched
from strandlake.operators import tables
from strandlake.plans.common import Registry, r6, table

query = Registry()
_YEAR = "year(l_shipdate)"
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("SELECT l_partkey AS gene, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1")
def feature_counts_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("gene"), F.col("l_returnflag").alias("flag"), F.lit(1).cast("bigint").alias("one"))
    return tables.pivoted(rows, ["gene"], "flag", ["A", "N", "R"], "one").toDF("gene", "a", "n", "r")


@query(f"SELECT {_YEAR}::INTEGER AS sample, count(*) FILTER (l_linestatus = 'O') AS fwd, count(*) FILTER (l_linestatus = 'F') AS rev, CASE WHEN count(*) FILTER (l_linestatus = 'O') / count(*) < 0.15 THEN 'reverse' WHEN count(*) FILTER (l_linestatus = 'O') / count(*) > 0.85 THEN 'forward' WHEN count(*) FILTER (l_linestatus = 'O') / count(*) BETWEEN 0.35 AND 0.65 THEN 'unstranded' END AS strandness FROM lineitem WHERE l_linestatus IN ('O', 'F') GROUP BY 1")
def strandness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_linestatus").isin("O", "F")).groupBy(F.year("l_shipdate").alias("sample")).agg(F.count_if(F.col("l_linestatus") == "O").alias("fwd"), F.count_if(F.col("l_linestatus") == "F").alias("rev"))
    return rows.withColumn("strandness", tables.strandness(F.col("fwd"), F.col("rev")))


_MATRIX = "m AS (SELECT l_partkey AS gene, c_mktsegment AS sample, sum(l_quantity) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("sample")), "o_custkey")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("gene"), "l_quantity")
    return rows.join(orders, "o_orderkey").groupBy("gene", "sample").agg(F.sum("l_quantity").alias("n"))


@query(f"WITH {_MATRIX} SELECT gene, count(*) FILTER (n >= 100) AS samples, sum(n) AS total FROM m GROUP BY gene HAVING count(*) FILTER (n >= 100) >= 2")
def low_count_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(spark, sf_dir).groupBy("gene").agg(F.count_if(F.col("n") >= 100).alias("samples"), F.sum("n").alias("total")).where("samples >= 2")


_DGE = f"{_MATRIX}, w AS (SELECT gene, coalesce(sum(n) FILTER (sample = 'BUILDING'), 0) AS x, coalesce(sum(n) FILTER (sample = 'MACHINERY'), 0) AS y FROM m GROUP BY gene), d AS (SELECT gene, log2((x + 1) / (y + 1)) AS lfc, exp(-abs(log2((x + 1) / (y + 1))) * 3) AS padj FROM w)"


def differential(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tables.pivoted(matrix(spark, sf_dir), ["gene"], "sample", ["BUILDING", "MACHINERY"], "n")
    lfc = F.log2((F.col("BUILDING") + 1) / (F.col("MACHINERY") + 1))
    return w.select("gene", lfc.alias("lfc"), F.exp(-F.abs(lfc) * 3).alias("padj"))


@query(f"WITH {_DGE} SELECT gene, round(lfc, 6) AS lfc, round(padj, 6) AS padj, CASE WHEN lfc > 0 THEN 'up' ELSE 'down' END AS direction FROM d WHERE padj <= 0.05 AND abs(lfc) >= 1")
def dge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = differential(spark, sf_dir).where(tables.significant(F.col("lfc"), F.col("padj"), 0.05, 1.0))
    return kept.select("gene", r6("lfc").alias("lfc"), r6("padj").alias("padj"), tables.direction(F.col("lfc")).alias("direction"))


@query(f"WITH {_DGE} SELECT CASE WHEN lfc > 0 THEN 'up' ELSE 'down' END AS direction, count(*) AS n, min(gene) AS first_gene, max(gene) AS last_gene FROM d WHERE padj <= 0.05 AND abs(lfc) >= 1 GROUP BY 1")
def dge_gene_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dge_filter(spark, sf_dir).groupBy("direction").agg(F.count("*").alias("n"), F.min("gene").alias("first_gene"), F.max("gene").alias("last_gene"))


@query(f"WITH {_MATRIX}, hi AS (SELECT gene, sample FROM m WHERE n >= 150) SELECT gene FROM hi WHERE sample = 'BUILDING' INTERSECT SELECT gene FROM hi WHERE sample = 'MACHINERY'")
def dge_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = matrix(spark, sf_dir).where("n >= 150")
    return high.where("sample = 'BUILDING'").select("gene").intersect(high.where("sample = 'MACHINERY'").select("gene"))


@query("WITH s AS (SELECT DISTINCT l_suppkey AS item, l_returnflag || l_linestatus AS label FROM lineitem WHERE l_quantity > 48), k AS (SELECT item, bit_or(CASE label WHEN 'AF' THEN 1 WHEN 'NF' THEN 2 WHEN 'NO' THEN 4 WHEN 'RF' THEN 8 ELSE 0 END)::INTEGER AS mask FROM s WHERE label IN ('AF', 'NF', 'NO', 'RF') GROUP BY item) SELECT mask, count(*) AS n FROM k GROUP BY mask")
def venn_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_suppkey").alias("item"), F.concat("l_returnflag", "l_linestatus").alias("label"))
    return tables.set_regions(rows, "item", "label", ["AF", "NF", "NO", "RF"])


@query("""WITH p AS (SELECT DISTINCT p_brand, p_type FROM part), s AS (SELECT p_brand, count(*) AS n FROM p GROUP BY 1), c AS (SELECT x.p_brand AS a, y.p_brand AS b, count(*) AS common FROM p x JOIN p y USING (p_type) WHERE x.p_brand < y.p_brand GROUP BY ALL)
 SELECT a, b, common, round(common / (x.n + y.n - common), 6) AS jaccard FROM c JOIN s x ON x.p_brand = a JOIN s y ON y.p_brand = b""")
def jaccard_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.set_sizes(table(spark, sf_dir, "part"), "p_type", "p_brand").select("a", "b", "common", r6("jaccard").alias("jaccard"))


@query("SELECT p_brand, round(sum(l_quantity * p_size) / nullif(sum(l_quantity), 0), 6) AS effective_length, sum(l_quantity) AS tpm FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand")
def effective_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    joined = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q")).join(part, "l_partkey")
    return joined.groupBy("p_brand").agg(r6(F.sum(F.col("q") * F.col("p_size")) / F.nullif(F.sum("q"), F.lit(0.0))).alias("effective_length"), F.sum("q").alias("tpm"))


@query(f"WITH {_MATRIX} SELECT x.sample AS a, y.sample AS b, count(*) FILTER (abs(x.n - y.n) <= 0.1 * greatest(x.n, y.n)) AS close, count(*) AS n, round(corr(x.n, y.n), 6) AS correlation FROM m x JOIN m y ON x.gene = y.gene AND x.sample < y.sample GROUP BY ALL")
def pairwise_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matrix(spark, sf_dir)
    pairs = m.select("gene", F.col("sample").alias("a"), F.col("n").alias("x")).join(m.select("gene", F.col("sample").alias("b"), F.col("n").alias("y")), "gene").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count_if(F.abs(F.col("x") - F.col("y")) <= 0.1 * F.greatest("x", "y")).alias("close"), F.count("*").alias("n"), r6(F.corr("x", "y")).alias("correlation"))


_TREE = "tree AS (SELECT r_regionkey::BIGINT AS id, NULL::BIGINT AS parent FROM region UNION ALL SELECT 100 + n_nationkey, n_regionkey FROM nation UNION ALL SELECT 1000 + c_custkey, 100 + c_nationkey FROM customer)"


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = lambda c: F.col(c).cast("bigint")
    regions = table(spark, sf_dir, "region").select(big("r_regionkey").alias("id"), F.lit(None).cast("bigint").alias("parent"))
    nations = table(spark, sf_dir, "nation").select((100 + big("n_nationkey")).alias("id"), big("n_regionkey").alias("parent"))
    return regions.union(nations).union(table(spark, sf_dir, "customer").select((1000 + F.col("c_custkey")).alias("id"), (100 + big("c_nationkey")).alias("parent")))


@query(f"WITH RECURSIVE {_TREE}, up AS (SELECT id, parent, id::VARCHAR AS path FROM tree UNION ALL SELECT up.id, tree.parent, tree.id || '/' || path FROM up JOIN tree ON tree.id = up.parent) SELECT id, path FROM up WHERE parent IS NULL")
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.lineage(tree(spark, sf_dir), 4).select("id", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


@query("SELECT n_regionkey::BIGINT AS region, count(*) AS n, round(sum(c_acctbal), 6) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def rank_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = tables.lineage(tree(spark, sf_dir), 4).where(F.size("path") == 3).select((F.col("id") - 1000).alias("c_custkey"), F.element_at("path", 1).alias("region"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").join(paths, "c_custkey").groupBy("region").agg(F.count("*").alias("n"), r6(F.sum("c_acctbal")).alias("balance"))


@query("WITH s AS (SELECT o_orderpriority AS grp, c_nationkey, n_regionkey, c_custkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_totalprice > 400000) SELECT grp || '-' || c_nationkey AS grp, CASE WHEN count(DISTINCT c_custkey) = 1 THEN 1000 + min(c_custkey) ELSE 100 + min(c_nationkey) END::BIGINT AS lca FROM s GROUP BY grp, c_nationkey")
def lca(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = tables.lineage(tree(spark, sf_dir), 4).select((F.col("id") - 1000).alias("c_custkey"), "path")
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    rows = orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey").join(paths, "c_custkey")
    return rows.groupBy(F.concat_ws("-", "o_orderpriority", F.col("c_nationkey").cast("string")).alias("grp")).agg(tables.lowest_common("path").alias("lca"))


@query(f"WITH {_TREE} SELECT parent AS id, count(*) AS children FROM tree WHERE parent IS NOT NULL GROUP BY 1")
def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree(spark, sf_dir).where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("children"))


@query("SELECT event_type AS taxon, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percentage FROM events GROUP BY 1")
def kraken_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("taxon")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("taxon", "n", r6(100.0 * F.col("n") / F.col("total")).alias("percentage"))  # one row


@query("SELECT user_id % 4 AS sample, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1")
def rank_by_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("sample"), "event_type", F.lit(1).cast("bigint").alias("one"))
    return tables.pivoted(rows, ["sample"], "event_type", ["view", "click", "purchase"], "one")


@query("""WITH hit AS (SELECT DISTINCT l_partkey AS gene FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.09), g AS (SELECT p_partkey AS gene, p_brand AS term FROM part)
 SELECT term, count(*) AS size, count(hit.gene) AS overlap FROM g LEFT JOIN hit USING (gene) GROUP BY term""")
def enrichment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enrichment(spark, sf_dir).select("term", "size", "overlap")


def _enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "lineitem").where("l_quantity >= 50 AND l_discount >= 0.09").select(F.col("l_partkey").alias("gene")).distinct()
    terms = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("term"))
    return enriched.over_representation(terms, hits, "term", "gene")


def _choose(n: str, k: str) -> str:
    return f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"


@query(f"""WITH hit AS (SELECT DISTINCT l_partkey AS gene FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.09), g AS (SELECT p_partkey AS gene, p_brand AS term FROM part), c AS (SELECT term, count(*) AS size, count(hit.gene) AS a FROM g LEFT JOIN hit USING (gene) GROUP BY term),
 u AS (SELECT count(*) AS n, count(hit.gene) AS d FROM (SELECT DISTINCT gene FROM g) x LEFT JOIN hit USING (gene)), k AS (SELECT c.*, u.*, unnest(range(a, least(size, d) + 1)) AS k FROM c, u),
 t AS (SELECT term, sum(exp({_choose('size', 'k')} + {_choose('(n - size)', '(d - k)')} - {_choose('n', 'd')})) AS s FROM k WHERE d - k <= n - size GROUP BY term), p AS (SELECT term, size, a, n, d, CASE WHEN a <= 0 THEN 1.0 ELSE least(1.0, s) END AS p FROM c JOIN t USING (term), u),
 r AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS r, count(*) OVER () AS m FROM p)
 SELECT term, size, a AS overlap, round(p, 6) AS p, round(least(1.0, min(p * m / r) OVER (ORDER BY p DESC)), 6) AS padj, round(a * (n - d - (size - a)) / nullif((size - a) * (d - a), 0), 6) AS odds FROM r""")
def enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.benjamini_hochberg(_enrichment(spark, sf_dir).withColumn("all", F.lit(1)), ["all"], "p").select("term", "size", "overlap", r6("p").alias("p"), r6("padj").alias("padj"), r6("odds").alias("odds"))


@query("""WITH p AS (SELECT p_partkey, p_brand, (p_partkey * 7919 % 1000 + 1) / 1000.0 AS p FROM part), r AS (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p) + count(*) OVER (PARTITION BY p_brand, p) - 1 AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM p)
 SELECT p_partkey, round(p, 6)::DOUBLE AS p, round(least(1.0, min(p * n / r) OVER (PARTITION BY p_brand ORDER BY p DESC)), 6)::DOUBLE AS padj FROM r""")
def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", ((F.col("p_partkey") * 7919 % 1000 + 1) / 1000.0).alias("p"))
    return tables.benjamini_hochberg(rows, ["p_brand"], "p").select("p_partkey", r6("p").alias("p"), r6("padj").alias("padj"))


@query("WITH q AS (SELECT l_suppkey, quantile_cont(l_extendedprice, 0.1) AS a, quantile_cont(l_extendedprice, 0.9) AS b FROM lineitem GROUP BY 1) SELECT l_suppkey, count(*) AS n, round(avg(l_extendedprice), 4) AS mean FROM lineitem JOIN q USING (l_suppkey) WHERE l_extendedprice BETWEEN a AND b GROUP BY 1")
def quantile_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.trimmed(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice"), ["l_suppkey"], "l_extendedprice", 0.1, 0.9)
    return rows.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber)) WHERE k > 5 AND k <= n - 5")
def edge_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate")
    return rows.withColumn("k", F.row_number().over(w.orderBy("l_shipdate", "l_orderkey", "l_linenumber"))).withColumn("n", F.count("*").over(w)).where("k > 5 AND k <= n - 5").select("l_suppkey", "l_orderkey", "l_linenumber")


@query("SELECT p_partkey, (rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2)::DOUBLE AS rank FROM part")
def rank_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.average_rank(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice"), ["p_brand"], "p_retailprice", descending=True).select("p_partkey", "rank")


@query("SELECT l_returnflag, l_linestatus, count(*) AS count_order, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL")
def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("count_order"), F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), r6(F.avg("l_discount")).alias("avg_disc"))


@query("WITH u AS (SELECT gene, sample, n FROM (SELECT l_partkey AS gene, l_returnflag AS sample, count(*) AS n FROM lineitem GROUP BY ALL)) SELECT sample, round(avg(ln(n + 1)), 6) AS mean_log, count(*) AS genes, round(exp(avg(ln(n))), 6) AS geometric_mean FROM u GROUP BY sample")
def size_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("gene"), F.col("l_returnflag").alias("sample")).agg(F.count("*").alias("n"))
    return u.groupBy("sample").agg(r6(F.avg(F.log(F.col("n") + 1))).alias("mean_log"), F.count("*").alias("genes"), r6(F.exp(F.avg(F.log("n")))).alias("geometric_mean"))
