"""Queries of peaks, filters, designs and running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions import quality, variants
from strandlake.operators import intervals, peaks, quantify, sheets, sliding, tracks
from strandlake.plans.common import Registry, r6, table
from strandlake.plans.coverage import _TRACK, track
from strandlake.plans.counts import _MATRIX, matrix
from strandlake.plans.sequences import _DNA, dna
from strandlake.plans.spans import _ORDERS, orders

query = Registry()


@query(f"WITH {_TRACK}, n AS (SELECT *, lag(cov) OVER w AS a, lead(cov) OVER w AS b FROM track WINDOW w AS (PARTITION BY chrom ORDER BY pos)) SELECT chrom, pos, round(cov, 6) AS cov FROM n WHERE cov > 100 AND cov > a AND cov > b")
def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.local_maxima(track(spark, sf_dir), "chrom", "pos", "cov", 100).select("chrom", "pos", r6("cov").alias("cov"))


@query(f"""WITH {_ORDERS}, o AS (SELECT orders_i.*, CASE WHEN o_orderstatus = 'F' THEN 'rep1' ELSE 'rep2' END AS src FROM orders_i JOIN orders ON o_orderkey = id), r AS (SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o),
 g AS (SELECT *, sum(CASE WHEN s < reach THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM r) SELECT chrom, min(s) AS "start", max(e) AS "end", count(*) AS n, CASE WHEN min(src) = max(src) THEN min(src) ELSE 'both' END AS sources FROM g GROUP BY chrom, run""")
def peak_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "rep1").otherwise("rep2").alias("src"))
    return peaks.replicated(orders(spark, sf_dir).join(status, "id"), ["chrom"], "src")


@query("SELECT p_partkey, CASE WHEN p <= 0 THEN 1000 ELSE least(CAST(trunc(-125 * log2(p)) AS INTEGER), 1000) END::INTEGER AS score, round(pow(2, -(p_partkey % 1000) / 125), 6) AS idr FROM (SELECT p_partkey, (p_partkey % 200) / 200.0::DOUBLE AS p FROM part)")
def idr_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", peaks.idr_score((F.col("p_partkey") % 200) / F.lit(200.0)).alias("score"), r6(peaks.idr_of_score(F.col("p_partkey") % 1000)).alias("idr"))


@query("SELECT x::DOUBLE AS threshold, round(100.0 * (SELECT count(*) FILTER (l_quantity > x) / count(l_quantity) FROM lineitem), 6) AS percentage FROM range(0, 51, 5) g(x)")
def genes_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.above_grid(table(spark, sf_dir, "lineitem"), "l_quantity", [float(x) for x in range(0, 51, 5)]).select("threshold", r6("percentage").alias("percentage"))


@query("WITH n AS (SELECT o_custkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders) SELECT o_custkey, bool_and(b IS NULL OR o_totalprice >= b) AS in_order FROM n GROUP BY o_custkey")
def sorted_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.is_sorted(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice")


@query("""SELECT p_brand, 'p_type' AS "column", count(p_type) - count(DISTINCT p_type) AS repeated FROM part GROUP BY p_brand UNION ALL SELECT p_brand, 'p_size', count(p_size) - count(DISTINCT p_size) FROM part GROUP BY p_brand""")
def duplicated_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.repeats(table(spark, sf_dir, "part"), ["p_brand"], ["p_type", "p_size"])


@query("WITH k AS (SELECT c_mktsegment AS s FROM customer GROUP BY 1 HAVING count(*) >= 2) SELECT x.s AS a, y.s AS b FROM k x JOIN k y ON x.s < y.s")
def design_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.comparisons(table(spark, sf_dir, "customer"), "c_mktsegment")


@query("WITH r AS (SELECT c_nationkey, c_acctbal, sum(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC ROWS UNBOUNDED PRECEDING) AS s, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS k, sum(c_acctbal) OVER (PARTITION BY c_nationkey) AS t FROM customer WHERE c_acctbal > 0) SELECT c_nationkey, min(k) AS n FROM r WHERE s >= 0.5 * t GROUP BY c_nationkey")
def positions_to_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.reaching(table(spark, sf_dir, "customer").where("c_acctbal > 0"), ["c_nationkey"], "c_acctbal", 0.5)


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY l_orderkey")
def select_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(wanted, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def exclude_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT c_nationkey, c_name, sum(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY CAST(regexp_extract(c_name, '\\d+') AS BIGINT) ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM customer")
def cumulative_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.functions.sequence import natural_key

    w = Window.partitionBy("c_nationkey").orderBy(natural_key(F.col("c_name"))).rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_name", F.sum("c_custkey").over(w).alias("upto"))


@query("WITH b AS (SELECT quantile_cont(l_extendedprice, 0.01) AS a, quantile_cont(l_extendedprice, 0.99) AS z FROM lineitem) SELECT CAST(floor((l_extendedprice - a) / ((z - a) / 30)) AS BIGINT) AS bin, count(*) AS n FROM lineitem, b WHERE l_extendedprice BETWEEN a AND z GROUP BY 1")
def depth_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("x"))
    bounds = rows.agg(F.percentile("x", F.lit(0.01)).alias("a"), F.percentile("x", F.lit(0.99)).alias("z"))  # one row
    joined = rows.join(F.broadcast(bounds), F.col("x").between(F.col("a"), F.col("z")))
    return joined.groupBy(F.floor((F.col("x") - F.col("a")) / ((F.col("z") - F.col("a")) / 30)).alias("bin")).agg(F.count("*").alias("n"))


@query("WITH g AS (SELECT l_partkey AS gene, log2((sum(l_quantity) FILTER (l_returnflag = 'A') + 1) / (sum(l_quantity) FILTER (l_returnflag = 'R') + 1)) AS f FROM lineitem GROUP BY 1) SELECT t::DOUBLE AS threshold, count(*) FILTER (f >= t) AS up, count(*) FILTER (f <= -t) AS down FROM g, (VALUES (0.0), (0.5), (1.0), (1.5)) v(t) GROUP BY t")
def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("gene")).agg(F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_quantity"))).alias("a"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("r"))
    f = F.log2((F.col("a") + 1) / (F.col("r") + 1))
    counts = sums.agg(F.array(*(F.struct(F.lit(t).alias("threshold"), F.count_if(f >= t).alias("up"), F.count_if(f <= -t).alias("down")) for t in (0.0, 0.5, 1.0, 1.5))).alias("x"))
    return counts.select(F.explode("x").alias("x")).select("x.*")


@query(f"""WITH {_TRACK}, m AS (SELECT chrom, pos, median(cov) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS m, count(*) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS k, cov FROM track) SELECT chrom, count(*) AS n, round(avg(CASE WHEN k = 21 THEN m ELSE cov END), 6) AS mean_rm FROM m GROUP BY chrom""")
def running_median_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracks.running_median(track(spark, sf_dir), "chrom", "pos", "cov", 21, block=1000)
    return rows.groupBy("chrom").agg(F.count("*").alias("n"), r6(F.avg("rm")).alias("mean_rm"))


@query(f"""WITH {_ORDERS}, f AS (SELECT chrom, min(s) AS s, max(e) AS e FROM orders_i GROUP BY chrom) SELECT o.chrom, o.id, o.s - f.s AS from_start, f.e - o.e AS to_end FROM orders_i o JOIN f USING (chrom) WHERE o.s - f.s > 60 AND f.e - o.e > 60""")
def remove_flanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir)
    ends = rows.groupBy("chrom").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    return rows.join(ends, "chrom").select("chrom", "id", (F.col("start") - F.col("a")).alias("from_start"), (F.col("b") - F.col("end")).alias("to_end")).where("from_start > 60 AND to_end > 60")


@query(f"""WITH {_ORDERS}, g AS (SELECT chrom, min(s) AS s, max(e) AS e FROM orders_i GROUP BY chrom) SELECT g.chrom, count(*) AS n FROM g JOIN orders_i o ON o.chrom = g.chrom AND o.s >= g.s AND o.e <= g.e GROUP BY g.chrom""")
def contained_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir)
    whole = rows.groupBy("chrom").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    met = intervals.overlaps(whole, rows, ["chrom"], 4096).where("start_r >= start_l AND end_r <= end_l")
    return met.groupBy("chrom").agg(F.count("*").alias("n"))


@query(f"""WITH {_DNA}, b AS (SELECT doc_id, i AS pos, substr(s, i, 1) AS c FROM (SELECT doc_id, s, unnest(range(1, length(s) + 1)) AS i FROM dna)), w AS (SELECT doc_id, count(*) FILTER (c IN ('G', 'C')) OVER x / count(*) OVER x AS gc FROM b WINDOW x AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING)) SELECT doc_id, round(max(gc), 6) AS most, round(min(gc), 6) AS least, round(avg(gc), 6) AS mean FROM w GROUP BY doc_id""")
def gc_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sliding.base_windows(dna(spark, sf_dir), "doc_id", "s", 25)
    return rows.groupBy("doc_id").agg(r6(F.max("gc")).alias("most"), r6(F.min("gc")).alias("least"), r6(F.avg("gc")).alias("mean"))


@query(f"WITH {_DNA} SELECT doc_id, round(len(regexp_extract_all(s, 'ACGT')) * 4 / length(s), 6) AS forward, round(len(regexp_extract_all(s, 'ACGT')) * 4 / length(s), 6) AS reverse, len(regexp_extract_all(s, 'ACGT')) * 4 / length(s) >= 0.02 AS telomeric FROM dna WHERE length(s) > 0")
def telomeric_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding.telomeric(dna(spark, sf_dir).where("length(s) > 0"), "doc_id", "s", "ACGT", 0.02).select("doc_id", r6("forward").alias("forward"), r6("reverse").alias("reverse"), "telomeric")


@query("SELECT p_brand AS gene, sum(l_quantity) AS reads, round(sum(l_extendedprice * p_size) / nullif(sum(l_extendedprice), 0), 6) AS length FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def gene_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    rows = table(spark, sf_dir, "lineitem").join(part.select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey").select(F.col("l_partkey").alias("transcript"), F.col("l_quantity").alias("reads"), F.col("l_extendedprice").alias("tpm"), F.col("p_size").alias("effective_length"))
    found = quantify.genes_from_transcripts(rows, part.select(F.col("p_partkey").alias("transcript"), F.col("p_brand").alias("gene")))
    return found.select("gene", "reads", r6("length").alias("length"))


@query(f"WITH {_MATRIX}, g AS (SELECT gene, avg(ln(n)) AS m FROM m WHERE n > 0 GROUP BY gene HAVING count(*) = (SELECT count(DISTINCT sample) FROM m)) SELECT sample, round(exp(quantile_cont(ln(n) - g.m, 0.5)), 6) AS factor FROM m JOIN g USING (gene) WHERE n > 0 GROUP BY sample")
def median_of_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantify.size_factors(matrix(spark, sf_dir)).select("sample", r6("factor").alias("factor"))


@query("SELECT p_type AS status, count(DISTINCT p_partkey) AS n, round(100.0 * count(DISTINCT p_partkey) / (SELECT count(*) FROM part), 6) AS percentage FROM part GROUP BY 1")
def assembly_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ID"), F.col("p_type").alias("Status"))
    return quantify.assembly_summary(rows).select("status", "n", r6("percentage").alias("percentage"))


@query("""WITH d AS (SELECT c_name AS label, c_mktsegment AS condition FROM customer), s AS (SELECT condition, count(*) AS n FROM d GROUP BY 1), r AS (
 SELECT 'unique labels' AS "check", count(*) AS n_bad, min(label) AS example FROM (SELECT label FROM d GROUP BY 1 HAVING count(*) > 1) UNION ALL
 SELECT 'two conditions', count(*), min(x) FROM (SELECT count(*) AS n, min(condition) AS x FROM s) WHERE n < 2 UNION ALL
 SELECT 'two samples a condition', count(*), min(condition) FROM s WHERE n < 2) SELECT "check", CASE WHEN n_bad > 0 THEN 'Error' ELSE 'Success' END AS status, n_bad, example FROM r""")
def design_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.design(table(spark, sf_dir, "customer").select(F.col("c_name").alias("label"), F.col("c_mktsegment").alias("condition")))


@query("SELECT l_orderkey, l_linenumber, round(least(-10 * log10(greatest(least(l_discount, 1.0), 1e-90)), 93.0), 6) AS sanger, round(CASE WHEN l_discount >= 1 THEN -5 ELSE least(greatest(-10 * log10(greatest(l_discount, 1e-90) / (1 - l_discount)), -5.0), 62.0) END, 6) AS solexa, round(exp(-pow(l_tax - 0.04, 2) / (2 * 0.0004)) / (0.02 * sqrt(2 * pi())), 6) AS density FROM lineitem")
def quality_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(quality.clamped_phred(p)).alias("sanger"), r6(quality.clamped_solexa(p)).alias("solexa"), r6(quality.normal_density(F.col("l_tax"), 0.04, 0.02)).alias("density"))


@query("SELECT l_orderkey, l_linenumber, kept FROM (SELECT l_orderkey, l_linenumber, CASE WHEN pol THEN d[3] + d[4] >= 30 AND d[3] >= 3 AND d[4] >= 3 AND coalesce(d[3] / nullif(d[1] + d[3], 0), 0) >= 0.4 AND coalesce(d[4] / nullif(d[2] + d[4], 0), 0) >= 0.4 ELSE d[1] + d[2] >= 30 AND d[1] >= 3 AND d[2] >= 3 AND coalesce(d[1] / nullif(d[1] + d[3], 0), 0) >= 0.4 AND coalesce(d[2] / nullif(d[2] + d[4], 0), 0) >= 0.4 END OR d IS NULL AS kept FROM (SELECT *, l_linenumber % 2 = 0 AS pol, CASE WHEN l_linenumber <> 7 THEN [l_quantity, l_suppkey, l_partkey % 40, l_orderkey % 30] END AS d FROM lineitem))")
def dp4_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    dp4 = F.when(c("l_linenumber") != 7, F.array(c("l_quantity"), c("l_suppkey").cast("double"), (c("l_partkey") % 40).cast("double"), (c("l_orderkey") % 30).cast("double")))
    kept = variants.valid_dp4(dp4, 30, 3, 0.4, c("l_linenumber") % 2 == 0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", kept.alias("kept"))


@query("""SELECT l_returnflag AS chr, l_partkey AS position, l_quantity + 0.3 AS depth, 'A' AS reference, CASE WHEN l_linenumber % 2 = 0 THEN 'C' ELSE 'CG;T' END AS alternative, l_suppkey AS score, CASE WHEN l_linenumber % 2 = 0 THEN printf('%.3f', 3 / (l_quantity + 0.3)) ELSE printf('%.3f;%.3f', 3 / (l_quantity + 0.3), 5 / (l_quantity + 0.3)) END AS frequency,
 CASE WHEN l_linenumber % 2 = 0 THEN printf('%.3f', least(1.2, l_linenumber) / (1.2::DOUBLE + l_linenumber)) ELSE printf('%.3f;0.250', least(1.2, l_linenumber) / (1.2::DOUBLE + l_linenumber)) END AS strand_balance, CASE WHEN l_linenumber % 2 = 0 THEN 'snp' ELSE 'insertion' END AS type FROM lineitem""")
def flattened_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, even = F.col, F.col("l_linenumber") % 2 == 0
    cells = lambda a, b: F.when(even, F.array(a)).otherwise(F.array(a, b))
    number = lambda x: F.lit(float(x))
    call = variants.flattened(c("l_returnflag"), c("l_partkey"), F.lit("A"), F.when(even, F.array(F.lit("C"))).otherwise(F.array(F.lit("CG"), F.lit("T"))), c("l_quantity") + 0.3, c("l_suppkey"), cells(number(3), number(5)), cells(number(1.2), number(1)), cells(c("l_linenumber").cast("double"), number(3)))
    return table(spark, sf_dir, "lineitem").select(call.alias("x")).select("x.*")
