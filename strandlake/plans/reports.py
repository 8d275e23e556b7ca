"""Queries of report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import reports
from strandlake.plans.common import Registry, r6, table
from strandlake.plans.coverage import _ROI, _TRACK, roi, track

query = Registry()


@query(f"""WITH {_ROI}, l AS (SELECT chrom, count(*) AS n FROM track GROUP BY chrom) SELECT chrom, round(1 - coalesce((SELECT sum(size) FROM roi WHERE roi.chrom = l.chrom), 0) / n, 6) AS centralness FROM l""")
def coverage_centralness(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = track(spark, sf_dir).groupBy("chrom").agg(F.count("*").alias("length"))
    return reports.centralness(roi(spark, sf_dir), lengths, "chrom").select("chrom", r6("centralness").alias("centralness"))


@query(f"""WITH {_ROI} SELECT 'low' AS sign, chrom, "start", "end" FROM roi WHERE "end" > 100 AND "start" < 900 AND max_zscore < 0 UNION ALL SELECT 'high', chrom, "start", "end" FROM roi WHERE "end" > 100 AND "start" < 900 AND max_zscore >= 0""")
def regions_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = roi(spark, sf_dir)
    parts = [reports.in_range(found, 100, 900, sign).select(F.lit(sign).alias("sign"), "chrom", "start", "end") for sign in ("low", "high")]
    return parts[0].union(parts[1])


@query(f"""WITH {_ROI}, s AS (SELECT chrom, count(*) AS n, avg(cov) AS doc FROM track GROUP BY chrom) SELECT chrom, n, round(doc, 6) AS doc, (SELECT count(*) FROM roi WHERE roi.chrom = s.chrom) AS roi, (SELECT count(*) FROM roi WHERE roi.chrom = s.chrom AND max_zscore < 0) AS roi_low, (SELECT count(*) FROM roi WHERE roi.chrom = s.chrom AND max_zscore >= 0) AS roi_high FROM s""")
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = track(spark, sf_dir).groupBy("chrom").agg(F.count("*").alias("n"), r6(F.avg("cov")).alias("doc"))
    return reports.coverage_summary(stats, roi(spark, sf_dir), "chrom")


@query(f"""WITH {_TRACK}, c AS (SELECT chrom, (pos - 1) // 400 AS chunk, count(*) AS length, avg(cov) AS doc, 100.0 * count(*) FILTER (cov > 0) / count(*) AS boc, stddev_samp(cov) AS std, count(*) FILTER (cov > 90) AS roi FROM track GROUP BY ALL)
 SELECT chrom, sum(length)::BIGINT AS length, round(sum(doc * length) / sum(length), 6) AS doc, round(sum(boc * length) / sum(length), 6) AS boc, round(avg(std), 6) AS std, sum(roi)::BIGINT AS roi FROM c GROUP BY chrom""")
def merged_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = track(spark, sf_dir).groupBy("chrom", F.floor((F.col("pos") - 1) / 400).alias("chunk")).agg(F.count("*").alias("length"), F.avg("cov").alias("doc"), (100.0 * F.count_if(F.col("cov") > 0) / F.count("*")).alias("boc"), F.stddev_samp("cov").alias("std"), F.count_if(F.col("cov") > 90).alias("roi"))
    got = reports.merged_summaries(chunks, ["chrom"], ["doc", "boc"], ["std"], ["roi"])
    return got.select("chrom", "length", *(r6(c).alias(c) for c in ("doc", "boc", "std")), "roi")


@query(f"""WITH {_ROI}, g AS (SELECT DISTINCT event_type AS chrom, user_id * 3 AS a, user_id * 3 + 40 AS b, 'g' || user_id AS gene, CASE WHEN user_id % 3 = 0 THEN 'CDS' ELSE 'gene' END AS type FROM events WHERE user_id < 200),
 h AS (SELECT * FROM g WHERE type <> 'CDS') SELECT roi.chrom, roi."start", roi."end", h.a AS gene_start, h.b AS gene_end, h.gene FROM roi LEFT JOIN h ON h.chrom = roi.chrom AND h.a < roi."end" AND h.b + 1 > roi."start" """)
def annotated_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    genes = table(spark, sf_dir, "events").where("user_id < 200").select(F.col("event_type").alias("chrom"), (u * 3).alias("start"), (u * 3 + 40).alias("stop"), F.concat(F.lit("g"), u.cast("string")).alias("gene"), F.when(u % 3 == 0, "CDS").otherwise("gene").alias("type")).distinct()
    return reports.annotated_regions(roi(spark, sf_dir), genes, "chrom", ("CDS",)).select("chrom", "start", "end", "gene_start", "gene_end", "gene")


@query(f"""WITH {_TRACK} SELECT chrom, pos, round(cov, 6) AS cov FROM track WHERE pos BETWEEN 50 AND 80""")
def track_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track(spark, sf_dir).where(F.col("pos").between(50, 80)).select("chrom", "pos", r6("cov").alias("cov"))


@query("WITH b AS (SELECT l_returnflag AS k, floor(l_extendedprice / 5000) * 5000 AS bin, count(*) AS n FROM lineitem GROUP BY ALL) SELECT k, bin::BIGINT AS bin, n, round(sum(n) OVER (PARTITION BY k ORDER BY bin DESC) / sum(n) OVER (PARTITION BY k), 6) AS share FROM b")
def cumulated_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("k"), "l_extendedprice")
    return reports.cumulated(rows, ["k"], "l_extendedprice", 5000).select("k", F.col("bin").cast("bigint").alias("bin"), "n", r6("share").alias("share"))


@query(f"WITH {_TRACK}, m AS (SELECT chrom, pos, avg(cov) OVER w AS mean, count(*) OVER w AS k FROM track WINDOW w AS (PARTITION BY chrom ORDER BY pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) SELECT chrom, pos, round(mean, 6) AS mean FROM m WHERE k = 4")
def trailing_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.trailing_mean(track(spark, sf_dir), "chrom", "pos", "cov", 4).select("chrom", "pos", r6("mean").alias("mean"))


@query("WITH c AS (SELECT l_returnflag AS k, count(*) AS t, [count(*) FILTER (l_quantity >= 10), count(*) FILTER (l_quantity >= 25), count(*) FILTER (l_quantity >= 40)] AS a FROM lineitem GROUP BY 1) SELECT k, i::INTEGER AS i, CASE i WHEN 0 THEN t - a[1] WHEN 1 THEN a[1] - a[2] WHEN 2 THEN a[2] - a[3] ELSE a[3] END AS n FROM c, range(0, 4) x(i)")
def interval_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(F.count("*").alias("t"), F.array(*(F.count_if(q >= e) for e, _ in reports.interval_edges([10, 25, 40])[1:])).alias("a"))
    return c.select("k", F.posexplode(reports.counts_of_intervals(F.col("a"), F.col("t"))).alias("i", "n"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN p_size::BIGINT END AS a, CASE WHEN p_size % 3 = 0 THEN (p_size + 7)::BIGINT END AS b, CASE p_size % 3 WHEN 0 THEN p_size + 3.5 END AS middle FROM part")
def distance_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 3 == 0, F.concat(s, F.lit("-"), (F.col("p_size") + 7).cast("string"))).when(F.col("p_size") % 3 == 1, F.concat(s, F.lit("+"))).otherwise(F.concat(F.lit("x"), s))
    rows = table(spark, sf_dir, "part").select("p_partkey", reports.distance_range(text).alias("r"), reports.middle_of_range(text).alias("middle"))
    return rows.select("p_partkey", F.col("r.start").alias("a"), F.col("r.end").alias("b"), F.col("middle").cast("double").alias("middle"))


@query("SELECT s_suppkey, s_suppkey::VARCHAR AS node, (s_suppkey * 10)::BIGINT AS length, s_suppkey + 0.5 AS coverage, s_nationkey::VARCHAR AS reads FROM supplier")
def contig_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    name = F.concat(F.lit("NODE_"), k, F.lit("_length_"), (F.col("s_suppkey") * 10).cast("string"), F.lit("_cov_"), k, F.lit(".5"))
    comment = F.concat(F.lit("len=5 reads="), F.col("s_nationkey").cast("string"), F.lit(" covStat=1.0"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", reports.spades_header(name).alias("x"), reports.tagged(comment, "reads").alias("reads"))
    return rows.select("s_suppkey", "x.node", "x.length", "x.coverage", "reads")


@query("SELECT l_suppkey AS barcode, sum(l_quantity) AS total, (row_number() OVER (ORDER BY sum(l_quantity) DESC, l_suppkey))::INTEGER AS rank FROM lineitem GROUP BY 1 ORDER BY total DESC, barcode LIMIT 15")
def top_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("barcode"), "l_quantity")
    return reports.top_barcodes(rows, "barcode", "l_quantity", 15)


@query("SELECT l_orderkey AS sample, round(avg(100.0 * l_linenumber / nullif(l_quantity, 0)), 6) AS percentage FROM lineitem GROUP BY 1")
def adapter_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "sample")
    return reports.adapter_share(rows, "sample", "l_linenumber", "l_quantity").select("sample", r6("percentage").alias("percentage"))


@query("SELECT l_linenumber AS length, sum(l_quantity) AS q, sum(l_partkey)::BIGINT AS k FROM lineitem GROUP BY 1")
def adapter_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("length"), F.col("l_quantity").alias("q"), F.col("l_partkey").alias("k"))
    return reports.paired_histogram(rows, "length", ["q", "k"])


@query("WITH l AS (SELECT p_brand AS k, p_partkey AS i, CASE p_size % 4 WHEN 0 THEN 'Total reads: 1,' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') WHEN 1 THEN 'Mapped reads:   ' || p_partkey || ' (9%)' ELSE 'x' END AS v FROM part) SELECT k, arg_min(TRY_CAST(replace(regexp_extract(v, '^Total reads: ([0-9,]+)', 1), ',', '') AS DOUBLE), i) FILTER (regexp_matches(v, '^Total')) AS total, arg_min(TRY_CAST(regexp_extract(v, '^Mapped reads:\\s+(\\d+)', 1) AS DOUBLE), i) FILTER (regexp_matches(v, '^Mapped')) AS mapped FROM l GROUP BY k")
def log_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    value = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("Total reads: 1,"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"))).when(F.col("p_size") % 4 == 1, F.concat(F.lit("Mapped reads:   "), k, F.lit(" (9%)"))).otherwise("x")
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("k"), F.col("p_partkey").alias("at"), value.alias("value"))
    return reports.log_values(rows, {"total": "^Total reads: ([0-9,]+)", "mapped": "^Mapped reads:\\s+(\\d+)"}, ["k"])


@query('WITH h AS (SELECT l_linenumber AS kmer, count(*) AS n FROM lineitem GROUP BY 1) SELECT sum(n)::BIGINT AS "distinct", sum(kmer * n)::BIGINT AS total FROM h')
def kmer_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    histogram = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("kmer")).agg(F.count("*").alias("n"))
    return reports.kmer_totals(histogram, "kmer", "n")


@query("SELECT p_brand AS species, count(DISTINCT p_size) AS groups, count(*) AS genes FROM part GROUP BY 1")
def orthogroup_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.group_sizes(table(spark, sf_dir, "part").select(F.col("p_brand").alias("species"), F.col("p_size").alias("grp")), "grp", "species")


@query("WITH c AS (SELECT l_returnflag AS k, l_orderkey, quantile_cont(l_quantity, 0.5) AS m, count(*) AS n, min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem GROUP BY ALL) SELECT k, count(*) FILTER (a >= 5 AND b <= 45) AS cells, round(avg(m), 6) AS mean_median, round(avg(n - 1), 6) AS mean_passes FROM c GROUP BY k")
def cell_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("k"), "l_orderkey", "l_quantity")
    got = reports.cell_statistics(rows, ["k"], "l_orderkey", "l_quantity", 5, 45)
    return got.select("k", "cells", r6("mean_median").alias("mean_median"), r6("mean_passes").alias("mean_passes"))


@query("SELECT CASE WHEN lang IS NULL THEN 'U' ELSE 'C' END AS status, count(*) AS n, round(quantile_cont(length(text), 0.25), 6) AS q1, round(quantile_cont(length(text), 0.5), 6) AS median, round(quantile_cont(length(text), 0.75), 6) AS q3 FROM documents GROUP BY 1")
def length_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.when(F.col("lang").isNull(), "U").otherwise("C").alias("status"), F.length("text").alias("n_chars"))
    return reports.length_by_class(rows, "status", "n_chars").withColumns({c: r6(c) for c in ("q1", "median", "q3")})


@query("WITH r AS (SELECT l_orderkey AS k, l_linenumber * 10 AS a, 8 + (l_linenumber * 7 + l_orderkey) % 9 AS n FROM lineitem WHERE l_linenumber <= 7 GROUP BY ALL), f AS (SELECT k, a, a + n AS b, coalesce(max(a + n) OVER (PARTITION BY k ORDER BY a, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM r) SELECT k, max(b)::INTEGER AS n, sum(greatest(a - reach, 0))::INTEGER AS gaps FROM f GROUP BY k")
def stitched_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (8 + (F.col("l_linenumber") * 7 + F.col("l_orderkey")) % 9).cast("int")
    reads = table(spark, sf_dir, "lineitem").where("l_linenumber <= 7").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 10).alias("a"), F.repeat(F.lit("A"), n).alias("s")).distinct()
    got = reports.stitched(reads, "k", "a", "s")
    return got.select("k", F.length("reference").alias("n"), (F.length("reference") - F.length(F.replace("reference", F.lit("N"), F.lit("")))).alias("gaps"))


@query("WITH c AS (SELECT l_partkey AS pos, count(*) FILTER (l_linenumber % 4 = 0) AS a, count(*) FILTER (l_linenumber % 4 = 1) AS c, count(*) FILTER (l_linenumber % 4 = 2) AS g, count(*) FILTER (l_linenumber % 4 = 3) AS t FROM lineitem GROUP BY 1), b AS (SELECT pos, list_filter([CASE WHEN a / (a + c + g + t) > 0.3 THEN 'a' END, CASE WHEN c / (a + c + g + t) > 0.3 THEN 'c' END, CASE WHEN g / (a + c + g + t) > 0.3 THEN 'g' END, CASE WHEN t / (a + c + g + t) > 0.3 THEN 't' END], lambda x: x IS NOT NULL) AS x FROM c) SELECT pos, array_to_string(x, ',') AS bases, len(x)::INTEGER AS n FROM b WHERE len(x) >= 2")
def base_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("pos")).agg(*(F.count_if(F.col("l_linenumber") % 4 == k).alias(b) for k, b in enumerate("acgt")))
    return reports.populations(counts, "pos", list("acgt"), 0.3)


@query("SELECT p_partkey FROM part WHERE length(p_type) > length(p_name) AND p_size >= 20 AND p_retailprice >= 1000")
def called_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.called_deletions(table(spark, sf_dir, "part"), "p_name", "p_type", "p_size", "p_retailprice", 20, 1000).select("p_partkey")


_CALLS = "c AS (SELECT l_partkey AS pos, l_returnflag AS sample, max(l_quantity) AS ao, max(l_extendedprice) / 500 AS dp, max(l_suppkey) AS qual FROM lineitem GROUP BY ALL)"


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("pos"), F.col("l_returnflag").alias("sample"))
    return rows.agg(F.max("l_quantity").alias("ao"), (F.max("l_extendedprice") / 500).alias("dp"), F.max("l_suppkey").alias("qual"))


@query(f"WITH {_CALLS}, f AS (SELECT pos, sample, ao / nullif(dp, 0) AS f FROM c) SELECT x.sample AS a, y.sample AS b, count(*) AS n, count(*) FILTER (abs(x.f - y.f) > 0.1 + 1e-5 * abs(y.f)) AS n_different FROM f x JOIN f y ON x.pos = y.pos AND x.sample < y.sample GROUP BY ALL")
def variants_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = _calls(spark, sf_dir).withColumn("f", F.col("ao") / F.nullif(F.col("dp"), F.lit(0.0)))
    return reports.pair_differences(shares, ["pos"], "sample", "f", 0.1)


@query(f"WITH {_CALLS} SELECT pos, {', '.join(f'round(coalesce(max(ao / nullif(dp, 0)) FILTER (sample = {s!r}), 0), 6) AS {s.lower()}' for s in 'ANR')} FROM c WHERE qual > 5 GROUP BY pos")
def joint_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir).withColumn("alts", F.array("ao"))
    got = reports.first_allele_frequencies(calls, ["pos"], "sample", list("ANR"), "alts", "dp", "qual", 5)
    return got.select("pos", *(r6(s).alias(s.lower()) for s in "ANR"))
