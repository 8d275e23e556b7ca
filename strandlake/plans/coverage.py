"""Depth-track queries: ``events`` as a track, a contig an event type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import tracks
from strandlake.plans.common import Registry, r6, table

query = Registry()
LOW, HIGH, WIDTH = -4.0, 4.0, 5

_TRACK = """track AS (SELECT event_type AS chrom, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pos, value AS cov FROM events)"""
_MEDIAN = f"""{_TRACK}, med AS (SELECT chrom, pos, cov, CASE WHEN count(*) OVER w = 5 THEN median(cov) OVER w ELSE cov END AS rm FROM track
 WINDOW w AS (PARTITION BY chrom ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
 scored AS (SELECT *, cov / nullif(rm, 0) AS scale, CASE WHEN cov = 0 THEN least(-4.01, coalesce((cov / nullif(rm, 0) - 1) / 0.2, 0)) ELSE coalesce((cov / nullif(rm, 0) - 1) / 0.2, 0) END AS zscore FROM med)"""
_ROI = f"""{_MEDIAN}, kept AS (SELECT * FROM scored WHERE zscore > 2 OR zscore < -2),
 marked AS (SELECT *, CASE WHEN lag(pos) OVER w = pos - 1 AND sign(lag(zscore) OVER w) = sign(zscore) THEN 0 ELSE 1 END AS fresh FROM kept WINDOW w AS (PARTITION BY chrom ORDER BY pos)),
 runs AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY pos) AS run FROM marked),
 ends AS (SELECT chrom, run, min(pos) AS a, max(pos) AS b FROM runs WHERE zscore > 4 OR zscore < -4 GROUP BY chrom, run),
 roi AS (SELECT chrom, a AS "start", b + 1 AS "end", b - a + 1 AS size, avg(cov) AS mean_cov, max(cov) AS max_cov, avg(rm) AS mean_rm, avg(zscore) AS mean_zscore,
  CASE WHEN avg(zscore) >= 0 THEN max(zscore) ELSE min(zscore) END AS max_zscore FROM runs JOIN ends USING (chrom, run) WHERE pos BETWEEN a AND b GROUP BY chrom, a, b)"""


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("chrom"), "ts", "event_id", F.col("value").alias("cov"))
    return tracks.dense_positions(events, "chrom", ["ts", "event_id"], F.date_trunc("day", "ts")).select("chrom", "pos", "cov")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.zscores(tracks.running_median(track(spark, sf_dir), "chrom", "pos", "cov", WIDTH), "cov", "rm", 1.0, 0.2, LOW)


def roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.regions(scored(spark, sf_dir), "chrom", "pos", "cov", low=LOW, high=HIGH)


@query(f"""WITH {_ROI} SELECT chrom, "start", "end", size, round(mean_cov, 6) AS mean_cov, round(max_cov, 6) AS max_cov, round(mean_rm, 6) AS mean_rm, round(mean_zscore, 6) AS mean_zscore, round(max_zscore, 6) AS max_zscore,
 round(CASE WHEN mean_cov <> 0 AND mean_rm <> 0 THEN log2(mean_cov / mean_rm) END, 6) AS log2_ratio FROM roi""")
def coverage_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roi(spark, sf_dir).select("chrom", "start", "end", "size", *(r6(c).alias(c) for c in ("mean_cov", "max_cov", "mean_rm", "mean_zscore", "max_zscore", "log2_ratio")))


@query(f"""WITH {_MEDIAN} SELECT chrom, pos, round(cov, 6) AS cov, round(rm, 6) AS rm, round(zscore, 6) AS zscore FROM scored""")
def running_median_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("chrom", "pos", *(r6(c).alias(c) for c in ("cov", "rm", "zscore")))


@query(f"""WITH {_ROI}, fresh AS (SELECT *, CASE WHEN "start" - lag("end") OVER w < 20 AND lag(max_zscore) OVER w * max_zscore >= 0 THEN 0 ELSE 1 END AS f FROM roi WINDOW w AS (PARTITION BY chrom ORDER BY "start")),
 chains AS (SELECT *, sum(f) OVER (PARTITION BY chrom ORDER BY "start") AS chain FROM fresh)
 SELECT chrom, min("start") AS "start", max("end") AS "end", count(*) AS n_regions, max("end") - min("start") AS size FROM chains GROUP BY chrom, chain""")
def coverage_cnv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.clusters(roi(spark, sf_dir), "chrom", 20).select("chrom", "start", "end", "n_regions", "size")


@query(f"""WITH {_TRACK}, base AS (SELECT chrom, count(cov) AS n, avg(cov) AS doc, stddev_samp(cov) AS std, 100.0 * count(*) FILTER (cov > 0) / count(cov) AS boc, quantile_cont(cov, 0.5) AS median FROM track GROUP BY chrom),
 spread AS (SELECT chrom, quantile_cont(abs(cov - median), 0.5) AS mad FROM track JOIN base USING (chrom) GROUP BY chrom)
 SELECT chrom, n, round(doc, 6) AS doc, round(std, 6) AS std, round(boc, 6) AS boc, round(median, 6) AS median, round(mad, 6) AS mad, round(std / nullif(doc, 0), 6) AS cv FROM base JOIN spread USING (chrom)""")
def coverage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("chrom"), F.col("value").alias("cov"))
    return tracks.depth_statistics(events, ["chrom"], "cov").select("chrom", "n", *(r6(c).alias(c) for c in ("doc", "std", "boc", "median", "mad", "cv")))


@query("""WITH m AS (SELECT event_type AS chrom, round_even(avg(value), 0) AS m FROM events GROUP BY event_type)
 SELECT chrom, round(CASE WHEN count(*) FILTER (value <= m) = 0 THEN 1 ELSE 1 - (count(*) FILTER (value <= m) - sum(value) FILTER (value <= m) / nullif(first(m), 0)) / count(value) END, 6) AS evenness FROM events JOIN m ON chrom = event_type GROUP BY chrom""")
def coverage_evenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("chrom"), F.col("value").alias("cov"))
    return tracks.evenness(events, ["chrom"], "cov").select("chrom", r6("evenness").alias("evenness"))


@query(f"""WITH {_TRACK} SELECT chrom, (pos - 1) // 10 AS bin, round(avg(cov), 6) AS mean_value, count(*) AS n FROM track GROUP BY ALL""")
def coverage_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.binned(track(spark, sf_dir), "chrom", "pos", "cov", 10).select("chrom", "bin", r6("mean_value").alias("mean_value"), "n")


@query(f"""WITH {_TRACK} SELECT chrom, pos, round(CASE WHEN count(*) OVER w = 7 THEN avg(cov) OVER w END, 6) AS ma FROM track WINDOW w AS (PARTITION BY chrom ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.moving_average(track(spark, sf_dir), "chrom", "pos", "cov", 7).select("chrom", "pos", r6("ma").alias("ma"))


@query("SELECT l_returnflag AS chrom, round(corr(l_discount, l_extendedprice), 6) AS gc_cov_correlation, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def gc_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("chrom")).agg(r6(F.corr("l_discount", "l_extendedprice")).alias("gc_cov_correlation"), F.count("*").alias("n"))


@query("""WITH b AS (SELECT l_returnflag AS k, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.75) AS q3 FROM lineitem GROUP BY 1)
 SELECT k AS chrom, count(*) FILTER (l_quantity < q1 - 1.5 * (q3 - q1) OR l_quantity > q3 + 1.5 * (q3 - q1)) AS n_outliers, round(first(q1), 6) AS q1, round(first(q3), 6) AS q3 FROM lineitem JOIN b ON k = l_returnflag GROUP BY k""")
def depth_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("chrom"), F.col("l_quantity").alias("x"))
    q = rows.groupBy("chrom").agg(F.percentile("x", F.lit(0.25)).alias("q1"), F.percentile("x", F.lit(0.75)).alias("q3"))
    span = 1.5 * (F.col("q3") - F.col("q1"))
    return rows.join(q, "chrom").groupBy("chrom").agg(F.count_if((F.col("x") < F.col("q1") - span) | (F.col("x") > F.col("q3") + span)).alias("n_outliers"), r6(F.first("q1")).alias("q1"), r6(F.first("q3")).alias("q3"))


@query("""SELECT CAST(floor(l_quantity / 5) * 5 AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1""")
def depth_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy((F.floor(F.col("l_quantity") / 5) * 5).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))
