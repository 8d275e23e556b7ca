"""Interval queries: shipments and orders as intervals of days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import intervals
from strandlake.plans.common import Registry, table

query = Registry()


def _day(column: str):
    return F.datediff(F.to_date(column), F.lit("1970-01-01").cast("date")).cast("bigint")


_DAY = "date_diff('day', DATE '1970-01-01', {}::DATE)"
_ORDERS = f"orders_i AS (SELECT o_custkey AS chrom, o_orderkey AS id, {_DAY.format('o_orderdate')} AS s, {_DAY.format('o_orderdate')} + 30 + o_orderkey % 40 AS e FROM orders)"
_SHIPS = f"ships AS (SELECT l_suppkey AS chrom, l_orderkey * 10 + l_linenumber AS id, {_DAY.format('l_shipdate')} AS s, {_DAY.format('l_shipdate')} + 1 + l_orderkey % 7 AS e FROM lineitem)"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return rows.select(F.col("o_custkey").alias("chrom"), F.col("o_orderkey").alias("id"), _day("o_orderdate").alias("start"), (_day("o_orderdate") + 30 + F.col("o_orderkey") % 40).alias("end"))


def ships(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_suppkey").alias("chrom"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), _day("l_shipdate").alias("start"), (_day("l_shipdate") + 1 + F.col("l_orderkey") % 7).alias("end"))


@query(f"""WITH {_SHIPS}, p AS (SELECT chrom, s AS x, 1 AS d FROM ships UNION ALL SELECT chrom, e, -1 FROM ships), q AS (SELECT chrom, x, sum(d) AS d FROM p GROUP BY chrom, x),
 r AS (SELECT chrom, x AS "start", lead(x) OVER w AS "end", CAST(sum(d) OVER w AS BIGINT) AS depth FROM q WINDOW w AS (PARTITION BY chrom ORDER BY x)) SELECT * FROM r WHERE depth > 0""")
def interval_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.depth(ships(spark, sf_dir), ["chrom"])


@query(f"""WITH {_ORDERS} SELECT a.chrom, a.id AS id_l, b.id AS id_r, greatest(a.s, b.s) AS overlap_start, least(a.e, b.e) AS overlap_end FROM orders_i a JOIN orders_i b ON a.chrom = b.chrom AND a.s < b.e AND b.s < a.e AND a.id < b.id""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir)
    met = intervals.overlaps(rows, rows, ["chrom"], 64).where("id_l < id_r")
    return met.select("chrom", "id_l", "id_r", F.greatest("start_l", "start_r").alias("overlap_start"), F.least("end_l", "end_r").alias("overlap_end"))


_RUNS = """, reach AS (SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM orders_i)"""


@query(f"""WITH {_ORDERS}{_RUNS}, runs AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM reach)
 SELECT chrom, min(s) AS "start", max(e) AS "end", count(*) AS n FROM runs GROUP BY chrom, run""")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merged(orders(spark, sf_dir), ["chrom"])


@query(f"""WITH {_ORDERS}{_RUNS} SELECT chrom, reach AS "start", s AS "end" FROM reach WHERE s > reach""")
def intergenic_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.gaps(orders(spark, sf_dir), ["chrom"])


_FEATURES = f"""feat AS (SELECT l_suppkey AS chrom, l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_returnflag = 'N' THEN '+' ELSE '-' END AS strand, {_DAY.format('l_shipdate')} AS s, {_DAY.format('l_shipdate')} + 1 AS e FROM lineitem),
 marked AS (SELECT *, CASE WHEN lag(strand) OVER (PARTITION BY chrom ORDER BY s, id) = strand THEN 0 ELSE 1 END AS f FROM feat), numbered AS (SELECT *, sum(f) OVER (PARTITION BY chrom ORDER BY s, id) AS run FROM marked),
 runs AS (SELECT chrom, run, strand, min(s) AS s, max(e) AS e, count(*) AS n FROM numbered GROUP BY ALL)"""


def _directons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("chrom"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_returnflag") == "N", "+").otherwise("-").alias("strand"), _day("l_shipdate").alias("start"), (_day("l_shipdate") + 1).alias("end"))
    return intervals.directons(rows, ["chrom"], ["start", "id"], "strand")


@query(f"""WITH {_FEATURES} SELECT chrom, run::BIGINT AS run, strand, s AS "start", e AS "end", n FROM runs""")
def directons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _directons(spark, sf_dir).select("chrom", F.col("run").cast("bigint").alias("run"), "strand", "start", "end", "n")


@query(f"""WITH {_FEATURES}, x AS (SELECT *, lead(s) OVER (PARTITION BY chrom ORDER BY run) AS nx FROM runs) SELECT chrom, e AS "start", nx AS "end", CASE WHEN strand = '+' THEN 'convergent' ELSE 'divergent' END AS kind FROM x WHERE nx IS NOT NULL""")
def strand_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.strand_switches(_directons(spark, sf_dir), ["chrom"], "strand")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, CAST(epoch(o_orderdate) AS BIGINT) AS at FROM orders), p AS (SELECT o_custkey AS k, CAST(epoch(o_orderdate) AS BIGINT) AS pat, max(o_orderkey) AS shift FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
 SELECT o_orderkey, shift FROM o ASOF LEFT JOIN p ON o.o_custkey = p.k AND o.at >= p.pat""")
def asof_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("at"))
    known = rows.where("o_orderstatus = 'F'").select("o_custkey", F.col("at").alias("shift_at"), F.col("o_orderkey").alias("shift"))
    return intervals.as_of(rows, known, ["o_custkey"], "at", "shift_at", "shift", 90 * 86400).select("o_orderkey", "shift")


@query(f"""WITH {_SHIPS} SELECT chrom, CAST(sum(e - s) AS BIGINT) AS bases, count(*) AS n, round(avg(e - s), 6) AS mean_length, max(e - s) AS longest FROM ships GROUP BY chrom""")
def interval_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("end") - F.col("start")
    return ships(spark, sf_dir).groupBy("chrom").agg(F.sum(size).alias("bases"), F.count("*").alias("n"), F.round(F.avg(size), 6).alias("mean_length"), F.max(size).alias("longest"))
