"""Record queries: alignments, variants, sheets and attributes read off the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import alignment, sequence, variants
from strandlake.operators import tables, tracks
from strandlake.plans.common import Registry, r6, table

query = Registry()
_CIGAR = "c AS (SELECT l_orderkey, l_linenumber, l_linenumber || 'S' || CAST(l_quantity AS INTEGER) || 'M' || (l_suppkey % 5 + 1) || 'D' || (l_partkey % 7 + 1) || 'M' || (l_orderkey % 3 + 1) || 'N' || (l_linenumber + 2) || 'M' AS cigar FROM lineitem)"


def cigar_column():
    s = lambda c: c.cast("string")
    return F.concat(s(F.col("l_linenumber")), F.lit("S"), s(F.col("l_quantity").cast("int")), F.lit("M"), s(F.col("l_suppkey") % 5 + 1), F.lit("D"), s(F.col("l_partkey") % 7 + 1), F.lit("M"), s(F.col("l_orderkey") % 3 + 1), F.lit("N"), s(F.col("l_linenumber") + 2), F.lit("M"))


def _cigars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cigar_column().alias("cigar"))


def _sum_of(ops: str) -> str:
    return f"coalesce(list_sum(list_transform(list_filter(regexp_extract_all(cigar, '\\d+[A-Z=]'), lambda x: contains('{ops}', x[-1])), lambda x: x[:-2]::BIGINT)), 0)::BIGINT"


@query(f"WITH {_CIGAR} SELECT l_orderkey, l_linenumber, {_sum_of('MIS=X')} AS query_length, {_sum_of('MDN=X')} AS reference_length, {_sum_of('SH')} AS clipped FROM c")
def cigar_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("cigar")
    return _cigars(spark, sf_dir).select("l_orderkey", "l_linenumber", alignment.query_length(c).alias("query_length"), alignment.reference_length(c).alias("reference_length"), alignment.clipped(c).alias("clipped"))


@query("SELECT l_orderkey, l_linenumber, 100 + l_quantity::BIGINT + l_suppkey % 5 + 1 + l_partkey % 7 + 1 AS \"start\", 100 + l_quantity::BIGINT + l_suppkey % 5 + 1 + l_partkey % 7 + 1 + l_orderkey % 3 + 1 AS \"end\" FROM lineitem")
def introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cigars(spark, sf_dir).select("l_orderkey", "l_linenumber", F.explode(alignment.introns(F.lit(100), F.col("cigar"))).alias("x")).select("l_orderkey", "l_linenumber", "x.start", "x.end")


_FLAG = "(l_orderkey * 31 + l_linenumber * 7) % 4096"


def _flag():
    return ((F.col("l_orderkey") * 31 + F.col("l_linenumber") * 7) % 4096).cast("bigint")


@query(f"SELECT {_FLAG} AS flag, count(*) AS n FROM lineitem GROUP BY 1")
def sam_flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(_flag().alias("flag")).agg(F.count("*").alias("n"))


@query(f"SELECT {', '.join(f'count(*) FILTER (({_FLAG}) & {bit} <> 0) AS {name}' for name, bit in alignment.FLAGS.items())}, count(*) AS total FROM lineitem")
def sam_flag_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(_flag().alias("flag")).agg(*(F.count_if(alignment.has_flag(F.col("flag"), name)).alias(name) for name in alignment.FLAGS), F.count("*").alias("total"))


@query("SELECT (l_partkey % 61)::BIGINT AS mapq, count(*) AS n FROM lineitem GROUP BY 1")
def mapq_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 61).alias("mapq")).agg(F.count("*").alias("n"))


@query("SELECT sign(l_partkey % 7 - 3)::INTEGER AS kind, abs(l_partkey % 7 - 3)::BIGINT AS length, count(*) AS n FROM lineitem GROUP BY ALL")
def indel_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("l_partkey") % 7 - 3
    return table(spark, sf_dir, "lineitem").groupBy(F.signum(size).cast("int").alias("kind"), F.abs(size).alias("length")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_extendedprice > 5000 AND l_tax * 100 > 1 AND l_discount * 100 > 1 AND l_extendedprice * l_discount * 5 / nullif(l_extendedprice, 0) >= 0.3 AND least(l_tax * 100, l_discount * 100) / nullif(l_tax * 100 + l_discount * 100, 0) >= 0.2")
def variant_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    keep = variants.kept(c("l_quantity"), c("l_extendedprice"), c("l_extendedprice") * c("l_discount") * 5, c("l_tax") * 100, c("l_discount") * 100, score=10, min_depth=5000, min_forward=1, min_reverse=1, min_frequency=0.3, min_balance=0.2)
    return table(spark, sf_dir, "lineitem").where(keep).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_tax + l_discount = 0 THEN 0 ELSE least(l_tax, l_discount) / (l_tax + l_discount) END, 6) AS balance FROM lineitem")
def strand_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(variants.strand_balance(F.col("l_tax"), F.col("l_discount"))).alias("balance"))


@query("SELECT l_orderkey, round(sum(l_extendedprice * l_discount) / nullif(sum(l_extendedprice), 0), 6) AS frequency FROM lineitem GROUP BY l_orderkey")
def allele_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("ao"), F.sum("l_extendedprice").alias("dp"))
    return sums.select("l_orderkey", r6(variants.frequency(F.col("ao"), F.col("dp"))).alias("frequency"))


@query("SELECT l_orderkey, l_linenumber, (l_quantity > 10 AND l_quantity < 20 OR l_quantity >= 45) AS kept, l_discount <= 0.03 AS low FROM lineitem")
def threshold_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", variants.threshold(F.col("l_quantity"), ">10&<20|>=45").alias("kept"), variants.threshold(F.col("l_discount"), "<=0.03").alias("low"))


@query("SELECT CASE WHEN length(p_name) = length(p_brand) AND length(p_name) = 1 THEN 'snp' WHEN length(p_brand) = length(p_name) THEN 'mnp' WHEN length(p_brand) < length(p_name) THEN 'insertion' ELSE 'deletion' END AS kind, count(*) AS n FROM part GROUP BY 1")
def variant_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(variants.kind(F.col("p_brand"), F.col("p_name")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, first(l_linenumber ORDER BY l_extendedprice DESC, l_linenumber) AS l_linenumber, max(l_extendedprice) AS score FROM lineitem GROUP BY l_orderkey")
def best_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("score", F.col("l_extendedprice"))
    return tables.best(rows, ["l_orderkey"], F.struct("l_extendedprice", -F.col("l_linenumber")), ["l_linenumber", "score"])


@query("SELECT p_brand, p_size, min(p_partkey) AS p_partkey, count(*) AS n FROM (SELECT *, rank() OVER (PARTITION BY p_brand, p_size ORDER BY CASE split_part(p_type, ' ', 1) WHEN 'ECONOMY' THEN 1 WHEN 'STANDARD' THEN 2 WHEN 'PROMO' THEN 3 ELSE 8 END) AS r FROM part) WHERE r = 1 GROUP BY ALL")
def best_feature_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.split("p_type", " ")[0]
    weight = F.when(kind == "ECONOMY", 1).when(kind == "STANDARD", 2).when(kind == "PROMO", 3).otherwise(8)
    counts = table(spark, sf_dir, "part").groupBy("p_brand", "p_size", weight.alias("w")).agg(F.min("p_partkey").alias("p_partkey"), F.count("*").alias("n"))
    return tables.best(counts, ["p_brand", "p_size"], -F.col("w"), ["p_partkey", "n"])


@query("SELECT p_brand, n, rank::INTEGER AS rank FROM (SELECT p_brand, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS rank FROM part GROUP BY 1) WHERE rank <= 10")
def top_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand").limit(10)
    return tables.top(counts.withColumn("all", F.lit(1)), ["all"], [F.desc("n"), F.col("p_brand")], 10).drop("all")


@query("SELECT conv_id, count(*) - 1 AS passes, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def zmw_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.count("*") - 1).alias("passes"), F.max("turn").alias("last_turn"))


@query("SELECT conv_id, bool_and(role = CASE turn % 2 WHEN 0 THEN 'user' ELSE 'assistant' END) AS in_step FROM conversations GROUP BY conv_id")
def mate_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.bool_and(F.col("role") == F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant")).alias("in_step"))


@query("SELECT event_type, count(*) AS n, sum(CAST(props->>'$.k' AS BIGINT))::BIGINT AS total, min(CAST(props->>'$.k' AS BIGINT)) AS least FROM events GROUP BY event_type")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.min(k).alias("least"))


@query("""WITH r AS (SELECT 'name_letters' AS "check", 'Error' AS level, count(*) FILTER (NOT regexp_matches(c_name, '^[A-Za-z0-9#_-]+$')) AS n_bad, min(c_name) FILTER (NOT regexp_matches(c_name, '^[A-Za-z0-9#_-]+$')) AS example FROM customer
 UNION ALL SELECT 'balance', 'Warning', count(*) FILTER (c_acctbal < 0), min(c_name) FILTER (c_acctbal < 0) FROM customer
 UNION ALL SELECT 'nation', 'Error', count(*) FILTER (c_nationkey < 0 OR c_nationkey > 24), min(c_name) FILTER (c_nationkey < 0 OR c_nationkey > 24) FROM customer
 UNION ALL SELECT 'segment', 'Warning', count(*) FILTER (c_mktsegment = 'MACHINERY'), min(c_name) FILTER (c_mktsegment = 'MACHINERY') FROM customer)
 SELECT "check", CASE WHEN n_bad > 0 THEN level ELSE 'Success' END AS status, n_bad, example FROM r""")
def sample_sheet_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"name_letters": ("Error", ~F.col("c_name").rlike("^[A-Za-z0-9#_-]+$")), "balance": ("Warning", F.col("c_acctbal") < 0), "nation": ("Error", ~F.col("c_nationkey").between(0, 24)), "segment": ("Warning", F.col("c_mktsegment") == "MACHINERY")}
    return tables.checks(table(spark, sf_dir, "customer"), rules, F.col("c_name"))


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def dup_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey HAVING count(*) > 1")
def multi_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(customers, "o_custkey", "left_semi").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT s_name, row_number() OVER (ORDER BY CAST(regexp_extract(s_name, '\\d+') AS BIGINT))::INTEGER AS place FROM supplier")
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = sequence.natural_key(F.col("s_name"))
    rows = table(spark, sf_dir, "supplier").select("s_name", key.alias("key"), F.lit(1).alias("all"))
    return tracks.dense_positions(rows, "all", ["key"], F.substring("key", 1, 27), "place").select("s_name", F.col("place").cast("int").alias("place"))


@query("SELECT l_orderkey, md5(string_agg(l_linenumber::VARCHAR || ':' || l_returnflag, ';' ORDER BY l_linenumber, l_returnflag)) AS md5 FROM lineitem GROUP BY l_orderkey")
def record_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.struct("l_linenumber", F.concat_ws(":", F.col("l_linenumber").cast("string"), "l_returnflag").alias("x"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["x"]), ";")).alias("md5"))


@query("SELECT event_type, user_id % 10 AS grp, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def events_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 10).alias("grp")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
