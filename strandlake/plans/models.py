"""Queries of models, scans, samples, alignment statistics and taxa."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import alignment_stats, models, samples, scans, tables, taxa
from strandlake.plans.common import Registry, r6, table
from strandlake.plans.coverage import track
from strandlake.plans.records import _FLAG, _flag
from strandlake.plans.sequences import _DNA, dna

query = Registry()


@query()
def mixture_zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z-scores under a fitted mixture; expectation maximisation isn't SQL."""
    rows = track(spark, sf_dir).withColumn("scale", F.col("cov") / 100)
    return models.fitted_zscores(rows, "scale").groupBy("chrom").agg(F.count("*").alias("n"), r6(F.avg("zscore")).alias("mean"), r6(F.stddev_pop("zscore")).alias("std"))


@query("""WITH t AS (SELECT l_returnflag AS chrom, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, CAST(floor(l_partkey / 10) AS BIGINT) AS b FROM lineitem),
 c AS (SELECT chrom, strand, b, count(*) AS c FROM t GROUP BY ALL), n AS (SELECT chrom, greatest(300, max(b) + 1)::DOUBLE AS n FROM t GROUP BY chrom), g AS (SELECT d.chrom, s, b FROM (SELECT DISTINCT chrom FROM t) d, range(0, 4) x(s), range(0, (SELECT greatest(300, max(b) + 1) FROM t)) y(b), n WHERE n.chrom = d.chrom AND b < n),
 v AS (SELECT g.chrom, g.s, coalesce(p.c, 0) AS x, coalesce(m.c, 0) AS y FROM g LEFT JOIN c p ON p.chrom = g.chrom AND p.b = g.b AND p.strand = '+' LEFT JOIN c m ON m.chrom = g.chrom AND m.b = g.b + g.s AND m.strand = '-'),
 k AS (SELECT chrom, sum(c) FILTER (strand = '+') AS p1, sum(c * c) FILTER (strand = '+') AS p2, sum(c) FILTER (strand = '-') AS m1, sum(c * c) FILTER (strand = '-') AS m2 FROM c GROUP BY chrom)
 SELECT chrom, s::INTEGER AS shift, round((sum(x * y) / first(n) - first(p1) / first(n) * first(m1) / first(n)) / nullif(sqrt((first(p2) / first(n) - pow(first(p1) / first(n), 2)) * (first(m2) / first(n) - pow(first(m1) / first(n), 2))), 0), 6) AS correlation FROM v JOIN k USING (chrom) JOIN n USING (chrom) WHERE p1 IS NOT NULL AND m1 IS NOT NULL GROUP BY chrom, s""")
def strand_cross_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("chrom"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"), F.col("l_partkey").alias("pos"))
    lengths = tags.groupBy("chrom").agg(F.greatest(F.lit(300), F.max(F.floor(F.col("pos") / 10)) + 1).alias("bins"))  # 300 as in the SQL, more where the contig is longer
    return models.cross_correlation(tags, "chrom", "pos", "strand", [0, 1, 2, 3], 10, lengths).select("chrom", "shift", r6("correlation").alias("correlation"))


@query("""WITH s AS (SELECT p_brand AS k, p_size % 3 AS g, count(*) AS n, sum(p_retailprice) AS s, sum(p_retailprice * p_retailprice) AS ss FROM part GROUP BY ALL), t AS (SELECT k, sum(n) AS n, sum(s) AS s, sum(ss) AS ss, sum(s * s / n) AS b, count(*) AS c FROM s GROUP BY k)
 SELECT k, round(((b - s * s / n) / (c - 1)) / nullif((ss - b) / (n - c), 0), 4) AS f, (c - 1)::BIGINT AS df_between, (n - c)::BIGINT AS df_within FROM t""")
def anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("k"), (F.col("p_size") % 3).alias("g"), "p_retailprice")
    return models.analysis_of_variance(rows, ["k"], "g", "p_retailprice").select("k", F.round("f", 4).alias("f"), "df_between", "df_within")


_WORDS = f"{_DNA}, w AS (SELECT substr(s, k * 8 + 1, 8) AS w FROM (SELECT s, unnest(range(0, length(s) // 8)) AS k FROM dna))"
_PFM = f"{_WORDS}, c AS (SELECT p AS position, w[p] AS letter, count(*) AS n FROM w, range(1, 9) x(p) GROUP BY ALL), f AS (SELECT *, n / sum(n) OVER (PARTITION BY position) AS share FROM c)"


def _frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = dna(spark, sf_dir).select(F.explode(F.regexp_extract_all("s", F.lit("(.{8})"), 1)).alias("w"))
    return models.position_frequencies(words, "w")


@query(f"WITH {_PFM} SELECT position::BIGINT AS position, letter, n, round(share, 6) AS share FROM f")
def position_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequencies(spark, sf_dir).select(F.col("position").cast("bigint").alias("position"), "letter", "n", r6("share").alias("share"))


@query(f"WITH {_PFM}, g AS (SELECT letter, sum(n) / (SELECT sum(n) FROM c) AS share FROM c GROUP BY letter) SELECT position::BIGINT AS position, round(sum((f.share + 1e-12) * log2((f.share + 1e-12) / (g.share + 1e-12))), 9) AS kl FROM f JOIN g USING (letter) GROUP BY position")
def divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _frequencies(spark, sf_dir)
    whole = p.groupBy("letter").agg(F.sum("n").alias("n"))
    background = p.select("position").distinct().crossJoin(whole.join(F.broadcast(whole.agg(F.sum("n").alias("t")))).select("letter", (F.col("n") / F.col("t")).alias("share")))  # eight positions, four letters
    return models.divergence(p, background, ["position", "letter"]).select(F.col("position").cast("bigint").alias("position"), F.round("kl", 9).alias("kl"))


@query(f"WITH {_PFM}, k AS (SELECT position, string_agg(letter, '' ORDER BY letter) AS s FROM f WHERE share >= 0.25 GROUP BY position) SELECT string_agg(CASE s WHEN 'A' THEN 'A' WHEN 'C' THEN 'C' WHEN 'G' THEN 'G' WHEN 'T' THEN 'T' WHEN 'AG' THEN 'R' WHEN 'CT' THEN 'Y' WHEN 'CG' THEN 'S' WHEN 'AT' THEN 'W' WHEN 'GT' THEN 'K' WHEN 'AC' THEN 'M' WHEN 'CGT' THEN 'B' WHEN 'AGT' THEN 'D' WHEN 'ACT' THEN 'H' WHEN 'ACG' THEN 'V' ELSE 'N' END, '' ORDER BY position) AS consensus FROM k")
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.consensus(_frequencies(spark, sf_dir))


@query(f"""WITH {_DNA}, m AS (SELECT doc_id, string_split_regex(s, '(?:AC){{3,}}') AS p, regexp_extract_all(s, '(?:AC){{3,}}') AS m FROM dna WHERE s IS NOT NULL), k AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM m),
 a AS (SELECT doc_id, list_sum(list_transform(p[1 : k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : k - 1], lambda x: length(x))), 0) AS a, m[k] AS match FROM k) SELECT doc_id, a::BIGINT AS "start", (a + length(match))::BIGINT AS "end", match FROM a""")
def regex_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.regex_scan(dna(spark, sf_dir), "doc_id", "s", "(?:AC){3,}")


@query(f"""WITH {_DNA}, f AS (SELECT doc_id, k AS frame, substr(s, k + 1) AS s FROM dna, range(0, 3) x(k)), c AS (SELECT doc_id, frame, list_transform(regexp_extract_all(s, '...'), lambda x: CASE WHEN x IN ('TAA', 'TAG', 'TGA') THEN '*' ELSE 'x' END) AS m FROM f)
 SELECT doc_id, frame::INTEGER AS frame, count(*) AS stretches, max(length(p))::BIGINT * 3 AS longest FROM (SELECT doc_id, frame, unnest(string_split(array_to_string(m, ''), '*')) AS p FROM c) WHERE length(p) * 3 >= 60 GROUP BY ALL""")
def reading_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scans.frames(dna(spark, sf_dir), "doc_id", "s", 60).where("strand = '+'")
    return rows.groupBy("doc_id", "frame").agg(F.count("*").alias("stretches"), F.max(F.col("end") - F.col("start")).cast("bigint").alias("longest"))


@query(f"WITH {_DNA} SELECT doc_id, (i - 1) // 200 AS \"window\", count(*) AS hits FROM (SELECT doc_id, s, unnest(range(1, length(s) - 1)) AS i FROM dna WHERE length(s) >= 3) WHERE substr(s, i, 3) = 'ACA' GROUP BY ALL")
def motif_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.motif_density(dna(spark, sf_dir), "doc_id", "s", "ACA", 200)


@query(f"SELECT count(*) FILTER ({_FLAG} & 2304 = 0) AS total, count(*) FILTER ({_FLAG} & 2308 = 0) AS mapped, count(*) FILTER ({_FLAG} & 2304 = 0 AND {_FLAG} & 4 <> 0) AS unmapped, count(*) FILTER ({_FLAG} & 2304 = 0 AND {_FLAG} & 2 <> 0) AS proper_pairs, count(*) FILTER ({_FLAG} & 1024 <> 0) AS duplicates, count(*) FILTER ({_FLAG} & 256 <> 0) AS secondary, count(*) FILTER ({_FLAG} & 512 <> 0) AS qc_fail FROM (SELECT * FROM lineitem)".replace(_FLAG, f"({_FLAG})"))
def alignment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_stats.summary(table(spark, sf_dir, "lineitem").select(_flag().alias("flag")))


@query(f"SELECT CASE WHEN f & 512 <> 0 THEN 'qc_fail' WHEN f & 1024 <> 0 THEN 'duplicate' WHEN f & 256 <> 0 THEN 'secondary' WHEN f & 4 <> 0 THEN 'unmapped' WHEN q < 30 THEN 'low_quality' ELSE 'used' END AS reason, count(*) AS n FROM (SELECT {_FLAG} AS f, l_partkey % 61 AS q FROM lineitem) GROUP BY 1")
def alignment_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_stats.by_first_reason(table(spark, sf_dir, "lineitem").select(_flag().alias("flag"), (F.col("l_partkey") % 61).alias("mapq")), 30)


@query("SELECT count(*) AS n, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, round(stddev_pop(x), 6) AS std FROM (SELECT abs(l_partkey % 1201 - 600) AS x FROM lineitem) WHERE x BETWEEN 10 AND 500")
def insert_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 1201 - 600).alias("tlen"))
    return alignment_stats.insert_size(rows, 10, 500).select("n", r6("mean").alias("mean"), r6("median").alias("median"), r6("std").alias("std"))


@query()
def random_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: the limit is its feature."""
    return samples.random_rows(table(spark, sf_dir, "orders").select("o_orderkey"), 100, "o_orderkey", 7)


@query("SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events) WHERE (n - 1) % 10 = 3")
def stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", "ts")
    return samples.every(rows, 10, 3, "event_type", ["ts", "event_id"], F.date_trunc("day", "ts")).select("event_type", "event_id")


@query("SELECT 1000 + c_custkey AS taxon, r_name AS kingdom, n_name AS phylum, ' ' AS species FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def rank_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = lambda c: F.col(c).cast("bigint")
    regions = table(spark, sf_dir, "region").select(big("r_regionkey").alias("taxon"), big("r_regionkey").alias("parent"), F.lit("superkingdom").alias("rank"), F.col("r_name").alias("name"))
    nations = table(spark, sf_dir, "nation").select((100 + big("n_nationkey")).alias("taxon"), big("n_regionkey").alias("parent"), F.lit("phylum").alias("rank"), F.col("n_name").alias("name"))
    customers = table(spark, sf_dir, "customer").select((1000 + F.col("c_custkey")).alias("taxon"), (100 + big("c_nationkey")).alias("parent"), F.lit("no rank").alias("rank"), F.col("c_name").alias("name"))
    return taxa.ranked(regions.union(nations).union(customers), 4).where("taxon >= 1000").select("taxon", "kingdom", "phylum", "species")


@query("SELECT coalesce(nullif(user_id % 7, 0), -1)::BIGINT AS taxon, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percentage FROM events GROUP BY 1")
def taxon_abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxa.abundance(table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("taxon"))).select("taxon", "n", r6("percentage").alias("percentage"))


@query("SELECT p_brand, p_type, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS k FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL)) WHERE k = 1")
def most_present_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return tables.top(counts, ["p_brand"], [F.desc("n"), F.col("p_type")], 1).select("p_brand", "p_type", "n")
