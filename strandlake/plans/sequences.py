"""Sequence queries: letters of ``documents`` read as bases, whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions import quality, sequence
from strandlake.operators import tables
from strandlake.plans.common import Registry, r6, table

query = Registry()
_LETTERS, _BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
_DNA = f"dna AS (SELECT doc_id, lang, translate(regexp_replace(text, '[^a-z]', '', 'g'), '{_LETTERS}', '{_BASES}') AS s FROM documents)"
_KMERS = "(SELECT doc_id, lang, s, unnest(range(1, length(s) - {k} + 2)) AS i FROM dna WHERE length(s) >= {k})"


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.translate(F.regexp_replace("text", "[^a-z]", ""), _LETTERS, _BASES).alias("s"))


def _n(letters: str) -> Column:
    return sequence.count_of(F.col("s"), letters).cast("bigint")


def _sql_n(letter: str) -> str:
    return f"(length(s) - length(replace(s, '{letter}', '')))"


def kmers_of(df: DataFrame, k: int, *keep: str) -> DataFrame:
    return df.select(*keep, F.explode(sequence.kmers(F.col("s"), k)).alias("kmer"))


@query(f"WITH {_DNA} SELECT doc_id, length(s)::BIGINT AS n, {', '.join(f'{_sql_n(c)}::BIGINT AS {c.lower()}' for c in 'ACGT')}, round(({_sql_n('G')} + {_sql_n('C')}) / nullif(length(s), 0), 6) AS gc FROM dna")
def base_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir).select("doc_id", F.length("s").cast("bigint").alias("n"), *(_n(c).alias(c.lower()) for c in "ACGT"), r6(sequence.gc_content(F.col("s"))).alias("gc"))


@query("""WITH c AS (SELECT lang, n_chars, count(*) AS c FROM documents GROUP BY ALL), r AS (SELECT *, sum(c * n_chars) OVER w AS upto, sum(c) OVER w AS rk, sum(c * n_chars) OVER (PARTITION BY lang) AS total FROM c WINDOW w AS (PARTITION BY lang ORDER BY n_chars DESC)),
 d AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC) AS k, sum(n_chars) OVER (PARTITION BY lang ORDER BY n_chars DESC ROWS UNBOUNDED PRECEDING) AS s, sum(n_chars) OVER (PARTITION BY lang) AS t FROM documents)
 SELECT lang, max(n_chars) AS n50, min(k) AS l50 FROM d WHERE s >= t * 0.5 GROUP BY lang""")
def n50_l50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.n50(table(spark, sf_dir, "documents"), ["lang"], "n_chars")


@query("""SELECT lang, count(*) AS n, min(n_chars) AS shortest, max(n_chars) AS longest, sum(n_chars)::BIGINT AS total, round(avg(n_chars), 6) AS mean, round(quantile_cont(n_chars, 0.5), 6) AS median, round(stddev_samp(n_chars), 6) AS std FROM documents GROUP BY lang""")
def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("n_chars")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.min(x).alias("shortest"), F.max(x).alias("longest"), F.sum(x).alias("total"), r6(F.avg(x)).alias("mean"), r6(F.percentile(x, F.lit(0.5))).alias("median"), r6(F.stddev_samp(x)).alias("std"))


@query(f"WITH {_DNA} SELECT i AS pos, substr(s, i, 1) AS base, count(*) AS n FROM {_KMERS.format(k=1)} GROUP BY ALL")
def per_position_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dna(spark, sf_dir).select(F.posexplode(sequence.kmers(F.col("s"), 1)).alias("pos", "base"))
    return rows.groupBy((F.col("pos") + 1).cast("bigint").alias("pos"), "base").agg(F.count("*").alias("n"))


@query(f"""WITH {_DNA}, w AS (SELECT doc_id, i * 100 AS at, substr(s, i * 100 + 1, 100) AS s FROM (SELECT doc_id, s, unnest(range(0, length(s) // 100)) AS i FROM dna))
 SELECT doc_id, at::BIGINT AS "start", round(CASE WHEN {_sql_n('G')} + {_sql_n('C')} = 0 THEN 0 ELSE ({_sql_n('G')} - {_sql_n('C')}) / ({_sql_n('G')} + {_sql_n('C')}) END, 6) AS gc_skew, round(CASE WHEN {_sql_n('A')} + {_sql_n('T')} = 0 THEN 0 ELSE ({_sql_n('A')} - {_sql_n('T')}) / ({_sql_n('A')} + {_sql_n('T')}) END, 6) AS at_skew FROM w""".replace(" AS at,", " AS x,").replace("SELECT doc_id, at::BIGINT", "SELECT doc_id, x::BIGINT"))
def gc_skew_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dna(spark, sf_dir).select("doc_id", F.explode(sequence.windows_of(F.col("s"), 100, 100)).alias("w"))
    return rows.select("doc_id", F.col("w.start").cast("bigint").alias("start"), r6(sequence.skew(F.col("w.word"), "G", "C")).alias("gc_skew"), r6(sequence.skew(F.col("w.word"), "A", "T")).alias("at_skew"))


@query(f"""WITH {_DNA} SELECT doc_id, round({' + '.join(f"CASE WHEN {_sql_n(c)} > 0 THEN -({_sql_n(c)} / length(s)) * ln({_sql_n(c)} / length(s)) ELSE 0 END" for c in 'ACGT')}, 6) AS entropy FROM dna WHERE length(s) > 0""")
def shannon_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir).where("length(s) > 0").select("doc_id", r6(sequence.entropy(F.col("s"))).alias("entropy"))


@query(f"WITH {_DNA} SELECT substr(s, i, 4) AS kmer, count(*) AS n FROM {_KMERS.format(k=4)} GROUP BY ALL")
def kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers_of(dna(spark, sf_dir), 4).groupBy("kmer").agg(F.count("*").alias("n"))


@query(f"""WITH {_DNA}, c AS (SELECT lang, substr(s, i, 5) AS kmer, count(*) AS n FROM {_KMERS.format(k=5)} GROUP BY ALL) SELECT lang, kmer, n, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, kmer) AS rank FROM c) WHERE rank <= 10""")
def kmer_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = kmers_of(dna(spark, sf_dir), 5, "lang").groupBy("lang", "kmer").agg(F.count("*").alias("n"))
    return tables.top(counts, ["lang"], [F.desc("n"), F.col("kmer")], 10)


@query(f"""WITH {_DNA}, k2 AS (SELECT substr(s, i, 2) AS kmer, count(*) AS n FROM {_KMERS.format(k=2)} GROUP BY ALL), k1 AS (SELECT substr(s, i, 1) AS b, count(*) AS n FROM {_KMERS.format(k=1)} GROUP BY ALL), t AS (SELECT sum(n) AS t FROM k1), t2 AS (SELECT sum(n) AS t2 FROM k2)
 SELECT kmer, k2.n, round((k2.n / t2) / ((x.n / t) * (y.n / t)), 6) AS odds FROM k2 JOIN k1 x ON x.b = kmer[1] JOIN k1 y ON y.b = kmer[2], t, t2""")
def kmer_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dna(spark, sf_dir)
    singles = kmers_of(rows, 1).groupBy("kmer").agg(F.count("*").alias("m")).withColumn("p", F.col("m") / F.sum("m").over(Window.partitionBy(F.lit(1))))  # four rows
    pairs = kmers_of(rows, 2).groupBy("kmer").agg(F.count("*").alias("n")).withColumn("q", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))  # sixteen rows
    first, second = singles.select(F.col("kmer").alias("a"), F.col("p").alias("pa")), singles.select(F.col("kmer").alias("b"), F.col("p").alias("pb"))
    joined = pairs.join(first, F.left("kmer", F.lit(1)) == F.col("a")).join(second, F.right("kmer", F.lit(1)) == F.col("b"))
    return joined.select("kmer", "n", r6(F.col("q") / (F.col("pa") * F.col("pb"))).alias("odds"))


_RC = "reverse(translate({}, 'ACGT', 'TGCA'))"


@query(f"WITH {_DNA} SELECT substr(s, i, 6) AS kmer, count(*) AS n FROM {_KMERS.format(k=6)} WHERE substr(s, i, 6) = {_RC.format('substr(s, i, 6)')} GROUP BY ALL")
def palindromes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers_of(dna(spark, sf_dir), 6).where(sequence.is_reverse_palindrome(F.col("kmer"))).groupBy("kmer").agg(F.count("*").alias("n"))


_ENZYMES = {"EcoRI": "GAATTC", "BamHI": "GGATCC", "HindIII": "AAGCTT", "NotI": "GCGGCCGC", "Sau3AI": "GATC", "MluCI": "AATT"}


@query(f"WITH {_DNA}, e AS (SELECT unnest(['{"', '".join(_ENZYMES)}']) AS enzyme, unnest(['{"', '".join(_ENZYMES.values())}']) AS site), p AS (SELECT doc_id, upper(s) AS s, unnest(range(1, length(s) + 1)) AS pos FROM dna) SELECT doc_id, enzyme, pos FROM p JOIN e ON substr(s, pos, length(site)) = site")
def restriction_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dna(spark, sf_dir).select("doc_id", F.explode(sequence.restriction_sites(F.lower("s"), _ENZYMES)).alias("x"))
    return rows.select("doc_id", "x.enzyme", "x.pos")


@query(f"WITH {_DNA} SELECT doc_id, len(regexp_extract_all(s, 'CG'))::BIGINT AS cpg, round(len(regexp_extract_all(s, 'CG')) * length(s) / nullif({_sql_n('C')} * {_sql_n('G')}, 0), 6) AS ratio FROM dna")
def cpg_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir).select("doc_id", F.regexp_count("s", F.lit("CG")).cast("bigint").alias("cpg"), r6(sequence.cpg_ratio(F.col("s"))).alias("ratio"))


@query(f"WITH {_DNA} SELECT doc_id, md5({_RC.format('s')}) AS revcomp_md5 FROM dna")
def revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir).select("doc_id", F.md5(sequence.reverse_complement(F.col("s"))).alias("revcomp_md5"))


@query(f"WITH {_DNA} SELECT doc_id, (2 * ({_sql_n('A')} + {_sql_n('T')}) + 4 * ({_sql_n('G')} + {_sql_n('C')}))::BIGINT AS wallace, round(69.3 + 41.0 * ({_sql_n('G')} + {_sql_n('C')}) / nullif(length(s), 0) - 650.0 / nullif(length(s), 0), 6) AS salt_adjusted FROM dna")
def melting_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir).select("doc_id", sequence.tm_wallace(F.col("s")).cast("bigint").alias("wallace"), r6(sequence.tm_salt_adjusted(F.col("s"))).alias("salt_adjusted"))


_RUNS = "(SELECT doc_id, unnest(regexp_extract_all(s, 'A+|C+|G+|T+')) AS run FROM dna)"


@query(f"WITH {_DNA} SELECT run[1] AS base, length(run)::BIGINT AS length, count(*) AS n FROM {_RUNS} GROUP BY ALL")
def homopolymer_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dna(spark, sf_dir).select(F.explode(sequence.runs_of_letters(F.col("s"))).alias("run"))
    return rows.groupBy(F.left("run", F.lit(1)).alias("base"), F.length("run").cast("bigint").alias("length")).agg(F.count("*").alias("n"))


@query(f"WITH {_DNA} SELECT doc_id, round(sum(length(run) * least(length(run), 4) * CASE run[1] WHEN 'G' THEN 1 WHEN 'C' THEN -1 ELSE 0 END) / sum(length(run)), 6) AS score FROM {_RUNS} GROUP BY doc_id")
def g4_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = sequence.g4_scores(F.col("s"))
    return dna(spark, sf_dir).where("length(s) > 0").select("doc_id", r6(F.aggregate(scores, F.lit(0).cast("bigint"), lambda a, x: a + x) / F.length("s")).alias("score"))


@query(f"WITH {_DNA}, k AS (SELECT substr(s, i, 3) AS w FROM {_KMERS.format(k=3)}) SELECT least(w, w[2:3] || w[1], w[3] || w[1:2]) AS kmer, count(*) AS n FROM k GROUP BY ALL")
def circular_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = kmers_of(dna(spark, sf_dir), 3).groupBy("kmer").agg(F.count("*").alias("c"))
    return words.groupBy(sequence.canonical_rotation(F.col("kmer")).alias("kmer")).agg(F.sum("c").alias("n"))


@query(f"WITH {_DNA} SELECT doc_id, round(count(DISTINCT substr(s, i, 3)) / least(length(s) - 2, 64), 6) AS complexity FROM {_KMERS.format(k=3)} GROUP BY doc_id, s")
def linguistic_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir).where("length(s) >= 3").select("doc_id", r6(sequence.linguistic_complexity(F.col("s"), 3)).alias("complexity"))


_CODON = "strpos('TCAG', c[{}])"


@query(f"WITH {_DNA}, c AS (SELECT doc_id, unnest(regexp_extract_all(s, '...')) AS c FROM dna) SELECT substr('{sequence.AMINO_ACIDS}', ((strpos('TCAG', c[1]) - 1) * 16 + (strpos('TCAG', c[2]) - 1) * 4 + strpos('TCAG', c[3]))::BIGINT, 1) AS amino_acid, count(*) AS n FROM c GROUP BY ALL")
def translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir).select(F.explode(F.split(sequence.translated(F.col("s")), "")).alias("amino_acid")).where("amino_acid != ''").groupBy("amino_acid").agg(F.count("*").alias("n"))


@query("WITH q AS (SELECT doc_id, regexp_replace(text, '[^!-~]', '', 'g') AS q FROM documents) SELECT doc_id, round(list_avg(list_transform(string_split(q, ''), lambda x: ascii(x) - 33)), 6) AS mean_quality FROM q WHERE q <> ''")
def phred_mean_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^!-~]", "").alias("q"))
    return rows.where("q != ''").select("doc_id", r6(quality.mean_quality(F.col("q"))).alias("mean_quality"))


@query("SELECT l_orderkey, l_linenumber, round(pow(10, -l_quantity / 10), 9) AS p, round(-10 * log10(pow(10, -l_quantity / 10)), 6) AS q, round(10 * log10(pow(10, l_quantity / 10) - 1), 6) AS solexa FROM lineitem")
def phred_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    p = quality.error_probability(q)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(p, 9).alias("p"), r6(quality.phred(p)).alias("q"), r6(quality.solexa_from_phred(q)).alias("solexa"))


@query("SELECT o_orderkey, round(n * 150.0 / o_totalprice, 6) AS coverage, round(1 - exp(-n * 150.0 / o_totalprice), 6) AS covered, round(n * exp(-n * 150.0 / o_totalprice), 6) AS contigs FROM (SELECT l_orderkey AS o_orderkey, sum(l_quantity) AS n FROM lineitem GROUP BY 1) JOIN orders USING (o_orderkey)")
def lander_waterman(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("n"))
    c = quality.fold_coverage(F.col("n"), F.lit(150.0), F.col("o_totalprice"))
    return reads.join(table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", r6(c).alias("coverage"), r6(quality.share_covered(c)).alias("covered"), r6(quality.expected_contigs(F.col("n"), c)).alias("contigs"))


@query("SELECT l_orderkey, l_linenumber, round(y, 6) AS y, round(0.25 * y * y + 0.25 * sqrt(1.5) / y - 11.0 / 8 / (y * y) + 5.0 / 8 * sqrt(1.5) / (y * y * y) - 1.0 / 8, 6) AS x FROM (SELECT *, 2 * sqrt(l_quantity + 3.0 / 8) AS y FROM lineitem)")
def anscombe(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = quality.anscombe(F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(y).alias("y"), r6(quality.inverse_anscombe(y)).alias("x"))


@query("WITH m AS (SELECT l_returnflag AS k, count(*) AS n, avg(l_quantity) AS mu, var_pop(l_quantity) AS v FROM lineitem GROUP BY 1), l AS (SELECT k, n, -n / 2.0 * (ln(2 * pi() * v) + 1) AS ll FROM m) SELECT k, round(ll, 4) AS log_likelihood, round(4 - 2 * ll, 4) AS aic, round(4 - 2 * ll + 12.0 / (n - 3), 4) AS aicc, round(-2 * ll + 2 * (ln(n) - ln(2 * pi())), 4) AS bic FROM l")
def aic_bic(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(F.count("*").alias("n"), F.var_pop("l_quantity").alias("v"))
    ll = -F.col("n") / 2.0 * (F.log(2 * F.pi() * F.col("v")) + 1)
    n, two = F.col("n"), F.lit(2)
    return m.select("k", *(F.round(x, 4).alias(name) for name, x in (("log_likelihood", ll), ("aic", quality.aic(ll, two)), ("aicc", quality.aicc(ll, two, n)), ("bic", quality.bic(ll, two, n)))))
