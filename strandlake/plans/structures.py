"""Queries of sequence structure: the letters of ``documents`` as bases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import sequence, structure
from strandlake.plans.common import Registry, r6, table
from strandlake.plans.sequences import _DNA, dna, kmers_of

query = Registry()


def _case(scale: dict[str, float], word: str) -> str:
    return f"CASE {word} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in scale.items()) + " END"


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def _scale_sql(scale: dict[str, float], width: int) -> str:
    return f"WITH {_DNA}, k AS (SELECT doc_id, substr(s, i, {width}) AS w FROM (SELECT doc_id, s, unnest(range(1, length(s) - {width} + 2)) AS i FROM dna WHERE length(s) >= {width})) SELECT doc_id, round(sum({_case(scale, 'w')}::DOUBLE) / count(*), 4) AS mean FROM k GROUP BY doc_id"


@query(_scale_sql(structure.BENDABILITY, 3))
def bendability(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = structure.bendability(F.col("s"))
    return dna(spark, sf_dir).where("length(s) >= 3").select("doc_id", F.round(_total(x) / F.size(x), 4).alias("mean"))


@query(_scale_sql(structure.TWIST, 2))
def helix_twist(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = structure.helix_twist(F.col("s"))
    return dna(spark, sf_dir).where("length(s) >= 2").select("doc_id", F.round(_total(x) / F.size(x), 4).alias("mean"))


@query(f"""WITH {_DNA}, k AS (SELECT doc_id, i, {_case(structure.ANGLES, 'substr(s, i, 2)')} AS a FROM (SELECT doc_id, s, unnest(range(1, length(s))) AS i FROM dna WHERE length(s) > 100)),
 w AS (SELECT doc_id, i, sum(a) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) / 99 AS f FROM k) SELECT doc_id, count(*)::INTEGER AS n, round(max(f), 6) AS greatest, round(min(f), 6) AS least FROM w WHERE i >= 100 GROUP BY doc_id""")
def dna_flexibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dna(spark, sf_dir).where("length(s) > 100").select("doc_id", structure.flexibility(100)("s").alias("x"))
    return rows.select("doc_id", F.size("x").alias("n"), r6(F.array_max("x")).alias("greatest"), r6(F.array_min("x")).alias("least"))


@query(f"""WITH {_DNA}, k AS (SELECT doc_id, i, substr(s, i, 3) AS w FROM (SELECT doc_id, s, unnest(range(1, length(s) - 1)) AS i FROM dna WHERE length(s) >= 52)), o AS (SELECT doc_id, (i - 1) // 50 * 50 + 1 AS i, w, count(*) AS c FROM k GROUP BY ALL),
 e AS (SELECT doc_id, i, sum(c) AS n, -sum(c / 50.0 * log2(c / 50.0)) AS h FROM o GROUP BY ALL) SELECT doc_id, i - 1 AS "start", round(h, 6) AS entropy FROM e WHERE n = 50""")
def word_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dna(spark, sf_dir).where("length(s) >= 52").select("doc_id", F.posexplode(structure.word_entropy(50)("s")).alias("start", "h"))
    return rows.where("start % 50 = 0").select("doc_id", F.col("start").cast("bigint").alias("start"), r6("h").alias("entropy"))


@query(f"""WITH {_DNA}, p AS (SELECT doc_id, substr(s, i::BIGINT, 60) AS w FROM (SELECT doc_id, s, unnest(range(1, length(s) + 1)) AS i FROM dna WHERE length(s) > 0)) SELECT doc_id, max({' + '.join(f"(length(w) - length(replace(w, '{c}', ''))) // 3" for c in ('AAA', 'CCC', 'GGG', 'TTT'))})::INTEGER AS most, sum({' + '.join(f"(length(w) - length(replace(w, '{c}', ''))) // 3" for c in ('AAA', 'CCC', 'GGG', 'TTT'))})::BIGINT AS total FROM p GROUP BY doc_id""")
def homopolymer_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dna(spark, sf_dir).where("length(s) > 0").select("doc_id", structure.homopolymers(3, 60)("s").alias("x"))
    return rows.select("doc_id", F.array_max("x").alias("most"), F.aggregate("x", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query(f"""WITH {_DNA}, l AS (SELECT doc_id, i, substr(s, i, 1) AS b, substr(s, i, 2) AS d, s FROM (SELECT doc_id, s, unnest(range(1, length(s) + 1)) AS i FROM dna WHERE length(s) >= 200)),
 x AS (SELECT unnest(['A', 'C', 'G', 'T']) AS x), xy AS (SELECT a.x AS x, b.x AS y FROM x a, x b), f AS (SELECT doc_id, length(s) AS n, substr(s, 1, 200) AS w, s FROM dna WHERE length(s) >= 200),
 c AS (SELECT doc_id, x, y, n, length(s) - length(replace(s, x, '')) AS sx, length(s) - length(replace(s, y, '')) AS sy, length(w) - length(replace(w, x, '')) AS wx, length(w) - length(replace(w, y, '')) AS wy FROM f, xy),
 g AS (SELECT doc_id, d, count(*) AS sd, count(*) FILTER (i < 200) AS wd FROM l WHERE length(d) = 2 GROUP BY ALL),
 p AS (SELECT c.doc_id, coalesce(wd, 0) / 199.0 / greatest(wx / 200.0 * wy / 200.0, 1e-9) AS here, coalesce(sd, 0) / (n - 1.0) / greatest(sx / n * sy / n, 1e-9) AS whole FROM c LEFT JOIN g ON g.doc_id = c.doc_id AND g.d = x || y)
 SELECT doc_id, round(sum(abs(here - whole)) / 16, 6) AS first_window FROM p GROUP BY doc_id""")
def signature_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dna(spark, sf_dir).where("length(s) >= 200").select("doc_id", structure.signature_difference(200)("s").alias("x"))
    return rows.select("doc_id", r6(F.get("x", F.lit(0))).alias("first_window"))


_SCORES = f"""{_DNA}, r AS (SELECT doc_id, unnest(regexp_extract_all(s, 'A+|C+|G+|T+')) AS run, generate_subscripts(regexp_extract_all(s, 'A+|C+|G+|T+'), 1) AS k FROM dna), v AS (SELECT doc_id, k, least(length(run), 4) * CASE run[1] WHEN 'G' THEN 1 WHEN 'C' THEN -1 ELSE 0 END AS v, unnest(range(length(run))) AS j FROM r),
 q AS (SELECT doc_id, v, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1 AS i FROM v), w AS (SELECT doc_id, i, count(*) OVER o AS n, sum(v) OVER o AS t FROM q WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)), hit AS (SELECT doc_id, i FROM w WHERE n = 20 AND abs(t) >= 20)"""


@query(f"""WITH {_SCORES}, m AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM hit) SELECT doc_id, min(i)::INTEGER AS "start", (max(i) + 20)::INTEGER AS "end", count(*)::INTEGER AS n FROM m GROUP BY doc_id, g""")
def quadruplex_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = structure.quadruplex_windows(sequence.g4_scores(F.col("s")))
    rows = dna(spark, sf_dir).where("length(s) > 0").select("doc_id", starts.alias("x")).select("doc_id", F.explode(structure.chained(F.col("x"), 20)).alias("r"))
    return rows.select("doc_id", "r.start", "r.end", "r.n")


_RC = "reverse(translate({}, 'ACGT', 'TGCA'))"


@query(f"""WITH {_DNA}, k AS (SELECT doc_id, stem, i - 1 AS "start", substr(s, i, 2 * stem) AS w FROM (SELECT doc_id, s, stem, unnest(range(1, length(s) - 2 * stem + 2)) AS i FROM dna, (SELECT unnest(range(6, 9)) AS stem) WHERE length(s) >= 2 * stem)) SELECT doc_id, stem::INTEGER AS stem, "start"::INTEGER AS "start", w AS word FROM k WHERE w = {_RC.format('w')}""")
def cruciforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(stem: int) -> DataFrame:
        rows = dna(spark, sf_dir).select("doc_id", F.posexplode(sequence.kmers(F.col("s"), 2 * stem)).alias("start", "word"))
        return rows.where(sequence.is_reverse_palindrome(F.col("word"))).select("doc_id", F.lit(stem).alias("stem"), "start", "word")

    return of(6).union(of(7)).union(of(8))


@query(f"""WITH {_DNA}, k AS (SELECT doc_id, doc_id * 7 % 90 AS near, i - 1 AS pos, substr(s, i, 3) AS c FROM (SELECT doc_id, s, unnest(range(1, length(s) - 1)) AS i FROM dna WHERE length(s) >= 3)),
 a AS (SELECT DISTINCT ON (doc_id) doc_id, pos, c FROM k WHERE c IN ('ATG', 'TTG', 'GTG') ORDER BY doc_id, abs(pos - near), -sign(pos - near)), b AS (SELECT DISTINCT ON (doc_id) doc_id, pos, c FROM k WHERE c IN ('CTA', 'TCA', 'TTA') ORDER BY doc_id, abs(pos - near), sign(pos - near))
 SELECT dna.doc_id, a.pos::INTEGER AS start_pos, a.c AS start_codon, b.pos::INTEGER AS stop_pos, b.c AS stop_codon FROM dna LEFT JOIN a ON a.doc_id = dna.doc_id LEFT JOIN b ON b.doc_id = dna.doc_id""")
def nearest_codons(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("doc_id") * 7 % 90).cast("int")
    rows = dna(spark, sf_dir).select("doc_id", structure.nearest_codon(F.col("s"), at, structure.STARTS).alias("a"), structure.nearest_codon(F.col("s"), at, structure.STOPS, "-").alias("b"))
    return rows.select("doc_id", F.col("a.pos").alias("start_pos"), F.col("a.codon").alias("start_codon"), F.col("b.pos").alias("stop_pos"), F.col("b.codon").alias("stop_codon"))


@query("SELECT doc_id, length(translate(upper(lang), 'ACGTNEF', '')) = 0 AS valid, reverse(lang) AS backwards FROM documents")
def sequence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", structure.is_valid(F.col("lang"), "ACGTNEF").alias("valid"), structure.reversed_sequence(F.col("lang")).alias("backwards"))


@query(f"WITH {_DNA}, b AS (SELECT unnest(['A', 'C', 'G', 'T']) AS b), w AS (SELECT x.b || y.b || z.b AS kmer FROM b x, b y, b z) SELECT kmer, count(doc_id) AS n FROM w LEFT JOIN (SELECT doc_id, substr(s, i, 3) AS kmer FROM (SELECT doc_id, s, unnest(range(1, length(s) - 1)) AS i FROM dna WHERE length(s) >= 3)) USING (kmer) GROUP BY kmer")
def every_kmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.range(1).select(F.explode(structure.words_over("ACGT", 3)).alias("kmer"))
    counts = kmers_of(dna(spark, sf_dir), 3).groupBy("kmer").agg(F.count("*").alias("c"))
    return words.join(counts, "kmer", "left").select("kmer", F.coalesce("c", F.lit(0)).alias("n"))


def _probes(ranges: str) -> str:
    return f"(SELECT n, first({{'p': p, 's': s}} ORDER BY t, p DESC, s DESC) AS x FROM l JOIN {ranges} ON (n + s) % (p + s) = 0 GROUP BY n)"


_WIDE = "(SELECT t, unnest(range(b + 1, a + 1)) AS p, c, d FROM (VALUES (1, 60, 40, 20, 10), (2, 70, 40, 30, 10), (3, 80, 40, 35, 10)) v(t, a, b, c, d))"


@query(f"""WITH l AS (SELECT DISTINCT length(text) AS n FROM documents WHERE text IS NOT NULL), r AS (SELECT t, p, unnest(range(d + 1, c + 1)) AS s FROM {_WIDE}), one AS {_probes('(SELECT * FROM r WHERE t = 1) r')}, wide AS {_probes('r')}
 SELECT l.n::INTEGER AS n, one.x.p::INTEGER AS probe, one.x.s::INTEGER AS space, CASE WHEN l.n < 50 THEN 50 WHEN l.n < 100 THEN 40 ELSE wide.x.p END::INTEGER AS wide_probe, CASE WHEN l.n < 50 THEN 15 WHEN l.n < 100 THEN 10 ELSE wide.x.s END::INTEGER AS wide_space,
 CASE WHEN l.n BETWEEN 50 AND 99 THEN 40 ELSE 50 END AS simple_probe FROM l LEFT JOIN one ON one.n = l.n LEFT JOIN wide ON wide.n = l.n""")
def probe_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    rows = table(spark, sf_dir, "documents").where("text is not null").select(F.length("text").alias("n")).distinct()
    found = rows.select("n", structure.probe_lengths(n).alias("a"), structure.widening_probe_lengths(n).alias("b"), structure.simple_probe_lengths(n).alias("c"))
    return found.select("n", F.col("a.probe").alias("probe"), F.col("a.space").alias("space"), F.col("b.probe").alias("wide_probe"), F.col("b.space").alias("wide_space"), F.col("c.probe").alias("simple_probe"))


@query()
def sequence_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir).select("doc_id", r6(structure.complexity(F.col("s"))).alias("complexity"))


@query()
def folding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = kmers_of(dna(spark, sf_dir), 6).select("kmer").distinct()
    return words.select("kmer", structure.most_pairs(F.col("kmer")).alias("energy"))
