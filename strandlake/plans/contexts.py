"""Queries of start contexts: features of ``lineitem`` on three long documents as contigs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import contexts, models
from strandlake.plans.common import Registry, r6
from strandlake.plans.features import _CONTIGS, _F, _RC, _contigs, _id, annotation

query = Registry()
_SPAN = f"""{_F}, {_CONTIGS}, x AS (SELECT seqid AS chrom, id, strand, "start", stop, CASE WHEN strand = '+' THEN substr(s, "start", 3) ELSE {_RC.format('substr(s, stop - 2, 3)')} END AS codon,
 CASE WHEN strand = '+' THEN substr(s, "start" - 12, 12) ELSE {_RC.format('substr(s, stop + 1, 12)')} END AS l, CASE WHEN strand = '+' THEN substr(s, "start" + 3, 9) ELSE {_RC.format('substr(s, stop - 11, 9)')} END AS r
 FROM f JOIN contigs USING (seqid) WHERE CASE WHEN strand = '+' THEN "start" - 12 >= 1 AND "start" + 11 <= length(s) ELSE stop + 12 <= length(s) AND stop - 11 >= 1 END)"""
_PFM = "c AS (SELECT p AS position, l[p] AS letter, count(*) AS n FROM x, range(1, 13) q(p) GROUP BY ALL), pf AS (SELECT position, letter, n / sum(n) OVER (PARTITION BY position) AS share FROM c)"


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.start_contexts(annotation(spark, sf_dir), _contigs(spark, sf_dir), _id(), 12, 9)


def frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.position_frequencies(found(spark, sf_dir), "left")


@query(f'WITH {_SPAN} SELECT chrom, id, strand, "start", stop, codon, l AS "left", r AS "right" FROM x')
def start_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir)


@query(f"WITH {_SPAN}, t AS (SELECT id, right(l, 4) || codon || left(r, 3) AS sequence FROM x) SELECT id, sequence, round(count(*) OVER (PARTITION BY sequence) / count(*) OVER (), 9) AS frequency FROM t")
def trimmed_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.trimmed_contexts(found(spark, sf_dir), 4, 3, None).select("id", "sequence", F.round("frequency", 9).alias("frequency"))


@query(f"WITH {_SPAN} SELECT round(count(*) FILTER (codon = 'ACA') / nullif(count(*), 0), 6) AS share FROM x WHERE strand = '+' AND id IN (SELECT l_orderkey || '.' || l_linenumber FROM lineitem WHERE l_quantity > 10)")
def codon_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.plans.common import table

    ids = table(spark, sf_dir, "lineitem").where("l_quantity > 10").select(F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    return contexts.codon_share(contexts.selected(found(spark, sf_dir), "+", F.length("left") == 12, ids), "ACA").select(r6("share").alias("share"))


@query(f"""WITH {_F}, {_CONTIGS}, a AS (SELECT DISTINCT seqid, CASE WHEN strand = '-' THEN stop - 2 ELSE "start" END AS pos FROM f), p AS (SELECT seqid, s, unnest(range(1, length(s) - 1)) AS pos FROM contigs)
 SELECT seqid AS chrom, pos, substr(s, pos - 5, 5) AS "left", substr(s, pos + 3, 5) AS "right" FROM p WHERE substr(s, pos, 3) = 'ACA' AND pos > 5 AND pos + 7 <= length(s) AND NOT EXISTS (SELECT 1 FROM a WHERE a.seqid = p.seqid AND a.pos = p.pos)""")
def genomic_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.genomic_contexts(_contigs(spark, sf_dir), contexts.annotated_starts(annotation(spark, sf_dir)), "ACA", 5, 5)


@query(f"WITH {_SPAN}, {_PFM} SELECT position::BIGINT AS position, round(2 + sum(share * log2(share)), 6) AS bits FROM pf GROUP BY position")
def information_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.information_content(frequencies(spark, sf_dir)).select(F.col("position").cast("bigint").alias("position"), r6("bits").alias("bits"))


@query(f"WITH {_SPAN}, {_PFM}, w AS (SELECT position, x AS letter, coalesce(max(share) FILTER (pf.letter = x), 0) AS share FROM pf, (SELECT unnest(['A', 'C', 'G', 'T']) AS x) GROUP BY ALL) SELECT position::BIGINT AS position, round(sum(pow(100 * share - CASE WHEN letter IN ('A', 'T') THEN 27 ELSE 23 END, 2) / CASE WHEN letter IN ('A', 'T') THEN 27 ELSE 23 END), 6) AS chi2 FROM w GROUP BY position")
def context_chi_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.chi_squared(frequencies(spark, sf_dir), 0.46).select(F.col("position").cast("bigint").alias("position"), r6("chi2").alias("chi2"))


@query(f"""WITH {_SPAN}, {_PFM}, g AS (SELECT letter, sum(n) / (SELECT sum(n) FROM c) AS share FROM c GROUP BY letter), k AS (SELECT position - 9 AS position, round(sum((pf.share + 1e-12) * log2((pf.share + 1e-12) / (g.share + 1e-12))), 12) AS kl FROM pf JOIN g USING (letter) GROUP BY position),
 s AS (SELECT sum(kl) FILTER (position < 0 AND position >= -6) / 6 AS ksi, sum(kl) FILTER (position < 0) AS total, max(kl) AS peak, (SELECT position FROM k ORDER BY kl DESC, position LIMIT 1) AS p FROM k)
 SELECT round(ksi, 6) AS ksi, round(total, 6) AS total, round(peak, 6) AS peak, p::BIGINT AS peak_position, round(peak / total, 6) AS concentration, round(sqrt(peak * total), 6) AS iii, round(peak * peak / total, 6) AS power FROM s""")
def divergence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = frequencies(spark, sf_dir)
    whole = p.groupBy("letter").agg(F.sum("n").alias("n"))
    shares = whole.join(F.broadcast(whole.agg(F.sum("n").alias("t")))).select("letter", (F.col("n") / F.col("t")).alias("share"))  # four rows
    kl = models.divergence(p, p.select("position").distinct().crossJoin(shares), ["position", "letter"])
    got = contexts.divergence_summary(kl.select((F.col("position") - 9).alias("position"), F.round("kl", 12).alias("kl")))
    return got.select(*(r6(c).alias(c) for c in ("ksi", "total", "peak")), F.col("peak_position").cast("bigint").alias("peak_position"), *(r6(c).alias(c) for c in ("concentration", "iii", "power")))


_IUPAC = "MAP {'A': 'A', 'C': 'C', 'G': 'G', 'T': 'T', 'AG': 'R', 'CT': 'Y', 'CG': 'S', 'AT': 'W', 'GT': 'K', 'AC': 'M', 'CGT': 'B', 'AGT': 'D', 'ACT': 'H', 'ACG': 'V', 'ACGT': 'N'}"


@query(f"""WITH {_SPAN}, {_PFM}, m AS (SELECT *, max(share) OVER (PARTITION BY position) AS m FROM pf), k AS (SELECT position, first(m) AS m, 2 + sum(share * log2(share)) AS bits, first(letter ORDER BY share DESC, letter) AS top, string_agg(letter, '' ORDER BY letter) FILTER (share >= 0.25) AS t, string_agg(letter, '' ORDER BY letter) FILTER (share >= 0.8 * m) AS r FROM m GROUP BY position),
 l AS (SELECT position, CASE WHEN m >= 0.5 THEN top ELSE 'n' END AS majority, CASE WHEN m >= 0.6 THEN {_IUPAC}[t] ELSE lower({_IUPAC}[t]) END AS threshold, CASE WHEN m >= 0.6 THEN {_IUPAC}[r] ELSE lower({_IUPAC}[r]) END AS relative, CASE WHEN bits >= 1 THEN {_IUPAC}[r] ELSE lower({_IUPAC}[r]) END AS information, top AS max_only FROM k)
 {' UNION ALL '.join(f"SELECT '{c}' AS mode, string_agg(coalesce({c}, 'n'), '' ORDER BY position) AS consensus FROM l" for c in ('majority', 'threshold', 'relative', 'information', 'max_only'))}""")
def consensus_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.all_consensus(frequencies(spark, sf_dir))


@query(f"WITH {_SPAN}, k AS (SELECT strand, substr(l, i, 4) AS kmer FROM x, range(1, 10) q(i)) SELECT kmer, count(*) FILTER (strand = '+') AS plus, count(*) FILTER (strand = '-') AS minus FROM k GROUP BY kmer")
def context_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.kmers_by_strand(found(spark, sf_dir), 4)


@query(f"WITH {_SPAN} SELECT id, regexp_matches(l, 'A[CG]A') AS found FROM x")
def context_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.holding(found(spark, sf_dir), "A[CG]A").select("id", "found")


@query(f"WITH {_CONTIGS} SELECT seqid AS chrom, round((length(s) - length(translate(s, 'GC', ''))) / length(s), 6) AS gc FROM contigs")
def gc_by_contig(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.gc_by_contig(_contigs(spark, sf_dir)).select("chrom", r6("gc").alias("gc"))


@query()
def bootstrapped_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples are drawn with a seed; a unit test holds their means against the plain divergence."""
    background = contexts.genomic_contexts(_contigs(spark, sf_dir), contexts.annotated_starts(annotation(spark, sf_dir)), "ACA", 12, 9)
    return contexts.bootstrapped_divergence(frequencies(spark, sf_dir), contexts.drawn(background, F.concat_ws(":", "chrom", F.col("pos").cast("string")), 0.5, 3), "left")


@query()
def shuffled_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffles and uniform draws by hash; a unit test checks their letters."""
    rows = found(spark, sf_dir)
    drawn = contexts.uniform_background(rows.select("id").distinct(), 0.46, 12, 5)
    return rows.select("id", contexts.shuffled(F.col("left"), 7, F.col("id")).alias("left")).join(drawn, "id")
