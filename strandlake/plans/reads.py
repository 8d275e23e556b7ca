"""Queries of alignments and reads: CIGAR strings off ``lineitem``, letters of ``documents`` as reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import alignment
from strandlake.operators import reads
from strandlake.plans.common import Registry, r6, table
from strandlake.plans.records import cigar_column
from strandlake.plans.sequences import _DNA, dna, kmers_of

query = Registry()
_PARTS = "p AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_partkey AS beg, l_linenumber AS s, CAST(l_quantity AS BIGINT) AS m1, l_suppkey % 5 + 1 AS d, l_partkey % 7 + 1 AS m2, l_orderkey % 3 + 1 AS n, l_linenumber + 2 AS m3 FROM lineitem)"
_FLAG = "((l_orderkey * 31 + l_linenumber * 7) % 4096)::BIGINT"


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = ((F.col("l_orderkey") * 31 + F.col("l_linenumber") * 7) % 4096).cast("bigint").alias("flag")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_partkey").alias("pos"), flag, (F.col("l_partkey") % 61).alias("mapq"), F.col("l_returnflag").alias("rname"), cigar_column().alias("cigar"))


@query(f"""WITH {_PARTS} SELECT l_orderkey, l_linenumber, 'exon' AS kind, beg + s AS "start", beg + s + m1 AS "end" FROM p UNION ALL SELECT l_orderkey, l_linenumber, 'exon', beg + s + m1 + d, beg + s + m1 + d + m2 FROM p
 UNION ALL SELECT l_orderkey, l_linenumber, 'exon', beg + s + m1 + d + m2 + n, beg + s + m1 + d + m2 + n + m3 FROM p UNION ALL SELECT l_orderkey, l_linenumber, 'clip', beg, beg + s FROM p UNION ALL SELECT l_orderkey, l_linenumber, 'deletion', beg + s + m1, beg + s + m1 + d FROM p
 UNION ALL SELECT l_orderkey, l_linenumber, 'intron', beg + m1 + d + m2, beg + m1 + d + m2 + n FROM p""")
def cigar_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, cigar = F.col("l_partkey"), F.col("cigar")
    rows = _aligned(spark, sf_dir)
    kinds = {"exon": alignment.exons, "clip": alignment.clips, "deletion": alignment.deletions, "intron": alignment.introns}

    def named(kind: str) -> Column:
        return F.transform(kinds[kind](at, cigar), lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    found = F.concat(*map(named, kinds))
    return rows.select("l_orderkey", "l_linenumber", F.explode(found).alias("x")).select("l_orderkey", "l_linenumber", "x.*")


@query("SELECT l_orderkey, l_linenumber, l_partkey + 3 + k * 4 AS \"start\", k + 1 AS size FROM (SELECT *, unnest(range(0, l_linenumber)) AS k FROM lineitem)")
def cigar_insertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cigar = F.concat(F.lit("3S"), F.array_join(F.transform(F.sequence(F.lit(1), F.col("l_linenumber").cast("int")), lambda k: F.concat(k.cast("string"), F.lit("I4M"))), ""))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(alignment.insertions(F.col("l_partkey"), cigar)).alias("x"))
    return rows.select("l_orderkey", "l_linenumber", "x.*")


@query(f"WITH {_PARTS} SELECT l_orderkey, l_linenumber, repeat('S', s::BIGINT) || repeat('M', m1) || repeat('D', d::BIGINT) || repeat('M', m2::BIGINT) || repeat('N', n::BIGINT) || repeat('M', m3::BIGINT) AS letters FROM p")
def cigar_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir).select("l_orderkey", "l_linenumber", alignment.expanded(F.col("cigar")).alias("letters"))


@query("""SELECT l_orderkey, l_linenumber, (l_quantity + l_linenumber)::BIGINT AS m, (l_linenumber % 3)::BIGINT AS i, 2::BIGINT AS d, 1 + (l_suppkey % 2)::BIGINT AS s,
 round(1 - (l_linenumber % 3 + 3 + l_suppkey % 2) / (l_quantity + l_linenumber + l_linenumber % 3 + 3 + l_suppkey % 2), 6) AS concordance FROM lineitem""")
def cs_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c: F.col(c).cast("int").cast("string")
    inserted = F.when(F.col("l_linenumber") % 3 > 0, F.concat(F.lit("+"), F.repeat(F.lit("a"), (F.col("l_linenumber") % 3).cast("int")))).otherwise("")
    cs = F.concat(F.lit(":"), n("l_quantity"), F.lit("*ag"), inserted, F.lit("-tc:"), n("l_linenumber"), F.when(F.col("l_suppkey") % 2 == 1, "*ct").otherwise(""))
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", alignment.cs_totals(cs).alias("x"))
    return x.select("l_orderkey", "l_linenumber", *(F.col(f"x.{c}").alias(c.lower()) for c in "MIDS"), r6(alignment.concordance(F.col("x.M"), F.col("x.I"), F.col("x.D"), F.col("x.S"))).alias("concordance"))


@query(f"WITH {_PARTS} SELECT l_orderkey, l_linenumber, round(1 - (d + 4) / nullif(d + 4 + m1 + m2 + m3, 0), 6) AS concordance FROM p")
def concordance_of_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = alignment.op_total(F.col("cigar"), "D") + 4
    return _aligned(spark, sf_dir).select("l_orderkey", "l_linenumber", r6(alignment.concordance_of_edits(F.col("cigar"), edits)).alias("concordance"))


_BITS = ", ".join(f"CASE WHEN flag & {bit} <> 0 THEN '{name}' END" for name, bit in alignment.FLAGS.items())


@query(f"WITH f AS (SELECT DISTINCT {_FLAG} AS flag FROM lineitem) SELECT flag, array_to_string(list_filter([{_BITS}], lambda x: x IS NOT NULL), ',') AS meaning FROM f")
def flag_meanings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir).select("flag").distinct().select("flag", F.array_join(alignment.flag_meanings(F.col("flag")), ",").alias("meaning"))


@query(f"""WITH {_PARTS}, f AS (SELECT *, ((l_orderkey * 31 + l_linenumber * 7) % 4096) & 16 <> 0 AS rev FROM p)
 SELECT l_orderkey, l_linenumber, (CASE WHEN rev THEN 0 ELSE s END)::BIGINT AS query_start, (s + m1 + m2 + m3 - CASE WHEN rev THEN s ELSE 0 END)::BIGINT AS query_end FROM f""")
def query_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir).select("l_orderkey", "l_linenumber", alignment.query_start(F.col("flag"), F.col("cigar")).alias("query_start"), alignment.query_end(F.col("flag"), F.col("cigar")).alias("query_end"))


@query(f"""WITH {_PARTS} SELECT {_FLAG} AS flag, (beg - 1)::BIGINT AS rstart, (beg - 1 + m1 + d + m2 + n + m3)::BIGINT AS rend, beg % 61 AS mapqs, l_returnflag AS rname, l_orderkey AS qname, (s + m1 + m2 + m3)::BIGINT AS qlen, (m1 + m2 + m3)::BIGINT AS qalen
 FROM p""")
def read_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.read_frame(_aligned(spark, sf_dir).withColumn("qname", F.col("l_orderkey")))


@query(f"WITH {_PARTS} SELECT (m1 + d + m2 + n + m3)::BIGINT AS read_length, count(*) AS n FROM p WHERE ((l_orderkey * 31 + l_linenumber * 7) % 4096) & 4 = 0 GROUP BY 1")
def mapped_read_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = _aligned(spark, sf_dir).where(~alignment.has_flag(F.col("flag"), "unmapped"))
    return mapped.groupBy(alignment.reference_length(F.col("cigar")).alias("read_length")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey AS a, l_partkey + l_quantity::BIGINT AS b, l_suppkey % 3 AS x FROM lineitem), j AS (SELECT u.l_orderkey, u.a, u.b, u.x = 0 AS own, v.a AS ma, v.b AS mb, v.x = 0 AS mate FROM e u JOIN e v ON u.l_orderkey = v.l_orderkey AND u.l_linenumber = 1 AND v.l_linenumber = 2)
 SELECT l_orderkey, CASE WHEN own THEN ma WHEN mate THEN a ELSE -1 END AS pos1, CASE WHEN own THEN b WHEN mate THEN mb ELSE -1 END AS pos2, CASE WHEN own THEN 1 WHEN mate THEN 2 ELSE 3 END AS mode FROM j""")
def paired_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("bigint")).alias("end"), (F.col("l_suppkey") % 3 == 0).alias("reverse"))
    mates = rows.where("l_linenumber = 2").select("l_orderkey", *(F.col(c).alias(f"mate_{c}") for c in ("start", "end", "reverse")))
    return reads.pair_distance(rows.where("l_linenumber = 1").join(mates, "l_orderkey")).select("l_orderkey", "pos1", "pos2", "mode")


@query(f"WITH {_DNA} SELECT doc_id, length(s)::INTEGER AS n FROM dna WHERE length(s) BETWEEN 100 AND 900 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def reads_of_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = reads.named(reads.of_length(dna(spark, sf_dir), "s", 100, 900), "doc_id", table(spark, sf_dir, "labels").select("doc_id"), keep=False)
    return kept.select("doc_id", F.length("s").alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 61 > 10 AND l_partkey % 61 < 50")
def mapq_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("mapq", F.col("l_partkey") % 61)
    return reads.strictly_between(rows, "mapq", 10, 50).select("l_orderkey", "l_linenumber")


@query("SELECT doc_id % 7 AS part, count(*) AS n, count(DISTINCT doc_id // 25) AS chunks FROM documents GROUP BY 1")
def reads_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(reads.part_of(F.col("doc_id"), 7).alias("part"), reads.chunk_of(F.col("doc_id"), 25).alias("chunk"))
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("chunk").alias("chunks"))


@query("SELECT (count(*) // 4)::BIGINT AS n_records, count(*) % 4 = 0 AS complete FROM lineitem")
def complete_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.complete_records(table(spark, sf_dir, "lineitem"))


@query(f"WITH {_DNA} SELECT 'asm_' || (doc_id + 1) || ' ' || lang AS header, md5(s) AS md5 FROM dna WHERE length(s) >= 500")
def renamed_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.renamed_contigs(dna(spark, sf_dir), "asm", "s", F.col("doc_id") + 1, F.col("lang")).select("header", F.md5("sequence").alias("md5"))


@query(f"WITH {_DNA} SELECT lang, md5(string_agg(s, '' ORDER BY doc_id)) AS md5, count(s) AS n FROM dna WHERE s IS NOT NULL GROUP BY lang")
def collapsed_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.collapsed(dna(spark, sf_dir), ["lang"], ["doc_id"], "s").select("lang", F.md5("sequence").alias("md5"), "n")


_GC = "(length(s) - length(translate(s, 'CGScgs', '')))"


@query(f"WITH {_DNA} SELECT doc_id, round(100.0 * {_GC} / nullif(length(s), 0), 6) AS gc, length(s)::INTEGER AS length FROM dna")
def read_gc_and_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.gc_and_length(dna(spark, sf_dir), ["doc_id"], "s").select("doc_id", r6("gc").alias("gc"), "length")


_READS = "r AS (SELECT doc_id, lang, substr(translate(s, 'CA', 'NA'), 1, 64) AS s, upper(md5(s)) || upper(md5(s)) AS q FROM dna WHERE length(s) >= 64)"


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir).where("length(s) >= 64").select("doc_id", "lang", F.substring(F.translate("s", "CA", "NA"), 1, 64).alias("s"), F.repeat(F.upper(F.md5("s")), F.lit(2)).alias("q"))


def _letter(c: str) -> str:
    return f"(64 - length(replace(s, '{c}', '')))"


@query(f"""WITH {_DNA}, {_READS}, v AS (SELECT *, list_sum(list_transform(string_split(q, ''), lambda x: ascii(x) - 33)) AS qs FROM r)
 SELECT lang, count(*) AS n_reads, {', '.join(f'sum({_letter(c)})::BIGINT AS {c.lower()}' for c in 'ACGTN')}, (64 * count(*))::BIGINT AS total_bases, round(avg(100.0 * ({_letter('G')} + {_letter('C')}) / 64), 6) AS gc, 64.0 AS mean_length, 64 AS min_length, 64 AS max_length, round(avg(qs / 64), 6) AS mean_quality, round(sum(qs) / (64 * count(*)), 6) AS base_quality FROM v GROUP BY lang""")
def read_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reads.read_statistics(_reads(spark, sf_dir), ["lang"], "s", "q")
    return found.withColumns({c: r6(c) for c in ("gc", "mean_length", "mean_quality", "base_quality")})


@query(f"""WITH {_DNA}, {_READS}, p AS (SELECT unnest(range(1, 65)) AS pos, unnest(list_transform(string_split(q, ''), lambda x: ascii(x) - 33)) AS q FROM r)
 SELECT pos, count(*) AS n, round(avg(q), 6) AS mean, round(quantile_cont(q, 0.25), 6) AS q1, round(quantile_cont(q, 0.5), 6) AS median, round(quantile_cont(q, 0.75), 6) AS q3 FROM p GROUP BY pos""")
def quality_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reads.quality_by_position(_reads(spark, sf_dir), [], "q")
    return found.withColumns({c: r6(c) for c in ("mean", "q1", "median", "q3")})


@query("SELECT count(*) FILTER (a.text IS DISTINCT FROM b.text) AS n_different, count(*) FILTER (a.text IS DISTINCT FROM b.text) = 0 AS equal FROM documents a FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN upper(text) ELSE text END AS text FROM documents WHERE doc_id % 11 <> 5) b USING (doc_id)")
def same_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "documents").select("doc_id", "text")
    right = left.where("doc_id % 11 != 5").withColumn("text", F.when(F.col("doc_id") % 10 == 3, F.upper("text")).otherwise(F.col("text")))
    return reads.same_reads(left, right, ["doc_id"], ["text"])


@query(f"WITH {_DNA}, k AS (SELECT substr(s, i, 3) AS k, count(*) AS n FROM (SELECT s, unnest(range(1, length(s) - 1)) AS i FROM dna WHERE length(s) >= 3) GROUP BY 1) SELECT concat_ws(chr(9), n, k[1], k[2], k[3]) AS line FROM k")
def krona_of_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.letters_of_kmers(kmers_of(dna(spark, sf_dir), 3).groupBy("kmer").agg(F.count("*").alias("n")), "kmer", "n")


@query("SELECT replace(s_name, '#', '_') AS instrument, (s_suppkey % 8)::VARCHAR AS lane, s_nationkey::VARCHAR AS tile, '#' || s_suppkey AS index, '1' AS member, s_suppkey FROM supplier")
def old_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.concat_ws(":", F.replace("s_name", F.lit("#"), F.lit("_")), (F.col("s_suppkey") % 8).cast("string"), F.col("s_nationkey").cast("string"), F.lit("941"), F.lit("1973")), F.lit("#"), F.col("s_suppkey").cast("string"), F.lit("/1 rest"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", reads.old_illumina_identifier(name).alias("x"))
    return rows.select("x.instrument", "x.lane", "x.tile", "x.index", "x.member", "s_suppkey")
