"""Column functions and operators against plain Python."""

import itertools
import math
import random
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from strandlake.functions import alignment, quality, sequence, variants
from strandlake.operators import enrichment, intervals, tables, tracks


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("dna, protein", [("ATGGCC", "MA"), ("ATGTAAGCC", "M*A"), ("ATGNNN", "MX"), ("AT", ""), ("TTTTGGTGA", "FW*")])
def test_translation(spark, dna, protein):
    assert one(spark, sequence.translated(F.col("s")), s=dna) == protein
    assert one(spark, sequence.translated(F.col("s"), to_stop=True), s=dna) == protein.split("*")[0]


def test_sequence_functions(spark):
    assert one(spark, sequence.reverse_complement(F.col("s")), s="ACGTN") == "NACGT"
    assert one(spark, sequence.kmers(F.col("s"), 3), s="ABCDE") == ["ABC", "BCD", "CDE"]
    assert one(spark, sequence.kmers(F.col("s"), 3), s="AB") == []
    assert one(spark, sequence.starts_of(F.col("s"), "AA"), s="AAAGAA") == [0, 1, 4]
    assert one(spark, sequence.canonical_rotation(F.col("s")), s="CAB") == "ABC"
    assert one(spark, sequence.runs_of_letters(F.col("s")), s="AABCCC") == ["AA", "B", "CCC"]
    assert one(spark, sequence.g4_scores(F.col("s")), s="GGACCCCC") == [2, 2, 0, -4, -4, -4, -4, -4]
    assert one(spark, sequence.wrapped(F.col("s"), 3), s="ABCDEFG") == "ABC\nDEF\nG"
    assert [(r.start, r.word) for r in one(spark, sequence.windows_of(F.col("s"), 4, 3), s="ABCDEFGHIJ")] == [(0, "ABCD"), (3, "DEFG"), (6, "GHIJ")]
    assert one(spark, sequence.natural_key(F.col("s")), s="chr2") < one(spark, sequence.natural_key(F.col("s")), s="chr10")
    assert one(spark, sequence.gc_content(F.col("s")), s="") is None


def test_cigar(spark):
    assert one(spark, alignment.query_length(F.col("c")), c="3S10M2I5D4M") == 19
    assert one(spark, alignment.reference_length(F.col("c")), c="3S10M2I5D4M") == 19
    assert one(spark, alignment.compressed(F.col("c")), c="3M4M2I") == "7M2I"
    assert [(r.start, r.end) for r in one(spark, alignment.introns(F.lit(10), F.col("c")), c="5M10N3M2N1M")] == [(15, 25), (28, 30)]
    assert one(spark, alignment.cigar_is_valid(F.col("c")), c="5Q") is False


def test_quality(spark):
    assert one(spark, quality.mean_quality(F.col("q")), q="!I") == 20.0
    assert one(spark, quality.mean_quality(F.col("q")), q="") is None
    assert math.isclose(one(spark, quality.phred_from_solexa(quality.solexa_from_phred(F.col("q"))), q=20.0), 20.0)


def test_thresholds(spark):
    assert one(spark, variants.threshold(F.col("x"), "<1|>5&<7"), x=6.0) is True
    assert one(spark, variants.threshold(F.col("x"), "<1|>5&<7"), x=7.0) is False
    with pytest.raises(ValueError):
        variants.threshold(F.lit(1), "about 3")


def test_hypergeometric():
    for total, size, drawn in ((20, 7, 9), (12, 12, 5), (30, 3, 1)):
        for k in range(0, min(size, drawn) + 1):
            exact = sum(Fraction(comb(size, j) * comb(total - size, drawn - j), comb(total, drawn)) for j in range(k, min(size, drawn) + 1))
            assert math.isclose(enrichment.hypergeometric_tail(k, size, drawn, total), float(exact), rel_tol=1e-9)


def test_fisher():
    a, b, c, d = 3, 1, 1, 3
    weights = {k: Fraction(comb(4, k) * comb(4, 4 - k), comb(8, 4)) for k in range(5)}
    assert math.isclose(enrichment.fisher_exact(a, b, c, d), float(sum(w for w in weights.values() if w <= weights[3])), rel_tol=1e-9)
    assert math.isclose(enrichment.fisher_exact(a, b, c, d, "greater"), float(weights[3] + weights[4]), rel_tol=1e-9)


def test_interval_overlaps(spark):
    rows = [(i % 2, i, (i * 37) % 100, (i * 37) % 100 + 1 + (i * 13) % 50) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, id int, start bigint, end bigint")
    for width in (1, 7, 64):
        got = {(r.id_l, r.id_r) for r in intervals.overlaps(df, df, ["k"], width).collect()}
        assert got == {(a[1], b[1]) for a, b in itertools.product(rows, rows) if a[0] == b[0] and a[2] < b[3] and b[2] < a[3]}


def test_as_of(spark):
    left = spark.createDataFrame([(1, t) for t in (0, 5, 10, 95)] + [(2, 3)], "k int, t bigint")
    right = spark.createDataFrame([(1, 4, "a"), (1, 10, "b"), (1, 30, "c")], "k int, at bigint, v string")
    for bucket in (1, 7, 1000):
        got = {(r.k, r.t): r.v for r in intervals.as_of(left, right, ["k"], "t", "at", "v", bucket).collect()}
        assert got == {(1, 0): None, (1, 5): "a", (1, 10): "b", (1, 95): "c", (2, 3): None}


def test_running_median_in_blocks(spark):
    values = [(k, i + 1, float((i * 7919) % 101)) for k in "ab" for i in range(50)]
    df = spark.createDataFrame(values, "chrom string, pos bigint, cov double")
    for block in (3, 7, 1000):
        got = {(r.chrom, r.pos): r.rm for r in tracks.running_median(df, "chrom", "pos", "cov", 9, block=block).collect()}
        for k, p, v in values:
            near = sorted(x[2] for x in values if x[0] == k and abs(x[1] - p) <= 4)
            assert got[k, p] == (near[4] if len(near) == 9 else v)


def test_dense_positions(spark):
    df = spark.createDataFrame([(i % 3, (i * 17) % 40) for i in range(40)], "k int, t int")
    got = tracks.dense_positions(df, "k", ["t"], F.floor(F.col("t") / 10)).collect()
    for k in range(3):
        assert [r.pos for r in sorted((r for r in got if r.k == k), key=lambda r: r.t)] == list(range(1, sum(r.k == k for r in got) + 1))


def test_adjusted_p_values(spark):
    ps = [0.01, 0.04, 0.03, 0.005, 0.04, None]
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate(ps)], "k int, i int, p double")
    got = {r.i: r.padj for r in tables.benjamini_hochberg(df, ["k"], "p").collect()}
    known = sorted(p for p in ps if p is not None)
    for i, p in enumerate(ps):
        assert got[i] is None if p is None else math.isclose(got[i], min(1.0, min(q * 5 / max(j + 1 for j, x in enumerate(known) if x == q) for q in known if q >= p)))


def test_adjusted_p_values_of_one_reading(spark):
    other_each_time = F.udf(lambda i: random.random() if i % 7 else 0.25, "double").asNondeterministic()  # as means of doubles, by their last bits
    df = spark.range(0, 60, 1, 3).select(F.when(F.col("id") % 2 == 0, F.lit("a")).alias("k"), "id", other_each_time("id").alias("p"))
    rows = tables.benjamini_hochberg(df, ["k"], "p").collect()
    assert len({r.id for r in rows}) == len(rows) == 60
    for r in rows:
        known = sorted(x.p for x in rows if x.k == r.k)
        assert math.isclose(r.padj, min(1.0, min(q * 30 / sum(x <= q for x in known) for q in known if q >= r.p)))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k int, start bigint, end bigint")
    assert intervals.merged(empty, ["k"]).count() == intervals.depth(empty, ["k"]).count() == intervals.gaps(empty, ["k"]).count() == 0
    assert tables.n50(spark.createDataFrame([], "k int, n bigint"), ["k"], "n").count() == 0
