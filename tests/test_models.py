"""Models, scans and samples."""

import math
import re

import numpy as np
from pyspark.sql import functions as F

from strandlake.operators import models, samples, scans, taxa
from strandlake.plans import catalog


def test_mixture():
    rng = np.random.default_rng(4)
    m = models.fit_mixture(np.concatenate((rng.normal(1, 0.1, 900), rng.normal(2, 0.1, 100))))
    assert math.isclose(m.means[m.central], 1, abs_tol=0.02) and math.isclose(m.sigmas[m.central], 0.1, abs_tol=0.02) and math.isclose(m.weights[m.central], 0.9, abs_tol=0.02)


def test_mixture_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "scale double")
    assert models.mixture_of(df, "scale") is None
    assert [r.zscore for r in models.fitted_zscores(df, "scale").collect()] == [0.0]


def test_regex_scan(spark):
    rows = [("a", "NNACGNNNT"), ("b", ""), ("c", None)]
    df = spark.createDataFrame(rows, "name string, s string")
    got = sorted(tuple(r) for r in scans.regex_scan(df, "name", "s", scans.GAPS).collect())
    assert got == [(n, m.start(), m.end(), m[0]) for n, s in rows for m in re.finditer(scans.GAPS, s or "")]


def test_frames(spark):
    df = spark.createDataFrame([("a", "ATGAAATAACCCGGG")], "name string, s string")
    got = {(r.strand, r.frame, r.start, r.end) for r in scans.frames(df, "name", "s", 6).collect()}
    assert {("+", 0, 0, 6), ("+", 0, 9, 15), ("+", 1, 4, 13)} <= got


def test_variants_are_folded(spark):
    contigs = spark.createDataFrame([("c1", "ACGTACGT"), ("c2", "AAAA")], "name string, s string")
    found = spark.createDataFrame([("c1", 2, "C", "CTT"), ("c1", 5, "AC", "A"), ("c1", 6, "C", "G"), ("c1", 8, "A", "T")], "name string, pos int, ref string, alt string")
    got = {r.name: (r.s, [tuple(x) for x in r.shifts]) for r in scans.with_variants(contigs, found, "name", "s").collect()}
    assert got == {"c1": ("ACTTGTAGT", [(2, 2), (5, 1)]), "c2": ("AAAA", [])}


def test_samples(spark):
    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"), F.lit(10).alias("n"))
    first = [r.k for r in samples.random_rows(df, 20, "k", 1).collect()]
    assert first == [r.k for r in samples.random_rows(df.repartition(7), 20, "k", 1).collect()] and len(set(first)) == 20
    assert sorted(r["count"] for r in samples.per_group(df, ["g"], 5, "k", 1).groupBy("g").count().collect()) == [5, 5, 5]
    assert [r.k for r in samples.every(df, 50, 1, "n", ["k"], F.floor(F.col("k") / 30)).orderBy("k").collect()] == [1, 51, 101, 151]
    assert 40 < samples.to_coverage(df, "n", 100, 10.0, "k", 1).count() < 160


def test_ranks(spark):
    nodes = spark.createDataFrame([(1, 1, "no rank", "root"), (2, 1, "superkingdom", "Bacteria"), (3, 2, "phylum", "P"), (4, 3, "species", "S")], "taxon bigint, parent bigint, rank string, name string")
    r = taxa.ranked(nodes).where("taxon = 4").first()
    assert (r.kingdom, r.phylum, r["class"], r.species) == ("Bacteria", "P", " ", "S")


def test_cross_correlation_of_a_long_contig(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [("A", "OF"[int(k)], int(p)) for k, p in zip(rng.integers(0, 2, 20_000), rng.integers(1, 20_000, 20_000), strict=True)]
    spark.createDataFrame(rows, "l_returnflag string, l_linestatus string, l_partkey bigint").write.parquet(str(tmp_path / "lineitem.parquet"))
    n = max(p for *_, p in rows) // 10 + 1
    x, y = (np.bincount([p // 10 for _, s, p in rows if s == which], minlength=n) for which in "OF")
    got = {r["shift"]: r.correlation for r in catalog.QUERIES["strand_cross_correlation"](spark, str(tmp_path)).collect()}
    for s in range(4):
        want = ((x[: n - s] * y[s:]).sum() / n - x.mean() * y.mean()) / (x.std() * y.std())
        assert math.isclose(got[s], want, abs_tol=2e-6)
