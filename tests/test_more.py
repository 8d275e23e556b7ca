"""Sheets, quantities, sliding windows and peaks on small tables."""

from pyspark.sql import functions as F

from strandlake.functions import quality, variants
from strandlake.operators import peaks, quantify, sheets, sliding


def test_sample_sheet(spark):
    good = spark.createDataFrame([("s1", "ACGT", "1"), ("s2", "ACGA", "2")], "Sample_ID string, index string, Lane string")
    assert sheets.is_valid(sheets.sample_sheet(good)).first().valid is True
    bad = good.union(spark.createDataFrame([("s1", "ACXT", "1"), ("s 3", "ACG", "9")], good.schema))
    found = {r.check: (r.status, r.n_bad) for r in sheets.sample_sheet(bad).collect()}
    assert found["unique sample ids"] == ("Error", 1) and found["letters of index"] == ("Error", 1) and found["one length of index"] == ("Warning", 1)
    assert found["letters of sample ids"] == ("Error", 1) and found["lanes"] == ("Error", 1) and found["unique indices"] == ("Success", 0)
    assert sheets.is_valid(sheets.sample_sheet(bad)).first().valid is False


def test_design(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("c", "y")], "label string, condition string")
    assert {r.check: r.n_bad for r in sheets.design(df).collect()} == {"unique labels": 1, "two conditions": 0, "two samples a condition": 1}
    assert {r.check: r.n_bad for r in sheets.design(df.where("condition = 'x'")).collect()}["two conditions"] == 1


def test_quantities(spark):
    q = spark.createDataFrame([("t1", 5.0, 1.0, 100.0), ("t2", 7.0, 3.0, 200.0), ("t3", 1.0, 0.0, 50.0)], "transcript string, reads double, tpm double, effective_length double")
    m = spark.createDataFrame([("t1", "g1"), ("t2", "g1"), ("t3", "g2")], "transcript string, gene string")
    assert {r.gene: (r.reads, r.length) for r in quantify.genes_from_transcripts(q, m).collect()} == {"g1": (12.0, 175.0), "g2": (1.0, 50.0)}
    counts = spark.createDataFrame([("g1", "a", 8), ("g1", "b", 4), ("g2", "a", 3)], "gene string, sample string, n int")
    design = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "sample string, condition string")
    assert {r.gene for r in quantify.expressed(counts, design, 5).collect()} == {"g1"}
    wide = spark.createDataFrame([("o1", "g1, g2", None), ("o2", "", "h1")], "Orthogroup string, A string, B string")
    assert sorted(map(tuple, quantify.orthogroup_members(wide).collect())) == [("o1", "A", "g1"), ("o1", "A", "g2"), ("o2", "B", "h1")]
    stats = spark.createDataFrame([("total", "5"), ("pair_types/UU", "3"), ("cis/1kb+/x", "2")], "key string, value string")
    assert [tuple(r) for r in quantify.cross_counts(stats).orderBy("name").collect()] == [("cis", "1kb+/x", 2.0), ("pair_types", "UU", 3.0), ("total", None, 5.0)]


def test_sliding(spark):
    df = spark.createDataFrame([("a", "ACGTGGGG"), ("b", "")], "name string, s string")
    rows = {r.pos: r for r in sliding.base_windows(df, "name", "s", 1).collect()}
    assert rows[1].gc == 0.5 and rows[7].gc == 1.0 and rows[7].entropy == 0.0 and rows[3].gc_skew == 0.0
    hits = {r.pos: r.hits for r in sliding.motif_windows(df, "name", "s", ["GG"], 1).collect()}
    assert hits == {1: 0, 2: 0, 3: 0, 4: 1, 5: 2, 6: 3, 7: 2}
    r = sliding.telomeric(spark.createDataFrame([("t", "TTAGGGTTAGGG"), ("e", None)], "name string, s string"), "name", "s", "TTAGGG", 0.9).orderBy("name").collect()
    assert [x.telomeric for x in r] == [False, True]


def test_peaks(spark):
    df = spark.createDataFrame([("c", i, v) for i, v in enumerate([1.0, 5.0, 2.0, 7.0, 7.0, 3.0, 9.0])], "k string, pos int, v double")
    assert [r.pos for r in peaks.local_maxima(df, "k", "pos", "v", 2.0).collect()] == [1]
    two = spark.createDataFrame([("c", 0, 10, "a"), ("c", 5, 15, "b"), ("c", 15, 20, "a"), ("d", 0, 3, "b")], "k string, start int, end int, src string")
    assert sorted(map(tuple, peaks.replicated(two, ["k"], "src").collect())) == [("c", 0, 15, 2, "both"), ("c", 15, 20, 1, "a"), ("d", 0, 3, 1, "b")]


def test_scales(spark):
    df = spark.range(1)
    one = lambda c: df.select(c.alias("x")).first()["x"]
    assert one(quality.quality_string(F.array(F.lit(0), F.lit(40)))) == "!I"
    assert one(quality.clamped_phred(F.lit(0.0))) == 93.0 and one(quality.clamped_solexa(F.lit(1.0))) == -5.0
    assert one(variants.strand_balances(F.array(F.lit(1), F.lit(3)), F.array(F.lit(3), F.lit(3)))) == [0.25, 0.5]
    assert one(variants.effect_fields(F.lit("SYN(LOW|SILENT|acC/acT|T9|30|gyrA)"))).gene == "gyrA"
