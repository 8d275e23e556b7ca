"""Windows, intervals, formulas, models and the command line against brute force and known values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake import __main__ as cli
from strandlake.functions import alignment, quality, structure, variants
from strandlake.operators import contexts, hierarchy, intervals, models, reports, tracks
from strandlake.sources import alignments, files, reads


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("width, block", [(5, 7), (11, 1000), (101, 30)])
def test_running_windows(spark, width, block):
    rng = random.Random(width)
    values = [[None if rng.random() < 0.1 else float(rng.randrange(9)) for _ in range(n)] for n in (160, 40, 3)]
    rows = [(None if k == 1 else f"c{k}", i + 1, v) for k, vs in enumerate(values) for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "chrom string, pos bigint, cov double")
    medians = {(r.chrom, r.pos): r.rm for r in tracks.running_median(df, "chrom", "pos", "cov", width, block=block).collect()}
    means = {(r.chrom, r.pos): r.ma for r in tracks.moving_average(df, "chrom", "pos", "cov", width, block=block).collect()}
    assert len(medians) == len(means) == len(rows)
    for k, vs in enumerate(values):
        for i in range(len(vs)):
            frame, at = vs[max(0, i - width // 2) : i + width // 2 + 1], (None if k == 1 else f"c{k}", i + 1)
            known = [v for v in frame if v is not None]
            full = i >= width // 2 and i + width // 2 < len(vs)
            assert medians[at] == ((np.median(known) if known else None) if full else vs[i])
            assert means[at] == (pytest.approx(np.mean(known)) if full and known else None)


def test_wide_medians_cost_little():
    x = np.random.default_rng(1).random(60_000)
    got = tracks.sliding_medians(x, 20_001)
    assert np.isnan(got[:10_000]).all() and got[30_000] == np.median(x[20_000:40_001]) and got[49_999] == np.median(x[39_999:60_000])


@pytest.mark.parametrize("width", [4, 1 << 20])
def test_intervals_in_bins(spark, width):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), s := rng.randrange(300), s + rng.randrange(0, 25), rng.choice("+-"), k) for k in range(150)]
    df = spark.createDataFrame(rows, "chrom string, start int, end int, strand string, id int")
    for chrom in ("a", "b", None):
        mine = sorted((s, e, st, k) for c, s, e, st, k in rows if c == chrom)
        cover = [sum(s <= p < e for s, e, _, _ in mine) for p in range(340)]
        steps = [(p, cover[p]) for p in range(340) if p == 0 or cover[p] != cover[p - 1]]
        want = {p: d for p, d in steps if d}
        got = {}
        for r in intervals.depth(df, ["chrom"], width=width).where(F.col("chrom").eqNullSafe(chrom)).collect():
            assert all(cover[p] == r.depth for p in range(r.start, r.end))
            got |= dict.fromkeys(range(r.start, r.end), r.depth)
        assert got == {p: d for p, d in enumerate(cover) if d} and want
        runs = []
        for s, e, _, _ in mine:
            if runs and s <= runs[-1][1]:
                runs[-1] = (runs[-1][0], max(runs[-1][1], e), runs[-1][2] + 1)
            else:
                runs.append((s, e, 1))
        where = F.col("chrom").eqNullSafe(chrom)
        assert sorted((r.start, r.end, r.n) for r in intervals.merged(df, ["chrom"], width=width).where(where).collect()) == runs
        assert sorted((r.start, r.end) for r in intervals.gaps(df, ["chrom"], width=width).where(where).collect()) == [(a[1], b[0]) for a, b in zip(runs, runs[1:], strict=False)]
        ordered, strands = sorted((s, k, st) for s, _, st, k in mine), []
        for s, _, st in ordered:
            if strands and strands[-1][0] == st:
                strands[-1][2] += 1
            else:
                strands.append([st, s, 1])
        found = intervals.directons(df, ["chrom"], ["start", "id"], "strand", width=width).where(where).orderBy("run").collect()
        assert [[r.strand, r.start, r.n] for r in found] == strands and [r.run for r in found] == list(range(1, len(strands) + 1))


def test_as_of(spark):
    rng = random.Random(5)
    left = [(k, rng.choice(["a", None]), rng.randrange(100) if k % 7 else None) for k in range(60)]
    right = [(rng.choice(["a", None]), rng.randrange(100), k) for k in range(25)] + [("a", 5, None), ("a", None, 9)]
    got = intervals.as_of(spark.createDataFrame(left, "id int, k string, at int"), spark.createDataFrame(right, "k string, t int, v int"), ["k"], "at", "t", "v", 10)
    found = {r.id: r.v for r in got.collect()}
    for i, k, at in left:
        known = [(t, v) for kk, t, v in right if kk == k and t is not None and v is not None and at is not None and t <= at]
        assert found[i] == (max(known)[1] if known else None)


def test_headers_are_carried(spark, tmp_path):
    lines = [f"#h{k}" if k % 13 == 5 else f"x{k}" for k in range(4000)]
    (tmp_path / "t.txt").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        df = files.lines(spark, str(tmp_path / "t.txt"))
        rows = files.carried(df, "h", F.when(F.col("value").startswith("#"), F.col("value"))).orderBy("block", "at").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    head, want = None, []
    for x in lines:
        head = x if x[0] == "#" else head
        want.append((x, head))
    assert [(r.value, r.h) for r in rows] == want


def test_formulas(spark):
    assert one(spark, structure.scaled(F.lit("aaac"), structure.BENDABILITY)) == [0.069, 0.055]
    assert one(spark, quality.inverse_anscombe(F.lit(2.0))) == pytest.approx(1 + 0.25 * 1.5**0.5 / 2 - 11 / 32 + 5 / 64 * 1.5**0.5 - 1 / 8)
    dp4 = lambda *x: F.array(*(F.lit(v) for v in x))
    assert one(spark, variants.valid_dp4(dp4(0, 0, 10, 10), 15, 5, 0.5, F.lit(True))) is True
    assert one(spark, variants.valid_dp4(dp4(20, 0, 10, 10), 15, 5, 0.5, F.lit(True))) is False  # a third of the forward reads
    assert one(spark, variants.valid_dp4(dp4(10, 10, 0, 0), 15, 5, 0.5, F.lit(False))) is True
    assert one(spark, variants.valid_dp4(F.lit(None).cast("array<int>"), 15, 5, 0.5, F.lit(True))) is True
    df = spark.createDataFrame([("a", x) for x in (0, 0, 5, 10)] + [("b", None), ("c", 7)], "k string, v int")
    got = {r.k: r.evenness for r in tracks.evenness(df, ["k"], "v").collect()}
    assert got["a"] == 0.5 and got["c"] == 1.0
    assert one(spark, alignments.plain_bases(F.lit("..+25" + "A" * 25 + ",^+.$-2acT*"), F.lit("G"))) == "GGGGT*"
    assert [tuple(x) for x in one(spark, alignment.insertions(F.lit(10), F.lit("3S2M4I1M")))] == [(15, 4)]
    assert tuple(one(spark, alignment.cs_totals(F.lit("-a:6-g:14+g:2+c:9*ac:10")))) == (41, 2, 2, 1)


def test_fasta_headers(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 note A->G here\nACGT\nAC\n>s2\r\nTT\r\n")
    got = {r.name: (r.comment, r.sequence) for r in reads.fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert got == {"s1": ("note A->G here", "ACGTAC"), "s2": ("", "TT")}


def test_nearest_codon(spark):
    found = lambda s, p, strand: one(spark, structure.nearest_codon(F.lit(s), F.lit(p), structure.STARTS, strand))
    assert tuple(found("ATGATGATG", 2, "+")) == (3, "ATG") and tuple(found("AAACAT", 3, "-")) == (3, "CAT") and found("CCCC", 1, "+") is None
    assert one(spark, structure.complexity(F.lit("AAAA"))) == 0.5  # A, AA new; then A, AA known
    assert one(spark, structure.most_pairs(F.lit("GGGCCC"))) == -3 and one(spark, structure.most_pairs(F.lit(""))) == 0


def test_backgrounds(spark):
    ids = spark.range(3000).select(F.col("id"))
    letters = [c for r in contexts.uniform_background(ids, 0.6, 10, 4).collect() for c in r.sequence]
    assert sum(c in "GC" for c in letters) / len(letters) == pytest.approx(0.6, abs=0.02)
    text = "ACGTTGCAAC"
    shuffles = {r.x for r in ids.limit(50).select(contexts.shuffled(F.lit(text), 3, F.col("id")).alias("x")).collect()}
    assert len(shuffles) > 30 and {"".join(sorted(x)) for x in shuffles} == {"".join(sorted(text))}
    assert {r.id for r in contexts.drawn(ids, F.col("id"), 0.2, 1).collect()} == {r.id for r in contexts.drawn(ids.repartition(7), F.col("id"), 0.2, 1).collect()}
    background = contexts.uniform_background(ids, 0.5, 4, 9).withColumnRenamed("sequence", "left")
    own = models.position_frequencies(background.where("id < 300"), "left")
    whole = models.position_frequencies(background, "left")
    plain = {r.position: r.kl for r in models.divergence(own, whole, ["position", "letter"]).collect()}
    for r in contexts.bootstrapped_divergence(own, background, "left", rounds=200, size=2000).collect():
        assert r.low <= r.mean <= r.high and r.mean == pytest.approx(plain[r.position], abs=0.01)


def test_clusters_and_mixtures():
    d = np.array([[0, 1, 5, 6], [1, 0, 5, 7], [5, 5, 0, 2], [6, 7, 2, 0]], dtype=float)
    assert hierarchy.clustered(d, "single").tolist() == [[0, 1, 1, 2], [2, 3, 2, 2], [4, 5, 5, 4]]
    assert hierarchy.clustered(d, "complete")[2, 2] == 7 and hierarchy.clustered(d)[2, 2] == pytest.approx(5.75)
    rng = np.random.default_rng(2)
    mixture = hierarchy.chosen_mixture(np.concatenate((rng.normal(20, 2, 3000), rng.normal(40, 2, 500))), 2, 3)
    assert hierarchy.main_depth(mixture) == pytest.approx(20, abs=1)


def test_components(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 4)) + np.outer(rng.normal(size=30) * 5, [1, 1, -1, -1])
    counts = spark.createDataFrame([(g, f"s{s}", float(x[g, s])) for g in range(30) for s in range(4)], "gene int, sample string, n double")
    names, at, share = hierarchy.principal_components(hierarchy.sample_products(counts, "gene", "sample", "n"))
    centred = x - x.mean(axis=1, keepdims=True)
    _, s, v = np.linalg.svd(centred, full_matrices=False)
    assert names == ["s0", "s1", "s2", "s3"] and np.allclose(np.abs(at[:, 0]), np.abs(v[0] * s[0])) and share[0] == pytest.approx(s[0] ** 2 / (s**2).sum())


def test_stitched(spark):
    rows = spark.createDataFrame([("a", 0, "ACGT"), ("a", 2, "GTTT"), ("a", 8, "CC"), ("a", 3, "T")], "k string, at int, s string")
    assert reports.stitched(rows, "k", "at", "s").first().reference == "ACGTTTNNCC"
    assert reports.interval_edges([1, 2]) == [(0, 1), (1, 2), (2, None)] == reports.interval_edges([0, 1, 2])


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.fa").write_text(">s1\n" + "GGGTTAGGGTTAGGG" * 4 + "\n>s2\nACGT\n")
    (tmp_path / "a.fq").write_text("".join(f"@r{k}\nACGT\n+\nIIII\n" for k in range(5)))
    (tmp_path / "a.gff").write_text("##gff-version 3\ns1\tdb\tgene\t2\t5\t.\t+\t.\tID=g1\ns1\tdb\tCDS\t2\t5\t.\t-\t.\tID=c1\n")
    (tmp_path / "a.b6").write_text("q\ts1\t99\t4\t0\t0\t1\t4\t9\t6\t1e-5\t50\n")
    assert [cli.sniffed(str(tmp_path / f"a.{x}")) for x in ("fa", "fq", "gff")] == ["fasta", "fastq", "gff"]
    run = lambda name, file, **rest: cli.COMMANDS[name](spark, cli.argparse.Namespace(**{"input": str(tmp_path / file), "head": 0, "types": "gene", "other": str(tmp_path / "a.fa"), "parts": 2, "motif": "TTAGGG", "share": 0.1} | rest)).collect()
    assert (run("fasta", "a.fa")[0].n, run("summary", "a.fq")[0].total, len(run("fastq", "a.fq", head=2))) == (2, 20, 2)
    assert sorted(r.part for r in run("fastq_split", "a.fq")) == [0, 0, 0, 1, 1]
    assert [r.line for r in run("gff_to_light_gff", "a.gff")] == ["s1\tdb\tgene\t2\t5\t.\t+\t.\tID=g1"]
    assert {r.line for r in run("feature_fasta", "a.gff", types="CDS,gene")} == {">g1\nGGTT", ">c1\nAACC"}
    assert run("blast_to_gff", "a.b6")[0].line.startswith("s1\tblastn\tmatch\t6\t9\t50\t-")
    assert {r.name: r.telomeric for r in run("telomark", "a.fa")} == {"s1": True, "s2": False}
    assert {r.name for r in run("g4hunter", "a.fa")} <= {"s1"} and len(run("ribodesigner", "a.fa")) == 2 and len(run("gff", "a.gff")) == 2
    assert len(run("gff_to_gtf", "a.gff")) == 2 and len(run("samplesheet", "a.gff")) == 3
