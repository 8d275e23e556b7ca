"""Readers and writers on small files, round trips included."""

import gzip
import struct
import zlib

from pyspark.sql import functions as F

from strandlake.sources import alignments, annotations, reads, reports, sinks


def test_fastq_ranges(spark, tmp_path):
    records = [(f"r{i} 1:N:0:ACGT", "ACGT" * (i % 7 + 1), "@+!I" * (i % 7 + 1)) for i in range(200)]
    text = "".join(f"@{a}\n{b}\n+\n{c}\n" for a, b, c in records)
    (tmp_path / "a.fastq").write_text(text)
    (tmp_path / "b.fastq.gz").write_bytes(gzip.compress(text.encode()))
    for size in (64, 333, 1 << 20):
        got = reads.fastq(spark, str(tmp_path / "a.fastq"), size).orderBy("offset").collect()
        assert [(r.identifier, r.sequence, r.quality) for r in got] == records
    assert reads.fastq(spark, str(tmp_path)).count() == 400
    parts = reads.fastq(spark, str(tmp_path / "a.fastq")).select(reads.illumina_identifier(F.lit("M:1:F:2:3:4:5 1:N:0:AC")).alias("x")).first().x
    assert (parts.lane, parts.y, parts.barcode) == ("2", "5", "AC")


def test_fasta_round_trip(spark, tmp_path):
    rows = [("c1", "len=5", "ACGTA"), ("c2", "", "A" * 200), ("c3", "x y", "")]
    df = spark.createDataFrame(rows, "name string, comment string, sequence string")
    sinks.fasta(df, str(tmp_path / "f"), comment="comment", width=60)
    got = reads.fasta(spark, str(tmp_path / "f")).orderBy("name").collect()
    assert [(r.name, r.comment, r.sequence) for r in got] == rows


def test_sam_and_bam(spark, tmp_path):
    (tmp_path / "x.sam").write_text("@HD\tVN:1.6\nq1\t16\tchr1\t10\t60\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:0\tRG:Z:a:b\n")
    r = alignments.sam(spark, str(tmp_path / "x.sam")).first()
    assert (r.qname, r.flag, r.pos, r.cigar, r.tags) == ("q1", 16, 10, "4M", {"NM": "0", "RG": "a:b"})
    body = struct.pack("<iiBBHHHiiii", 0, 9, 3, 60, 0, 1, 16, 5, -1, -1, 0) + b"q1\0" + struct.pack("<I", 5 << 4) + bytes([0x12, 0x48, 0x10]) + bytes([40] * 5)
    data = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000) + struct.pack("<i", len(body)) + body
    packer = zlib.compressobj(wbits=31)
    (tmp_path / "x.bam").write_bytes(packer.compress(data) + packer.flush())
    r = alignments.bam(spark, str(tmp_path / "x.bam")).first()
    assert (r.qname, r.flag, r.rname, r.pos, r.cigar, r.seq, r.qual) == ("q1", 16, "chr1", 10, "5M", "ACGTA", "IIIII")


def test_gff_and_writers(spark, tmp_path):
    (tmp_path / "x.gff").write_text('##gff-version 3\nchr1\tsrc\tgene\t1\t9\t.\t+\t.\tID=g1;Name=a%3Bb;ID=g2\nbad line\nchr1\tsrc\tCDS\t2\t8\t0.5\t?\t0\tgene_id "x y"; n "2";\n##FASTA\n>chr1\na\tb\tc\td\te\tf\tg\th\ti\n')
    rows = annotations.gff(spark, str(tmp_path / "x.gff")).orderBy("start").collect()
    assert [r.attributes for r in rows] == [{"Name": "a%3Bb", "ID": "g2"}, {"gene_id": "x y", "n": "2"}]
    assert (rows[0].start, rows[0].stop, rows[0].strand, rows[1].strand) == (1, 9, "+", "?")
    df = annotations.gff(spark, str(tmp_path / "x.gff"), skip_types=("CDS",))
    sinks.bed(df, str(tmp_path / "bed"))
    assert spark.read.text(str(tmp_path / "bed")).first().value == "chr1\t0\t9\tg2\t0\t+"
    sinks.gff(df, str(tmp_path / "gff"))
    assert annotations.gff(spark, str(tmp_path / "gff")).count() == 1
    sinks.gtf(df, str(tmp_path / "gtf"), {"ID": "gene_id"})
    assert annotations.gff(spark, str(tmp_path / "gtf")).first().attributes["gene_id"] == "g2"


def test_vcf(spark, tmp_path):
    (tmp_path / "x.vcf").write_text("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\nchr1\t7\t.\tA\tC,G\t50.5\t.\tDP=10;INDEL;AO=3,4\tGT:DP\t0/1:5\t1/1:6\n")
    r = annotations.vcf(spark, str(tmp_path / "x.vcf")).first()
    assert (r.pos, r.alt, r.qual, r.info, r.samples["s2"]) == (7, ["C", "G"], 50.5, {"DP": "10", "INDEL": "", "AO": "3,4"}, {"GT": "1/1", "DP": "6"})


def test_bed12_and_wiggle(spark, tmp_path):
    (tmp_path / "x.bed").write_text("track name=x\nchr1\t100\t200\tg\t0\t+\t100\t200\t0\t2\t10,20,\t0,80,\n")
    r = annotations.bed(spark, str(tmp_path / "x.bed")).first()
    assert (r.block_sizes, r.block_starts) == ([10, 20], [100, 180])
    (tmp_path / "x.wig").write_text("track\nfixedStep chrom=c1 start=5 step=2\n1.5\n2.5\nvariableStep chrom=c2\n9 4\n")
    assert sorted((r.chrom, r.pos, r.value) for r in annotations.wiggle(spark, str(tmp_path / "x.wig")).collect()) == [("c1", 5, 1.5), ("c1", 7, 2.5), ("c2", 9, 4.0)]


def test_genbank_and_embl(spark, tmp_path):
    (tmp_path / "x.gbk").write_text('LOCUS       AB1  20 bp\nDEFINITION  x\nFEATURES             Location/Qualifiers\n     source          1..20\n                     /organism="a\n                     b"\n     CDS             complement(join(3..6,9..12))\n                     /gene="g1"\n                     /pseudo\nORIGIN\n        1 acgt\n//\n')
    rows = annotations.genbank(spark, str(tmp_path / "x.gbk")).orderBy("gene_start").collect()
    assert [(r.type, r.gene_start, r.gene_end, r.strand) for r in rows] == [("source", 1, 20, "+"), ("CDS", 3, 12, "-")]
    assert rows[0].qualifiers == {"organism": "a b"} and rows[1].qualifiers == {"gene": "g1", "pseudo": ""}
    (tmp_path / "x.embl").write_text("ID   X1; SV 1\nAC   A1;\nDE   some\nDE   words\nSQ   Sequence 8 BP;\n     acgt acgt 8\n//\n")
    r = annotations.embl(spark, str(tmp_path / "x.embl")).first()
    assert (r.id, r.accession, r.description, r.sequence) == ("X1", "A1", "some words", "ACGTACGT")


def test_reports(spark, tmp_path):
    (tmp_path / "p").write_text("chr1\t5\t9\tn1\t7\t.\t2.5\t3\t4\t2\n")
    r = reports.table(spark, str(tmp_path / "p"), "narrowpeak").first()
    assert (r.start, r.strand, r.fold_enrichment, r.summit) == (5, ".", 2.5, 2)
    (tmp_path / "s.csv").write_text("[Header],,\nDate, 2020\n\n[Data]\nSample_ID,index\ns1, ACGT\n")
    rows = reports.sample_sheet(spark, str(tmp_path / "s.csv")).orderBy("line_no").collect()
    assert [(r.section, r.fields) for r in rows] == [("Header", ["Date", "2020"]), ("Data", ["Sample_ID", "index"]), ("Data", ["s1", "ACGT"])]
    (tmp_path / "names").write_text("1\t|\troot\t|\t\t|\tscientific name\t|\n2\t|\tB\t|\t\t|\tsynonym\t|\n2\t|\tBacteria\t|\t\t|\tscientific name\t|\n")
    (tmp_path / "nodes").write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tsuperkingdom\t|\n")
    got = reports.taxonomy(spark, str(tmp_path / "names"), str(tmp_path / "nodes")).orderBy("taxon").collect()
    assert [(r.taxon, r.parent, r.rank, r.name) for r in got] == [(1, 1, "no rank", "root"), (2, 1, "superkingdom", "Bacteria")]
    (tmp_path / "fc").write_text("# x\nGeneid\tChr\tStart\tEnd\tStrand\tLength\t/a/s1_Aligned.bam\ng1\tc;c\t1;5\t2;9\t+;+\t7\t42\n")
    assert reports.feature_counts(spark, str(tmp_path / "fc")).first().asDict() == {"Geneid": "g1", "Length": 7, "s1": 42}


def test_mpileup(spark, tmp_path):
    (tmp_path / "m").write_text("c\t1\tA\t5\t^I.,+2ACg$*-1tT\tIIIII\n")
    r = alignments.mpileup(spark, str(tmp_path / "m")).first()
    assert (r.n_a, r.n_g, r.n_t, r.n_del) == (2, 1, 1, 1)


def test_small_reports(spark, tmp_path):
    (tmp_path / "m.txt").write_text("-----\nBin Id  x\n-----\n  s1   k__Bacteria (UID203)   5449   104   58   0  104  0  0  0  0   100.00   0.50   0.00  \n----\n")
    (tmp_path / "a.txt").write_text(">c1 x\n2 genes found\n1   tRNA-Ala   [10,82]   35.5   (tgc)\n2   tRNA-Leu   c[100,180]   34.0   (caa)\n>c2\n0 genes found\n")
    (tmp_path / "r.gff").write_text("##gff-version2\nx\tRNAmmer-1.2\trRNA\t5\t90\t59.3\t+\t.\t8s_rRNA\t\n")
    (tmp_path / "g.txt").write_text(">s1\nStart\tEnd\tSequence\tLength\tScore\tNBR\n5 \t 30 \t GGG \t 25 \t 1.2\n40 \t 70 \t CCC \t 30 \t -1.5 \t 2\n")
    (tmp_path / "i.txt").write_text("track x\n#c\nvariableStep\n1\t9\t1\t0\t0\t0\t0\t0\n2\t1\t0\t0\t0\t0\t0\t0\n")
    (tmp_path / "x.gfa").write_text("H\tVN:Z:1.0\nS\tu1\tACGT\tLN:i:4\tdp:i:12\nS\tu2\tAC\nL\tu1\t+\tu2\t-\t2M\n")
    (tmp_path / "t.nwk").write_text("((a:1,b:2):0.5,c:3);")
    m = reports.completeness(spark, str(tmp_path / "m.txt")).first()
    assert (m["sample"], m.marker_lineage, m.n_markers, m.completeness, m.contamination) == ("s1", "k__Bacteria (UID203)", 104, 100, 0.5)
    assert [(r.contig, r.kind, r.start, r.length, r.strand) for r in reports.transfer_rnas(spark, str(tmp_path / "a.txt")).orderBy("start").collect()] == [("c1", "tRNA-Ala", 10, 72, "+"), ("c1", "tRNA-Leu", 100, 80, "-")]
    r = reports.ribosomal_rnas(spark, str(tmp_path / "r.gff")).first()
    assert (r.chrom, r.stop, r.score, r.attributes) == ("x", 90, 59.3, "8s_rRNA")
    assert [(r["name"], r.end, r.score, r.nbr) for r in reports.quadruplexes(spark, str(tmp_path / "g.txt")).orderBy("start").collect()] == [("s1", 30, 1.2, None), ("s1", 70, -1.5, 2)]
    assert [(r.pos, r.a, r.n) for r in reports.base_counts(spark, str(tmp_path / "i.txt"), 5).orderBy("pos").collect()] == [(1, 9, 0), (2, 0, 10_000)]
    segments, links = reports.assembly_graph(spark, str(tmp_path / "x.gfa"))
    assert sorted(map(tuple, segments.collect())) == [("u1", 4, 12.0), ("u2", 2, None)] and tuple(links.first()) == ("u1", "+", "u2", "-", "2M")
    t = reports.newick_distances(spark, str(tmp_path / "t.nwk")).first()
    assert (t.leaves, round(t.mean, 6), round(t.variance, 6)) == (3, 4.333333, 1.055556)  # 3, 4.5 and 5.5
