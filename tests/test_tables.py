"""Readers with their checks, selections, percentiles and writers."""

import gzip
import struct

import pytest
from pyspark.sql import functions as F

from strandwise.functions import percentiles
from strandwise.sources import bigwig, tables, text


def test_percentile_sequences():
    assert percentiles.stepped(0, 1, 0.1) == [round(k / 10, 12) for k in range(11)]
    assert percentiles.stepped(90, 40, 20) == [40.0, 60.0, 80.0, 90.0] and percentiles.stepped(-5, 120, 50) == [0.0, 50.0, 100.0]
    assert percentiles.parsed(["50,90", "50", "10"]) == [50.0, 90.0, 10.0] and percentiles.bins([0, 10, 30]) == [(0.0, 10.0), (10.0, 30.0)]
    assert [percentiles.label(x) for x in (None, 10.0, 2.5, 0.1234567)] == ["", "10", "2.5", "0.123457"]
    for bad in (lambda: percentiles.stepped(0, 1, 0), lambda: percentiles.parsed(["101"]), lambda: percentiles.bins([5, 5])):
        with pytest.raises(ValueError):
            bad()


def test_peaks_and_positions(spark, tmp_path):
    path = tmp_path / "p.bed"
    path.write_text("chr1\t10\t60\ta\t5.5\t+\t20\nchr1\t70\t80\tb\t-1\t+\t75\nchrM\t0\t100\tc\tnan\t+\t5\nchr2\t5\t90\td\t3\t+\t200\n")
    got = sorted((r["chrom"], r["s"], r["pos"], r["score"]) for r in tables.peaks(spark, str(path), strict=False).collect())
    assert got == [("chr1", 10, 35, 5.5), ("chr1", 70, 75, -1.0), ("chr2", 5, 47, 3.0)]
    assert [r["s"] for r in tables.peaks(spark, str(path), position_column=7, least=20, strict=False).collect()] == [10]
    with pytest.raises(Exception, match="no peak"):
        tables.peaks(spark, str(path)).collect()
    assert {(r["chrom"], r["pos"]) for r in tables.positions(spark, str(path), strict=False).collect()} == {("1", 20), ("1", 75), ("2", 200)}


def test_region_modes(spark):
    df = spark.createDataFrame([("c", 100, 200, "+"), ("c", 100, 200, "-"), ("c", 3, 9, "+")], "chrom string, s long, e long, strand string")
    got = lambda mode: [(r["s"], r["e"]) for r in tables.region_modes(df, mode, 50).collect()]
    assert got("interval") == [(100, 200), (100, 200), (3, 9)]
    assert got("downstream") == [(100, 150), (150, 200), (3, 53)] and got("upstream") == [(51, 101), (199, 249), (0, 4)]


def test_genes_and_rules(spark, tmp_path):
    (tmp_path / "g.bed").write_text("chr1\t10\t500\tENSG01.7\tAbc\t+\n1\t600\t900\tENSG02\tDef\t-\nchr9\t5\t6\tENSG03\tGhi\t+\n")
    known = tables.genes(spark, str(tmp_path / "g.bed"))
    assert {r["gene_id"] for r in known.collect()} == {"ENSG01", "ENSG02", "ENSG03"}
    sizes = spark.createDataFrame([("chr1", 700)], "chrom string, length long")
    assert {(r["gene_id"], r["e"]) for r in tables.genes(spark, str(tmp_path / "g.bed"), sizes).collect()} == {("ENSG01", 500), ("ENSG02", 700)}
    chosen = tables.selected_genes(known, [("ENSG01.2", "a"), ("def", "a")], "both")
    assert sorted((r["region"], r["gene_id"]) for r in chosen.collect()) == [("ENSG01", "ENSG01"), ("ENSG02", "ENSG02"), ("a", "ENSG01"), ("a", "ENSG02")]
    with pytest.raises(Exception, match="not known"):
        tables.selected_genes(known, [("nobody", "a")]).collect()
    (tmp_path / "r.tsv").write_text("set_name\tinclude_rule\texclude_if_candidate\non\tA & B\t\noff\tC\ton\n")
    assert tables.rules(spark, str(tmp_path / "r.tsv")) == ({"on": "A & B", "off": "C"}, {"off": ["on"]})
    (tmp_path / "t.tsv").write_text("fragment_range\toutput_prefix\ttracks\tbasic_scope\n137-197\tmono\tpns,coverage\tall\n")
    assert tables.track_specs(spark, str(tmp_path / "t.tsv")) == [("mono", 137, 197, ["pns", "coverage"], "all")]
    with gzip.open(tmp_path / "e.tsv.gz", "wt") as f:
        f.write("Gene\tGene name\tTissue\tnTPM\nENSG01.1\tAbc\tT  cell\t2\nENSG01\tAbc\tt_cell\t4\nENSG02\tDef\tT cell\t-1\nENSG02\tDef\tliver\t7\n")
    assert [(r["gene_id"], r["value"]) for r in tables.tissue_expression(spark, str(tmp_path / "e.tsv.gz"), "T_CELL").collect()] == [("ENSG01", 3.0)]


def test_fasta_chunks(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a first\nacgt\nACGTN\n>b\n" + "T" * 25 + "\n>c\n")
    got = sorted((r["chrom"], r["start"], r["seq"]) for r in tables.fasta(spark, str(tmp_path / "x.fa"), 10).collect())
    assert got == [("a", 0, "ACGTACGTN"), ("b", 0, "T" * 10), ("b", 10, "T" * 10), ("b", 20, "T" * 5)]


def test_bigwig_regions(spark, tmp_path):
    runs = [(c, 10 * i, 10 * i + 7, float(i)) for c in ("chr1", "chr2") for i in range(3000)]
    path = tmp_path / "x.bw"
    path.write_bytes(bigwig.encoded(runs, {"chr1": 30000, "chr2": 30000}))
    spark.dataSource.register(bigwig.BigWigSource)
    got = sorted(map(tuple, spark.read.format("bigwig").option("regions", "1:1003-1025,chr2:29990-30000").option("limit", "101").load(str(path)).collect()))
    assert got == [("chr1", 1003, 1007, 100.0), ("chr1", 1010, 1017, 101.0), ("chr1", 1020, 1025, 101.0), ("chr2", 29990, 29997, 101.0)]
    with open(path, "rb") as f:
        read = []
        _, blocks, _ = bigwig.contigs_and_blocks(f, lambda *span: read.append(span) or (span[0], span[1]) < (0, 20) < (span[2], span[3]))
    assert 1 <= len(blocks) < 4


def test_tracks_and_tables_out(spark, tmp_path):
    track = spark.createDataFrame([("c", 0, 5, 1.0), ("c", 5, 9, 1.0), ("c", 12, 14, 2.0)], "chrom string, start long, end long, value double")
    text.write_bedgraph(track, f"{tmp_path}/b")
    lines = sorted(line for p in (tmp_path / "b").glob("part-*") for line in p.read_text().splitlines())
    assert lines == ["c\t0\t9\t1", "c\t12\t14\t2"]
    with pytest.raises(Exception, match="overlaps"):
        text.write_bedgraph(track.unionByName(spark.createDataFrame([("c", 4, 6, 3.0)], track.schema)), f"{tmp_path}/bad")
    rows = spark.createDataFrame([("g", [1.0, float("nan")]), ("h", [2.0, 3.0, 4.0])], "k string, signal array<double>")
    wide = tables.matrix_lines(rows, ["k"], 3)
    assert wide.columns == ["k", "offset_0", "offset_1", "offset_2"] and sorted(map(tuple, wide.collect())) == [("g", "1.0", "NA", "NA"), ("h", "2.0", "3.0", "4.0")]
    tables.write_table(wide, f"{tmp_path}/t", ["k"])
    back = spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/t")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, wide.collect()))
    spans = spark.createDataFrame([("c", 0, 10), ("c", 5, 15), ("c", 0, 100)], "chrom string, s long, e long")
    assert {r["metric"]: r["value"] for r in tables.fragment_summary(spans, 5, 20).collect()} == {"total_fragments_filtered_all": 3, "total_fragments_used_in_range": 2, "unique_bases_covered_by_used_fragments": 15}
    assert struct.calcsize("<I") == 4 and rows.select(F.size("signal")).count() == 2


def test_fragment_source_and_counts(spark, tmp_path):
    bed = tmp_path / "f.bed"
    bed.write_text("chr1\t10\t60\n1\t100\t150\nchr1\tx\t5\n# note\n")
    with pytest.raises(ValueError):
        tables.fragment_source(spark)
    clean = tmp_path / "g.bed"
    clean.write_text("chr1\t10\t60\n1\t100\t150\n")
    black = spark.createDataFrame([("chr1", 149, 160)], "chrom string, s long, e long")
    assert [(r["source_id"], r["chrom"], r["s"]) for r in tables.fragment_source(spark, [str(clean)], blacklist=black).collect()] == [(1, "1", 10)]
    assert [(r["rows"], r["malformed"]) for r in tables.interval_counts(spark, str(bed)).collect()] == [(2, 1)]


def test_bed8_and_flanks(spark):
    peaks = spark.createDataFrame([("c", 10, 20, 15, -2.5), ("c", 40, 50, 60, 5000.0), ("c", 100, 110, 105, 1.0)], "chrom string, s long, e long, pos long, score double")
    assert sorted(r["value"] for r in tables.filtered_bed8(peaks).collect()) == ["c\t10\t20\tc:15\t3\t.\t15\t16", "c\t100\t110\tc:105\t1\t.\t105\t106", "c\t40\t50\tc:60\t1000\t.\t49\t50"]
    sites = spark.createDataFrame([(1, "c", 60), (2, "d", 60)], "site int, chrom string, pos long")
    rows = {r["site"]: r for r in tables.flanking_table(sites, peaks, 50, "t").collect()}
    assert (rows[1]["t_count"], rows[1]["t_up_pos"], rows[1]["t_down_pos"], rows[1]["t_up_gap"]) == ("3", "15", "60", "45")
    assert (rows[2]["t_count"], rows[2]["t_up_pos"]) == ("0", "NA") and len(rows[1]) == 15
