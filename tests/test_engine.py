"""Operators against dense definitions, and every query against its SQL."""

import gzip
import os
import struct
import zlib
from pathlib import Path

import numpy as np
import pytest

import __spark_entry__ as entry
from strandwise.functions import numerics
from strandwise.operators import annotate, calls, correlate, intervals, sequence, signals, spacing
from strandwise.plans import catalog, views
from strandwise.sources import alignments, text

DATA = "/root/testdata/sf0.001"


def fragments(spark, rows):
    return spark.createDataFrame([(1, "c", s, e) for s, e in rows], "source_id int, chrom string, s long, e long")


def dense(rows, low=-400, high=1400):
    out = np.zeros(high - low)
    for r in rows:
        out[r["start"] - low:r["end"] - low] = r["value"]
    return out


def dense_lines(rows, low=-400, high=1400):
    out = np.zeros(high - low)
    for r in rows:
        n = r["end"] - r["start"]
        out[r["start"] - low:r["end"] - low] = r["at_start"] + r["slope"] * np.arange(n)
    return out


RNG = np.random.default_rng(9)
SPANS = [(int(s), int(s + n)) for s, n in zip(RNG.integers(0, 900, 80), RNG.integers(60, 260, 80))]


def triangle(n):
    j = np.arange(n)
    return np.minimum(j, n - 1 - j) / (((n - 1) // 2) * (n // 2))


def test_kernels_against_dense_sums(spark):
    m, want = 167, {k: np.zeros(1800) for k in ("cover", "pos", "centre", "box", "tri", "wps")}
    for s, e in SPANS:
        n = max(e - s, 2 * m - (e - s)) if e - s < m else e - s
        lo, at = min(s, e - m), 400
        want["cover"][s + at:e + at] += 1
        for a in (s, e - m):
            want["pos"][a + at:a + at + m] += triangle(m) / 2
        want["centre"][lo + at:lo + at + n] += 1 / n
        want["tri"][lo + at:lo + at + n] += triangle(n)
        box = np.zeros(n)
        k, w = n // 4, 4 - n % 4
        box[k] += w
        box[k + 1:n - k - 1] += 4
        box[n - k - 1] += w
        want["box"][lo + at:lo + at + n] += box / (2 * n)
        length, p = e - s, 120
        kernel = np.concatenate([-np.ones(p - 1), np.ones(length - p + 1), -np.ones(p - 1)]) if length >= p else -np.ones(2 * (p - 1))
        first = s - p // 2 + 1 + at
        want["wps"][first:first + len(kernel)] += kernel
    df = fragments(spark, SPANS)
    assert (dense(signals.coverage(df).collect()) == want["cover"]).all()
    assert np.allclose(dense_lines(signals.positive_score(df).collect()) / (2 * 83 * 83), want["pos"], atol=1e-9)
    assert np.allclose(dense(signals.centring(df).collect()) / signals.UNIT, want["centre"], atol=1e-8)
    assert np.allclose(dense(signals.boxcar_score(df).collect()) / signals.UNIT, want["box"], atol=1e-6)
    assert np.allclose(dense_lines(signals.triangle_score(df).collect()) / signals.UNIT, want["tri"], atol=1e-6)
    assert (dense(signals.protection_score(df).collect()) == want["wps"]).all()


def test_two_level_sums_equal_one_level(spark):
    df = fragments(spark, SPANS)
    events = signals.changes(df, ["chrom"], (df["s"], __import__("pyspark").sql.functions.lit(1)), (df["e"], __import__("pyspark").sql.functions.lit(-1)))
    one, many = (sorted(map(tuple, signals.runs(events, ["chrom"], b).collect())) for b in (1 << 20, 16))
    assert one == many


def test_fragment_fixtures(spark):
    df = spark.createDataFrame([(1, "c", 10, 20), (1, "c", 10, 20), (1, "c", 30, 45), (2, "c", 10, 20)], "source_id int, chrom string, s long, e long")
    assert sorted((r["s"], r["e"]) for r in spacing.limited_copies(df, 1).collect()) == [(10, 20), (30, 45)]
    assert len(spacing.limited_copies(df, 1, ("source_id", "chrom", "s", "e")).collect()) == 3
    assert len(spacing.limited_copies(df, 0).collect()) == 4
    assert sorted((r["pos"], r["value"]) for r in signals.dyads(fragments(spark, [(4, 10)])).collect()) == [(6, 0.5), (7, 0.5)]


def test_runs_and_regions(spark):
    track = spark.createDataFrame([("c", 1, 2, 1.0), ("c", 2, 3, 2.0), ("c", 3, 5, 3.0), ("c", 6, 7, 5.0), ("c", 7, 8, 6.0)], "chrom string, start long, end long, value double")
    assert sorted((r["start"], r["end"], r["top"]) for r in signals.runs_above(track).collect()) == [(1, 5, 3.0), (6, 8, 6.0)]
    assert [(r["start"], r["end"]) for r in signals.runs_above(track, gap=1).collect()] == [(1, 8)]
    assert [(r["start"], r["end"], r["value"]) for r in signals.compressed(spark.createDataFrame([("c", 0, 2, 1), ("c", 2, 5, 1), ("c", 6, 7, 1)], "chrom string, start long, end long, value int"), ["chrom"]).orderBy("start").collect()] == [(0, 5, 1), (6, 7, 1)]


def test_centres_of_regions_are_those_of_the_sql(spark):
    import duckdb

    rows = [(-56, 55), (-60, -3), (-70, -10), (100, 151), (200, 260)]
    track = spark.createDataFrame([(f"c{i}", s, e, 1) for i, (s, e) in enumerate(rows)], "chrom string, start long, end long, value int")
    want = [duckdb.connect().execute(f"select ({s} + {e}) // 2").fetchone()[0] for s, e in rows]
    assert [r["centre"] for r in signals.call_regions(track).orderBy("chrom").collect()] == want


def test_interval_algebra_against_bases(spark):
    rng = np.random.default_rng(2)
    for _ in range(3):
        a, b = ([(int(s), int(s + n)) for s, n in zip(rng.integers(0, 300, 20), rng.integers(1, 40, 20))] for _ in range(2))
        A, B = fragments(spark, a), fragments(spark, b)
        bases = lambda x: {p for s, e in x for p in range(s, e)}
        got = [(r["s"], r["e"]) for r in intervals.merged(A.select("chrom", "s", "e"), ["chrom"]).collect()]
        assert bases(got) == bases(a) and sum(e - s for s, e in got) == len(bases(a))
        left = [(r["s"], r["e"]) for r in intervals.subtracted(A.select("chrom", "s", "e"), B, ["chrom"]).collect()]
        assert bases(left) == bases(a) - bases(b) and sum(e - s for s, e in left) == len(bases(left))
        pairs = sorted((r["s"], r["e"], r["r_s"], r["r_e"]) for r in intervals.overlap_join(A, B, width=16).collect())
        assert pairs == sorted((s, e, t, u) for s, e in a for t, u in b if s < u and t < e)
        semi = sorted((r["s"], r["e"]) for r in intervals.overlap_join(A, B, "left_semi", width=16).collect())
        anti = sorted((r["s"], r["e"]) for r in intervals.overlap_join(A, B, "left_anti", width=16).collect())
        assert semi == sorted(x for x in a if any(x[0] < u and t < x[1] for t, u in b)) and sorted(semi + anti) == sorted(a)
        band = sorted((r["s"], r["r_s"]) for r in intervals.band_join(A, B, ["chrom"], "s", -7, 9).collect())
        assert band == sorted((s, t) for s, _ in a for t, _ in b if -7 <= t - s <= 9)


def greedy(query, target, most):
    out, query, target = [], set(query), set(target)
    while query and target:
        d, q, t = min((abs(q - t), q, t) for q in query for t in target)
        if d > most:
            break
        out.append((q, t, d))
        query.discard(q), target.discard(t)
    return sorted(out)


def test_matching_equals_greedy(spark):
    rng = np.random.default_rng(8)
    for _ in range(3):
        q, t = (sorted({int(x) for x in rng.integers(0, 200, 25)}) for _ in range(2))
        frame = lambda v: spark.createDataFrame([("c", x) for x in v], "chrom string, pos long")
        got = sorted((r["query"], r["target"], r["distance"]) for r in spacing.matched_one_to_one(frame(q), frame(t), 30).collect())
        assert got == greedy(q, t, 30)


def test_flanks_and_neighbours(spark):
    centres = spark.createDataFrame([("c", p) for p in (10, 100, 200, 300, 400)], "chrom string, pos long")
    sites = spark.createDataFrame([("c", 200, "+"), ("c", 260, "-"), ("d", 5, "+"), ("c", 5, "+")], "chrom string, pos long, strand string")
    got = {(r["chrom"], r["pos"]): (r["spacing"], r["status"]) for r in spacing.flanks(sites, centres).collect()}
    assert got == {("c", 200): (200, "ok"), ("c", 260): (100, "ok"), ("d", 5): (None, "no_matching_contig"), ("c", 5): (None, "missing_flank")}
    assert {(r["chrom"], r["pos"]): r["neighbour"] for r in spacing.kth_neighbour(sites, centres, 2).collect()} == {("c", 200): 400, ("c", 260): 100, ("d", 5): None, ("c", 5): 100}


def test_rules_and_sets(spark):
    genes = spark.createDataFrame([(1, "c", 0, 10), (2, "c", 20, 30), (3, "c", 40, 50)], "gene_id int, chrom string, s long, e long")
    states = spark.createDataFrame([("c", 0, 25, "a"), ("c", 22, 60, "b")], "chrom string, s long, e long, label string")
    got = {(r["gene_id"], r["set_name"]) for r in annotate.gene_sets(genes, states, {"x": "a", "y": "b & (a | c)"}, leftover="none").collect()}
    assert got == {(1, "x"), (3, "none")}
    with pytest.raises(ValueError):
        annotate.rule_expression("a & !b")
    with pytest.raises(ValueError):
        annotate.rule_expression("(a | b")


def test_histogram_and_lines(spark):
    h = spark.createDataFrame([(1, 186, 7), (1, 185, 7), (1, 184, 2)], "ord int, distance int, n long")
    r = spacing.histogram_summary(h, ["ord"]).first()
    assert (r["mode"], r["total"]) == (185, 16)
    fit = spacing.line_fit(spark.createDataFrame([(1, 182), (2, 367), (3, 552)], "x int, y int"), "x", "y").first()
    assert round(fit["slope"], 9) == 185 and round(fit["intercept"], 9) == -3


def test_masked_opportunities(spark):
    valid = [1, 0, 1, 1, 0, 1]
    runs = spark.createDataFrame([("c", 0, 0, 1), ("c", 0, 2, 4), ("c", 0, 5, 6)], "chrom string, window int, s long, e long")
    got = {r["distance"]: r["opportunities"] for r in correlate.masked_opportunities(runs, 5).collect() if r["opportunities"]}
    assert got == {d: n for d in range(1, 6) if (n := sum(a * b for a, b in zip(valid, valid[d:])))}


def test_numerics():
    d = np.arange(0, 41, 10.0)
    assert numerics.moving_average_by_distance(d, np.array([0, 0, 10.0, 0, 0]), 21).tolist() == pytest.approx([0, 10 / 3, 10 / 3, 10 / 3, 0])
    x = np.arange(200, 1201.0)
    wave = sum(np.exp(-((x - c) ** 2) / 800) for c in (370, 555, 740, 925, 1110)) + 0.02 * np.sin(x)
    peaks, fit = numerics.repeat_length(x, wave)
    assert len(peaks) == 5 and abs(fit["slope"] - 185) < 1 and fit["r2"] > 0.999
    assert numerics.smoothing_windows(160) == (51, 21)
    spectrum = numerics.periodogram(np.sin(2 * np.pi * np.arange(2000) / 50), np.arange(20, 120))
    assert 48 <= 20 + int(np.argmax(spectrum)) <= 52
    assert numerics.t_test_p(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert numerics.holm(np.array([0.01, 0.04, 0.03])).tolist() == pytest.approx([0.03, 0.06, 0.06])
    assert numerics.savgol(np.arange(30.0) ** 2, 7).tolist() == pytest.approx((np.arange(30.0) ** 2).tolist())
    assert np.isnan(numerics.running_median(np.arange(5.0), 10)).all()
    assert numerics.running_median(np.arange(10.0), 4)[2] == 1.5
    assert calls.source_median(np.array([1.0, 2, 3, 4])) == 3.0 and calls.half_away(-1.5) == -2
    assert calls.protected_calls(100, np.concatenate([np.full(30, 1.0), np.full(40, 9.0), np.full(30, 1.0)])) != []


def test_sequences(spark):
    chunks = spark.createDataFrame([("c", 0, "acgtACGTAC"), ("c", 10, "GGGGTTTTAA")], "chrom string, start long, seq string")
    got = {(r["s"], r["e"]): r["sequence"] for r in sequence.fragment_sequences(fragments(spark, [(2, 12), (15, 24), (0, 3)]), chunks, 10).collect()}
    assert got == {(2, 12): "GTACGTACGG", (15, 24): "TTTAANNNN", (0, 3): "ACG"}
    moved = sequence.randomized(fragments(spark, [(i, i + 150) for i in range(0, 5000, 7)])).collect()
    assert all(r["e"] - r["s"] == 150 and 0 <= r["s"] <= 100_000 - 150 for r in moved) and len({r["s"] for r in moved}) > 500


def test_text_sources(spark, tmp_path):
    path = tmp_path / "a.bed.gz"
    with gzip.open(path, "wt") as f:
        f.write("#x\ntrack name=y\nchr1\t10\t20\tn\t5\nchr1 30 45\n\n")
    assert sorted((r["chrom"], r["s"], r["e"]) for r in text.fragments(spark, [str(path)]).collect()) == [("1", 10, 20), ("1", 30, 45)]
    bad = tmp_path / "b.bed"
    bad.write_text("chr1\t20\t10\nchr1\t1\t2\n")
    assert text.interval_rows(spark, str(bad), strict=False).count() == 1
    with pytest.raises(Exception, match="no interval"):
        text.interval_rows(spark, str(bad)).collect()
    track = spark.createDataFrame([("c", 5, 9, 2.0), ("c", 0, 5, 1.5)], "chrom string, start long, end long, value double")
    text.write_bedgraph(track, f"{tmp_path}/g")
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/g").collect()) == ["c\t0\t5\t1.5", "c\t5\t9\t2"]
    text.write_wig(track, f"{tmp_path}/w")
    assert "variableStep chrom=c span=5" in {r["value"] for r in spark.read.text(f"{tmp_path}/w").collect()}


def blocked(data):
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def test_bam_source(spark, tmp_path):
    def read(name, flag, pos, length, mate, tlen, clip=0):
        ops = [length << 4] + ([clip << 4 | 4] if clip else [])
        body = struct.pack("<iiBBHHHiiii", 0, pos, len(name) + 1, 60, 0, len(ops), flag, 0, 0, mate, tlen) + name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops)
        return struct.pack("<i", len(body)) + body

    raw = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    raw += read("a", 99, 100, 50, 200, 150) + read("a", 147, 200, 50, 100, -150) + read("b", 99, 10, 20, 40, 50, 3) + read("b", 147, 40, 20, 10, -50)
    path = tmp_path / "x.bam"
    path.write_bytes(blocked(raw[:60]) + blocked(raw[60:]) + blocked(b""))
    spark.dataSource.register(alignments.BamSource)
    reads = spark.read.format("bam").load(str(path))
    assert reads.count() == 4
    assert [(r["s"], r["e"]) for r in alignments.pair_fragments(alignments.usable(reads)).collect()] == [(100, 250)]
    assert sorted((r["s"], r["e"]) for r in alignments.first_read_lengths(reads).collect()) == [(10, 60), (100, 250)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    plain = lambda v: None if v is None else round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    df = entry.queries()[name](spark, DATA)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall()), key=str)
    assert got == want


def test_bigwig_round_trip(spark, tmp_path):
    from strandwise.sources import bigwig

    rng = np.random.default_rng(1)
    rows = [(c, int(10 * i), int(10 * i + rng.integers(1, 10)), float(rng.integers(1, 50)) / 2) for c in ("chr1", "chr20", "x") for i in range(2500)]
    track = spark.createDataFrame(rows, "chrom string, start long, end long, value double")
    files = [r["path"] for r in bigwig.write_bigwig(track, {"chr1": 30000, "chr20": 30000, "x": 30000}, f"{tmp_path}/bw").collect()]
    spark.dataSource.register(bigwig.BigWigSource)
    back = spark.read.format("bigwig").option("paths", "\n".join(files)).load()
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    one = tmp_path / "all.bw"
    many = sorted(rows)
    one.write_bytes(bigwig.encoded(many, {"chr1": 30000, "chr20": 30000, "x": 30000}))
    with open(one, "rb") as f:
        contigs, blocks, packed = bigwig.contigs_and_blocks(f)
    assert contigs[1] == ("chr20", 30000) and packed and len(blocks) == 15
    assert list(bigwig.block_runs(struct.pack("<IIIIIBBH", 0, 5, 11, 3, 2, 3, 0, 2) + struct.pack("<ff", 1, 2))) == [(0, 5, 7, 1.0), (0, 8, 10, 2.0)]


def test_matching_of_even_chains(spark):
    q, t = list(range(0, 800, 20)), list(range(10, 810, 20))
    frame = lambda v: spark.createDataFrame([("c", x) for x in v], "chrom string, pos long")
    for most in (30, None):
        got = sorted((r["query"], r["target"], r["distance"]) for r in spacing.matched_one_to_one(frame(q), frame(t), most, rounds=2).collect())
        assert got == greedy(q, t, 30) and len(got) == 40
    rng = np.random.default_rng(4)
    for _ in range(50):
        q, t = (sorted({int(x) for x in rng.integers(0, 120, 40)}) for _ in range(2))
        sides = sorted([(x, 0) for x in q] + [(x, 1) for x in t])
        for most in (0, 3, 10**6):
            assert sorted(spacing.nearest_pairs([p for p, _ in sides], [s for _, s in sides], most)) == greedy(q, t, most)


def test_states_keep_every_order(spark):
    assert views.view(spark, DATA, "states").count() == spark.read.parquet(f"{DATA}/orders.parquet").count()
