"""Operators of whole commands against brute force on small inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.functions import contigs, numerics
from strandwise.operators import annotate, calls, combine, compare, correlate, intervals, regions, select, sequence, signals, spacing

RNG = np.random.default_rng(4)
SPANS = [(int(s), int(s + n)) for s, n in zip(RNG.integers(300, 2600, 60), RNG.integers(110, 210, 60))]


def fragments(spark, rows, chrom="c"):
    return spark.createDataFrame([(1, chrom, s, e) for s, e in rows], "source_id int, chrom string, s long, e long")


def test_running_aggregates_over_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(k, int(p), int(i), None if rng.random() < 0.4 else int(rng.integers(0, 50))) for k in "ab" for i, p in enumerate(np.sort(rng.integers(0, 300, 60)))]
    df = spark.createDataFrame(rows, "k string, p long, i int, v int")
    kinds = {"total": ("sum", F.col("v")), "top": ("max", F.col("v")), "at": ("last", F.col("v"))}
    for inclusive in (True, False):
        for descending in (True, False):
            got = {(r["k"], r["i"]): (r["total"], r["top"], r["at"]) for r in intervals.running(df, ["k"], ["p", "i"], kinds, inclusive, descending, block=16).collect()}
            for k in "ab":
                own = [r for r in rows if r[0] == k]
                own = own[::-1] if descending else own
                for n, r in enumerate(own):
                    seen = [x[3] for x in own[: n + inclusive] if x[3] is not None]
                    assert got[k, r[2]] == ((sum(seen), max(seen), seen[-1]) if seen else (None, None, None))


def test_as_of_joins(spark):
    rng = np.random.default_rng(2)
    centres, anchors = sorted(set(rng.integers(0, 5_000_000, 80).tolist())), rng.integers(0, 5_000_000, 50).tolist() + [7]
    anchors += centres[:5]
    c = spark.createDataFrame([("c", p) for p in centres], "chrom string, pos long")
    a = spark.createDataFrame([(i, "c", p) for i, p in enumerate(anchors)] + [(99, "d", 5)], "i int, chrom string, pos long")
    for strict in (True, False):
        low = {r["i"]: r["before"] for r in intervals.last_before(c, a, strict=strict).collect()}
        high = {r["i"]: r["after"] for r in intervals.first_after(c, a, strict=strict).collect()}
        for i, p in enumerate(anchors):
            assert low[i] == max((x for x in centres if x < p or (not strict and x == p)), default=None)
            assert high[i] == min((x for x in centres if x > p or (not strict and x == p)), default=None)
        assert low[99] is None and high[99] is None


def test_matching_of_a_long_chain(spark):
    places = np.cumsum(np.arange(1100, 100, -1)).tolist()  # each gap is smaller than the one before
    query, target = places[::2], places[1::2]
    q, t = (spark.createDataFrame([("c", p) for p in x], "chrom string, pos long") for x in (query, target))
    got = sorted((r["query"], r["target"]) for r in spacing.matched_one_to_one(q, t, rounds=3).collect())
    side = [i % 2 for i in range(len(places))]
    assert got == sorted((a, b) for a, b, _ in spacing.nearest_pairs(places, side)) and len(got) == 500


def centred(spans, m=167, size=3200):
    out = np.zeros(size)
    for s, e in spans:
        n = e - s if e - s >= m else 2 * m - (e - s)
        j = np.arange(m)
        triangle = np.minimum(j, m - 1 - j) / (2 * ((m - 1) // 2) * (m // 2))
        out[s:s + m] += triangle
        out[e - m:e] += triangle
        low = min(s, e - m)
        out[low:low + n] -= 1 / n
    return out


def test_regions_against_bases(spark):
    value = centred(SPANS)
    lines = regions.centred_lines(fragments(spark, SPANS))
    unit = signals.UNIT * regions.weight()
    got = np.zeros(len(value))
    for r in lines.collect():
        got[r["start"]:r["end"]] = (r["value"] + r["slope"] * np.arange(r["end"] - r["start"])) / unit
    assert np.allclose(got, value, atol=1e-8)
    for bridge, sign in ((0, 1), (4, 1), (2, -1)):
        signed, found, at = sign * np.round(got, 12), [], 0
        over = np.flatnonzero(signed > 0)
        for part in np.split(over, np.flatnonzero(np.diff(over) > bridge + 1) + 1):
            if len(part) and part[-1] + 1 - part[0] >= 50:
                found.append((int(part[0]), int(part[-1]) + 1))
        called = regions.positive_regions(lines if sign > 0 else regions.turned(lines), 50, bridge)
        rows = sorted((r["start"], r["end"], r["score"] / unit, r["place"], r["centre"]) for r in called.collect())
        assert [(a, b) for a, b, *_ in rows] == found and found
        for a, b, score, place, centre in rows:
            assert np.isclose(score, signed[a:b].max()) and np.isclose(signed[place], score) and centre == (a + b) // 2
        use = lines if sign > 0 else regions.turned(lines)
        minima = sorted((r["pos"], r["value"] / unit) for r in regions.minima_between(called, use).collect())
        want = [a + int(np.argmin(signed[a:b])) for (_, a), (b, _) in zip(found, found[1:])]
        assert [p for p, _ in minima] == want and np.allclose([v for _, v in minima], signed[want])
        both = {r["start"]: r for r in regions.flanked(called, regions.minima_between(called, use)).collect()}
        for a, b in found:
            c = (a + b) // 2
            assert both[a]["up_pos"] == max((p for p in want if p < c), default=c) and both[a]["down_pos"] == min((p for p in want if p > c), default=c)
    cover = np.zeros(len(value), int)
    for s, e in SPANS:
        cover[s:e] += 1
    for r in regions.with_largest_cover(called, signals.coverage(fragments(spark, SPANS))).collect():
        own = cover[r["start"]:r["end"]]
        assert (r["max_coverage"], r["max_position"]) == (own.max(), r["start"] + int(own.argmax()))
    kept = regions.covered(called, signals.coverage(fragments(spark, SPANS)), 4, "centre")
    assert {r["start"] for r in kept.collect()} == {r["start"] for r in called.collect() if cover[r["centre"]] >= 4}


def test_wps_command(spark):
    spans = [(s + d, s + d + 160) for s in range(400, 5400, 200) for d in range(6)]
    sizes = spark.createDataFrame([("c", 6000), ("short", 500)], "chrom string, length long")
    found = sorted((r["start"], r["centre"], r["score"]) for r in calls.wps_peaks(fragments(spark, spans), sizes, cutoff=1.0).collect())
    assert len(found) > 10 and all(abs((c - 480) % 200 - (200 if (c - 480) % 200 > 100 else 0)) <= 8 for _, c, _ in found)


def test_selectors():
    sizes = {"chr1": 100, "chr2": 50, "chrX": 70, "M": 16}
    assert select.regions(["1-2,chrX:5-10", "x:8-20".replace("x", "X"), "MT"], sizes) == [("chr1", 0, 100), ("chr2", 0, 50), ("chrX", 5, 20), ("M", 0, 16)]
    assert select.regions(["autosomes"], sizes) == [("chr1", 0, 100), ("chr2", 0, 50)] and len(select.regions(["all"], sizes)) == 4
    for bad in ("chr9", "chr1:50-40", "chr2:0-60"):
        with pytest.raises(ValueError):
            select.regions([bad], sizes)


def test_lag_sums_and_density_paths(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 3, 900).astype(float), rng.integers(0, 3, 900).astype(float)
    want = np.array([sum(x[i] * y[i + d] for i in range(900) if 0 <= i + d < 900) for d in range(-300, 301)])
    assert np.allclose(correlate.lag_sums(x, y, -300, 300), want) and np.allclose(correlate.lag_sums(x, y, -100, 100), want[200:401])
    rows = lambda v: spark.createDataFrame([("c", 0, i, float(n)) for i, n in enumerate(v) if n], "chrom string, window long, pos long, value double")
    for share in (0.0, 2.0):
        got = {r["lag"]: r["raw"] for r in correlate.cross_correlation_by_density(rows(x), rows(y), 900, 20, share).collect()}
        assert np.allclose([got[d] for d in range(-20, 21)], want[280:321])
        auto = {r["distance"]: r["raw"] for r in correlate.auto_correlation_by_density(rows(x), 900, 20, share).collect()}
        assert np.allclose([auto[d] for d in range(1, 21)], [x[:-d] @ x[d:] for d in range(1, 21)])


def test_masked_opportunities_in_windows(spark):
    rows = [("c", w, int(s), int(s + n)) for w in (0, 1) for s, n in zip(range(0, 400, 40), RNG.integers(1, 39, 10))]
    df = spark.createDataFrame(rows, "chrom string, window int, s long, e long")
    got = {r["distance"]: r["opportunities"] for r in correlate.masked_opportunities(df, 60).collect() if r["opportunities"]}
    want = {}
    for w in (0, 1):
        bases = {p for _, v, s, e in rows if v == w for p in range(s, e)}
        for d in range(1, 61):
            want[d] = want.get(d, 0) + sum(p + d in bases for p in bases)
    assert got == {d: n for d, n in want.items() if n}


def test_resolution_peaks_of_gaussians():
    x = np.arange(200, 1201)
    y = sum(np.exp(-0.5 * ((x - c) / 25) ** 2) for c in (370, 555, 740, 925, 1110)) + 0.02 * np.sin(2 * np.pi * x / 10)
    peaks = numerics.resolution_peaks(x, y, 160)
    assert len(peaks) == 5 and np.abs(peaks - [370, 555, 740, 925, 1110]).max() <= 3
    slope = np.where(x < 500, 0.01 * x, 5 - 0.001 * (x - 500)) + 0.2 * np.exp(-0.5 * ((x - 460) / 4) ** 2)
    tops = numerics.plateau_maxima(numerics.moving_average_by_distance(x, slope, numerics.smoothing_windows(160)[1]))
    assert set(numerics.resolution_peaks(x, slope, 160)) <= set(x[tops].astype(float))  # a slope's edge never wins


def test_directional_repeats(spark):
    x = np.arange(-1200, 1201)
    y = sum(np.exp(-0.5 * ((x - c) / 25) ** 2) for c in (-950, -760, -570, -380, -190, 0, 185, 370, 555, 740, 925))
    both = numerics.directional_repeat_length(x, y)
    assert abs(both["positive"]["slope"] - 185) < 1 and abs(both["negative"]["slope"] - 190) < 1
    assert both["positive"]["n"] == 6 and both["negative"]["n"] == 6 and both["positive"]["quality"] == "pass"
    without = numerics.directional_repeat_length(x, y, exclusion=(-80.0, 80.0), low=100, high=800)
    assert without["positive"]["n"] == 4 and without["negative"]["n"] == 4 and abs(without["positive"]["intercept"]) < 3
    df = spark.createDataFrame([("k", int(a), float(b)) for a, b in zip(x, y)], "k string, offset long, mean double")
    rows = {r["side"]: r for r in calls.directional_repeats(df, ["k"]).collect()}
    assert rows["negative"]["quality"] == "pass" and rows["positive"]["peaks"] == 6


def test_numerics_by_hand():
    x = RNG.random(500)
    y = []
    first = np.concatenate([x[:300], x])
    for t in range(len(first)):
        y.append(first[t] + sum(y[t - k] / (5 + 4 * (k - 1)) for k in range(1, 25) if t >= k))
    assert np.allclose(numerics.recursive_filter(x), y[300:])
    found = numerics.fixed_distribution(np.array([105, 150, 150, 900]), np.array([1, 5, 5, 9]), 100, 200)
    assert found["percent"].sum() == pytest.approx(100) and found["smooth"].sum() == pytest.approx(100) and found["mode"] == 150 and (found["smooth"][:10] == 0).all()
    assert math.isnan(numerics.fixed_distribution(np.array([5]), np.array([1]), 100, 200)["mode"])
    lengths = np.arange(100, 801)
    counts = sum(1000 * np.exp(-0.5 * ((lengths - c) / 20) ** 2) for c in (167, 352, 537, 722))
    peaks, fit = numerics.fragment_size_peaks(lengths, counts)
    assert abs(fit["slope"] - 185) < 3 and fit["quality"] == "pass" and len(peaks) == 4
    assert numerics.fragment_size_peaks(np.array([101]), np.array([3]))[1]["quality"] == "insufficient_peaks"


def test_rank_bins_and_targets(spark):
    assert [b[2:] for b in spacing.boundary_ranks(20, [0, 10, 30, 100])] == [(0, 2), (2, 6), (6, 20)]
    with pytest.raises(ValueError):
        spacing.boundary_ranks(3, [0, 1, 100])
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(50)], "i int, v double")
    got = {r["i"]: (r["lower"], r["upper"]) for r in spacing.bins_from_boundaries(df, [10, 50, 100], F.col("v"), F.col("i")).collect()}
    order = sorted(range(50), key=lambda i: (i % 7, i))
    assert got == {i: (10.0, 50.0) if 5 <= k < 25 else (50.0, 100.0) for k, i in enumerate(order) if k >= 5}


def test_group_tests_equal_numpy(spark):
    rng = np.random.default_rng(6)
    rows = [(p, g, float(v)) for p in "xy" for g, shift in (("a", 0), ("b", 1), ("c", 3)) for v in rng.integers(0, 9, 25) + shift]
    got = {(r["part"], r["a"], r["b"]): r for r in compare.tested_groups(spark.createDataFrame(rows, "part string, g string, v double"), "part", "g", "v").collect()}
    for p in "xy":
        own = {g: np.array([v for q, h, v in rows if (q, h) == (p, g)]) for g in "abc"}
        pairs = [("a", "b"), ("a", "c"), ("b", "c")]
        plain = [numerics.mann_whitney(own[a], own[b]) for a, b in pairs]
        for (a, b), (u, prob), adjusted in zip(pairs, plain, numerics.holm(np.array([q for _, q in plain]))):
            r = got[p, a, b]
            wins = sum((x > y) + 0.5 * (x == y) for x in own[a] for y in own[b])
            assert r["statistic"] == u == wins and r["p"] == pytest.approx(prob) and r["adjusted"] == pytest.approx(adjusted)
            assert r["stars"] == ("****" if adjusted < 1e-4 else "***" if adjusted < 1e-3 else "**" if adjusted < 0.01 else "*" if adjusted < 0.05 else "ns")
    stars = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (0.2,)], "p double").select(contigs.significance(F.col("p")).alias("s")).collect()
    assert [r["s"] for r in stars] == ["NA", "NA", "NA", "ns"]


def test_pair_statistics(spark):
    x = RNG.random(40)
    y = x + RNG.random(40)
    r = compare.pair_statistics(spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(x, y)], "k string, x double, y double"), "k", "x", "y", ranks=True).first()
    rank = lambda v: np.argsort(np.argsort(v))
    assert r["r"] == pytest.approx(np.corrcoef(x, y)[0, 1]) and r["rho"] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])
    assert r["r_p"] == pytest.approx(numerics.correlation_p(r["r"], 40)) and 0 < r["rho_p"] < 0.05


def test_match_accounts(spark):
    query = spark.createDataFrame([("c", 10), ("c", 500), ("c", 12), ("d", 1)], "chrom string, pos long")
    target = spark.createDataFrame([("c", 11), ("c", 30)], "chrom string, pos long")
    pairs = spacing.matched_one_to_one(query, target, 5)
    got = {(r["chrom"], r["pos"]): r["status"] for r in compare.match_accounts(query, target, pairs, 25).collect()}
    assert got == {("c", 10): "matched", ("c", 12): "unique_assignment", ("c", 500): "beyond_distance", ("d", 1): "no_contig"}


def test_matched_randomization(spark):
    rng = np.random.default_rng(8)
    text = "".join(rng.choice(list("ACGT"), 2000))
    text = text[:700] + "N" * 50 + text[750:]
    chunks = spark.createDataFrame([("c", a, text[a:a + 250].lower()) for a in range(0, 2000, 250)], "chrom string, start long, seq string")
    spans = [(int(s), int(s + n)) for s, n in zip(rng.integers(0, 1700, 60), rng.integers(40, 120, 60))]
    black = spark.createDataFrame([("c", 300, 360), ("c", 990, 1010)], "chrom string, s long, e long")
    run = lambda: sorted(map(tuple, sequence.matched_randomized(fragments(spark, spans), chunks, black, 1000, most=1).collect()))
    rows = run()
    assert rows == run() and len(rows) == 60
    used = set()
    for _, _, s, e, new, outcome, anchor in rows:
        if new is None:
            assert outcome == "skipped"
            continue
        n = e - s
        assert new != s and new // 1000 == s // 1000 == (new + n - 1) // 1000 and set(text[new:new + n]) <= set("ACGT")
        assert not any(new < b and a < new + n for a, b in ((300, 360), (990, 1010))) and (new, n) not in used
        used.add((new, n))
        if anchor:
            k = 0 if anchor == "start" else n - 2
            assert text[new + k:new + k + 2] == text[s + k:s + k + 2] and outcome in ("matched", "fallback")
    report = {r["metric"]: r["value"] for r in sequence.randomization_report(sequence.matched_randomized(fragments(spark, spans), chunks, black, 1000, most=1)).collect()}
    assert report["unique_coordinates"] == len(used) and report["duplicates"] == 0 and report["collision_fraction"] == 0
    assert sequence.expected_positions(4, 5) == [-2, -1, 0, 1]


def test_combined_parts(spark):
    parts = spark.createDataFrame([("a", 1, 10.0, 2), ("a", 2, 20.0, 4), ("b", 1, 5.0, 3), ("b", 2, 30.0, 6)], "part string, distance int, raw double, opportunities long")
    total = spark.createDataFrame([(30.0,)], "total double")
    got = {r["distance"]: (r["raw"], r["opportunities"], r["value"], r["percent"], r["per_million"]) for r in combine.correlations(parts, ["distance"], total).collect()}
    assert got[1] == pytest.approx((15, 5, 3, 37.5, 15 / 900 * 1e6)) and got[2] == pytest.approx((50, 10, 5, 62.5, 50 / 900 * 1e6))
    table = spark.createDataFrame([("n", "3"), ("n", "4.5"), ("mode", "x"), ("mode", "y"), ("kind", "z"), ("kind", "z")], "metric string, value string")
    assert {r["metric"]: r["value"] for r in combine.metrics(table, {"n"}).collect()} == {"n": "7.5", "mode": "mixed", "kind": "z"}
    heads = spark.createDataFrame([("f1", 0, "20", 50), ("f1", 1, "M", 16), ("f2", 0, "chr20", 50), ("f2", 1, "chr3", 9)], "source string, ord int, chrom string, length long")
    assert {(r["chrom"], r["length"]) for r in combine.headers(heads).collect()} == {("chr20", 50), ("M", 16), ("chr3", 9)}
    with pytest.raises(Exception, match="two lengths"):
        combine.headers(heads.unionByName(spark.createDataFrame([("f3", 0, "20", 51)], heads.schema))).collect()


def test_sets_rows_and_names(spark):
    members = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "gene_id int, set_name string")
    assert {r["sets"]: r["n"] for r in annotate.venn(members).collect()} == {"x&y": 1, "x": 1}
    with pytest.raises(Exception, match="in two sets"):
        annotate.exclusive(members).collect()
    with pytest.raises(Exception, match="comes twice"):
        annotate.checked_genes(members).collect()
    names = ["chr10", "chr2", "chrX", "chr1", "a10b2", "a10b10", "a9b1"]
    got = [r["n"] for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(spacing.natural_key(F.col("n"))).collect()]
    assert got == ["a9b1", "a10b2", "a10b10", "chr1", "chr2", "chr10", "chrX"]
    rows = {"a": [0.0, -3.0, -1.0, 2.0, 5.0], "b": [-1.0, 4.0, 3.0, 0.0, 0.0], "c": [1.0, 1.0, 1.0, 1.0, 9.0], "d": [-2.0, -1.0, -1.0, -1.0, -1.0]}
    df = spark.createDataFrame(list(rows.items()), "k string, signal array<double>")
    order = lambda mode: [r["k"] for r in annotate.sorted_rows(df, mode, F.col("k")).orderBy("rank").collect()]
    assert order("center") == ["b", "c", "a", "d"] and order("max") == ["c", "a", "b", "d"] and order("unsorted") == list("abcd")
    assert order("rise_after_min") == ["b", "a", "c", "d"] and order("mean_absolute") == ["c", "a", "b", "d"]
    meta = spark.createDataFrame([("T cell", "blood")], "profile string, category string")
    got = annotate.with_metadata(spark.createDataFrame([("t_CELL",), ("none",)], "profile string"), meta).collect()
    assert {(r["profile"], r["category"]) for r in got} == {("t_CELL", "blood"), ("none", "")}
    colours = spark.createDataFrame([(2, "s", "1,1,1"), (1, "s", "2,2,2"), (3, "t", "0,0,0")], "ord int, label string, rgb string")
    assert {(r["label"], r["rgb"], r["conflicts"]) for r in annotate.state_colours(colours).collect()} == {("s", "2,2,2", 1), ("t", "0,0,0", 0)}


def test_downsampling_and_strands(spark):
    counts = spark.createDataFrame([("a", n, 50) for n in range(10)] + [("b", n, 7) for n in range(10)], "profile string, length int, n long")
    got = {}
    for r in calls.downsampled(counts, "profile", "length", "n").collect():
        got[r["profile"]] = got.get(r["profile"], 0) + r["n"]
    assert got == {"a": 70, "b": 70}
    sites = spark.createDataFrame([(i, "+" if i % 3 else None) for i in range(90)], "i int, strand string")
    assert select.with_strand(sites, "skip", 1, ["i"]).count() == 60 and select.on_strand(select.with_strand(sites, "forward", 1, ["i"]), "plus").count() == 90
    drawn = {r["strand"] for r in select.with_strand(sites, "random", 1, ["i"]).where("i % 3 = 0").collect()}
    assert drawn == {"+", "-"} and 15 < select.sampled(sites, 0.3, 2, ["i"]).count() < 40
