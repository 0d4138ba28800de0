"""Queries on deep stacks of intervals: right rows, and no step that makes a row for each pair of what overlaps."""

from collections import Counter

import numpy as np
import pytest

from strandwise.plans import catalog

LABELS = "abcde"


def rows_made(df) -> tuple[list, int]:
    """The rows, and the most that any one join or explode of the plan has put out."""
    found, most = df.collect(), 0
    left = [df._jdf.queryExecution().executedPlan()]
    while left:
        plan = left.pop()
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            left.append(plan.executedPlan())
            continue
        if "QueryStage" in name:
            left.append(plan.plan())
            continue
        if "Join" in name or name == "Generate":
            most = max(most, plan.metrics().apply("numOutputRows").value())
        children = plan.children()
        left += [children.apply(i) for i in range(children.size())]
    return found, most


@pytest.fixture(scope="module")
def stack(spark):
    """600 states on top of one another, some over the ends of blocks, and 600 peaks, some at one place."""
    rng = np.random.default_rng(8)
    starts = np.concatenate([rng.integers(0, 600, 500), rng.integers(65_000, 65_800, 100)])
    states = [(int(o), f"chr{1 + k % 2}", int(s), int(s + n), LABELS[o % 5]) for k, (o, s, n) in enumerate(zip(rng.permutation(600), starts, rng.integers(1, 900, 600)))]
    places = np.concatenate([rng.integers(0, 1500, 450), rng.integers(65_000, 66_500, 148), [9_000_000, 9_000_100]])
    peaks = [(k, f"chr{1 + k % 2}", int(p), int(p) - 25, int(p) + 26, float(k % 90), "click" if k % 3 else "view") for k, p in enumerate(places)]
    return peaks, states, spark.createDataFrame(peaks, "event_id long, chrom string, pos long, s long, e long, score double, klass string"), spark.createDataFrame(states, "ord long, chrom string, s long, e long, label string")


def over(states, chrom, pos):
    return sorted((o, label) for o, c, s, e, label in states if c == chrom and s <= pos < e)


def test_distance_histogram(stack):
    peaks, states, p, s = stack
    got, most = rows_made(catalog.distance_histogram(p, s))
    want = Counter()
    for chrom in ("chr1", "chr2"):
        own = sorted(r[2] for r in peaks if r[1] == chrom)
        label = ["|".join(sorted({x for _, x in over(states, chrom, q)})) or "NA" for q in own]
        for i in range(len(own)):
            for q in range(1, 11):
                if i + q < len(own) and own[i + q] > own[i]:
                    d, same = own[i + q] - own[i], label[i] if label[i] == label[i + q] else None
                    want[q, d, None, None, 1] += 1
                    want[q, d, chrom, None, 1] += 1
                    if same is not None:
                        want[q, d, None, same, 0] += 1
                        want[q, d, chrom, same, 0] += 1
    assert Counter({(r["ord"], r["distance"], r["chrom"], r["state"], r["all_states"]): r["n"] for r in got}) == want
    assert most <= 10 * len(peaks)


def test_peak_state_labels(stack):
    peaks, states, p, s = stack
    got, most = rows_made(catalog.peak_state_labels(p, s))
    assert {r["event_id"]: r["state"] for r in got} == {k: "|".join(sorted({x for _, x in over(states, c, q)})) or "NA" for k, c, q, *_ in peaks}
    assert most <= len(LABELS) * len(peaks)


def gene_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(k, f"n{k}", f"chr{1 + k % 2}", int(s), int(s + n), "+-"[k % 2]) for k, (s, n) in enumerate(zip(rng.integers(0, 3000, 200), rng.integers(300, 900, 200)))]
    return rows, spark.createDataFrame(rows, "gene_id long, gene_name string, chrom string, s long, e long, strand string")


def met_sets(genes, states):
    rules = {"active": lambda x: {"a", "b"} <= x or "c" in x, "quiet": lambda x: "e" in x, "mixed": lambda x: bool({"a", "b"} & x) and "d" in x}
    for k, _, chrom, s, e, _ in genes:
        met = {label for _, c, a, b, label in states if c == chrom and a < e and s < b}
        yield k, {n for n, test in rules.items() if test(met)}


def renamed(states):
    """The states under the names that the rules know."""
    from pyspark.sql import functions as F

    names = F.create_map(*[F.lit(x) for pair in zip(LABELS, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) for x in pair])
    return states.withColumn("label", names[F.col("label")])


def test_gene_sets_with_exclusions(spark, stack):
    genes, g = gene_rows(spark)
    got, most = rows_made(catalog.gene_sets_with_exclusions(g, renamed(stack[3])))
    want = [(k, n) for k, sets in met_sets(genes, stack[1]) for n in sets if n == "quiet" or (n == "active" and "quiet" not in sets) or (n == "mixed" and sets == {"mixed"})]
    assert sorted((r["gene_id"], r["set_name"]) for r in got) == sorted(want) and most <= len(LABELS) * len(genes)


def firsts(peaks, states):
    return {k: next((label for _, label in over(states, c, q)), None) for k, c, q, *_ in peaks}


def test_peak_first_state(stack):
    peaks, states, p, s = stack
    got, most = rows_made(catalog.peak_first_state(p, s))
    assert {r["event_id"]: r["state"] for r in got} == firsts(peaks, states)
    assert most <= 2 * len(states) + 2 * len(peaks)  # two spans of each interval's part of a block


def test_state_enrichment(stack):
    peaks, states, p, s = stack
    got, most = rows_made(catalog.state_enrichment(p, s))
    n = Counter(x for x in firsts(peaks, states).values() if x)
    bases = {x: sum(len({b for _, c, a, e, label in states if c == chrom and label == x for b in range(a, e)}) for chrom in ("chr1", "chr2")) for x in LABELS}
    assert {r["label"]: (r["bases"], r["n"]) for r in got} == {x: (bases[x], n[x]) for x in LABELS}
    for r in got:
        assert r["enrichment"] == pytest.approx((n[r["label"]] / sum(n.values())) / (bases[r["label"]] / sum(bases.values())), abs=1e-6)
    assert most <= 2 * len(states) + 2 * len(peaks)


def test_states_in_score_bins(stack):
    peaks, states, p, s = stack
    got, most = rows_made(catalog.table_queries.states_in_score_bins(p, s))
    first = firsts(peaks, states)
    assert {(r["bin"], r["label"]): r["n"] for r in got} == Counter(((r[5] >= 20) + (r[5] >= 60), first[r[0]] or "unassigned") for r in peaks)
    assert most <= 2 * len(states) + 2 * len(peaks)


def test_peak_states(stack):
    peaks, states, p, s = stack
    got, most = rows_made(catalog.peak_states(p, s))
    first, cuts = firsts(peaks, states), {q: np.percentile([r[5] for r in peaks], q) for q in (0, 50, 90)}
    assert {(r["pct"], r["label"]): r["n"] for r in got} == Counter((q, first[r[0]] or "unassigned") for r in peaks for q, cut in cuts.items() if r[5] >= cut)
    assert most <= 2 * len(states) + 2 * len(peaks)


def test_gene_sets(spark, stack):
    genes, g = gene_rows(spark)
    got, most = rows_made(catalog.gene_sets(g, renamed(stack[3])))
    sets = dict(met_sets(genes, stack[1]))
    want = [(k, next(iter(s))) for k, s in sets.items() if len(s) == 1] + [(k, "rest") for k, s in sets.items() if not s]
    assert sorted((r["gene_id"], r["set_name"]) for r in got) == sorted(want) and most <= len(LABELS) * len(genes)


def spacings(genes, peaks):
    for k, _, chrom, s, e, strand in genes:
        left, right = (max(0, s - 10_000), s), (e, e + 10_000)
        for region, (a, b) in {"body": (s, e), "upstream": left if strand == "+" else right, "downstream": right if strand == "+" else left}.items():
            own = sorted({r[2] for r in peaks if r[1] == chrom and a <= r[2] < b})
            if own:
                yield (k, region), (len(own), float(np.median(np.diff(own))) if len(own) > 1 else None)


def test_gene_spacing(spark, stack):
    genes, g = gene_rows(spark)
    genes.append((900, "far", "chr1", 64_500, 66_000, "-"))  # over the end of a block
    g = g.unionByName(spark.createDataFrame(genes[-1:], g.schema))
    got, most = rows_made(catalog.gene_spacing(g, stack[2]))
    assert {(r["gene_id"], r["region"]): (r["peaks"], r["spacing"]) for r in got} == dict(spacings(genes, stack[0])) and len(got) == len(dict(spacings(genes, stack[0])))
    assert most <= 3 * len(genes) + 3 * len(stack[0])


def test_spacing_of_regions_that_share_keys(spark, stack):
    from strandwise.operators import annotate

    rows = [(1, "chr1", 0, 300), (1, "chr1", 200, 700), (2, "chr2", 0, 500), (3, "chr1", 500, 500)]
    got = {r["k"]: (r["peaks"], r["spacing"]) for r in annotate.adjacent_spacing(spark.createDataFrame(rows, "k long, chrom string, s long, e long"), stack[2], ["k"]).collect()}
    for k in (1, 2):
        own = sorted(p for _, c, a, b in (r for r in rows if r[0] == k) for p in {r[2] for r in stack[0] if r[1] == c and a <= r[2] < b})
        assert got[k] == (len(own), np.median(np.diff(own)))
    assert set(got) == {1, 2}


def test_range_medians():
    from strandwise.functions import numerics

    rng = np.random.default_rng(6)
    for values in (rng.integers(0, 40, 300), np.full(9, 7), rng.integers(0, 10**9, 64)):
        low = rng.integers(0, len(values) + 1, 200)
        high = np.minimum(low + rng.integers(0, 90, 200), len(values))
        want = [np.median(values[a:b]) if b > a else np.nan for a, b in zip(low, high)]
        assert np.array_equal(numerics.range_medians(values, low, high), want, equal_nan=True)


def test_spacing_expression(spark, stack):
    genes, g = gene_rows(spark)
    values = {(k, n): float((k * 7 + len(n)) % 23) for k, *_ in genes for n in ("A", "BB")}
    x = spark.createDataFrame([(*k, v) for k, v in values.items()], "gene_id long, profile string, value double")
    got, most = rows_made(catalog.spacing_expression(g, stack[2], x))
    known = {k: v for k, (_, v) in spacings(genes, stack[0]) if v is not None}
    want = {}
    for region in ("body", "upstream", "downstream"):
        for n in ("A", "BB"):
            own = [(v, np.log2(values[k, n] + 1)) for (k, r), v in known.items() if r == region]
            if len(own) >= 30:
                want[region, n] = (len(own), pytest.approx(np.corrcoef(*zip(*own))[0, 1], abs=2e-6))
    assert {(r["region"], r["profile"]): (r["genes"], r["r"]) for r in got} == want and want
    assert most <= 2 * 3 * len(genes) + 3 * len(stack[0])


def test_correlation_of_a_constant_side(spark):
    """All spacings are 1 where every place has a peak: no number, as in the SQL, and no division by zero."""
    from strandwise.functions import contigs

    rows = [("a", 1.0, 2.0), ("a", 1.0, 5.0), ("b", 1.0, 2.0), ("b", 2.0, 4.0), ("b", 3.0, 5.0), ("b", None, 9.0), ("c", None, 1.0)]
    got = {r["k"]: r["r"] for r in spark.createDataFrame(rows, "k string, x double, y double").groupBy("k").agg(contigs.correlation("x", "y").alias("r")).collect()}
    parted = spark.range(0, 49 * 6, 1, 6).selectExpr("1.0D as x", "double(id * 7919 % 101) as y")  # 49 times a 49th is not 1
    assert np.isnan(parted.agg(contigs.correlation("x", "y").alias("r")).first()[0])
    assert np.isnan(got["a"]) and got["b"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 5])[0, 1]) and got["c"] is None


@pytest.fixture(scope="module")
def dense(spark):
    """Fragments at nearly every place of 4,000, and some at the end of a block and of the contig."""
    rng = np.random.default_rng(9)
    starts = np.concatenate([rng.integers(0, 4000, 6000), rng.integers(64_000, 67_000, 600), rng.integers(199_000, 200_000, 100)])
    rows = [(1 + k % 2, f"chr{1 + k % 2}", int(s), int(s + n)) for k, (s, n) in enumerate(zip(starts, rng.integers(100, 200, len(starts))))]
    return rows, spark.createDataFrame(rows, "source_id long, chrom string, s long, e long")


def windows_of(genes):
    return genes + [(901, "x", "chr1", 64_700, 67_000, "+"), (902, "y", "chr2", 65_000, 67_500, "-"), (903, "z", "chr1", 199_000, 200_100, "+"), (904, "w", "chr2", 100, 900, "-")]


def test_gene_trajectories(spark, dense):
    from strandwise.plans import table_queries

    fragments, f = dense
    genes = windows_of(gene_rows(spark)[0])
    g = spark.createDataFrame(genes, "gene_id long, gene_name string, chrom string, s long, e long, strand string")
    b = spark.createDataFrame([(0, "chr1", 500, 900), (1, "chr1", 800, 1000), (2, "chr2", 65_900, 66_000)], "ord long, chrom string, s long, e long")
    got, most = rows_made(table_queries.gene_trajectories(g, f, b))
    track = {c: np.bincount([s for _, x, s, _ in fragments if x == c], minlength=203_000) for c in ("chr1", "chr2")}
    hidden = {c: np.zeros(203_000) for c in track}
    for c, s, e in (("chr1", 500, 1000), ("chr2", 65_900, 66_000)):
        hidden[c][s:e] = 1
    want = {}
    for k, _, c, s, e, strand in genes:
        a = s if strand == "+" else e - 2000
        if a >= 0 and a + 2000 <= 200_200:
            v = track[c][a:a + 2000][::1 if strand == "+" else -1]
            want[k] = (int(v.sum()), int(v @ np.arange(2000)), pytest.approx(1 - hidden[c][a:a + 2000].sum() / 2000))
    assert {r["gene_id"]: (r["total"], r["moment"], r["valid"]) for r in got} == want
    assert most <= 2 * len(fragments)


def test_gene_signal_of_many_groups(spark, dense, monkeypatch):
    from strandwise.operators import annotate, windows

    fragments, f = dense
    genes, g = gene_rows(spark)
    monkeypatch.setattr(windows, "GROUP_VALUES", 5000)
    monkeypatch.setattr(windows, "MATRIX_VALUES", 1500)
    got = {r["gene_id"]: r["signal"] for r in annotate.gene_signal(g, catalog._start_track(f), {"chr1": 200_200, "chr2": 200_200}, 700).collect()}
    track = {c: np.bincount([s for _, x, s, _ in fragments if x == c], minlength=203_000) for c in ("chr1", "chr2")}
    inside = [r for r in genes if r[5] == "+" or r[4] >= 700]
    assert set(got) == {r[0] for r in inside}
    for k, _, c, s, e, strand in inside:
        assert got[k] == (track[c][s:s + 700] if strand == "+" else track[c][e - 700:e][::-1]).tolist()


def test_distances_inside_states(stack):
    from strandwise.plans import table_queries

    peaks, states, p, s = stack
    got, most = rows_made(table_queries.distances_inside_states(p, s.unionByName(s.limit(3))))
    want = Counter()
    for _, chrom, a, b, label in states:
        own = sorted({r[2] for r in peaks if r[1] == chrom and a <= r[2] < b})
        want.update((label, y - x) for x, y in zip(own, own[1:]) if y - x <= 400)
    assert {(r["label"], r["distance"]): r["n"] for r in got} == want
    assert most <= 2 * len(states) + 2 * len(peaks)


def test_repeat_length_of_dense_peaks(spark):
    """No distance of ten neighbours reaches the least one that is looked at: no peak, and no error; a contig with far ones keeps its own."""
    near = [(k, "chr1", k * 3, float(k), "view") for k in range(300)]
    far = [(1000 + k, "chr2", k * 185, float(k), "view") for k in range(300)]
    made = lambda rows: spark.createDataFrame(rows, "event_id long, chrom string, pos long, score double, klass string")
    assert catalog.repeat_length(made(near)).collect() == []
    both, alone = (catalog.repeat_length(made(rows)).orderBy("number").collect() for rows in (near + far, far))
    assert both == alone


def test_periodicity_expression(spark, dense):
    from strandwise.functions import numerics

    fragments, f = dense
    genes = windows_of(gene_rows(spark)[0]) + [(905, "none", "chr1", 120_000, 121_000, "+")]
    g = spark.createDataFrame(genes, "gene_id long, gene_name string, chrom string, s long, e long, strand string")
    value = {k: float(k * 13 % 29) for k, *_ in genes}
    x = spark.createDataFrame([(k, "A", v) for k, v in value.items()], "gene_id long, profile string, value double")
    got, most = rows_made(catalog.periodicity_expression(g, f, x))
    periods = np.arange(120, 281)
    track = {c: np.bincount([s + 500 for _, y, s, _ in fragments if y == c], minlength=203_000) for c in ("chr1", "chr2")}
    power, v = [], []
    for k, _, c, s, e, strand in genes:
        at = s if strand == "+" else e - 1
        own = track[c][at:at + 1001][::1 if strand == "+" else -1].astype(float)
        if own.any():
            power.append(numerics.periodogram(numerics.recursive_filter(own), periods))
            v.append(value[k])
    from strandwise.functions import contigs

    shown = [r[0] for r in spark.createDataFrame([(i, a) for i, a in enumerate(v)], "i int, value double").orderBy("i").select(contigs.expression_value("value", "log2-floor")).collect()]
    want = {int(p): (len(v), pytest.approx(np.corrcoef(column, shown)[0, 1], abs=2e-6)) for p, column in zip(periods, np.array(power).T)}
    assert {r["period"]: (r["genes"], r["r"]) for r in got} == want
    assert most <= max(2 * len(fragments), len(periods) * len(genes))


def test_spectra_of_rows():
    from strandwise.functions import numerics

    rng = np.random.default_rng(3)
    rows, periods = rng.poisson(1.0, (5, 1001)).astype(float), np.arange(120, 281)
    together = numerics.periodogram(numerics.recursive_filter(rows), periods)
    for row, power in zip(rows, together):
        assert np.allclose(numerics.periodogram(numerics.recursive_filter(row), periods), power, rtol=1e-9)


def test_fetched_fragments(spark, dense):
    from strandwise.plans import signal_queries

    fragments, f = dense
    genes = windows_of(gene_rows(spark)[0]) + [(905, "none", "chr1", 120_000, 121_000, "+"), (906, "edge", "chr2", 4400, 4500, "+"), (3, "again", "chr2", 10, 400, "-")]
    got, most = rows_made(signal_queries.fetched_fragments(spark.createDataFrame(genes, "gene_id long, gene_name string, chrom string, s long, e long, strand string"), f))
    want, once = {}, {r[1:] for r in fragments}
    for k, _, c, s, e, _ in genes:
        met = [(a, b) for x, a, b in once if x == c and a < e and b > s]
        if met:
            first, n, bases = want.get(k, (10**9, 0, 0))
            want[k] = (min(first, min(met)[0]), n + len(met), bases + sum(b - a for a, b in met))
    assert {r["gene_id"]: (r["first"], r["n"], r["bases"]) for r in got} == want
    assert most <= 2 * len(fragments)


def test_fragment_lengths_by_state(dense, stack):
    fragments, f = dense
    got, most = rows_made(catalog.fragment_lengths_by_state(f, stack[3]))
    want = Counter()
    for _, c, s, e in fragments:
        for label in {x for _, x in over(stack[1], c, (s + e) // 2)} or {"unassigned"}:
            want[label, e - s] += 1
    assert {(r["label"], r["length"]): r["n"] for r in got} == want
    assert most <= len(LABELS) * len(fragments)


def tied(spark, n=400):
    """Peaks of which several share a place, rows in another order than their events."""
    rng = np.random.default_rng(12)
    rows = [(int(k), "chr1", int(k) % 37 * 3, float(k * 7919 % 101), "abc"[k % 3]) for k in rng.permutation(n)]
    return rows, spark.createDataFrame(rows, "event_id long, chrom string, pos long, score double, klass string").repartition(5)


def neighbours(rows):
    own = sorted(rows, key=lambda r: (r[2], r[0]))
    return [(a[4], a[3], b[2] - a[2], b[3]) for a, b in zip(own, own[1:])]


def test_pair_percentiles_of_ties(spark):
    """The SQL leaves the order of peaks at one place open; here it is that of their events."""
    rows, p = tied(spark)
    got = {r["klass"]: (r["n"], r["least"], r["median"], r["mean"], r["largest"]) for r in catalog.pair_percentiles(p).collect()}
    for k in "abc":
        d = [x[2] for x in neighbours(rows) if x[0] == k]
        assert got[k] == (len(d), min(d), np.median(d), pytest.approx(np.mean(d), abs=1e-6), max(d))


def test_pair_score_correlation_of_ties(spark):
    rows, p = tied(spark)
    pairs = [x for x in neighbours(rows) if x[2] <= 5]
    got = {r["bin"]: (r["n"], r["r"]) for r in catalog.pair_score_correlation(p).collect()}
    assert got[0] == (len(pairs), pytest.approx(np.corrcoef([x[1] for x in pairs], [x[3] for x in pairs])[0, 1], abs=1e-6))


def test_pair_statistics_of_ties(spark):
    from strandwise.plans import table_queries

    rows, p = tied(spark)
    got = {r["klass"]: (r["n"], r["r"], r["slope"]) for r in table_queries.pair_statistics(p).collect()}
    for k in "abc":
        x, y = zip(*[(a[1], a[3]) for a in neighbours(rows) if a[0] == k])
        assert got[k] == (len(x), pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-8), pytest.approx(np.polyfit(x, y, 1)[0], abs=1e-8))
