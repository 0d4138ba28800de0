"""Registry of the engine's queries, and the SQL that states each result independently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import contigs
from ..operators import annotate, calls, compare, correlate, intervals, sequence, signals, spacing
from .views import FRAGMENT_CONTIG, PEAK_CONTIG, VIEWS, view, with_views

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Registers a query of (views of the tables) and its SQL, which may name the same views."""
    def add(f):
        name = f.__name__
        _QUERIES[name] = lambda spark, sf_dir: f(*(view(spark, sf_dir, v) for v in views))
        if sql:
            _SQL[name] = with_views(*views) + "\n" + sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_SQL)


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


_EVENTS = ", ev as ({events}), net as (select chrom, pos, sum(d) as d from ev group by 1, 2 having sum(d) <> 0), {name} as (select chrom, pos as \"start\", lead(pos) over (partition by chrom order by pos) as \"end\", cast(sum(d) over (partition by chrom order by pos) as bigint) as value from net)\n"
_COVERAGE = _EVENTS.format(events="select chrom, s as pos, 1 as d from fragments union all select chrom, e, -1 from fragments", name="track")


# -- fragments -------------------------------------------------------------------------------------------------------
@query("select source_id, chrom, s, e from (select *, row_number() over (partition by chrom, s, e order by source_id) as n from fragments) where n <= 1", "fragments")
def dedup_fragments(fragments):
    return spacing.limited_copies(fragments, 1)


@query("select source_id, chrom, s, e from (select *, row_number() over (partition by source_id, chrom, s, e order by e) as n from fragments) where n <= 2", "fragments")
def dedup_fragments_per_source(fragments):
    return spacing.limited_copies(fragments, 2, ("source_id", "chrom", "s", "e"))


@query("select e - s as length, count(*) as n from fragments group by 1", "fragments")
def fragment_lengths(fragments):
    return fragments.groupBy((F.col("e") - F.col("s")).alias("length")).agg(F.count(F.lit(1)).alias("n"))


@query(", m as (select f.source_id, f.chrom, f.s, f.e, s.label from fragments f left join states s on f.chrom = s.chrom and (f.s + f.e) // 2 >= s.s and (f.s + f.e) // 2 < s.e), d as (select distinct * from m) select coalesce(label, 'unassigned') as label, e - s as length, count(*) as n from (select f.source_id, f.chrom, f.s, f.e, d.label from fragments f join d on f.source_id = d.source_id and f.chrom = d.chrom and f.s = d.s and f.e = d.e) group by 1, 2", "fragments", "states")
def fragment_lengths_by_state(fragments, states):
    """Fragments of one middle and length are counted before they meet the merged intervals of each state, each of which they meet once."""
    placed = fragments.groupBy("chrom", contigs.midpoint(F.col("s"), F.col("e")).alias("pos"), (F.col("e") - F.col("s")).alias("length")).agg(F.count(F.lit(1)).alias("copies"))
    own = intervals.merged(states.select("chrom", "label", "s", "e"), ["chrom", "label"])
    found = intervals.point_join(placed, own, "left")
    return found.groupBy(F.coalesce("r_label", F.lit("unassigned")).alias("label"), "length").agg(F.sum("copies").alias("n"))


@query(_COVERAGE + "select chrom, \"start\", \"end\", value from track where value <> 0", "fragments")
def coverage(fragments):
    return signals.coverage(fragments)


@query(_COVERAGE.replace("from fragments", "from fragments where e - s between 137 and 197") + """, up as (select *, case when "start" = lag("end") over (partition by chrom order by "start") then 0 else 1 end as fresh from track where value > 3),
isl as (select *, sum(fresh) over (partition by chrom order by "start") as island from up),
runs as (select chrom, island, min("start") as s, max("end") as e, max(value) as top, sum(value * ("end" - "start")) as area from isl group by 1, 2)
select chrom, e - s as length, count(*) as n, max(top) as top, cast(sum(area) as bigint) as area from runs group by 1, 2""", "fragments")
def positive_runs(fragments):
    track = signals.coverage(fragments.where((F.col("e") - F.col("s")).between(137, 197)))
    return signals.runs_above(track, 3).groupBy("chrom", "length").agg(F.count(F.lit(1)).alias("n"), F.max("top").alias("top"), F.sum("area").alias("area"))


@query(_COVERAGE + """select chrom, cast(sum("end" - "start") as bigint) as bases, cast(sum(value * ("end" - "start")) as bigint) as total from track where value > 0 group by 1""", "fragments")
def unique_bases(fragments):
    width = F.col("end") - F.col("start")
    return signals.coverage(fragments).where("value > 0").groupBy("chrom").agg(F.sum(width).alias("bases"), F.sum(F.col("value") * width).alias("total"))


@query(_COVERAGE + """, m as (select cast(sum(value * ("end" - "start")) as double) / sum("end" - "start") as mean from track where value <> 0) select chrom, "start", "end", round(value * 100.0 / mean, 6) as value from track, m where value <> 0""", "fragments")
def mean_scale(fragments):
    track = signals.coverage(fragments)
    return signals.scaled(track, signals.nonzero_mean(track).first()["mean"]).withColumn("value", _r("value"))


_DYAD = "select chrom, s + (e - s) // 2 as pos, case when (e - s) % 2 = 0 then 0.5 else 1.0 end as w from fragments union all select chrom, s + (e - s) // 2 - 1, 0.5 from fragments where (e - s) % 2 = 0"


@query(f"select chrom, pos, cast(sum(w) as double) as value from ({_DYAD}) group by 1, 2", "fragments")
def dyads(fragments):
    return signals.dyads(fragments)


@query("select chrom, s + (e - s) // 2 as pos, least(cast(count(*) as double), 2.0) as value from fragments group by 1, 2", "fragments")
def capped_dyads(fragments):
    return signals.capped(signals.dyads(fragments, "right"), 2.0)


@query("select chrom, pos, cast(sum(l + r) as bigint) as combined, cast(sum(l) as bigint) as \"left\", cast(sum(r) as bigint) as \"right\" from (select chrom, s as pos, 1 as l, 0 as r from fragments union all select chrom, e - 1, 0, 1 from fragments) group by 1, 2", "fragments")
def fragment_ends(fragments):
    return signals.fragment_ends(fragments)


_RANGES = [("short", 100, 149), ("mono", 137, 197), ("all", 1, 1000)]


@query(", ranges(name, lo, hi) as (values ('short', 100, 149), ('mono', 137, 197), ('all', 1, 1000)) select name, chrom, s as pos, count(*) as value from fragments join ranges on e - s between lo and hi group by 1, 2, 3", "fragments")
def multi_range_starts(fragments):
    fits = F.filter(F.array(*[F.when((F.col("e") - F.col("s")).between(lo, hi), F.lit(n)) for n, lo, hi in _RANGES]), lambda x: x.isNotNull())
    return fragments.select("chrom", F.col("s").alias("pos"), F.explode(fits).alias("name")).groupBy("name", "chrom", "pos").agg(F.count(F.lit(1)).alias("value"))


def _moment_sql(events: str) -> str:
    return f""", ev as ({events}), net as (select chrom, pos, sum(d) as d from ev group by 1, 2 having sum(d) <> 0),
run as (select chrom, pos as "start", lead(pos) over w as "end", cast(sum(d) over w as bigint) as slope, cast(sum(cast(d as hugeint) * pos) over w as hugeint) as moment from net window w as (partition by chrom order by pos))
select chrom, "start", "end", cast(slope * ("start" + 1) - moment as bigint) as at_start, slope from run where "end" is not null and (slope <> 0 or slope * ("start" + 1) - moment <> 0)"""


@query(_moment_sql(" union all ".join(f"select chrom, {a} + {p} as pos, {d} as d from fragments" for a in ("s", "e - 167") for p, d in ((1, 1), (84, -1), (84, -1), (167, 1)))), "fragments")
def positive_score(fragments):
    return signals.positive_score(fragments)


_SUPPORT = "select chrom, least(s, e - 167) as lo, case when e - s >= 167 then e - s else 334 - (e - s) end as n from fragments"


@query(_EVENTS.format(events=f"select chrom, lo as pos, 1000000000000 // n as d from ({_SUPPORT}) union all select chrom, lo + n, -(1000000000000 // n) from ({_SUPPORT})", name="track") + "select chrom, \"start\", \"end\", value from track where value <> 0", "fragments")
def score_centring(fragments):
    return signals.centring(fragments)


@query(_EVENTS.format(events=" union all ".join(f"select chrom, {p} as pos, (1000000000000 // (2 * n)) * {w} as d from ({_SUPPORT})" for p, w in (("lo + n // 4", "(4 - n % 4)"), ("lo + n // 4 + 1", "(n % 4)"), ("lo + n - n // 4 - 1", "(-(n % 4))"), ("lo + n - n // 4", "(-(4 - n % 4))"))), name="track") + "select chrom, \"start\", \"end\", value from track where value <> 0", "fragments")
def boxcar_score(fragments):
    return signals.boxcar_score(fragments)


@query(_moment_sql(" union all ".join(f"select chrom, {p} as pos, {d} * (1000000000000 // (((n - 1) // 2) * (n // 2))) as d from ({_SUPPORT})" for p, d in (("lo + 1", 1), ("lo + (n - 1) // 2 + 1", -1), ("lo + n - (n - 1) // 2", -1), ("lo + n", 1)))), "fragments")
def triangle_score(fragments):
    return signals.triangle_score(fragments)


_WPS = _EVENTS.format(events="""select chrom, s - 59 as pos, -1 as d from fragments union all select chrom, case when e - s >= 120 then s + 60 else s + 179 end, case when e - s >= 120 then 2 else 1 end from fragments
union all select chrom, e - 59, -2 from fragments where e - s >= 120 union all select chrom, e + 60, 1 from fragments where e - s >= 120""", name="track")  # fmt: skip


@query(_WPS + "select chrom, \"start\", \"end\", value from track where value <> 0", "fragments")
def protection_score(fragments):
    return signals.protection_score(fragments)


def _regions_sql(sign: int, bridge: int, shift: int = 0) -> str:
    return _WPS + f""", moved as (select chrom, "start", "end", value + {shift} as value from track where value <> 0), up as (select *, case when "start" - lag("end") over (partition by chrom order by "start") <= {bridge} then 0 else 1 end as fresh from moved where {sign} * value > 0),
isl as (select *, sum(fresh) over (partition by chrom order by "start") as island from up),
reg as (select chrom, island, min("start") as "start", max("end") as "end", max({sign} * value) as score from isl group by 1, 2)
select chrom, "start", "end", ("start" + "end") // 2 as centre, score, "end" - "start" as length from reg where "end" - "start" >= 50"""


@query(_regions_sql(1, 5, 12), "fragments")
def call_regions(fragments):
    """The tables' protection is seldom over zero, so regions are called over -12."""
    return signals.call_regions(signals.protection_score(fragments).withColumn("value", F.col("value") + 12), 50, 5)


@query(_regions_sql(-1, 0), "fragments")
def call_breakpoints(fragments):
    return signals.call_regions(signals.protection_score(fragments), 50, negated=True)


# -- intervals -------------------------------------------------------------------------------------------------------
_MERGE = """, o as (select *, max(e) over (partition by {k} order by s, e rows between unbounded preceding and 1 preceding) as reach from {t}),
i as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by {k} order by s, e rows unbounded preceding) as island from o),
u as (select {k}, min(s) as s, max(e) as e from i group by {k}, island)
"""


@query(_MERGE.format(k="chrom", t="states") + "select chrom, s, e from u", "states")
def merged_states(states):
    return intervals.merged(states.select("chrom", "s", "e"), ["chrom"])


@query("select f.* from fragments f where not exists (select 1 from blacklist b where b.chrom = f.chrom and b.s < f.e and f.s < b.e)", "fragments", "blacklist")
def fragments_off_blacklist(fragments, blacklist):
    return intervals.overlap_join(fragments, blacklist, "left_anti")


@query("select p.* from peaks p where exists (select 1 from states b where b.chrom = p.chrom and b.s < p.e and p.s < b.e)", "peaks", "states")
def peaks_on_states(peaks, states):
    return intervals.overlap_join(peaks, states, "left_semi")


@query(""", b as (select chrom, s + i as pos from blacklist, range(0, 700) r(i) where s + i < e group by 1, 2), a as (select label, chrom, s + i as pos from states, range(0, 1000) r(i) where s + i < e group by 1, 2, 3)
select label, count(*) as bases from a where not exists (select 1 from b where b.chrom = a.chrom and b.pos = a.pos) group by 1""", "states", "blacklist")
def state_bases(states, blacklist):
    return annotate.state_coverage(states, blacklist)


@query("select p.event_id, coalesce(string_agg(distinct s.label, '|' order by s.label), 'NA') as state from peaks p left join states s on p.chrom = s.chrom and p.pos >= s.s and p.pos < s.e group by 1", "peaks", "states")
def peak_state_labels(peaks, states):
    return annotate.state_labels(peaks, states, ["event_id"])


@query("select p.event_id, arg_min(s.label, s.ord) as state from peaks p left join states s on p.chrom = s.chrom and p.pos >= s.s and p.pos < s.e group by 1", "peaks", "states")
def peak_first_state(peaks, states):
    return annotate.first_state(peaks, states, ["event_id"])


@query(", t as (select unnest([0.0, 50.0, 90.0]) as pct), c as (select pct, (select quantile_cont(score, pct / 100) from peaks) as cut from t), a as (select p.event_id, p.score, arg_min(s.label, s.ord) as label from peaks p left join states s on p.chrom = s.chrom and p.pos >= s.s and p.pos < s.e group by 1, 2) select c.pct, coalesce(label, 'unassigned') as label, count(*) as n from a, c where a.score >= c.cut group by 1, 2".replace("(select quantile_cont(score, pct / 100) from peaks)", "case when pct = 0 then (select quantile_cont(score, 0.0) from peaks) when pct = 50 then (select quantile_cont(score, 0.5) from peaks) else (select quantile_cont(score, 0.9) from peaks) end").replace("select unnest([0.0, 50.0, 90.0]) as pct", "select cast(unnest([0, 50, 90]) as int) as pct"), "peaks", "states")
def peak_states(peaks, states):
    cuts = peaks.agg(F.percentile("score", F.array(F.lit(0.0), F.lit(0.5), F.lit(0.9))).alias("q")).select(F.explode(F.arrays_zip(F.array(F.lit(0), F.lit(50), F.lit(90)).alias("pct"), F.col("q").alias("cut"))).alias("x")).select(F.col("x.pct").alias("pct"), F.col("x.cut").alias("cut"))
    assigned = annotate.first_state(peaks, states, ["event_id", "score"])
    return assigned.join(F.broadcast(cuts), F.col("score") >= F.col("cut")).groupBy("pct", F.coalesce("state", F.lit("unassigned")).alias("label")).agg(F.count(F.lit(1)).alias("n"))  # three rows


@query(""", a as (select label, chrom, s + i as pos from states, range(0, 1000) r(i) where s + i < e group by 1, 2, 3), b as (select label, count(*) as bases from a group by 1),
f as (select p.event_id, arg_min(s.label, s.ord) as label from peaks p join states s on p.chrom = s.chrom and p.pos >= s.s and p.pos < s.e group by 1), n as (select label, count(*) as n from f group by 1)
select label, bases, coalesce(n, 0) as n, round((coalesce(n, 0) * 1.0 / (select sum(n) from n)) / (bases * 1.0 / (select sum(bases) from b)), 6) as enrichment, round(coalesce(n, 0) * 1e6 / bases, 6) as per_mb from b left join n using (label)""", "peaks", "states")
def state_enrichment(peaks, states):
    counts = annotate.first_state(peaks, states, ["event_id"]).where("state is not null").groupBy(F.col("state").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    found = annotate.enrichment(counts, annotate.state_coverage(states))
    return found.select("label", "bases", "n", _r("enrichment").alias("enrichment"), _r("per_mb").alias("per_mb"))


# -- spacing ---------------------------------------------------------------------------------------------------------
_LEADS = " union all ".join(f"select chrom, {q} as ord, lead(pos, {q}) over (partition by chrom order by pos) - pos as distance, case when label = lead(label, {q}) over (partition by chrom order by pos) then label end as state from named" for q in range(1, 11))
_DISTANCES = f", named as (select p.*, coalesce(l.state, 'NA') as label from peaks p join (select p.event_id, string_agg(distinct s.label, '|' order by s.label) as state from peaks p left join states s on p.chrom = s.chrom and p.pos >= s.s and p.pos < s.e group by 1) l using (event_id)), dist as (select * from ({_LEADS}) where distance > 0)\n"


@query(_DISTANCES + "select ord, distance, chrom, state, grouping(state) as all_states, count(*) as n from dist group by grouping sets ((ord, distance), (ord, distance, chrom), (ord, distance, state), (ord, distance, chrom, state)) having grouping(state) = 1 or state is not null", "peaks", "states")
def distance_histogram(peaks, states):
    named = peaks.join(annotate.state_labels(peaks, states, ["event_id"]), "event_id")
    found = spacing.distance_histogram(spacing.neighbour_distances(named, 10, state="state"))
    return found.withColumn("all_states", F.col("all_states").cast("long"))


_HIST = _DISTANCES + ", h as (select ord, distance, count(*) as n from dist group by 1, 2)"
_MODES = _HIST + ", top as (select ord, arg_min(distance, struct_pack(a := -n, b := distance)) as mode from h group by 1)"


@query(_HIST + ", x as (select ord, quantile_cont(distance, 0.5) as median, avg(distance) as mean from dist group by 1) select h.ord, cast(sum(n) as bigint) as total, round(any_value(x.mean), 6) as mean, any_value(x.median) as median, arg_min(distance, struct_pack(a := -n, b := distance)) as mode, min(distance) as least, max(distance) as largest from h join x on h.ord = x.ord group by h.ord", "peaks", "states")
def distance_summary(peaks, states):
    h = spacing.neighbour_distances(peaks, 10).groupBy("ord", "distance").agg(F.count(F.lit(1)).alias("n"))
    return spacing.histogram_summary(h, ["ord"]).withColumn("mean", _r("mean"))


@query(_MODES + " select round(regr_slope(mode, ord), 6) as slope, round(regr_intercept(mode, ord), 6) as intercept, round(regr_r2(mode, ord), 6) as r2, count(*) as points from top", "peaks", "states")
def order_regression(peaks, states):
    h = spacing.neighbour_distances(peaks, 10).groupBy("ord", "distance").agg(F.count(F.lit(1)).alias("n"))
    fit = spacing.line_fit(spacing.histogram_summary(h, ["ord"]), "ord", "mode")
    return fit.select(_r("slope").alias("slope"), _r("intercept").alias("intercept"), _r("r2").alias("r2"), "points")


@query("select event_id, chrom, pos, s, e, score, klass from (select *, row_number() over (partition by chrom, pos // 100 order by score desc, event_id) as n from peaks) where n = 1", "peaks")
def best_peak_of_each_bin(peaks):
    keyed = peaks.withColumn("place", F.floor(F.col("pos") / 100))
    return spacing.one_per_position(keyed, "highest-score", pos="place").drop("place")


_SITES = ", sites as (select gene_id, chrom, case when strand = '+' then s else e - 1 end as pos, strand from genes)"


def _sites(genes: DataFrame) -> DataFrame:
    return genes.select("gene_id", "chrom", F.when(F.col("strand") == "+", F.col("s")).otherwise(F.col("e") - 1).alias("pos"), "strand")


@query(_SITES + ", x as (select g.gene_id, g.chrom, g.pos, (select max(p.pos) from peaks p where p.chrom = g.chrom and p.pos < g.pos) as before, (select min(p.pos) from peaks p where p.chrom = g.chrom and p.pos > g.pos) as after from sites g) select *, case when before is null or after is null then 'missing_flank' else 'ok' end as status, after - before as spacing from x", "genes", "peaks")
def flank_spacing(genes, peaks):
    return spacing.flanks(_sites(genes).drop("strand"), peaks)


@query(_SITES + ", k as (select distinct chrom, pos from peaks), c as (select g.gene_id, g.strand, p.pos, row_number() over (partition by g.gene_id order by case when g.strand = '-' then -p.pos else p.pos end) as n from sites g join k p on p.chrom = g.chrom and (case when g.strand = '-' then p.pos < g.pos else p.pos > g.pos end)) select s.gene_id, c.pos as neighbour from sites s left join c on c.gene_id = s.gene_id and c.n = 2", "genes", "peaks")
def second_downstream_peak(genes, peaks):
    return spacing.kth_neighbour(_sites(genes), peaks, 2).select("gene_id", "neighbour")


@query(_SITES + " select g.gene_id, max(case when p.pos < g.pos then p.pos end) as upstream, min(case when p.pos >= g.pos then p.pos end) as downstream, count(*) as n from sites g join peaks p on p.chrom = g.chrom and p.s < g.pos + 2001 and p.e > g.pos - 2000 group by 1", "genes", "peaks")
def flanking_peaks(genes, peaks):
    around = _sites(genes).select("gene_id", "chrom", F.col("pos").alias("site"), (F.col("pos") - 2000).alias("s"), (F.col("pos") + 2001).alias("e"))
    met = intervals.overlap_join(around, peaks.select("chrom", "s", "e", "pos"))
    return met.groupBy("gene_id").agg(F.max(F.when(F.col("r_pos") < F.col("site"), F.col("r_pos"))).alias("upstream"), F.min(F.when(F.col("r_pos") >= F.col("site"), F.col("r_pos"))).alias("downstream"), F.count(F.lit(1)).alias("n"))


@query("select event_id, ntile(20) over (order by score, event_id) as bin from peaks", "peaks")
def equal_rank_bins(peaks):
    return spacing.equal_rank_bins(peaks, 20, F.col("score"), F.col("event_id")).select("event_id", "bin")


@query("select event_id, cast(ceil(row_number() over (order by score, event_id) * 100.0 / count(*) over ()) as bigint) as pct from peaks", "peaks")
def percentile_groups(peaks):
    ranked = spacing.global_rank(peaks, F.col("score"), F.col("event_id"))
    return ranked.select("event_id", F.ceil(F.col("rank") * 100 / F.lit(peaks.count())).alias("pct"))


# -- scores ----------------------------------------------------------------------------------------------------------
@query(", g as (select * from genes where e - s between 800 and 2500) select gene_id, e - s as length from g where e - s >= (select quantile_cont(e - s, 0.5) from g)", "genes")
def filter_by_percentile(genes):
    return annotate.filtered_peaks(genes, F.col("e") - F.col("s"), 800, 2500, percentile=50).select("gene_id", (F.col("e") - F.col("s")).alias("length"))


@query("select event_id, score from peaks where score >= 20 and score <= 120 and e - s >= 51", "peaks")
def filter_by_score(peaks):
    return annotate.filtered_peaks(peaks, F.abs("score"), 51, least=20, most=120).select("event_id", "score")


@query(", b as (select klass, cast(floor(score + 0.5) as bigint) as bin, count(*) as n from peaks group by 1, 2) select klass, bin, n, round(n * 1.0 / sum(n) over (partition by klass), 9) as fraction, cast(sum(n) over (partition by klass order by bin) as bigint) as cumulative from b", "peaks")
def score_frequency(peaks):
    return annotate.score_table(peaks, "klass", "score").withColumn("fraction", _r("fraction", 9))


@query(", x as (select min(score) as lo, max(score) as hi from peaks), b as (select klass, cast(least(floor((score - lo) / 12.5), ceil((hi - lo) / 12.5) - 1) as bigint) as bin, count(*) as n from peaks, x group by 1, 2) select klass, bin, n, round(n * 1.0 / sum(n) over (partition by klass), 9) as fraction, cast(sum(n) over (partition by klass order by bin) as bigint) as cumulative from b", "peaks")
def score_bins(peaks):
    return annotate.score_table(peaks, "klass", "score", 12.5).withColumn("fraction", _r("fraction", 9))


@query("select klass, count(*) as n, min(score) as least, round(quantile_cont(score, 0.25), 6) as q1, round(quantile_cont(score, 0.5), 6) as median, round(avg(score), 6) as mean, round(quantile_cont(score, 0.75), 6) as q3, max(score) as largest, round(stddev_pop(score), 6) as std from peaks group by 1", "peaks")
def score_summary(peaks):
    found = annotate.score_summary(peaks, "klass", "score")
    return found.select("klass", "n", "least", *[_r(c).alias(c) for c in ("q1", "median", "mean", "q3")], "largest", _r("std").alias("std"))


@query(", q as (select klass, quantile_cont(score, 0.25) as q1, quantile_cont(score, 0.5) as median, quantile_cont(score, 0.75) as q3 from peaks group by 1), x as (select p.klass, score, q1, median, q3, score between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as inside from peaks p join q on p.klass = q.klass) select klass, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3, min(case when inside then score end) as low, max(case when inside then score end) as high, count(*) filter (not inside) as outside from x group by klass, x.q1, x.median, x.q3", "peaks")
def box_statistics(peaks):
    found = annotate.box_stats(peaks, "klass", "score")
    return found.select("klass", *[_r(c).alias(c) for c in ("q1", "median", "q3")], "low", "high", "outside")


_NEXT = ", n as (select pos, lead(pos) over (partition by chrom order by pos) - pos as d, score, lead(score) over (partition by chrom order by pos) as other, klass from peaks), x as (select * from n where d is not null)"


def _next_pairs(peaks: DataFrame) -> DataFrame:
    """Each peak's distance and score with the next one; of peaks at one place, which the SQL leaves in any order, the first event comes first."""
    order = Window.partitionBy("chrom").orderBy("pos", "event_id")
    return peaks.select("klass", "score", (F.lead("pos").over(order) - F.col("pos")).alias("d"), F.lead("score").over(order).alias("other")).where("d is not null")


@query(_NEXT + " select b as bin, count(x.d) as n, round(count(x.d) * 1.0 / (select count(*) from x) / 10, 12) as density from range(0, 50) r(b) left join x on x.d between 0 and 500 and case when x.d = 500 then 49 else x.d // 10 end = b group by 1", "peaks")
def pair_distance_histogram(peaks):
    return compare.signed_histogram(_next_pairs(peaks), "d", 0, 500, 10).withColumn("density", _r("density", 12))


@query(_NEXT + " select case when d <= 5 then 0 when d <= 10 then 1 when d <= 20 then 2 when d <= 50 then 3 when d <= 100 then 4 else 5 end as bin, count(*) as n, round(corr(score, other), 6) as r from x group by 1", "peaks")
def pair_score_correlation(peaks):
    return compare.distance_bin_correlation(_next_pairs(peaks), "d", "score", "other").withColumn("r", _r("r"))


@query(_NEXT + " select klass, count(*) as n, min(d) as least, round(quantile_cont(d, 0.25), 6) as q1, round(quantile_cont(d, 0.5), 6) as median, round(quantile_cont(d, 0.75), 6) as q3, round(avg(d), 6) as mean, max(d) as largest from x group by 1", "peaks")
def pair_percentiles(peaks):
    found = compare.percentile_summary(_next_pairs(peaks), "klass", "d")
    return found.select("klass", "n", "least", *[_r(c).alias(c) for c in ("q1", "median", "q3", "mean")], "largest")


@query(", t as (select klass, score, count(*) as ties from peaks group by 1, 2), r as (select klass, score, coalesce(sum(ties) over (partition by klass order by score rows between unbounded preceding and 1 preceding), 0) + (ties + 1) / 2.0 as rk, sum(ties) over (partition by klass) as n from t) select klass, score, round(case when n = 1 then 100.0 else 100 * (rk - 1) / (n - 1) end, 6) as percentile from r", "peaks")
def average_percentile_ranks(peaks):
    return compare.average_percentile_rank(peaks, "score", ["klass"]).withColumn("percentile", _r("percentile"))


@query(", k as (select f.*, case when chrom in ('chr1', 'chr2', 'chr3') then 150000 end as length from fragments f) select 'interval' as check, count(*) filter (not (s >= 0 and e > s)) as failed, count(*) filter (s >= 0 and e > s) as passed from k union all select 'contig', count(*) filter (length is null), count(*) filter (length is not null) from k union all select 'inside', count(*) filter (length is null or e > length), count(*) filter (e <= length) from k".replace(" as check,", ' as "check",'), "fragments")
def input_report(fragments):
    sizes = fragments.sparkSession.createDataFrame([(str(i), 150_000) for i in range(1, 4)], "chrom string, length long")
    return compare.input_report(fragments, sizes)


# -- correlations ----------------------------------------------------------------------------------------------------
_STARTS = ", points as (select chrom, s // 100000 as win, s as pos, count(*) as value from fragments where e - s between 137 and 197 group by 1, 2, 3)"


def _starts(fragments: DataFrame, low: int = 137, high: int = 197) -> DataFrame:
    kept = fragments.where((F.col("e") - F.col("s")).between(low, high))
    return correlate.in_windows(kept.groupBy("chrom", F.col("s").alias("pos")).agg(F.count(F.lit(1)).alias("value")))


@query(_STARTS + ", w as (select unnest([0, 1, 2]) as i), r as (select i * 100000 as s, least((i + 1) * 100000, 200200) as e from w), o as (select d as distance, cast(sum(4 * greatest(e - s - d, 0)) as bigint) as opportunities from r, range(1, 501) x(d) where e - s >= 2 group by 1), p as (select b.pos - a.pos as distance, cast(sum(a.value * b.value) as bigint) as raw from points a join points b on a.chrom = b.chrom and a.win = b.win and b.pos - a.pos between 1 and 500 group by 1) select o.distance, coalesce(raw, 0) as raw, opportunities, round(coalesce(raw, 0) * 1.0 / opportunities, 12) as value from o left join p on o.distance = p.distance", "fragments")
def auto_correlation(fragments):
    raw = correlate.auto_correlation_by_density(_starts(fragments), 100_000, 500).withColumn("raw", F.col("raw").cast("long"))
    sizes = fragments.sparkSession.createDataFrame([(f"chr{i}", FRAGMENT_CONTIG) for i in range(1, 5)], "chrom string, length long")
    chances = correlate.opportunities(correlate.windows(sizes), 500)
    return chances.join(raw, "distance", "left").select(F.col("distance").cast("long").alias("distance"), F.coalesce("raw", F.lit(0)).alias("raw"), "opportunities", _r(correlate.per_opportunity(F.coalesce("raw", F.lit(0)).cast("double"), F.col("opportunities")), 12).alias("value"))


_VALID = ", seg as (select chrom, coalesce(e2, 0) as s, coalesce(lead_s, 200200) as e from (select chrom, s as s0, e as e2, lead(s) over (partition by chrom order by s) as lead_s from u) where coalesce(lead_s, 200200) > e2)"


@query(_MERGE.format(k="chrom", t="blacklist") + _VALID + ", b as (select chrom, unnest(range(s, e)) as pos from seg), z as materialized (select chrom, pos + d as pos, d from b, range(1, 21) r(d)) select cast(d as bigint) as distance, count(*) as opportunities from z join b using (chrom, pos) group by 1", "blacklist")
def masked_opportunities(blacklist):
    holes = intervals.merged(blacklist.select("chrom", "s", "e"), ["chrom"])
    order = Window.partitionBy("chrom").orderBy("s")
    valid = holes.select("chrom", F.col("e").alias("s"), F.coalesce(F.lead("s").over(order), F.lit(FRAGMENT_CONTIG)).alias("e")).where("e > s")
    return correlate.masked_opportunities(valid, 20, ("chrom",)).withColumn("distance", F.col("distance").cast("long"))


_CROSS = ", a as (select chrom, s // 100000 as win, s as pos, count(*) as value from fragments where e - s between 120 and 180 group by 1, 2, 3), b as (select chrom, (e - 1) // 100000 as win, e - 1 as pos, count(*) as value from fragments where e - s between 120 and 180 group by 1, 2, 3), c as (select b.pos - a.pos as lag, cast(sum(a.value * b.value) as bigint) as raw from a join b on a.chrom = b.chrom and a.win = b.win and b.pos - a.pos between -200 and 200 group by 1)"


def _crossed(fragments: DataFrame) -> DataFrame:
    kept = fragments.where((F.col("e") - F.col("s")).between(120, 180))
    ends = correlate.in_windows(kept.groupBy("chrom", (F.col("e") - 1).alias("pos")).agg(F.count(F.lit(1)).alias("value")))
    found = correlate.cross_correlation_by_density(_starts(fragments, 120, 180), ends, 100_000, 200)
    return found.where("raw <> 0").withColumn("raw", F.col("raw").cast("long"))


@query(_CROSS + " select lag, raw from c", "fragments")
def cross_correlation(fragments):
    return _crossed(fragments)


@query(_CROSS + " select abs(lag) as distance, cast(sum(raw) as bigint) as raw from c group by 1", "fragments")
def absolute_cross_correlation(fragments):
    return correlate.absolute(_crossed(fragments), "lag", "raw")


# -- aggregates and genes ----------------------------------------------------------------------------------------------
_AGG = _SITES + ", a as (select {k} chrom, pos, strand from sites), n as (select {kn} count(*) as anchors from a {g}), f as (select chrom, s as pos, count(*) as value from fragments group by 1, 2), m as (select {k2} case when a.strand = '-' then a.pos - f.pos else f.pos - a.pos end as \"offset\", sum(f.value) as total from a join f on a.chrom = f.chrom and f.pos between a.pos - 100 and a.pos + 100 group by {gb})"


def _start_track(fragments: DataFrame) -> DataFrame:
    return fragments.groupBy("chrom", F.col("s").alias("start")).agg(F.count(F.lit(1)).alias("value")).withColumn("end", F.col("start") + 1)


@query(_AGG.format(k="", kn="", g="", k2="", gb="1") + " select o as \"offset\", cast(coalesce(total, 0) as bigint) as total, anchors, round(coalesce(total, 0) * 1.0 / anchors, 9) as mean from range(-100, 101) r(o) cross join n left join m on m.\"offset\" = o", "genes", "fragments")
def aggregate_profile(genes, fragments):
    return annotate.aggregate_profile(_sites(genes), _start_track(fragments), 100).withColumn("mean", _r("mean", 9))


@query(_AGG.format(k="gene_id % 3 as category,", kn="category,", g="group by 1", k2="a.category,", gb="1, 2") + " select n.category, o as \"offset\", cast(coalesce(total, 0) as bigint) as total, anchors, round(coalesce(total, 0) * 1.0 / anchors, 9) as mean from range(-100, 101) r(o) cross join n left join m on m.\"offset\" = o and m.category = n.category", "genes", "fragments")
def aggregate_by_category(genes, fragments):
    sites = _sites(genes).withColumn("category", F.col("gene_id") % 3)
    return annotate.aggregate_profile(sites, _start_track(fragments), 100, ["category"]).withColumn("mean", _r("mean", 9))


@query(_SITES + ", x as (select gene_id, value from expression where profile = 'NO'), q as (select gene_id, ntile(5) over (order by value, gene_id) as quintile from x), a as (select quintile, chrom, pos, strand from sites join q using (gene_id)), n as (select quintile, count(*) as anchors from a group by 1), f as (select chrom, s as pos, count(*) as value from fragments group by 1, 2), m as (select a.quintile, case when a.strand = '-' then a.pos - f.pos else f.pos - a.pos end as \"offset\", sum(f.value) as total from a join f on a.chrom = f.chrom and f.pos between a.pos - 100 and a.pos + 100 group by 1, 2) select n.quintile, o as \"offset\", cast(coalesce(total, 0) as bigint) as total, anchors, round(coalesce(total, 0) * 1.0 / anchors, 9) as mean from range(-100, 101) r(o) cross join n left join m on m.\"offset\" = o and m.quintile = n.quintile", "genes", "fragments", "expression")
def tss_quintiles(genes, fragments, expression):
    ranked = spacing.equal_rank_bins(expression.where("profile = 'NO'").select("gene_id", "value"), 5, F.col("value"), F.col("gene_id")).select("gene_id", F.col("bin").alias("quintile"))
    return annotate.aggregate_profile(_sites(genes).join(ranked, "gene_id"), _start_track(fragments), 100, ["quintile"]).withColumn("mean", _r("mean", 9))


_RULES = {"active": "1-URGENT & 2-HIGH | 3-MEDIUM", "quiet": "5-LOW", "mixed": "(1-URGENT | 2-HIGH) & 4-NOT SPECIFIED"}
_MET = ", met as (select g.gene_id, list(distinct s.label) as st from genes g join states s on s.chrom = g.chrom and s.s < g.e and g.s < s.e group by 1), c as (select gene_id, (list_contains(st, '1-URGENT') and list_contains(st, '2-HIGH')) or list_contains(st, '3-MEDIUM') as active, list_contains(st, '5-LOW') as quiet, (list_contains(st, '1-URGENT') or list_contains(st, '2-HIGH')) and list_contains(st, '4-NOT SPECIFIED') as mixed from met)"


@query(_MET + ", f as (select gene_id, 'active' as set_name from c where active and not quiet and not mixed union all select gene_id, 'quiet' from c where quiet and not active and not mixed union all select gene_id, 'mixed' from c where mixed and not active and not quiet) select * from f union all select gene_id, 'rest' from genes where gene_id not in (select gene_id from c where active or quiet or mixed)", "genes", "states")
def gene_sets(genes, states):
    return annotate.gene_sets(genes, states, _RULES, leftover="rest")


@query(_MET + " select gene_id, 'active' as set_name from c where active and not quiet union all select gene_id, 'quiet' from c where quiet union all select gene_id, 'mixed' from c where mixed and not (active or quiet)", "genes", "states")
def gene_sets_with_exclusions(genes, states):
    return annotate.gene_sets(genes, states, _RULES, {"active": ["quiet"], "mixed": ["active", "quiet"]})


_SPACE = """, r as (select gene_id, chrom, 'body' as region, s, e from genes union all select gene_id, chrom, case when strand = '+' then 'upstream' else 'downstream' end, greatest(0, s - 10000), s from genes union all select gene_id, chrom, case when strand = '+' then 'downstream' else 'upstream' end, e, e + 10000 from genes),
i as (select r.gene_id, r.region, p.pos from r join (select distinct chrom, pos from peaks) p on p.chrom = r.chrom and p.pos >= r.s and p.pos < r.e), d as (select gene_id, region, pos, pos - lag(pos) over (partition by gene_id, region order by pos) as d from i),
sp as (select gene_id, region, count(*) as peaks, median(d) as spacing from d group by 1, 2)
"""


@query(_SPACE + "select gene_id, region, peaks, cast(spacing as double) as spacing from sp", "genes", "peaks")
def gene_spacing(genes, peaks):
    return annotate.adjacent_spacing(annotate.gene_regions(genes), peaks, ["gene_id", "region"])


@query(_SPACE + ", x as (select region, profile, spacing, log2(value + 1) as v from sp join expression using (gene_id) where spacing is not null) select region, profile, count(*) as genes, round(corr(spacing, v), 6) as r from x group by 1, 2 having count(*) >= 30", "genes", "peaks", "expression")
def spacing_expression(genes, peaks, expression):
    spaced = annotate.adjacent_spacing(annotate.gene_regions(genes), peaks, ["gene_id", "region"]).where("spacing is not null")
    both = spaced.join(expression.withColumn("v", contigs.expression_value(F.col("value"))), "gene_id")
    return both.groupBy("region", "profile").agg(F.count(F.lit(1)).alias("genes"), _r(contigs.correlation("spacing", "v")).alias("r")).where("genes >= 30")


# -- length profiles ---------------------------------------------------------------------------------------------------
_PROFILES = ", c as (select chrom as profile, e - s as length, count(*) as n from fragments group by 1, 2)"


def _profiles(fragments: DataFrame) -> DataFrame:
    return fragments.groupBy(F.col("chrom").alias("profile"), (F.col("e") - F.col("s")).alias("length")).agg(F.count(F.lit(1)).alias("n"))


@query(_PROFILES + " select profile, length, n, round(100.0 * n / sum(n) over (partition by profile), 9) as profile_percent, round(100.0 * n / sum(n) over (partition by length), 9) as length_percent, round((n - min(n) over (partition by profile)) * 1.0 / (max(n) over (partition by profile) - min(n) over (partition by profile)), 9) as minmax from c", "fragments")
def profile_shares(fragments):
    return annotate.profile_shares(_profiles(fragments)).select("profile", "length", "n", *[_r(c, 9).alias(c) for c in ("profile_percent", "length_percent", "minmax")])


@query(_PROFILES + ", p as (select profile, length, 100.0 * n / sum(n) over (partition by profile) as v from c), g as (select a.profile, b.length, coalesce(p.v, 0) as v from (select distinct profile from c) a cross join (select distinct length from c) b left join p on p.profile = a.profile and p.length = b.length) select profile, length, round(coalesce((v - avg(v) over (partition by length)) / nullif(stddev_pop(v) over (partition by length), 0), 0), 6) as z from g", "fragments")
def length_zscores(fragments):
    return annotate.length_zscores(_profiles(fragments)).withColumn("z", _r("z"))


@query(_PROFILES + ", r as (select *, sum(n) over (partition by profile order by length) as run, sum(n) over (partition by profile) as whole from c) select profile, min(case when 2 * run >= whole then length end) as median, arg_min(length, struct_pack(a := -n, b := length)) as mode from r group by 1", "fragments")
def profile_middle(fragments):
    return annotate.weighted_middle(_profiles(fragments), "profile", "length", "n")


@query(_PROFILES + ", t as (select length, sum(n) as n from c group by 1) select length, round(avg(n) over (order by length range between 5 preceding and 5 following), 9) as smooth from t", "fragments")
def distance_moving_average(fragments):
    whole = fragments.groupBy((F.col("e") - F.col("s")).alias("length")).agg(F.count(F.lit(1)).alias("n"))
    return whole.select("length", _r(F.avg("n").over(Window.orderBy("length").rangeBetween(-5, 5)), 9).alias("smooth"))  # a row for each length


# -- sequences ---------------------------------------------------------------------------------------------------------
_BASE = "substr('ACGT', cast(1 + (p*p*31 + p*17 + 7) % 1009 % 4 as int), 1)"
_CHUNK = 1000


def _reference(spark: SparkSession) -> DataFrame:
    ids = spark.range(0, 4 * (FRAGMENT_CONTIG // _CHUNK + 1))
    chunk = ids.select(F.concat(F.lit("chr"), (1 + F.col("id") % 4).cast("string")).alias("chrom"), (F.floor(F.col("id") / 4) * _CHUNK).alias("start"))
    return chunk.withColumn("seq", F.expr(f"array_join(transform(sequence(start, start + {_CHUNK - 1}), p -> {_BASE}), '')"))


@query(f", f as (select s, e from fragments where e - s between 140 and 150), b as (select s, e, s + i as p from f, range(0, 149) r(i) where s + i < e - 1), d as (select p - s - (e - s) // 2 as position, {_BASE} || {_BASE.replace('p*p', '(p+1)*(p+1)').replace('p*17', '(p+1)*17')} as pair from b) select position, count(*) as covered, count(*) filter (pair in ('AA','AT','TA','TT')) as ww, count(*) filter (pair in ('CC','CG','GC','GG')) as ss from d group by 1", "fragments")
def dinucleotide_profile(fragments):
    kept = fragments.where((F.col("e") - F.col("s")).between(140, 150)).groupBy("chrom", "s", "e").agg(F.collect_list("source_id").alias("copies"))
    found = sequence.fragment_sequences(kept, _reference(fragments.sparkSession), _CHUNK)
    return sequence.dinucleotide_profile(found.withColumn("copy", F.explode("copies")))


_SITE_ROWS = ", ".join(f"({g}, {p})" for g, ranges in ((1, sequence.MINOR), (2, sequence.MAJOR)) for lo, hi in ranges for p in range(lo, hi))


@query(f""", f as (select chrom, s, e, count(*) as copies, s + (e - s) // 2 as dyad from fragments group by 1, 2, 3), sites(g, r) as (values {_SITE_ROWS}),
x as (select chrom, s, e, copies, dyad, g, dyad + r as p from f, sites), d as (select *, {_BASE} || {_BASE.replace('p*p', '(p+1)*(p+1)').replace('p*17', '(p+1)*17')} as pair from x where dyad >= 73),
c as (select chrom, s, e, copies, count(*) filter (g = 1 and pair in ('AA','AT','TA','TT')) as w1, count(*) filter (g = 2 and pair in ('AA','AT','TA','TT')) as w2, count(*) filter (g = 1 and pair in ('CC','CG','GC','GG')) as s1, count(*) filter (g = 2 and pair in ('CC','CG','GC','GG')) as s2 from d group by 1, 2, 3, 4),
t as (select copies, case when w1 >= w2 * 1.125 then case when s1 > s2 * 1.125 then 'type2' else 'type1' end else case when s1 > s2 * 1.125 then 'type4' else 'type3' end end as kind from c union all select copies, 'unclassified' from f where dyad < 73)
select kind, cast(sum(copies) as bigint) as n from t group by 1""", "fragments")
def ww_types(fragments):
    kept = fragments.groupBy("chrom", "s", "e").agg(F.count(F.lit(1)).alias("copies"))
    cores = sequence.fragment_sequences(sequence.core_intervals(kept).groupBy("chrom", "s", "e").agg(F.sum("copies").alias("copies")), _reference(fragments.sparkSession), _CHUNK)
    return cores.groupBy(F.coalesce(sequence.core_type(F.col("sequence")), F.lit("unclassified")).alias("kind")).agg(F.sum("copies").alias("n"))


# -- not expressible in one SQL statement ------------------------------------------------------------------------------
@query(None, "peaks", "genes")
def one_to_one_matching(peaks, genes):
    return spacing.matched_one_to_one(_sites(genes), peaks, 250)


@query(None, "fragments")
def randomized_fragments(fragments):
    return sequence.randomized(fragments)


@query(None, "fragments")
def protected_calls(fragments):
    return calls.call_protected(signals.protection_score(fragments).withColumn("value", F.col("value") + 12), cutoff=1.0)


@query(None, "fragments")
def adjusted_protection(fragments):
    """Sums of the adjusted tracks over each thousand bases."""
    sizes = fragments.sparkSession.createDataFrame([(f"chr{i}", FRAGMENT_CONTIG) for i in range(1, 5)], "chrom string, length long")
    found = calls.adjusted_protection(signals.protection_score(fragments), sizes)
    rows = found.select("chrom", "start", F.posexplode(F.arrays_zip("smoothed", "smoothed_adjusted")).alias("i", "v"))
    return rows.groupBy("chrom", F.floor((F.col("start") + F.col("i")) / 1000).alias("kb")).agg(_r(F.sum("v.smoothed"), 3).alias("smoothed"), _r(F.sum("v.smoothed_adjusted"), 3).alias("adjusted"))


@query(None, "peaks")
def repeat_length(peaks):
    """Peaks of the pooled neighbour distances of each contig, and their line."""
    h = spacing.neighbour_distances(peaks, 10).where("distance <= 1200").groupBy("chrom", "distance").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return calls.profile_peaks(h, ["chrom"])


@query(None, "peaks")
def smoothed_distances(peaks):
    h = spacing.neighbour_distances(peaks, 3).where("distance <= 1500").groupBy("ord", "distance").agg(F.count(F.lit(1)).alias("n"))
    return calls.smoothed_histogram(h, ["ord"]).withColumn("smooth", _r("smooth"))


@query(None, "genes", "fragments", "expression")
def periodicity_expression(genes, fragments, expression):
    """Correlation of expression with the spectrum of starts in 1,000 bases from each gene's start."""
    half = 500
    sites = _sites(genes).where(F.col("pos") < FRAGMENT_CONTIG)
    spectra = calls.site_spectra(sites, _start_track(fragments), half, "gene_id")
    both = spectra.join(expression.withColumn("v", contigs.expression_value(F.col("value"), "log2-floor")), "gene_id")
    powers = both.select("profile", "v", F.posexplode("powers").alias("at", "power"))
    return powers.groupBy("profile", (F.col("at") + 120).alias("period")).agg(F.count(F.lit(1)).alias("genes"), _r(contigs.correlation("power", "v")).alias("r")).where("genes >= 30")


from . import signal_queries, table_queries  # noqa: E402  (register more queries)

__all__ = ["PEAK_CONTIG", "VIEWS", "oracle_sql", "queries", "query", "signal_queries", "table_queries"]
