"""Readers of peaks, positions, genes, rules and sequences with their checks, and writers of tables with headings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.contigs import contig_key, gene_key
from .text import headed, interval_rows


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def _kept(rows: DataFrame, good: Column, strict: bool, told: str) -> DataFrame:
    """Rows that pass, or all of them with an error at the first that does not."""
    if not strict:
        return rows.where(F.coalesce(good, F.lit(False)))
    first = rows.columns[0]
    error = F.raise_error(F.concat(F.lit(f"{told}: "), F.to_json(F.struct("*")))).cast(dict(rows.dtypes)[first])
    return rows.withColumn(first, F.when(F.coalesce(good, F.lit(False)), F.col(first)).otherwise(error))


def peaks(spark: SparkSession, paths: str | list[str], score_column: int = 5, position_column: int | None = None, least: int | None = None, most: int | None = None, strict: bool = True) -> DataFrame:
    """(source, chrom, s, e, pos, score): peaks whose score is finite and whose position lies inside; length limits come before the score.

    The position is the midpoint unless a column holds it. Rows that break a rule raise an error, or go if not strict.
    """
    wanted = {"score": score_column, **({"pos": position_column} if position_column else {})}
    rows = interval_rows(spark, paths, wanted, strict)
    length = F.col("e") - F.col("s")
    if least is not None:
        rows = rows.where(length >= least)
    if most is not None:
        rows = rows.where(length <= most)
    pos = F.expr("try_cast(pos as bigint)") if position_column else F.floor((F.col("s") + F.col("e")) / 2)
    rows = rows.select("source", "chrom", "s", "e", pos.cast("long").alias("pos"), F.expr("try_cast(score as double)").alias("score"))
    return _kept(rows, _finite(F.col("score")) & (F.col("pos") >= F.col("s")) & (F.col("pos") < F.col("e")), strict, "no peak")


def positions(spark: SparkSession, path: str, score_column: int = 5, summit_column: int = 7, strict: bool = True) -> DataFrame:
    """(chrom, pos, score): summits with a finite score under one key for each contig; equal summits stay apart."""
    rows = interval_rows(spark, path, {"score": score_column, "summit": summit_column}, strict)
    rows = rows.select(contig_key(F.col("chrom")).alias("chrom"), F.expr("try_cast(summit as bigint)").alias("pos"), F.expr("try_cast(score as double)").alias("score"))
    return _kept(rows, F.col("pos").isNotNull() & _finite(F.col("score")), strict, "no summit")


def region_modes(rows: DataFrame, mode: str = "interval", extend: int = 2000, strand: str = "strand") -> DataFrame:
    """Regions as they are, or ``extend`` bases downstream or upstream of the strand's first base, cut off at zero."""
    if mode == "interval":
        return rows
    if mode not in ("downstream", "upstream"):
        raise ValueError("modes are interval, downstream and upstream")
    plus = F.col(strand) == "+"
    anchor = F.when(plus, F.col("s")).otherwise(F.col("e") - 1)
    right = plus if mode == "downstream" else ~plus
    start, end = F.when(right, anchor).otherwise(anchor - extend + 1), F.when(right, anchor + extend).otherwise(anchor + 1)
    return rows.withColumn("__s", F.greatest(start, F.lit(0).cast("long"))).withColumn("e", end).withColumn("s", F.col("__s")).drop("__s").where("e > s")


def genes(spark: SparkSession, path: str, sizes: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """(gene_id, gene_name, chrom, s, e, strand): ids without versions. Duplicate ids raise an error when read.

    With sizes, ends are cut to the contig and genes of other contigs go; without, a strand is needed.
    """
    from ..operators.annotate import checked_genes

    rows = interval_rows(spark, path, {"gene_id": 4, "gene_name": 5, "strand": 6}, strict)
    rows = rows.select(gene_key(F.col("gene_id")).alias("gene_id"), F.coalesce("gene_name", "gene_id").alias("gene_name"), "chrom", "s", "e", "strand")
    if sizes is None:
        return checked_genes(_kept(rows, F.col("strand").isin("+", "-"), strict, "gene without strand"))
    known = sizes.select(contig_key(F.col("chrom")).alias("__k"), F.col("length").alias("__n"))
    cut = rows.join(known, contig_key(F.col("chrom")) == F.col("__k")).withColumn("e", F.least("e", "__n")).where("e > s").drop("__k", "__n")
    return checked_genes(cut)


def selected_genes(known: DataFrame, wanted: list[tuple[str, str]], grouping: str = "individual") -> DataFrame:
    """Rows of the wanted (name, group) with a column ``region``: the gene's id, the group (pooled), or both.

    A name is an id without its version or a gene name in any case; one that is not known raises an error.
    """
    if grouping not in ("individual", "pooled", "both"):
        raise ValueError("groupings are individual, pooled and both")
    asked = known.sparkSession.createDataFrame([(w, g, w.split(".")[0] if w.startswith("ENS") else w) for w, g in wanted], "__asked string, __group string, __key string")
    on = (gene_key(F.col("gene_id").cast("string")) == F.col("__key")) | (F.lower("gene_name") == F.lower("__asked"))
    met = F.broadcast(asked).join(known, on, "left")  # a list that a user wrote
    told = F.raise_error(F.concat(F.lit("gene is not known: "), F.col("__asked"))).cast(dict(known.dtypes)["gene_id"])
    met = met.withColumn("gene_id", F.when(F.col("gene_id").isNull(), told).otherwise(F.col("gene_id")))
    names = {"individual": [F.col("gene_id").cast("string")], "pooled": [F.col("__group")], "both": [F.col("gene_id").cast("string"), F.col("__group")]}[grouping]
    return met.withColumn("region", F.explode(F.array(*names))).drop("__asked", "__group", "__key").dropDuplicates(["region", "gene_id"])


def tissue_expression(spark: SparkSession, path: str, profile: str) -> DataFrame:
    """(gene_id, value): means of one profile of a long table; profile names match without regard to case, spaces and underscores."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"[\s_]+", " ")))
    rows = headed(spark, path, {"gene": ("gene id", "ensembl"), "tissue": ("cell line", "cell type", "profile"), "ntpm": ("nx", "ptpm", "tpm", "value")})
    value = F.expr("try_cast(ntpm as double)")
    rows = rows.where(plain(F.col("tissue")) == " ".join(profile.replace("_", " ").lower().split()))
    return rows.where(_finite(value) & (value >= 0)).groupBy(gene_key(F.col("gene")).alias("gene_id")).agg(F.avg(value).alias("value"))


def rules(spark: SparkSession, path: str) -> tuple[dict[str, str], dict[str, list[str]]]:
    """Rules by set name, and the sets that each excludes, from a table of set_name, include_rule and exclude_if_candidate."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path).collect()  # what a user wrote
    names = [r["set_name"].strip() for r in rows]
    if len(set(names)) != len(names):
        raise ValueError("a set has two rules")
    include = {r["set_name"].strip(): r["include_rule"].strip() for r in rows}
    others = {r["set_name"].strip(): [x.strip() for x in (r.asDict().get("exclude_if_candidate") or "").replace(";", ",").split(",") if x.strip()] for r in rows}
    if bad := {x for xs in others.values() for x in xs} - set(names):
        raise ValueError(f"sets are not known: {sorted(bad)}")
    return include, {k: v for k, v in others.items() if v}


def track_specs(spark: SparkSession, path: str) -> list[tuple[str, int, int, list[str], str]]:
    """(prefix, low, high, tracks, scope) for each row of a table of fragment_range, output_prefix, tracks and basic_scope."""
    out = []
    for r in spark.read.option("sep", "\t").option("header", True).csv(path).collect():
        low, high = (int(x) for x in r["fragment_range"].split("-"))
        if low > high:
            raise ValueError(f"{r['fragment_range']} is no range")
        scope = (r.asDict().get("basic_scope") or "range").strip()
        if scope not in ("range", "all"):
            raise ValueError(f"{scope} is no scope")
        out.append((r["output_prefix"].strip(), low, high, [t.strip() for t in r["tracks"].split(",") if t.strip()], scope))
    return out


def fasta(spark: SparkSession, paths: str | list[str], width: int = 100_000) -> DataFrame:
    """(chrom, start, seq): upper-case sequence in chunks of ``width`` bases. A file is read by one task, a contig's chunks leave it one by one."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield from _chunks(path, width)

    names = [paths] if isinstance(paths, str) else paths
    return spark.createDataFrame([(p,) for p in names], "path string").repartition(len(names)).mapInArrow(cut, "chrom string, start long, seq string")


def _chunks(path: str, width: int) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    name, start, held = None, 0, ""

    def put(text: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([start], pa.int64()), pa.array([text])], ["chrom", "start", "seq"])

    with store.open_input_stream(where, compression="detect") as stream:
        rest = b""
        while True:
            raw = stream.read(1 << 20)
            lines = (rest + raw).split(b"\n")
            rest = lines.pop() if raw else b""
            for line in lines:
                text = line.decode("ascii").strip()
                if text.startswith(">"):
                    if held:
                        yield put(held)
                    name, start, held = text[1:].split()[0], 0, ""
                    continue
                held += text.upper()
                while len(held) >= width:
                    yield put(held[:width])
                    start, held = start + width, held[width:]
            if not raw:
                break
    if held:
        yield put(held)


def write_table(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A tab-separated table with headings, sorted over its files; nulls are empty."""
    rows = df if not order else df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.option("sep", "\t").option("header", True).option("nullValue", "").csv(path)


def matrix_lines(rows: DataFrame, keys: list[str], widest: int, missing: str = "NA", signal: str = "signal") -> DataFrame:
    """(keys, offset_0 ... offset_n) as text: rows of values as columns, filled up to the widest."""
    value = lambda k: F.when((F.size(signal) <= k) | F.isnan(F.try_element_at(F.col(signal), F.lit(k + 1))), F.lit(missing)).otherwise(F.try_element_at(F.col(signal), F.lit(k + 1)).cast("string"))
    return rows.select(*keys, *[F.coalesce(value(k), F.lit(missing)).alias(f"offset_{k}") for k in range(widest)])


def fragment_summary(fragments: DataFrame, low: int, high: int) -> DataFrame:
    """(metric, value): fragments, those in the range of lengths, and bases that these cover."""
    from ..operators.signals import coverage

    used = fragments.where((F.col("e") - F.col("s")).between(low, high))
    covered = coverage(used).agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("v"))
    counts = fragments.agg(F.count(F.lit(1)).alias("a"), F.count_if((F.col("e") - F.col("s")).between(low, high)).alias("b")).crossJoin(covered)  # two rows
    names = {"total_fragments_filtered_all": "a", "total_fragments_used_in_range": "b", "unique_bases_covered_by_used_fragments": "v"}
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).cast("long").alias("value")) for n, c in names.items()])).alias("x")).select("x.*")


def fragment_source(spark: SparkSession, beds: list[str] | None = None, bams: list[str] | None = None, blacklist: DataFrame | None = None, **flags) -> DataFrame:
    """(source_id, chrom, s, e) of fragment files or of the pairs of BAM files, one of both, without blacklisted fragments."""
    from ..operators.intervals import overlap_join
    from . import alignments, text

    if bool(beds) == bool(bams):
        raise ValueError("give either fragment files or BAM files")
    if beds:
        found = text.fragments(spark, beds)
    else:
        spark.dataSource.register(alignments.BamSource)
        reads = spark.read.format("bam").option("paths", "\n".join(bams)).load()
        number = F.element_at(F.create_map(*[x for i, p in enumerate(bams, 1) for x in (F.lit(p), F.lit(i))]), F.col("path"))
        found = alignments.pair_fragments(alignments.usable(reads, **flags)).select(number.alias("source_id"), contig_key(F.col("chrom")).alias("chrom"), "s", "e")
    if blacklist is None:
        return found
    return overlap_join(found, blacklist.withColumn("chrom", contig_key(F.col("chrom"))), "left_anti")


def interval_counts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source, rows, malformed): what a reader that is not strict leaves out of each file."""
    lines = spark.read.text(paths).select(F.input_file_name().alias("source"), F.rtrim("value").alias("line")).where("line <> ''").where(~F.col("line").rlike(r"^\s*(#|track(\s|$)|browser(\s|$))"))
    all_rows = lines.groupBy("source").agg(F.count(F.lit(1)).alias("__all"))
    good = interval_rows(spark, paths, strict=False).groupBy(F.col("source").alias("__s")).agg(F.count(F.lit(1)).alias("rows"))
    both = all_rows.join(good, F.col("source") == F.col("__s"), "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))
    return both.select("source", "rows", (F.col("__all") - F.col("rows")).alias("malformed"))


def filtered_bed8(peaks: DataFrame, scale: float = 1.0) -> DataFrame:
    """Lines of eight columns (value, chrom, start): whole scores from 0 to 1000, thick starts kept inside the interval."""
    score = F.least(F.lit(1000), F.greatest(F.lit(0), F.floor(F.abs(F.col("score")) * F.lit(scale) + 0.5))).cast("int")
    thick = F.greatest(F.col("s"), F.least(F.col("pos"), F.col("e") - 1))
    name = F.concat_ws(":", "chrom", F.col("pos").cast("string"))
    return peaks.select(F.concat_ws("\t", "chrom", F.col("s").cast("string"), F.col("e").cast("string"), name, score.cast("string"), F.lit("."), thick.cast("string"), (thick + 1).cast("string")).alias("value"), "chrom", F.col("s").alias("start"))


def flanking_table(sites: DataFrame, peaks: DataFrame, extend: int, track: str, key: str = "site", missing: str = "NA") -> DataFrame:
    """(key, contig, count, and six fields of the nearest peak on each side) as text, for each site; a peak at the site is downstream.

    ``sites`` has the key, chrom and pos, ``peaks`` chrom, s, e, pos and score; peaks count that meet pos -+ extend.
    """
    from ..operators.intervals import overlap_join

    around = sites.select(key, "chrom", F.col("pos").alias("site_pos"), (F.col("pos") - extend).alias("s"), (F.col("pos") + extend + 1).alias("e"))
    fields = ["s", "e", "pos", "score"]
    met = overlap_join(around, peaks.select("chrom", *fields))
    gap = F.col("r_pos") - F.col("site_pos")
    near = F.struct(F.abs(gap).alias("gap"), F.col("r_pos").alias("pos"), F.col("r_s").alias("s"), F.col("r_e").alias("e"), F.col("r_score").alias("score"), F.col("chrom").alias("contig"))
    found = met.groupBy(key).agg(F.count(F.lit(1)).alias("count"), F.min(F.when(gap < 0, near)).alias("up"), F.min(F.when(gap >= 0, near)).alias("down"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(missing))
    out = [text(F.col(f"{side}.{c}")).alias(f"{track}_{side}_{c}") for side in ("up", "down") for c in ("contig", "s", "e", "pos", "score", "gap")]
    return sites.select(key, "chrom").join(found, key, "left").select(key, F.col("chrom").alias(f"{track}_contig"), F.coalesce("count", F.lit(0)).cast("string").alias(f"{track}_count"), *out)
