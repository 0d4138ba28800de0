"""The engine's data model over the driver's tables: the same text is valid in Spark and in standard SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fragments": ("lineitem", "select 1 + l_suppkey % 2 as source_id, concat('chr', cast(1 + l_suppkey % 4 as varchar(10))) as chrom, cast((l_orderkey*37 + l_linenumber*11) % 200000 as bigint) as s, cast((l_orderkey*37 + l_linenumber*11) % 200000 + 100 + 2*cast(l_quantity as int) as bigint) as e from lineitem"),
    "peaks": ("events", "select event_id, concat('chr', cast(1 + user_id % 4 as varchar(10))) as chrom, cast(event_id * 193 % 1000003 as bigint) as pos, cast(event_id * 193 % 1000003 - 25 as bigint) as s, cast(event_id * 193 % 1000003 + 26 as bigint) as e, value as score, event_type as klass from events where event_id * 193 % 1000003 >= 25"),
    "states": ("orders", "select o_orderkey as ord, concat('chr', cast(1 + o_custkey % 4 as varchar(10))) as chrom, cast(o_orderkey * 911 % 1000000 as bigint) as s, cast(o_orderkey * 911 % 1000000 + 200 + o_custkey % 800 as bigint) as e, o_orderpriority as label from orders"),
    "genes": ("part", "select p_partkey as gene_id, p_name as gene_name, concat('chr', cast(1 + p_partkey % 4 as varchar(10))) as chrom, cast(p_partkey * 487 % 990000 as bigint) as s, cast(p_partkey * 487 % 990000 + 500 + p_size * 50 as bigint) as e, case when p_partkey % 2 = 0 then '+' else '-' end as strand from part"),
    "expression": ("lineitem", "select l_partkey as gene_id, concat(l_returnflag, l_linestatus) as profile, avg(l_quantity) as value from lineitem group by l_partkey, l_returnflag, l_linestatus"),
    "blacklist": ("supplier", "select s_suppkey as ord, concat('chr', cast(1 + s_suppkey % 4 as varchar(10))) as chrom, cast(s_suppkey * 7919 % 200000 as bigint) as s, cast(s_suppkey * 7919 % 200000 + 150 + s_nationkey * 20 as bigint) as e from supplier"),
}

FRAGMENT_CONTIG, PEAK_CONTIG = 200_200, 1_001_000


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, text = VIEWS[name]
    return spark.sql(text.replace(f"from {table}", "from {source}"), source=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def with_views(*names: str) -> str:
    """The head of a SQL statement that defines the views."""
    return "with " + ",\n".join(f"{n} as ({VIEWS[n][1]})" for n in names)
