"""The record table that the estimators and the planner read, bound to the tables of an order book."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: All columns of a record.
COLUMNS = ("id", "dataset_year", "start_month", "region", "district", "festival_type", "type_tokens", "venue_type", "duration_days", "budget_krw", "quality_flag", "visitors", "festival_name")
#: What estimates read of it.
FEATURES = ("id", "dataset_year", "region", "district", "type_tokens", "venue_type", "duration_days", "budget_krw", "quality_flag")


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What orders and customers tell of each record. Region and nation are small and Catalyst broadcasts them by size."""
    where = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    where = where.select("c_custkey", "r_name", "n_name", "c_mktsegment")
    return table(spark, sf_dir, "orders").join(where, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"),
        F.year("o_orderdate").alias("dataset_year"),
        F.month("o_orderdate").alias("start_month"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("district"),
        F.col("c_mktsegment").alias("festival_type"),
        F.col("o_orderpriority").alias("venue_type"),
        F.col("o_totalprice").alias("budget_krw"),
        F.when(F.col("o_orderstatus").isin("F", "O"), "VALID").otherwise("MISSING_OR_NONPOSITIVE").alias("quality_flag"),
    )


def _items(items: DataFrame, parts: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """What lineitems tell of each record, as far as ``columns`` ask for it; they are combined per order before any join with records."""
    wanted = {
        "duration_days": F.count("*").cast("int").alias("duration_days"),
        "visitors": F.sum("l_quantity").alias("q"),
        "type_tokens": F.sort_array(F.collect_set("p_type")).alias("toks"),
        "festival_name": F.min("p_name").alias("nm"),
    }
    return items.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(*(v for k, v in wanted.items() if k in columns))


def records(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = COLUMNS, only_latest: bool = False) -> DataFrame:
    """One row per plan record, with ``columns``; ``only_latest``: those of the latest year of all.

    Tables that no column needs are not read. The latest year is found, and filtered by, before lineitems are joined.
    """
    heads = _heads(spark, sf_dir)
    if only_latest:
        heads = latest(heads)
    if not {"duration_days", "visitors", "type_tokens", "festival_name"} & set(columns):
        return heads.select(*columns)
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    if only_latest:
        items = items.join(heads.select(F.col("id").alias("l_orderkey")), "l_orderkey", "left_semi")
    per = _items(items, table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name"), columns)
    filled = {
        "type_tokens": lambda: F.coalesce("toks", F.array().cast("array<string>")).alias("type_tokens"),
        "visitors": lambda: (F.coalesce("q", F.lit(0.0)) * 20).alias("visitors"),
        "festival_name": lambda: F.coalesce("nm", F.lit("")).alias("festival_name"),
    }
    return heads.join(per, F.col("id") == F.col("l_orderkey"), "left").select(*(filled[n]() if n in filled else n for n in columns))


def latest(rows: DataFrame) -> DataFrame:
    """The records of the latest year of all."""
    return rows.join(F.broadcast(rows.agg(F.max("dataset_year").alias("dataset_year"))), "dataset_year")


#: The same table as a DuckDB query, written on its own for the oracles.
RECORDS_SQL = """
items as (
  select l_orderkey, count(*) n, sum(l_quantity) q, list_sort(list_distinct(list(p_type))) toks, min(p_name) nm
  from lineitem join part on p_partkey = l_partkey group by l_orderkey
), records as (
  select o_orderkey id, cast(year(o_orderdate) as integer) dataset_year, cast(month(o_orderdate) as integer) start_month,
    r_name region, n_name district, c_mktsegment festival_type, coalesce(toks, []) type_tokens, o_orderpriority venue_type,
    cast(n as integer) duration_days, o_totalprice budget_krw,
    case when o_orderstatus in ('F', 'O') then 'VALID' else 'MISSING_OR_NONPOSITIVE' end quality_flag,
    cast(coalesce(q, 0) * 20 as double) visitors, coalesce(nm, '') festival_name
  from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey
  left join items on l_orderkey = o_orderkey
)"""

#: Of that, the latest year.
LATEST_SQL = RECORDS_SQL.replace("records as (", "every_year as (") + ", records as (select * from every_year where dataset_year = (select max(dataset_year) from every_year))"
