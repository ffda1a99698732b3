"""Plain relational operators on the TPC-H-like tables (beyond the reference)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def pricing_summary(lineitem: DataFrame) -> DataFrame:
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return lineitem.where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


def segment_revenue(customer: DataFrame, orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    j = customer.join(orders, F.col("c_custkey") == F.col("o_custkey")).join(lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("c_mktsegment").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


def region_cube(region: DataFrame, nation: DataFrame, customer: DataFrame) -> DataFrame:
    j = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.cube("r_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def last_event_before(events: DataFrame) -> DataFrame:
    """As-of: for each error, the user's last click before it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("click", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w)).where("event_type = 'error'").select("event_id", "user_id", "click")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df, dealt over the session's cores by a key of distinct values where it has fewer pieces than cores: a file of one row group is one task's work, however many wait. Larger tables stay as they lie, so what is shuffled is at most a split for each core."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)
