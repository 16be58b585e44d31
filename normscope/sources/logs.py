"""The benchmark tables as event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import EventSpec

EVENTS = EventSpec(
    name="events", entity="user_id", time="ts", event_id="event_id", entity_type="user", numeric=("value", "k", "error_cost"),
    categorical=("event_type",), dimensions=("event_type",), rates=("error_cost",),
)
LINEITEM = EventSpec(
    name="lineitem", entity="l_suppkey", time="l_shipdate", event_id="l_orderkey", entity_type="supplier",
    numeric=("l_quantity", "l_extendedprice", "l_discount", "l_tax", "returned_amount"), categorical=("l_returnflag", "l_linestatus"),
    dimensions=("l_returnflag", "l_linestatus"), rates=("returned_amount",),
)
ORDERS = EventSpec(
    name="orders", entity="o_custkey", time="o_orderdate", event_id="o_orderkey", entity_type="customer", numeric=("o_totalprice",),
    categorical=("o_orderpriority", "o_orderstatus"), dimensions=("o_orderstatus",),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"),
        F.when(F.col("event_type") == "error", F.col("value")).otherwise(F.lit(0.0)).alias("error_cost"),
    )


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        *[c for c in LINEITEM.columns if c not in ("returned_amount", "l_shipdate")], F.col("l_shipdate").cast("timestamp").alias("l_shipdate"),
        F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).otherwise(F.lit(0.0)).alias("returned_amount"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
