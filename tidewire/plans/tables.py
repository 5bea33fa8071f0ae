"""Replicated tables derived from the driver's data, their specs, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import TableSpec

USERS = TableSpec("users", ("c_custkey",), "owner")
PAYMENTS = TableSpec("payments", ("o_orderkey",), "owner", "o_orderdate")
FEED = TableSpec("feed", ("feed_id",), "owner", "ts")
ITEMS = TableSpec("line_items", ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"), "owner", "l_shipdate")
TURNS = TableSpec("turns", ("conv_id", "turn"), "owner")

SQL = {
    "users": "SELECT c_custkey, c_name, c_acctbal, c_mktsegment, r_name AS owner FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "payments": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, owner FROM orders JOIN users ON o_custkey = c_custkey",
    "feed": "SELECT event_id AS feed_id, user_id, event_type, value, ts, owner FROM events JOIN users ON user_id = c_custkey",
    "line_items": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_quantity, owner FROM lineitem JOIN payments ON l_orderkey = o_orderkey",
}


def sql(*names: str) -> str:
    """A WITH clause that defines the named tables and what they rest on."""
    wanted = ["users", *(["payments"] if {"payments", "line_items"} & set(names) else []), *[n for n in names if n not in ("users", "payments")]]
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in wanted)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def users(spark: SparkSession, d: str) -> DataFrame:
    nation, region = read(spark, d, "nation"), read(spark, d, "region")
    owner = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("owner"))
    return read(spark, d, "customer").join(owner, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "owner")


def payments(spark: SparkSession, d: str) -> DataFrame:
    u = users(spark, d).select("c_custkey", "owner")
    return read(spark, d, "orders").join(u, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "owner")


def feed(spark: SparkSession, d: str) -> DataFrame:
    u = users(spark, d).select("c_custkey", "owner")
    return read(spark, d, "events").join(u, F.col("user_id") == F.col("c_custkey")).select(F.col("event_id").alias("feed_id"), "user_id", "event_type", "value", "ts", "owner")


def line_items(spark: SparkSession, d: str) -> DataFrame:
    p = payments(spark, d).select("o_orderkey", "owner")
    return read(spark, d, "lineitem").join(p, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_quantity", "owner")
