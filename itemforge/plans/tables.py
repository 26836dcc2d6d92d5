"""Record sets read from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.functions.numbers import number_text
from itemforge.session import spread


# Tables whose rows are worked on hard (texts, JSON lines, records, cell profiles), and the rows of one task where a scan is dealt out.
HEAVY = {"documents": 5_000, "pages": 5_000, "conversations": 20_000, "customer": 20_000, "events": 40_000, "lineitem": 200_000}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df, HEAVY[name]) if name in HEAVY else df


CUSTOMER_HEADER = ["id", "name", "country", "segment", "balance"]
ORDER_HEADER = ["code", "country", "year", "status", "total", "priority"]


def customer_records(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with their country; a negative balance is written ``N/A``."""
    joined = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.lit("customers.csv").alias("source_file"), (F.col("c_custkey") + 1).alias("source_row"),
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("country"),
        F.col("c_mktsegment").alias("segment"),
        F.when(F.col("c_acctbal") < 0, "N/A").otherwise(number_text(F.col("c_acctbal"))).alias("balance"))


def order_records(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the country of their customer and the year of their date."""
    orders, customer, nation = (table(spark, sf, n) for n in ("orders", "customer", "nation"))
    placed = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return spread(orders, 100_000).join(placed, F.col("o_custkey") == F.col("c_custkey")).select(
        F.lit("orders.csv").alias("source_file"), (F.col("o_orderkey") + 1).alias("source_row"),
        F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("code"), F.col("n_name").alias("country"),
        F.year("o_orderdate").cast("string").alias("year"), F.col("o_orderstatus").alias("status"),
        number_text(F.col("o_totalprice")).alias("total"), F.col("o_orderpriority").alias("priority"))


def turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn with the next one of its conversation. An equi join, so a huge conversation stays spread."""
    turns = table(spark, sf, "conversations")
    nxt = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"), F.col("role").alias("answer_role"))
    return turns.join(nxt, ["conv_id", "turn"]).select(
        F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("eval_id"),
        F.col("text").alias("prompt"), "answer", "conv_id", "turn", "answer_role")


def benchmark_items(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages as evaluation items with one assertion each."""
    return table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("eval_id"), F.col("text").alias("prompt"), F.array("text").alias("assertions"))
