"""The supplied Parquet tables, and their view as a typed graph.

Customers are persons, parts events and suppliers organizations. An order line says that its customer
and its supplier took part in the event; the first line of an order also that the customer founded the
supplier. Second and third lines give candidates that the schema must refuse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _candidate(head: Column, head_type: str, relation: str, tail: Column, tail_type: str, extractor: str) -> Column:
    parts = {"head": head, "head_type": F.lit(head_type), "relation": F.lit(relation), "tail": tail, "tail_type": F.lit(tail_type), "extractor": F.lit(extractor)}
    return F.struct(*(c.alias(n) for n, c in parts.items()))


def order_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate edges of all order lines: one scan and one join, then up to five candidates a line."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    name = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    person, event, organization = name("C", "o_custkey"), name("P", "l_partkey"), name("S", "l_suppkey")
    other = F.concat(F.lit("S"), (F.col("l_partkey") % 10).cast("string"))
    on_line = lambda number, candidate: F.when(F.col("l_linenumber") == number, candidate)
    found = F.array_compact(F.array(
        _candidate(person, "Person", "PARTICIPATED_IN", event, "Event", "order"),
        _candidate(organization, "Organization", "PARTICIPATED_IN", event, "Event", "supply"),
        on_line(1, _candidate(person, "Person", "FOUNDED", organization, "Organization", "first_line")),
        on_line(2, _candidate(event, "Event", "PARTICIPATED_IN", person, "Person", "reversed")),
        on_line(3, _candidate(organization, "Organization", "FOUNDED", other, "Organization", "third_line")),
    ))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.inline(found),
        F.when(F.col("l_returnflag") == "R", "llm").otherwise("rule").alias("origin"),
        (1 - F.col("l_discount")).alias("confidence"),
        F.col("o_orderpriority").alias("source"),
        F.col("l_orderkey").alias("ord"),
        F.col("l_orderkey").cast("string").alias("evidence"),
    )
