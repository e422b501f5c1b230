"""Scores of answers against a golden set, by number of hops, with the layer that failed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import answer_accuracy

TRIPLE = ("head", "relation", "tail")


def _trimmed(triples: DataFrame, *keys: str) -> DataFrame:
    return triples.select(*keys, *(F.trim(c).alias(c) for c in TRIPLE))


def found_in(expected: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """Expected triples (item_id, triple) with whether they are known; keys that both have must agree too."""
    own = _trimmed(expected, "item_id", "n")
    there = _trimmed(known, *keys).distinct().withColumn("hit", F.lit(1))
    return own.join(there, [*keys, *TRIPLE], "left").select("item_id", "n", *TRIPLE, F.coalesce("hit", F.lit(0)).alias("hit"))


def path_recall(items: DataFrame, expected: DataFrame, context: DataFrame) -> DataFrame:
    """(item_id, recall): the share of an item's expected triples in its context; 1 if none are expected."""
    shares = found_in(expected, context, "item_id").groupBy("item_id").agg(F.round(F.avg("hit"), 3).alias("recall"))
    return items.select("item_id").join(shares, "item_id", "left").select("item_id", F.coalesce("recall", F.lit(1.0)).alias("recall"))


def missing(expected: DataFrame, edges: DataFrame) -> DataFrame:
    return _trimmed(expected, "item_id", "n").join(_trimmed(edges), list(TRIPLE), "left_anti")


def scored(items: DataFrame, answers: DataFrame, recalls: DataFrame, control: DataFrame | None = None) -> DataFrame:
    """Items (item_id, hops, answerable, expected) with accuracy, recall and, for unanswerable ones, whether they were refused."""
    rows = items.join(answers.select("item_id", "answer", "refused"), "item_id").join(recalls, "item_id")
    if control is not None:
        rows = rows.join(control.select("item_id", F.col("answer").alias("control_answer")), "item_id", "left")
    else:
        rows = rows.withColumn("control_answer", F.lit(None).cast("string"))
    right = F.when(F.col("answerable"), answer_accuracy(F.coalesce("answer", F.lit("")), F.col("expected")))
    other = F.when(F.col("answerable"), answer_accuracy(F.coalesce("control_answer", F.lit("")), F.col("expected")))
    return rows.withColumn("accuracy", right).withColumn("control_accuracy", other).withColumn("refusal_ok", F.when(~F.col("answerable"), F.col("refused")))


def failure_layer(rows: DataFrame, absent_in_graph: DataFrame, absent_in_context: DataFrame) -> DataFrame:
    """rows with the layer of answerable items that fell short: index, retrieval or generation."""
    graph = absent_in_graph.select("item_id").distinct().withColumn("no_graph", F.lit(True))
    context = absent_in_context.select("item_id").distinct().withColumn("no_context", F.lit(True))
    short = F.col("answerable") & ((F.col("accuracy") < 1) | (F.col("recall") < 1))
    layer = F.when(short & F.col("no_graph"), "index").when(short & F.col("no_context"), "retrieval").when(short, "generation")
    return rows.join(graph, "item_id", "left").join(context, "item_id", "left").withColumn("layer", layer).drop("no_graph", "no_context")


def by_hops(rows: DataFrame) -> DataFrame:
    """Means of the answerable items by hops."""
    mean = lambda c, n: F.round(F.avg(c), 3).alias(n)
    return rows.filter("answerable").groupBy("hops").agg(F.count("*").alias("n"), mean("accuracy", "accuracy"), mean("recall", "recall"), mean("control_accuracy", "control_accuracy"))


def overall(rows: DataFrame) -> DataFrame:
    """One row of totals: no items give full refusal accuracy and no means."""
    return rows.agg(
        F.count(F.when(F.col("answerable"), 1)).alias("answerable"), F.coalesce(F.round(F.avg("accuracy"), 3), F.lit(0.0)).alias("accuracy"), F.coalesce(F.round(F.avg("control_accuracy"), 3), F.lit(0.0)).alias("control_accuracy"),
        F.coalesce(F.round(F.avg(F.col("refusal_ok").cast("double")), 3), F.lit(1.0)).alias("refusal_accuracy"), F.count(F.when(~F.col("answerable") & ~F.col("refused"), 1)).alias("hallucinations"),
    )


def layer_counts(rows: DataFrame) -> DataFrame:
    """(layer, items) with zeros."""
    every = rows.sparkSession.createDataFrame([("index",), ("retrieval",), ("generation",)], "layer string")
    counts = rows.groupBy("layer").agg(F.count("*").alias("items"))
    return every.join(counts, "layer", "left").select("layer", F.coalesce("items", F.lit(0)).alias("items"))


def golden_report(items: DataFrame, expected: DataFrame, edges: DataFrame) -> DataFrame:
    """(item_id, hops, expected triples, present ones, ok) of the answerable items."""
    hits = found_in(expected, edges).groupBy("item_id").agg(F.count("*").alias("triples"), F.sum("hit").alias("present"))
    rows = items.filter("answerable").join(hits, "item_id", "left")
    return rows.select("item_id", "hops", F.coalesce("triples", F.lit(0)).alias("triples"), F.coalesce("present", F.lit(0)).alias("present"), (F.coalesce("triples", F.lit(0)) == F.coalesce("present", F.lit(0))).alias("ok"))
