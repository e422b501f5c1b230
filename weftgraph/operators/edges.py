"""Candidate edges to final ones: schema gate with reasons, merge with provenance, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: (head type, relation, tail type) that an edge may have.
ALLOWED = (("Person", "PARTICIPATED_IN", "Event"), ("Person", "FOUNDED", "Organization"), ("Organization", "PARTICIPATED_IN", "Event"))
KEY = ("head", "relation", "tail")


def reject_reason(allowed: tuple[tuple[str, str, str], ...] = ALLOWED) -> Column:
    """Why a candidate is refused, or null. The schema is a few literals, so the gate is a filter and needs no join."""
    fits = F.concat_ws("|", "head_type", "relation", "tail_type").isin(*("|".join(t) for t in allowed))
    return F.when(F.col("head") == F.col("tail"), "self_loop").when(~fits, "schema_type_mismatch")


def gated(candidates: DataFrame, allowed: tuple[tuple[str, str, str], ...] = ALLOWED) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused with reason)."""
    judged = candidates.withColumn("reason", reject_reason(allowed))
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")


def refused_log(refused: DataFrame, most: int | None = None) -> DataFrame:
    """One row for each refused triple and reason, the first by ord; the log itself may be limited."""
    log = refused.groupBy(*KEY, "reason").agg(F.min("ord").alias("ord"), F.count("*").alias("times"))
    return log.orderBy("ord", *KEY, "reason").limit(most) if most else log


def merged(accepted: DataFrame, quotes: int = 3) -> DataFrame:
    """One edge for each (head, relation, tail): origins rolled up, greatest confidence, sorted sources and extractors, first quotations.

    All of it is pre-aggregated per task; the list of quotations never holds more than ``quotes``.
    """
    edges = accepted.groupBy(*KEY).agg(
        F.min("head_type").alias("head_type"), F.min("tail_type").alias("tail_type"),
        F.max(F.when(F.col("origin") == "rule", 1).otherwise(0)).alias("rule"), F.max(F.when(F.col("origin") == "llm", 1).otherwise(0)).alias("llm"),
        F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("extractor")).alias("extractors"),
    )
    told = accepted.filter("evidence <> ''").groupBy(*KEY, "evidence").agg(F.min("ord").alias("ord"))
    # The limit by rank holds in each task before the shuffle, so a hot edge moves few quotations.
    first = told.withColumn("place", F.row_number().over(W.partitionBy(*KEY).orderBy("ord", "evidence"))).filter(F.col("place") <= quotes)
    kept = first.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "evidence"))), lambda q: q["evidence"]).alias("evidence"))
    origin = F.when((F.col("rule") == 1) & (F.col("llm") == 1), "rule+llm").when(F.col("llm") == 1, "llm").otherwise("rule")
    return edges.join(kept, list(KEY), "left").select(
        *KEY, "head_type", "tail_type", origin.alias("origin"), "confidence", "sources",
        F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"), "extractors",
    )


def confirmed(edges: DataFrame, told: DataFrame, low: float = 0.95, high: float = 0.99) -> DataFrame:
    """Merged edges where a model's candidate (told) that repeats an edge raises its confidence to at least low and at most high.

    A triple repeats an edge if a rule found it too or the model gave it more than once.
    """
    times = told.groupBy(*KEY).agg(F.count("*").alias("times"))
    again = F.col("times").isNotNull() & (F.col("origin").contains("rule") | (F.col("times") > 1))
    raised = F.least(F.lit(high), F.greatest("confidence", F.lit(low)))
    return edges.join(times, list(KEY), "left").withColumn("confidence", F.when(again, raised).otherwise(F.col("confidence"))).select(*edges.columns)


def firing_counts(accepted: DataFrame) -> DataFrame:
    """Accepted candidates by extractor, before the merge."""
    return accepted.groupBy("extractor").agg(F.count("*").alias("fired"))


def budgeted(edges: DataFrame, most: int = 25) -> DataFrame:
    """At most so many edges of a head and relation by confidence; edges that a rule found do not count and all stay."""
    rank = F.row_number().over(W.partitionBy("head", "relation").orderBy(F.col("confidence").desc(), "tail"))
    exempt = edges.filter(F.col("origin").contains("rule"))
    return exempt.unionByName(edges.filter(~F.col("origin").contains("rule")).withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank"))


def pruned(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges between nodes, the others with the reason node_pruned)."""
    ids = nodes.select("id")
    both = edges.join(ids.withColumnRenamed("id", "head"), "head", "left_semi").join(ids.withColumnRenamed("id", "tail"), "tail", "left_semi")
    return both, edges.join(both.select(*KEY), list(KEY), "left_anti").withColumn("reason", F.lit("node_pruned"))
