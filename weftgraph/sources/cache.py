"""Answers of a remote model by the digest of what was asked: a left join, and only misses are asked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cache_key
from .stage import written

ENTRY = "key string, answer string"


def looked_up(asked: DataFrame, cache: DataFrame, *columns: str) -> DataFrame:
    """asked with its key and the cached answer, null where there is none."""
    keyed = asked.withColumn("key", cache_key(*(F.col(c) for c in columns)))
    return keyed.join(cache.select("key", F.col("answer").alias("cached")), "key", "left")


def answered(asked: DataFrame, cache: DataFrame, ask: Callable[[Column], Column] | None, prompt: str, *columns: str) -> DataFrame:
    """asked with answers from the cache, and from the model where it has none; without a model they stay null."""
    rows = looked_up(asked, cache, *columns)
    fresh = F.when(F.col("cached").isNull(), ask(F.col(prompt))) if ask else F.lit(None).cast("string")
    return rows.withColumn("answer", F.coalesce("cached", fresh))


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(key, answer) of a stored cache, one answer a key; empty where there is none yet."""
    try:
        return spark.read.schema(ENTRY).parquet(path).groupBy("key").agg(F.min("answer").alias("answer"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ENTRY)


def remembered(asked: DataFrame, path: str, ask: Callable[[Column], Column] | None, prompt: str, *columns: str) -> DataFrame:
    """asked with key, cached, answer and status. Each key that is not stored is asked once, and what comes back is appended to the store.

    Only new entries are written, in one commit, so that readers see all of them or none; a failed answer (null) is not stored.
    status is hit, call (asked and answered), error (asked without an answer) or skipped (there is no model).
    """
    rows = looked_up(asked, entries(asked.sparkSession, path), *columns)
    if ask is None:
        return rows.withColumn("answer", F.col("cached")).withColumn("status", F.when(F.col("cached").isNull(), "skipped").otherwise("hit"))
    missed = rows.filter("cached is null").groupBy("key").agg(F.min(prompt).alias(prompt))
    fresh = written(missed.select("key", ask(F.col(prompt)).alias("fresh")), "answers")
    fresh.filter("fresh is not null").select("key", F.col("fresh").alias("answer")).write.mode("append").parquet(path)
    status = F.when(F.col("cached").isNotNull(), "hit").when(F.col("fresh").isNotNull(), "call").otherwise("error")
    return written(rows.join(fresh, "key", "left").select(*rows.columns, F.coalesce("cached", "fresh").alias("answer"), status.alias("status")), "remembered")


def counters(rows: DataFrame, store: DataFrame) -> DataFrame:
    """One row: rows of ``remembered`` by status, misses (asked, answered or not), and the entries of the store."""
    n = lambda *kinds: F.count(F.when(F.col("status").isin(*kinds), 1))
    counts = rows.agg(n("hit").alias("hit"), n("call", "error").alias("miss"), n("call").alias("call"), n("error").alias("error"), n("skipped").alias("skipped"))
    return counts.crossJoin(store.agg(F.count("*").alias("cached_entries")))
