"""Helpers the training-data operators share: table access and shared-folder tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A key is hot if it holds over this part of all rows, so there are fewer hot keys than this.
HOT_KEYS = 1000
#: Words are maximal runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied Parquet tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see: spark.checkpoint.dir. Only a local master may leave it unset (tests) and gets a temporary one."""
    context = spark.sparkContext
    known = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not known:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="weftgraph-"))
        known = context.getCheckpointDir()
    return known.rstrip("/")


def _target(spark: SparkSession, name: str) -> str:
    ship(spark)
    target = f"{shared_dir(spark)}/weftgraph/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return target


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Cuts the lineage: what a lost executor held is reread, not recomputed. The
    folder is deleted when the driver's JVM ends.
    """
    spark = df.sparkSession
    target = _target(spark, name)
    df.write.option("compression", codec).parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def materialize_by(df: DataFrame, name: str, part: str, codec: str = "zstd") -> tuple[DataFrame, Callable[[int], None]]:
    """Like materialize, in a folder for each value of an int column; the function deletes one that is used up."""
    spark = df.sparkSession
    target = _target(spark, name)
    df.write.option("compression", codec).partitionBy(part).parquet(target)

    def drop(value: int) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{part}={value}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return spark.read.schema(df.schema).parquet(target), drop


def looked_up(left: DataFrame, right: DataFrame, key: str, count: str) -> DataFrame:
    """left with the other columns of right, which has one row for each of left's keys and the number of left's rows with it in count.

    Hot keys are broadcast: by their counts there are fewer than HOT_KEYS. Rows of the other keys meet by a shuffle, in which
    the rows of hot keys are spread over all tasks and meet nothing. right is read several times, so it should be written.
    """
    total = right.agg(F.sum(count).alias("n")).first()["n"] or 0
    others = [c for c in right.columns if c not in (key, count)]
    found = lambda name: F.struct(F.lit(1).alias("_"), *others).alias(name)
    hot = right.filter(F.col(count) * HOT_KEYS > total).select(F.col(key).alias("hot_key"), found("hot_found"))
    rest = right.filter(F.col(count) * HOT_KEYS <= total).select(F.col(key).alias("rest_key"), F.lit(0).cast("long").alias("rest_salt"), found("rest_found"))
    salt = F.when(F.col("hot_found").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(*left.columns), F.lit(1 << 20)) + 1)
    rows = left.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left").withColumn("hot_salt", salt)
    rows = rows.join(rest, (F.col(key) == F.col("rest_key")) & (F.col("hot_salt") == F.col("rest_salt")), "left")
    both = F.coalesce("hot_found", "rest_found")
    return rows.filter(both.isNotNull()).select(*left.columns, *(both[c].alias(c) for c in others))


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """(hot_key, salts) for the keys over more than one in HOT_KEYS of df's rows; a salt has no more rows than that part, and there are fewer than 2 * HOT_KEYS salts."""
    counts = materialize(df.groupBy(key).agg(F.count("*").alias("n")), "counts")
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 1
    salts = F.least(F.col("n"), F.ceil(F.col("n") * HOT_KEYS / total)).cast("int")
    return counts.filter(F.col("n") * HOT_KEYS > total).select(F.col(key).alias("hot_key"), salts.alias("salts"))


def dealt(left: DataFrame, right: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """left and right joined by key; left's rows of a hot key are dealt out over its salts, and right's are repeated for each.

    Unlike looked_up, right may have several rows for a key, and wide ones: nothing of it is broadcast.
    """
    marked = lambda df: df.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left")
    salt = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*left.columns), F.col("salts"))).cast("int")
    repeats = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
    rows = marked(left).select(*left.columns, salt.alias("hot_salt"))
    return rows.join(marked(right).select(*right.columns, repeats.alias("hot_salt")), [key, "hot_salt"]).drop("hot_salt")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str | Column) -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_count(column: str | Column) -> Column:
    """Number of words of a text as long, 0 for null."""
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")
