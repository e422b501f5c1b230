"""Questions as a stream: each micro-batch is answered like a batch and appended to the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.ask import ask

QUESTION = "qid string, question string"


def answer_stream(spark: SparkSession, questions: str, edges: DataFrame, aliases: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Answers JSON questions that arrive in a folder. A batch that runs again after a failure replaces its own folder of the log."""

    def run(batch: DataFrame, number: int) -> None:
        got = ask(batch.dropDuplicates(["qid"]), edges, aliases)
        got.answers.select("qid", "question", "refused", "answer", "path_explanation").write.mode("overwrite").json(f"{log}/batch={number}")

    stream = spark.readStream.schema(QUESTION).json(questions)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(spark: SparkSession, events: str, schema: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """A stream of event tables as counts and sums by window and type, with late rows up to a watermark."""
    stream = spark.readStream.schema(schema).parquet(events).withColumn("at", F.col("ts").cast("timestamp"))
    return stream.withWatermark("at", late).groupBy(F.window("at", window), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
