"""Ranking of text chunks by character n-grams: tf-idf, cosine, top k, and quotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import char_grams, chunks, excerpt, quotable, without_particle, words


def chunked(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, offset, chunk): the overlapping windows of each document."""
    return documents.select(F.col(key).alias("doc"), F.inline(chunks(F.col(text))))


def term_counts(rows: DataFrame, *keys: str, text: str = "chunk") -> DataFrame:
    """(keys, gram, tf): damped counts of n-grams, 1 + ln(count)."""
    return rows.select(*keys, F.explode(char_grams(F.col(text))).alias("gram")).groupBy(*keys, "gram").agg((1 + F.log(F.count("*"))).alias("tf"))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("gram").agg(F.count("*").alias("df"))


def ranked(questions: DataFrame, parts: DataFrame, most: int = 5, least: float = 0.001) -> DataFrame:
    """(qid, doc, offset, score, rank): the best chunks of each question (qid, question).

    Only the grams of the questions take part in the join. The norm of a chunk needs all of its grams, and the frequency
    of a gram all chunks; both are aggregated once for the whole corpus. The limit comes before the threshold.
    """
    counts = term_counts(parts, "doc", "offset")
    total = parts.agg(F.count("*").alias("n"))
    idf = document_frequency(counts).crossJoin(F.broadcast(total)).select("gram", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    weighed = counts.join(idf, "gram").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighed.groupBy("doc", "offset").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    asked = term_counts(questions, "qid", text="question").join(idf, "gram").withColumn("qw", F.col("tf") * F.col("idf")).select("qid", "gram", "qw")
    lengths = asked.groupBy("qid").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    dots = weighed.join(asked, "gram").groupBy("qid", "doc", "offset").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    scored = dots.join(norms, ["doc", "offset"]).join(lengths, "qid").withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("qnorm")), 6))
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.col("score").desc(), "doc", "offset"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= most).filter(F.col("score") > least).select("qid", "doc", "offset", "score", "rank")


def quoted(questions: DataFrame, hits: DataFrame, parts: DataFrame, most: int = 4) -> DataFrame:
    """(qid, n, line): the sentences of the hits with most question words, limited before repeats go; else the beginnings of two hits."""
    raw = words(F.col("question"))
    asked = questions.select("qid", F.array_distinct(F.concat(raw, F.transform(raw, without_particle))).alias("keys"))
    rows = hits.join(parts, ["doc", "offset"]).join(asked, "qid")
    each = rows.select("qid", "rank", "doc", "keys", F.posexplode(quotable(F.col("chunk"))).alias("pos", "sentence"))
    scored = each.withColumn("hits", F.size(F.filter("keys", lambda k: F.contains(F.col("sentence"), k)))).filter("hits > 0")
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.col("hits").desc(), "rank", "pos"))
    chosen = scored.withColumn("n", place).filter(F.col("n") <= most).withColumn("first", F.min("n").over(W.partitionBy("qid", "sentence"))).filter("n = first")
    quotes = chosen.select("qid", "n", F.concat(F.lit("- ["), F.col("doc").cast("string"), F.lit("] "), "sentence").alias("line"))
    rest = rows.filter("rank <= 2").join(quotes.select("qid").distinct(), "qid", "left_anti")
    return quotes.unionByName(rest.select("qid", F.col("rank").alias("n"), F.concat(F.lit("- ["), F.col("doc").cast("string"), F.lit("] "), excerpt(F.col("chunk")), F.lit("...")).alias("line")))


def answered(questions: DataFrame, hits: DataFrame, quotes: DataFrame) -> DataFrame:
    """(qid, question, answer, sources): quotations under a heading, or that nothing was found."""
    lines = quotes.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    sources = hits.groupBy("qid").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"])).alias("sources"))
    rows = questions.join(sources, "qid", "left").join(lines, "qid", "left")
    answer = F.when(F.col("sources").isNull(), fixed.NOTHING_FOUND).otherwise(F.concat(F.lit(fixed.QUOTED), F.coalesce("lines", F.lit(""))))
    return rows.select("qid", "question", answer.alias("answer"), "sources")
