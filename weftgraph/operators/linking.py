"""Questions to seeds: aliases contained in a question, and concepts that the graph does not know."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.rules import co_participant, route, seed_score, target_relation, target_type, type_priority
from ..functions.text import without_particle

#: An alias table up to this many rows is broadcast and tested by a loop; a larger one meets substrings by equality.
BROADCAST_ALIASES = 1_000


def contained(questions: DataFrame, aliases: DataFrame, least: int = 2) -> DataFrame:
    """(qid, question, surface, id, type) for aliases that a question contains.

    A small alias table is broadcast and tested on every question. For a larger one the question's
    substrings of the lengths that aliases have are joined by equality instead: no nested loop at any size.
    """
    usable = aliases.filter(F.length("surface") >= least)
    if usable.limit(BROADCAST_ALIASES + 1).count() <= BROADCAST_ALIASES:
        return questions.join(F.broadcast(usable), F.expr("contains(question, surface)")).select("qid", "question", "surface", "id", "type")
    parts = questions.select("qid", "question", F.explode(substrings(F.col("question"), _lengths(usable, "surface"))).alias("surface"))
    return parts.join(usable, "surface").select("qid", "question", "surface", "id", "type")


def _lengths(rows: DataFrame, column: str) -> list[int]:
    """The different lengths of a column of names, of which there are few."""
    return sorted(r[0] for r in rows.select(F.length(column)).distinct().collect() if r[0])


def substrings(text: Column, lengths: list[int]) -> Column:
    """The different substrings of a text that have one of the lengths."""
    part_of = lambda n: lambda i: F.substring(text, i, F.lit(n))
    parts = [F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), part_of(n))).otherwise(F.array().cast("array<string>")) for n in lengths]
    return F.array_distinct(F.flatten(F.array(*parts))) if parts else F.array().cast("array<string>")


def seeds(questions: DataFrame, aliases: DataFrame, least: int = 2) -> DataFrame:
    """Seeds of each question: the longest surface of a node, ranked by type, score and length."""
    found = contained(questions, aliases, least)
    longest = F.row_number().over(W.partitionBy("qid", "id").orderBy(F.length("surface").desc(), "surface"))
    one = found.withColumn("place", longest).filter("place = 1").withColumn("score", seed_score(F.col("surface"), F.col("question"), F.col("type")))
    rank = F.row_number().over(W.partitionBy("qid").orderBy(type_priority(F.col("type")).desc(), F.col("score").desc(), F.length("surface").desc(), "surface", "id"))
    return one.select("qid", "surface", F.col("id").alias("node"), "type", "score", rank.alias("rank"))


def intent(questions: DataFrame) -> DataFrame:
    q = F.col("question")
    return questions.select("*", target_type(q).alias("wanted"), co_participant(q).alias("co"), target_relation(q).alias("relation"), route(q).alias("route"))


def _concepts(question: Column, surfaces: Column) -> Column:
    rest = F.aggregate(surfaces, question, lambda text, s: F.replace(text, s, F.lit(" ")))
    words = F.regexp_extract_all(rest, F.lit("([가-힣]{2,})"), F.lit(1))
    return F.transform(words, lambda w: F.struct(w.alias("word"), without_particle(w).alias("stem")))


def unknown_concepts(questions: DataFrame, found: DataFrame, aliases: DataFrame) -> DataFrame:
    """(qid, word) of words that are neither common nor part of any alias."""
    surfaces = found.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "surface"))), lambda x: x["surface"]).alias("surfaces"))
    rows = questions.join(surfaces, "qid", "left").withColumn("surfaces", F.coalesce("surfaces", F.array().cast("array<string>")))
    words = rows.select("qid", F.explode(F.array_distinct(_concepts(F.col("question"), F.col("surfaces")))).alias("c")).select("qid", "c.word", "c.stem")
    common = F.col("stem").isin(*fixed.COMMON_WORDS) | F.col("word").isin(*fixed.COMMON_WORDS)
    asked, known = words.filter(~common), aliases.select("surface").distinct()
    if known.limit(BROADCAST_ALIASES + 1).count() <= BROADCAST_ALIASES:
        return asked.join(F.broadcast(known), F.expr("contains(surface, stem)"), "left_anti").select("qid", "word")
    parts = known.select(F.explode(substrings(F.col("surface"), _lengths(asked, "stem"))).alias("stem")).distinct()
    return asked.join(parts, "stem", "left_anti").select("qid", "word")
