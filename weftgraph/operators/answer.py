"""Answers from ranked paths: refusal, summary, numbered path and sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from .paths import numbered, rendered, top


def supporting(best: DataFrame, most: int = 5) -> DataFrame:
    """The triples of the top paths of each question, once each, with their sources joined in order."""
    each = top(best, most).select("qid", "rank", F.explode("path").alias("s")).select("qid", "rank", F.col("s.hop").alias("hop"), "s.head", "s.relation", "s.tail", "s.origin", "s.confidence", "s.sources")
    order = F.array_sort(F.collect_list(F.struct("rank", "hop", "sources", "origin", "confidence")))
    grouped = each.groupBy("qid", "head", "relation", "tail").agg(order.alias("seen"))
    return grouped.select("qid", "head", "relation", "tail", F.get("seen", 0)["rank"].alias("rank"), F.get("seen", 0)["hop"].alias("hop"), F.get("seen", 0)["origin"].alias("origin"), F.get("seen", 0)["confidence"].alias("confidence"), F.array_distinct(F.flatten(F.transform("seen", lambda x: x["sources"]))).alias("sources"))


def _summary(seeds: Column, lines: Column, n: Column) -> Column:
    """The heading for the kind of question, with the number of candidates, and a line for each."""
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts), F.lit("\n"), lines)
    shown = F.concat(F.lit(fixed.UPPER), n.cast("string"))
    one, chain = fixed.ONE_STEP, fixed.CHAIN
    taken = F.when(F.get("best_path", 0)["relation"] == "PARTICIPATED_IN", one[1]).otherwise(one[2])
    reached = F.when(F.col("relation") == "FOUNDED", chain[1]).otherwise(chain[2])
    return (
        F.when(F.col("co") & (F.col("wanted") == "Event"), text(fixed.SEARCHED, seeds, fixed.CO_EVENT[0], shown, fixed.CO_EVENT[1]))
        .when(F.col("co"), text(fixed.SEARCHED, seeds, fixed.CO_ORGANIZATION[0], shown, fixed.CO_ORGANIZATION[1]))
        .when(F.size("best_path") == 1, text(seeds, one[0], taken, shown, one[3]))
        .when(F.col("wanted") == "Person", text(fixed.SEARCHED, seeds, fixed.PERSONS[0], shown, fixed.PERSONS[1]))
        .otherwise(text(fixed.SEARCHED, seeds, chain[0], reached, " ", shown, chain[3]))
    )


def composed(questions: DataFrame, found: DataFrame, best: DataFrame, gaps: DataFrame, most: int = 5) -> DataFrame:
    """(qid, refused, answer, path_explanation, ...): three blocks for each question, or the refusal.

    questions carry wanted, co and relation; gaps are the qids with unknown concepts.
    """
    ranked = top(best, most)
    lines = ranked.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("- "), "at", F.lit(fixed.GROUNDS), rendered(F.col("path")), F.lit(")")).alias("line")))).alias("lines"),
        F.min_by("path", "rank").alias("best_path"), F.count("*").alias("n"),
    )
    named = found.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node"))), lambda x: x["node"]).alias("seeds"))
    source = F.concat(F.lit("- ("), "head", F.lit(", "), "relation", F.lit(", "), "tail", F.lit(fixed.CITED), F.when(F.size("sources") > 0, F.array_join("sources", ", ")).otherwise(fixed.GRAPH_SOURCE), F.lit(" (origin: "), "origin", F.lit(", confidence: "), F.col("confidence").cast("string"), F.lit(")"))
    sources = supporting(best, most).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "hop", source.alias("line")))).alias("cited"))
    rows = questions.join(named, "qid", "left").join(lines, "qid", "left").join(sources, "qid", "left").join(gaps.select("qid", F.lit(True).alias("gap")).distinct(), "qid", "left")
    refused = F.col("best_path").isNull() | F.col("seeds").isNull() | F.coalesce("gap", F.lit(False))
    texts = lambda c: F.array_join(F.transform(c, lambda x: x["line"]), "\n")
    answer = F.concat(F.lit(f"{fixed.BLOCKS[0]}\n"), _summary(F.array_join("seeds", ", "), texts("lines"), F.col("n")), F.lit(f"\n\n{fixed.BLOCKS[1]}\n"), numbered(F.col("best_path")), F.lit(f"\n\n{fixed.BLOCKS[2]}\n"), texts("cited"))
    refusal = F.lit(f"{fixed.BLOCKS[0]}\n{fixed.REFUSAL}\n\n{fixed.BLOCKS[1]}\n{fixed.NO_PATH}\n\n{fixed.BLOCKS[2]}\n{fixed.NO_SOURCE}")
    return rows.select(
        "qid", "question", refused.alias("refused"), F.when(refused, refusal).otherwise(answer).alias("answer"),
        F.when(refused, fixed.NO_PATH).otherwise(rendered(F.col("best_path"))).alias("path_explanation"),
        F.when(~refused, F.col("best_path")).alias("traversed_path"), F.coalesce("seeds", F.array().cast("array<string>")).alias("seeds"),
    )


def guarded(answers: DataFrame, nodes: DataFrame, polish: Callable[[Column], Column] | None = None) -> DataFrame:
    """Answers with an optional polished summary, dropped where it names nodes that the answer does not, or misses its target.

    answers: qid, answer, polished, allowed (array), target. polish fills polished; null means there is none.
    """
    rows = answers.withColumn("polished", polish(F.col("answer"))) if polish else answers
    longest = F.array_sort("allowed", lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    rest = F.aggregate(longest, F.col("polished"), lambda text, name: F.replace(text, name, F.lit(" ")))
    open_ = rows.select("qid", "allowed", rest.alias("rest")).filter("rest is not null")
    strange = open_.join(nodes.filter(F.length("id") >= 2).select("id"), F.expr("contains(rest, id) and not array_contains(allowed, id)"), "left_semi").select("qid", F.lit(True).alias("strange"))
    kept = F.col("polished").isNotNull() & F.contains("polished", "target") & F.col("strange").isNull()
    return rows.join(strange.distinct(), "qid", "left").withColumn("final", F.when(kept, F.col("polished")).otherwise(F.col("answer"))).drop("strange")


def evidence_by_source(edges: DataFrame) -> DataFrame:
    """(source, quotes): the distinct quotations of each source in order of the edges."""
    each = edges.select(F.explode("sources").alias("source"), "head", "relation", "tail", "evidence").select("source", "head", "relation", "tail", F.posexplode("evidence").alias("pos", "quote"))
    first = each.groupBy("source", "quote").agg(F.min(F.struct("head", "relation", "tail", "pos")).alias("first"))
    return first.withColumn("n", F.row_number().over(W.partitionBy("source").orderBy("first", "quote"))).select("source", "n", "quote")
