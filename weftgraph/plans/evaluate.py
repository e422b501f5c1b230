"""A golden set through the graph and the control, scored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate as V
from ..sources.stage import written
from .ask import ask, ask_texts


def evaluate(items: DataFrame, expected: DataFrame, edges: DataFrame, aliases: DataFrame, parts: DataFrame | None = None, reverse: bool = False) -> dict[str, DataFrame]:
    """Frames items, by_hops, overall and layers for golden items (item_id, hops, question, expected, answerable)."""
    questions = items.select(F.col("item_id").alias("qid"), "question")
    got = ask(questions, edges, aliases, reverse=reverse)
    answers = written(got.answers.withColumnRenamed("qid", "item_id"), "answers")
    context = written(got.context.withColumnRenamed("qid", "item_id"), "context")
    control = ask_texts(questions, parts).withColumnRenamed("qid", "item_id") if parts is not None else None
    rows = V.scored(items, answers, V.path_recall(items, expected, context), control)
    absent = V.found_in(expected, context, "item_id").filter("hit = 0")
    rows = written(V.failure_layer(rows, V.missing(expected, edges), absent), "items")
    return {"items": rows, "by_hops": V.by_hops(rows), "overall": V.overall(rows), "layers": V.layer_counts(rows)}


def markdown(by_hops: DataFrame, overall: DataFrame, layers: DataFrame) -> str:
    """A short report of tables that have a row a hop count, one row, and a row a layer."""
    table = lambda frame, order: "\n".join(["| " + " | ".join(frame.columns) + " |", "|" + "-|" * len(frame.columns), *("| " + " | ".join(str(v) for v in row) + " |" for row in frame.orderBy(order).collect())])
    return "\n\n".join(["# Evaluation", "## By hops", table(by_hops, "hops"), "## Overall", table(overall, "answerable"), "## Failure layers", table(layers, "layer")]) + "\n"
