"""Questions to answers over a graph, a batch at a time; and the text control."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import answer as A
from ..operators import linking as L
from ..operators import paths as P
from ..operators import tfidf as R
from ..sources.stage import written


@dataclass(frozen=True)
class Answers:
    answers: DataFrame
    context: DataFrame
    best: DataFrame
    seeds: DataFrame


def ask(questions: DataFrame, edges: DataFrame, aliases: DataFrame, max_triples: int = 60, reverse: bool = False) -> Answers:
    """Answers of questions (qid, question). reverse also follows the templates that end in persons, which parity leaves out."""
    asked = L.intent(questions)
    # Every template reads the seeds and the steps.
    found = written(L.seeds(questions, aliases), "seeds")
    steps = written(P.steps_of(edges), "steps")
    rows = found.join(asked.select("qid", "question", "wanted", "co", "relation"), "qid")
    # A question without a person among its seeds starts from all of them.
    persons = rows.groupBy("qid").agg(F.max((F.col("type") == "Person").cast("int")).alias("persons"), F.count("*").alias("n"))
    rows = rows.join(persons, "qid")
    starts = rows.filter("co and (persons = 0 or type = 'Person')")
    events = rows.filter("co and type = 'Event'").select("qid", F.col("node").alias("event"))
    battle = F.col("question").rlike(fixed.BATTLE_QUESTION)
    to_organization = P.co_participants(starts.filter("wanted = 'Organization'"), steps, events)
    to_event = P.co_participants(starts.filter("wanted = 'Event'"), steps, events, to_event=True)
    ends = rows.select("qid", "question").distinct()
    to_event = to_event.join(ends, "qid").filter(~F.col("question").contains(fixed.BATTLE_WORD) | F.col("at").rlike(fixed.BATTLE_NAME)).drop("question")
    common = P.intersected(rows.filter("not co and wanted = 'Person' and n >= 2"), steps)
    near = P.one_hop(rows.filter("not co and not (coalesce(wanted, '') = 'Person' and n >= 2)").select("qid", "node", "relation", "wanted"), steps)
    paths = to_organization.unionByName(to_event)
    bonus = F.when(battle & F.get("nodes", 1).rlike(fixed.BATTLE_NAME), 1.5).otherwise(1.0)
    paths = paths.join(ends, "qid").withColumn("score", F.col("score") * bonus).drop("question").unionByName(common).unionByName(near)
    if reverse:
        singles = rows.filter("not co and n = 1")
        paths = paths.unionByName(P.along(P.start(singles.filter("type = 'Event' and wanted = 'Person'")), steps, P.EVENT_PEOPLE))
        paths = paths.unionByName(P.along(P.start(singles.filter("type = 'Organization' and wanted = 'Person'")), steps, P.ORGANIZATION_FOUNDERS))
        paths = paths.unionByName(P.along(P.start(singles.filter("type = 'Person' and wanted = 'Event'")), steps, P.PERSON_ORGANIZATION_EVENT))
    paths = written(paths, "paths")
    best = P.best_by_target(paths)
    gaps = L.unknown_concepts(questions, found, aliases)
    context = P.context(paths, found, steps, max_triples)
    return Answers(A.composed(asked, found, best, gaps), context, best, found)


def run_records(questions: DataFrame, got: Answers, edges: DataFrame, start_hops: int = 2, max_hops: int = 3) -> DataFrame:
    """What is logged of each question: intent, seeds, path, context, sources, and whether a second, wider try was due.

    The second try would read the same templates again, so it is a column and not a loop.
    """
    triples = got.context.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "head", "relation", "tail"))), lambda t: F.struct(t["head"], t["relation"], t["tail"])).alias("context_triples"))
    rows = L.intent(questions).select("qid", "route", "co", "wanted").join(got.answers, "qid").join(triples, "qid", "left")
    rows = rows.join(P.context_sources(got.context, edges), "qid", "left").join(P.hops_used(got.best), "qid", "left").join(P.visited(got.seeds, got.best).withColumnRenamed("visited", "visited_nodes"), "qid", "left")
    co_start = F.when(F.col("wanted") == "Event", max_hops + 1).otherwise(max_hops)
    first, last = F.when(F.col("co"), co_start).otherwise(start_hops), F.when(F.col("co"), co_start).otherwise(max_hops)
    return rows.select("*", (F.col("refused") & (first < last)).alias("deepened")).drop("co", "wanted").withColumn("hops_used", F.coalesce("hops_used", F.lit(1)))


def ask_deepening(questions: DataFrame, edges: DataFrame, aliases: DataFrame, start_hops: int = 2, max_hops: int = 3, wider: bool = False) -> DataFrame:
    """Answers with the rounds that they took: a question without one is asked again while its hops are below its limit.

    The rounds are bounded by the difference of the hops. Questions about co-participants start at their limit and have one round. A later
    round reads the same templates, so it changes nothing but the count, unless wider lets it also follow those that end in persons.
    """
    co = L.intent(questions).select("qid", "co")
    got = ask(questions, edges, aliases).answers.withColumn("rounds", F.lit(1))
    for turn in range(2, max(max_hops - start_hops, 0) + 2):
        got = written(got, "answers")
        again = got.filter("refused").join(co.filter("not co"), "qid", "left_semi").select("qid")
        if again.isEmpty():
            break
        more = ask(questions.join(again, "qid", "left_semi"), edges, aliases, reverse=wider).answers.withColumn("rounds", F.lit(turn))
        got = got.join(again, "qid", "left_anti").unionByName(more)
    return got


def ask_texts(questions: DataFrame, parts: DataFrame) -> DataFrame:
    """The control: quotations from the best chunks."""
    hits = written(R.ranked(questions, parts), "hits")
    return R.answered(questions, hits, R.quoted(questions, hits, parts))
