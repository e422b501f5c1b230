"""Path templates over typed edges, their scores, the best for each target, and the context they give.

A template is a list of steps; each step is one join of the paths so far with the edges, from the seeds on, so the
number of paths grows with the seeds and not with the graph. Questions are rows: a batch is answered at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.rules import edge_weight
from .graph import HUB_DEGREE, adjacency, degree_penalty


@dataclass(frozen=True)
class Step:
    """A relation to follow to a node type; forward leaves the head, reverse the tail, either takes both."""

    relation: str
    to: str
    direction: str = "either"


PART_OF_EVENT = Step("PARTICIPATED_IN", "Event")
PEOPLE_OF_EVENT = Step("PARTICIPATED_IN", "Person")
FOUNDED = Step("FOUNDED", "Organization", "forward")
ORGANIZATION_IN_EVENT = Step("PARTICIPATED_IN", "Event", "forward")
TO_ORGANIZATION = (PART_OF_EVENT, PEOPLE_OF_EVENT, FOUNDED)
TO_EVENT = (*TO_ORGANIZATION, ORGANIZATION_IN_EVENT)
#: Reverse templates, off in the parity mode: who took part in an event, who founded an organization, and their chain.
EVENT_PEOPLE = (Step("PARTICIPATED_IN", "Person", "reverse"),)
ORGANIZATION_FOUNDERS = (Step("FOUNDED", "Person", "reverse"),)
PERSON_ORGANIZATION_EVENT = (FOUNDED, ORGANIZATION_IN_EVENT)


def steps_of(edges: DataFrame) -> DataFrame:
    """Edges as steps from either end, with weight and the fields that a path keeps."""
    weighed = edges.withColumn("weight", edge_weight(F.col("confidence"), F.col("head"), F.col("tail"), F.col("sources")))
    return adjacency(weighed).select("node", "other", "other_type", "direction", "relation", "head", "tail", "weight", "confidence", "origin", "sources")


def start(seeds: DataFrame) -> DataFrame:
    """Paths of no step from seeds (qid, node)."""
    return seeds.select("qid", F.col("node").alias("seed"), F.col("node").alias("at"), F.array("node").alias("nodes"), F.lit(1.0).alias("score"), F.array().cast(PATH).alias("path"))


PATH = "array<struct<hop:int,from_node:string,to_node:string,direction:string,head:string,relation:string,tail:string,weight:double,confidence:double,origin:string,sources:array<string>>>"


def followed(paths: DataFrame, steps: DataFrame, step: Step, hop: int) -> DataFrame:
    """Paths longer by one step."""
    fitting = steps.filter((F.col("relation") == step.relation) & (F.col("other_type") == step.to))
    if step.direction != "either":
        fitting = fitting.filter(F.col("direction") == step.direction)
    made = F.struct(F.lit(hop).alias("hop"), F.col("at").alias("from_node"), F.col("other").alias("to_node"), *(F.col(c) for c in ("direction", "head", "relation", "tail", "weight", "confidence", "origin", "sources")))
    return paths.join(fitting, F.col("at") == F.col("node")).select("qid", "seed", F.col("other").alias("at"), F.concat("nodes", F.array("other")).alias("nodes"), (F.col("score") * F.col("weight")).alias("score"), F.concat("path", F.array(made)).alias("path"))


def along(paths: DataFrame, steps: DataFrame, template: tuple[Step, ...]) -> DataFrame:
    for hop, step in enumerate(template, 1):
        paths = followed(paths, steps, step, hop)
    return paths


def co_participants(seeds: DataFrame, steps: DataFrame, events: DataFrame | None = None, to_event: bool = False) -> DataFrame:
    """Organizations that other participants of the seeds' events founded, or further events of those.

    The other person is none of the question's seeds; events (qid, event) restrict the first one; the last event differs from it.
    """
    first = followed(start(seeds), steps, PART_OF_EVENT, 1)
    if events is not None:
        named = events.select("qid", F.col("event").alias("at"))
        some = named.select("qid").distinct()
        first = first.join(named, ["qid", "at"], "left_semi").unionByName(first.join(some, "qid", "left_anti"))
    second = followed(first, steps, PEOPLE_OF_EVENT, 2)
    second = second.join(seeds.select("qid", F.col("node").alias("at")), ["qid", "at"], "left_anti")
    found = followed(second, steps, FOUNDED, 3)
    if not to_event:
        return found
    return followed(found, steps, ORGANIZATION_IN_EVENT, 4).filter(F.col("at") != F.get("nodes", 1))


def one_hop(seeds: DataFrame, steps: DataFrame) -> DataFrame:
    """Forward edges of seeds (qid, node, relation, wanted) with the relation asked for, to the type wanted if any is."""
    made = F.struct(F.lit(1).alias("hop"), F.col("s.node").alias("from_node"), F.col("other").alias("to_node"), *(F.col(f"e.{c}").alias(c) for c in ("direction", "head", "relation", "tail", "weight", "confidence", "origin", "sources")))
    match = (F.col("s.node") == F.col("e.node")) & (F.col("s.relation") == F.col("e.relation")) & (F.col("s.wanted").isNull() | (F.col("s.wanted") == F.col("e.other_type")))
    joined = seeds.alias("s").join(steps.filter("direction = 'forward'").alias("e"), match)
    return joined.select("qid", F.col("s.node").alias("seed"), F.col("other").alias("at"), F.array("s.node", "other").alias("nodes"), F.col("weight").alias("score"), F.array(made).cast(PATH).alias("path"))


def intersected(seeds: DataFrame, steps: DataFrame) -> DataFrame:
    """Persons that took part in a seed event and founded a seed organization: path by the first edge of each kind."""
    joined = seeds.select("qid", "node", F.col("type").alias("seed_type")).join(steps.filter("other_type = 'Person'"), "node")
    side = F.when((F.col("seed_type") == "Event") & (F.col("relation") == "PARTICIPATED_IN"), "event").when((F.col("seed_type") == "Organization") & (F.col("relation") == "FOUNDED"), "organization")
    found = joined.withColumn("side", side).filter("side is not null")
    edge = F.struct("head", "relation", "tail", "weight", "confidence", "origin", "sources")
    persons = found.groupBy("qid", F.col("other").alias("at")).agg(F.min(F.when(F.col("side") == "event", edge)).alias("e"), F.min(F.when(F.col("side") == "organization", edge)).alias("o")).filter("e is not null and o is not null")
    as_step = lambda hop, c, from_, to, way: F.struct(F.lit(hop).alias("hop"), from_.alias("from_node"), to.alias("to_node"), F.lit(way).alias("direction"), *(F.col(f"{c}.{x}").alias(x) for x in ("head", "relation", "tail", "weight", "confidence", "origin", "sources")))
    path = F.array(as_step(1, "o", F.col("o.tail"), F.col("at"), "reverse"), as_step(2, "e", F.col("at"), F.col("e.tail"), "forward")).cast(PATH)
    return persons.select("qid", F.col("o.tail").alias("seed"), "at", F.array("o.tail", "at", "e.tail").alias("nodes"), (F.col("o.weight") * F.col("e.weight")).alias("score"), path.alias("path"))


def best_by_target(paths: DataFrame) -> DataFrame:
    """The path with the highest score to each target of a question; ties go to the smaller nodes."""
    rank = F.row_number().over(W.partitionBy("qid", "at").orderBy(F.col("score").desc(), "nodes"))
    return paths.withColumn("place", rank).filter("place = 1").drop("place")


def top(best: DataFrame, most: int = 5) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.col("score").desc(), "nodes"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= most)


def context(paths: DataFrame, seeds: DataFrame, steps: DataFrame, most: int = 60) -> DataFrame:
    """Triples of a question's paths in the order of their nodes, then the seeds' own edges, once each, up to the limit."""
    of_paths = paths.select("qid", F.lit(0).alias("turn"), F.concat_ws(">", "nodes").alias("ord"), F.explode("path").alias("s")).select("qid", "turn", "ord", F.col("s.hop").alias("hop"), "s.head", "s.relation", "s.tail")
    of_seeds = seeds.select("qid", "node").join(steps, "node").select("qid", F.lit(1).alias("turn"), F.col("node").alias("ord"), F.lit(0).alias("hop"), "head", "relation", "tail")
    once = of_paths.unionByName(of_seeds).groupBy("qid", "head", "relation", "tail").agg(F.min(F.struct("turn", "ord", "hop")).alias("first"))
    rank = F.row_number().over(W.partitionBy("qid").orderBy("first", "head", "relation", "tail"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= most).select("qid", "rank", "head", "relation", "tail", F.col("first.turn").alias("turn"))


def _inner(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes between the ends of each path, with their degrees."""
    inside = paths.select("qid", "nodes", F.explode(F.array_distinct(F.slice("nodes", 2, F.greatest(F.size("nodes") - 2, F.lit(0))))).alias("id"))
    return inside.join(nodes.select("id", "degree"), "id")


def penalised(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Paths whose score is lowered by the degree penalty of each node that they pass."""
    factors = _inner(paths, nodes).groupBy("qid", "nodes").agg(F.product(degree_penalty(F.col("degree"))).alias("factor"))
    return paths.join(factors, ["qid", "nodes"], "left").withColumn("score", F.col("score") * F.coalesce("factor", F.lit(1.0))).drop("factor")


def without_hubs(paths: DataFrame, nodes: DataFrame, threshold: int = HUB_DEGREE) -> tuple[DataFrame, DataFrame]:
    """(paths that pass no hub, the hubs (qid, id, degree, paths) that others would pass)."""
    passed = _inner(paths, nodes).filter(F.col("degree") > threshold)
    kept = paths.join(passed.select("qid", "nodes").distinct(), ["qid", "nodes"], "left_anti")
    return kept, passed.groupBy("qid", "id").agg(F.max("degree").alias("degree"), F.count("*").alias("paths"))


def context_sources(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(qid, sources): the sorted sources of a question's context triples."""
    each = found.join(edges.select("head", "relation", "tail", "sources"), ["head", "relation", "tail"]).select("qid", F.explode("sources").alias("source"))
    return each.groupBy("qid").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def hops_used(best: DataFrame) -> DataFrame:
    return best.groupBy("qid").agg(F.coalesce(F.max(F.size("path")), F.lit(1)).alias("hops_used"))


def visited(seeds: DataFrame, best: DataFrame) -> DataFrame:
    """The sorted nodes of a question's seeds and best paths."""
    every = seeds.select("qid", "node").unionByName(best.select("qid", F.explode("nodes").alias("node")))
    return every.groupBy("qid").agg(F.array_sort(F.collect_set("node")).alias("visited"))


def rendered(path: Column) -> Column:
    """A -[R]-> B <-[R]- C."""
    arrow = lambda s: F.when(s["direction"] == "forward", F.concat(F.lit("-["), s["relation"], F.lit("]->"))).otherwise(F.concat(F.lit("<-["), s["relation"], F.lit("]-")))
    return F.array_join(F.transform(path, lambda s, i: F.concat(F.when(i == 0, F.concat(s["from_node"], F.lit(" "))).otherwise(""), arrow(s), F.lit(" "), s["to_node"])), " ")


def numbered(path: Column) -> Column:
    """One line for each step, reverse ones marked."""
    line = lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), rendered(F.array(s)), F.when(s["direction"] == "reverse", fixed.REVERSED_STEP).otherwise(""))
    return F.array_join(F.transform(path, line), "\n")


def _sides(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(head, event) of participations and (b, organization) of foundings."""
    part = edges.filter("relation = 'PARTICIPATED_IN'").select("head", F.col("tail").alias("event")).distinct()
    return part, edges.filter("relation = 'FOUNDED'").select(F.col("head").alias("b"), F.col("tail").alias("organization")).distinct()


def pattern_counts(edges: DataFrame) -> DataFrame:
    """(event, patterns, organizations) of the patterns (a, event, b, organization): a and b took part in the event and b founded the organization.

    The pairs of a and b are counted and never listed: a founder has as many patterns as there are others in the event.
    """
    part, founded = _sides(edges)
    people = part.groupBy("event").agg(F.count("*").alias("people"))
    bridges = part.withColumnRenamed("head", "b").join(founded, "b").filter("organization <> event")
    # An organization that takes part itself is not its own first person.
    own = part.select("event", F.col("head").alias("organization"), F.lit(1).alias("inside"))
    each = bridges.join(people, "event").join(own, ["event", "organization"], "left")
    each = each.withColumn("others", F.col("people") - 1 - F.when(F.col("organization") != F.col("b"), F.coalesce("inside", F.lit(0))).otherwise(0)).filter("others > 0")
    return each.groupBy("event").agg(F.sum("others").alias("patterns"), F.count_distinct("organization").alias("organizations"))


def bridges(edges: DataFrame, most: int = 10, per_event: int = 2, after: str | None = None, upto: str | None = None) -> DataFrame:
    """(a, event, b, organization), the least organization of each a, event and b, that a choice of so many patterns can need; of the a after one name and up to another, if given.

    Of an event's founders only the first most + per_event + 1 can be chosen: so many others at most are a itself or taken already.
    """
    part, founded = _sides(edges)
    asked = part
    if after is not None:
        asked = asked.filter(F.col("head") > after)
    if upto is not None:
        asked = asked.filter(F.col("head") <= upto)
        part = part.join(asked.select("event").distinct(), "event", "left_semi")
    pairs = part.withColumnRenamed("head", "b").join(founded, "b").filter("organization <> event")
    # The two least organizations of a founder, as one of them may be a.
    least = pairs.withColumn("n", F.row_number().over(W.partitionBy("event", "b").orderBy("organization"))).filter("n <= 2").groupBy("event", "b").agg(F.array_sort(F.collect_list("organization")).alias("organizations"))
    first = least.withColumn("n", F.row_number().over(W.partitionBy("event").orderBy("b"))).filter(F.col("n") <= most + per_event + 1)
    joined = asked.withColumnRenamed("head", "a").join(first, "event").filter("a <> b")
    return joined.select("a", "event", "b", F.get(F.filter("organizations", lambda o: o != F.col("a")), 0).alias("organization")).filter("organization is not null")


def golden_marked(patterns: DataFrame, items: DataFrame, expected: DataFrame) -> DataFrame:
    """patterns (a, event, b, organization) with goldenset_id, the item whose first three expected triples they are; then the items' patterns that were not among them.

    items (item_id, hops, type, answerable) count if they ask for a path of two hops or more; of items with the same path the
    last by item_id marks a pattern, and the first names one that is added. An unanswerable item adds none.
    """
    asked = items.filter("type = 'path' and hops >= 2").select("item_id", F.coalesce("answerable", F.lit(True)).alias("answerable"))
    steps = expected.filter("n < 3").join(asked, "item_id").groupBy("item_id", "answerable").agg(F.array_sort(F.collect_list(F.struct("n", "head", "relation", "tail"))).alias("t"))
    paths = steps.filter(F.size("t") == 3)
    signature = F.transform("t", lambda s: F.struct(s["head"].alias("head"), s["relation"].alias("relation"), s["tail"].alias("tail")))
    used = paths.select("item_id", "answerable", signature.alias("path"))
    marks = used.groupBy("path").agg(F.max("item_id").alias("goldenset_id"))
    step = lambda head, relation, tail: F.struct(F.col(head).alias("head"), F.lit(relation).alias("relation"), F.col(tail).alias("tail"))
    own = patterns.withColumn("path", F.array(step("a", "PARTICIPATED_IN", "event"), step("b", "PARTICIPATED_IN", "event"), step("b", "FOUNDED", "organization")))
    more = used.filter("answerable").groupBy("path").agg(F.min("item_id").alias("goldenset_id")).join(own.select("path"), "path", "left_anti")
    added = more.select(F.col("path")[0]["head"].alias("a"), F.col("path")[0]["tail"].alias("event"), F.col("path")[1]["head"].alias("b"), F.col("path")[2]["tail"].alias("organization"), "goldenset_id", F.lit(True).alias("added"))
    return own.join(marks, "path", "left").select("a", "event", "b", "organization", "goldenset_id", F.lit(False).alias("added")).unionByName(added)


def first_patterns(edges: DataFrame, write: Callable[[DataFrame], DataFrame], most: int = 10, per_event: int = 2, people: tuple[int, ...] = (16, 4096)) -> list[tuple[str, str, str, str]]:
    """diverse_patterns of the whole graph. The choice goes up in a, so the first so many people are asked, then more if
    there are not enough patterns, and at last all that are left; write stores the few patterns of a stretch."""
    heads = _sides(edges)[0].select("head").distinct()
    chosen: list[tuple[str, str, str, str]] = []
    after = None
    for n in (*people, None):
        left = heads if after is None else heads.filter(F.col("head") > after)
        upto = left.orderBy("head").limit(n).agg(F.max("head").alias("last")).first()["last"] if n else None
        if n and upto is None:
            break
        chosen = diverse_patterns(write(bridges(edges, most, per_event, after, upto)), most, per_event, chosen)
        if len(chosen) >= most:
            break
        after = upto
    return chosen


def diverse_patterns(patterns: DataFrame, most: int = 10, per_event: int = 2, before: Sequence[tuple[str, str, str, str]] = ()) -> list[tuple[str, str, str, str]]:
    """A greedy choice in alphabetical order: an event at most twice, a bridge person once; before are those chosen already.

    Sequential by nature, in ``most`` rounds. What is refused once stays so, so that each round is the least row that is not refused.
    """
    chosen = list(before)
    while len(chosen) < most:
        events = [e for _, e, _, _ in chosen]
        free = patterns.filter(~F.col("b").isin([b for _, _, b, _ in chosen]) & ~F.col("event").isin([e for e in set(events) if events.count(e) >= per_event]))
        least = free.agg(F.min(F.struct("a", "event", "b", "organization")).alias("least")).first()["least"]
        if least is None:
            break
        chosen.append(tuple(least))
    return chosen
