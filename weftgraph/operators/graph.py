"""Node tables and whole-graph statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


HUB_DEGREE = 25


def nodes_of(edges: DataFrame) -> DataFrame:
    """(id, type, degree) of all endpoints: one aggregation of both ends."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("head").alias("id"), F.col("head_type").alias("type")), F.struct(F.col("tail").alias("id"), F.col("tail_type").alias("type")))))
    return ends.groupBy("id", "type").agg(F.count("*").alias("degree"))


def degree_penalty(degree: Column) -> Column:
    return 1 / (1 + F.sqrt(degree))


def hubs(nodes: DataFrame, threshold: int = HUB_DEGREE) -> DataFrame:
    return nodes.filter(F.col("degree") > threshold)


def statistics(edges: DataFrame) -> DataFrame:
    """Edge counts by relation, by origin and in all, in one pass."""
    grouped = edges.groupingSets([["relation"], ["origin"], []], "relation", "origin").agg(F.grouping_id().alias("level"), F.count("*").alias("edges"))
    kind = F.when(F.col("level") == 1, "relation").when(F.col("level") == 2, "origin").otherwise("all")
    return grouped.select(kind.alias("kind"), F.coalesce("relation", "origin", F.lit("all")).alias("value"), "edges")


def adjacency(edges: DataFrame) -> DataFrame:
    """Each edge under both of its ends: node, other, direction."""
    ends = F.array(
        F.struct(F.col("head").alias("node"), F.col("tail").alias("other"), F.col("tail_type").alias("other_type"), F.lit("forward").alias("direction")),
        F.struct(F.col("tail").alias("node"), F.col("head").alias("other"), F.col("head_type").alias("other_type"), F.lit("reverse").alias("direction")),
    )
    return edges.select(F.inline(ends), "*").drop("head_type", "tail_type")


def with_documents(edges: DataFrame) -> DataFrame:
    """(id, type, sources, doc_count): the documents of a node are the sources of its edges."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("head").alias("id"), F.col("head_type").alias("type")), F.struct(F.col("tail").alias("id"), F.col("tail_type").alias("type")))), "sources")
    grouped = ends.select("id", "type", F.explode("sources").alias("source")).groupBy("id", "type").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return grouped.withColumn("doc_count", F.size("sources"))


def alias_rows(nodes: DataFrame) -> DataFrame:
    """(surface, id, type) for every node's own id and aliases."""
    return nodes.select(F.explode(F.array_distinct(F.concat(F.array("id"), "aliases"))).alias("surface"), "id", "type")


def alias_index(nodes: DataFrame, last_wins: bool = True) -> DataFrame:
    """surface -> id, where nodes in order of ``ord`` claim a surface: the last as the reader sees it, or the first as the builder does."""
    order = F.col("ord").desc() if last_wins else F.col("ord").asc()
    rows = nodes.select("ord", F.explode(F.array_distinct(F.concat(F.array("id"), "aliases"))).alias("surface"), "id", "type")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("surface").orderBy(order, "id"))).filter("rank = 1").drop("rank", "ord")


def claimed_aliases(nodes: DataFrame) -> DataFrame:
    """surface -> id as it is exported: an id stands for itself, and any other surface for the first node by id that has it."""
    rows = nodes.select(F.explode(F.array_distinct(F.concat(F.array("id"), "aliases"))).alias("surface"), "id")
    return rows.groupBy("surface").agg(F.coalesce(F.max(F.when(F.col("surface") == F.col("id"), F.col("id"))), F.min("id")).alias("id"))


def alias_conflicts(claims: DataFrame) -> DataFrame:
    """Claims (surface, id, type, ord) that come after another node's first claim of the surface."""
    first = F.first(F.struct("id", "type")).over(W.partitionBy("surface").orderBy("ord", "id", "type"))
    later = claims.withColumn("kept", first).filter((F.col("kept.id") != F.col("id")) | (F.col("kept.type") != F.col("type")))
    return later.select("surface", F.col("kept.id").alias("kept_id"), F.col("id").alias("rejected_id")).distinct()


def homonym_ids(nodes: DataFrame) -> DataFrame:
    """node_id for (name, type): one of a name keeps it (documents, then more sources, then type), the others get their type behind it."""
    rank = F.row_number().over(W.partitionBy("name").orderBy(F.col("is_doc").desc(), F.col("doc_count").desc(), "type"))
    return nodes.withColumn("node_id", F.when(rank == 1, F.col("name")).otherwise(F.concat("name", F.lit(" ("), "type", F.lit(")"))))


def by_type_priority(names: DataFrame, nodes: DataFrame, order: tuple[str, ...] = ("Person", "Organization", "Event")) -> DataFrame:
    """Names joined to the node of their name whose type comes first in order."""
    place = F.array_position(F.array(*(F.lit(t) for t in order)), F.col("type"))
    joined = names.join(nodes, names["name"] == nodes["node_name"])
    return joined.withColumn("rank", F.row_number().over(W.partitionBy("name").orderBy(place, "id"))).filter("rank = 1").drop("rank", "node_name")


def bounded_search(edges: DataFrame, seeds: DataFrame, hops: int, hub_degree: int | None = None) -> DataFrame:
    """(seed, node, hop): nodes within so many undirected steps. Hubs are reached but not passed if hub_degree is given.

    The loop over hops is unrolled into joins; a node that was reached before does not come back.
    """
    near = adjacency(edges).select("node", "other").distinct()
    if hub_degree is not None:
        passable = near.groupBy("node").agg(F.count("*").alias("degree")).filter(F.col("degree") <= hub_degree).select("node")
        near_inner = near.join(passable, "node", "left_semi")
    else:
        near_inner = near
    reached = seeds.select(F.col("seed"), F.col("seed").alias("node"), F.lit(0).alias("hop"))
    frontier = reached
    for hop in range(1, hops + 1):
        step = frontier.select("seed", "node").join(near if hop == 1 else near_inner, "node").select("seed", F.col("other").alias("node")).distinct()
        frontier = step.join(reached.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop))
        reached = reached.unionByName(frontier)
    return reached
