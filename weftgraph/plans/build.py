"""Documents to a graph: the whole batch build."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import mention_scan
from ..operators import edges as E
from ..operators import entities as N
from ..operators import extract as X
from ..operators.graph import nodes_of
from ..sources.stage import written


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    refused: DataFrame
    dropped: DataFrame
    fired: DataFrame


def build(documents: DataFrame, gazetteer: DataFrame | None = None, discovery: bool = False, ask: Callable[[Column], Column] | None = None) -> Graph:
    """The graph of documents (title, categories, body) and further titles (title, categories, redirects).

    With ask, a model reads the sentences that the rules left without an edge; what it names must be among their mentions.
    """
    own = documents.select("title", "categories", F.lit(True).alias("is_doc"), F.array().cast("array<string>").alias("redirects"))
    pages = own if gazetteer is None else own.unionByName(gazetteer.join(own.select("title"), "title", "left_anti").select("title", "categories", F.lit(False).alias("is_doc"), "redirects"))
    entities, dropped = N.inventory(pages)
    entities = written(entities.withColumn("ord", F.xxhash64("title")), "entities")
    claims = N.first_claims(N.alias_claims(entities))
    if discovery:
        more = N.discovered(documents, claims)
        claims = claims.unionByName(more.select(F.col("name").alias("surface"), F.col("name").alias("id"), "type"))
    claims = written(claims.unionByName(N.gloss_aliases(documents, claims)), "claims")
    scan = mention_scan(N.surface_table(claims))
    typed = documents.join(entities.filter("is_doc").select("title", F.col("name").alias("doc_name"), F.col("type").alias("doc_type")), "title")
    rows = written(X.with_mentions(X.sentence_rows(typed.select(F.col("doc_name").alias("title"), "doc_type", "body")), scan), "mentions")
    events = entities.filter("type = 'Event'").select(F.col("name").alias("id"))
    found = X.candidates(rows).unionByName(X.category_candidates(typed.select(F.col("doc_name").alias("title"), "doc_type", "categories"), events))
    accepted, refused = E.gated(found)
    told = X.model_candidates(X.residual(rows, accepted), ask)
    if told is not None:
        # A model may answer otherwise the second time, so its candidates are written before they are used twice.
        told, doubted = E.gated(written(told, "told"))
        accepted, refused = accepted.unionByName(told), refused.unionByName(doubted)
    edges = E.merged(accepted)
    edges = written(E.confirmed(edges, told) if told is not None else edges, "edges")
    mentioned = rows.select(F.explode("mentions").alias("m"), "title").select(F.col("m.name").alias("id"), F.col("m.type").alias("type"), "title")
    told = mentioned.unionByName(entities.filter("is_doc").select(F.col("name").alias("id"), "type", F.col("name").alias("title")))
    sources = told.groupBy("id", "type").agg(F.array_sort(F.collect_set("title")).alias("sources"))
    aliases = claims.groupBy("id", "type").agg(F.array_sort(F.collect_set("surface")).alias("aliases"))
    used = nodes_of(edges).unionByName(entities.filter("is_doc").select(F.col("name").alias("id"), "type", F.lit(0).cast("long").alias("degree"))).groupBy("id", "type").agg(F.max("degree").alias("degree"))
    nodes = used.join(sources, ["id", "type"], "left").join(aliases, ["id", "type"], "left")
    nodes = nodes.withColumn("doc_count", F.coalesce(F.size("sources"), F.lit(0))).withColumn("aliases", F.coalesce("aliases", F.array("id")))
    return Graph(nodes, edges, E.refused_log(refused, 300), dropped, E.firing_counts(accepted))
