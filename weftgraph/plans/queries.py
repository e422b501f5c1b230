"""Registered queries of the graph, text, selection and evaluation operators over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..functions.arrow import mention_scan
from ..operators import answer as A
from ..operators import corpus as C
from ..operators import edges as E
from ..operators import entities as N
from ..operators import evaluate as V
from ..operators import extract as X
from ..operators import graph as G
from ..operators import linking as L
from ..operators import paths as P
from ..operators import tfidf as I
from ..ship import ship
from ..sources import cache as K
from ..sources import files, sinks
from ..sources.cache import answered as cached_answers
from ..sources.stage import folder, written
from ..sources.tables import order_candidates, table
from . import samples as S
from .ask import ask, ask_texts, run_records
from .build import build
from .evaluate import evaluate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SEEDS = tuple(f"C{i}" for i in range(5))


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def joined(column: str | Column) -> Column:
    return F.array_join(column, ";")


_GRAPHS: dict[tuple[str, str], DataFrame] = {}


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """The merged graph of the order lines, written once an application and read by all queries over it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _GRAPHS:
        _GRAPHS[key] = written(E.merged(E.gated(order_candidates(spark, d))[0]), "graph")
    return _GRAPHS[key]


def person_triples(spark: SparkSession, d: str) -> DataFrame:
    """(head, relation, tail) of the graph's edges from persons; without the merge of what else an edge has, unless that is there already."""
    if (spark.sparkContext.applicationId, d) in _GRAPHS:
        return graph_edges(spark, d).filter("head_type = 'Person'").select(*E.KEY)
    return written(E.gated(order_candidates(spark, d))[0].filter("head_type = 'Person'").select(*E.KEY).distinct(), "triples")


def rows(spark: SparkSession, values: list, schema: str) -> DataFrame:
    """Literal rows in one partition, so that what groups and joins them needs no exchange."""
    ship(spark)
    return spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema).coalesce(1)


def seeds(spark: SparkSession, names: tuple[str, ...] = SEEDS) -> DataFrame:
    """Each seed asks a question of its own."""
    return rows(spark, [(n, n) for n in names], "qid string, node string")


# --- edges and graph


@query
def kg_edges_merge(spark: SparkSession, d: str) -> DataFrame:
    return graph_edges(spark, d).select("head", "relation", "tail", "origin", F.round("confidence", 6).alias("confidence"), joined("sources").alias("sources"), joined("evidence").alias("evidence"), joined("extractors").alias("extractors"), F.size("sources").alias("doc_count"))


@query
def kg_schema_gate(spark: SparkSession, d: str) -> DataFrame:
    judged = order_candidates(spark, d).withColumn("reason", E.reject_reason())
    return judged.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason"), "extractor").agg(F.count("*").alias("n"))


@query
def kg_refused_log(spark: SparkSession, d: str) -> DataFrame:
    return E.refused_log(E.gated(order_candidates(spark, d))[1]).select("head", "relation", "tail", "reason", F.col("ord").alias("first_seen"), "times")


@query
def kg_refused_log_top(spark: SparkSession, d: str) -> DataFrame:
    """The limited log of a report."""
    return E.refused_log(E.gated(order_candidates(spark, d))[1], 300).select("head", "relation", "tail", "reason")


@query
def kg_firing_counts(spark: SparkSession, d: str) -> DataFrame:
    return E.firing_counts(E.gated(order_candidates(spark, d))[0])


@query
def kg_degree(spark: SparkSession, d: str) -> DataFrame:
    return G.nodes_of(graph_edges(spark, d))


@query
def kg_hubs(spark: SparkSession, d: str) -> DataFrame:
    return G.hubs(G.nodes_of(graph_edges(spark, d)))


@query
def kg_degree_penalty(spark: SparkSession, d: str) -> DataFrame:
    return G.nodes_of(graph_edges(spark, d)).select("id", F.round(G.degree_penalty(F.col("degree")), 6).alias("penalty"))


@query
def kg_stats(spark: SparkSession, d: str) -> DataFrame:
    return G.statistics(graph_edges(spark, d))


@query
def kg_node_types(spark: SparkSession, d: str) -> DataFrame:
    return G.nodes_of(graph_edges(spark, d)).groupBy("type").agg(F.count("*").alias("nodes"))


@query
def kg_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return G.adjacency(graph_edges(spark, d)).select("node", "other", "other_type", "direction", "relation")


@query
def kg_node_documents(spark: SparkSession, d: str) -> DataFrame:
    return G.with_documents(graph_edges(spark, d)).select("id", "type", joined("sources").alias("sources"), "doc_count")


@query
def kg_relation_budget(spark: SparkSession, d: str) -> DataFrame:
    return E.budgeted(graph_edges(spark, d), 3).select("head", "relation", "tail", "origin")


@query
def kg_pruned(spark: SparkSession, d: str) -> DataFrame:
    edges = graph_edges(spark, d)
    kept = G.nodes_of(edges).filter("degree >= 8")
    inside, gone = E.pruned(edges, kept)
    return inside.select("head", "relation", "tail", F.lit("kept").alias("state")).unionByName(gone.select("head", "relation", "tail", F.col("reason").alias("state")))


@query
def kg_edge_weight(spark: SparkSession, d: str) -> DataFrame:
    edges = graph_edges(spark, d)
    return edges.select("head", "relation", "tail", F.round(R.edge_weight(F.col("confidence"), F.col("head"), F.col("tail"), F.col("sources")), 6).alias("weight"))


def _ranked(best: DataFrame, most: int = 5) -> DataFrame:
    return P.top(best, most).select("qid", F.col("at").alias("target"), F.round("score", 6).alias("score"), P.rendered(F.col("path")).alias("path"), "rank")


@query
def kg_1hop(spark: SparkSession, d: str) -> DataFrame:
    asked = seeds(spark).withColumn("relation", F.lit("FOUNDED")).withColumn("wanted", F.lit("Organization"))
    return _ranked(P.best_by_target(P.one_hop(asked, P.steps_of(graph_edges(spark, d)))), 10)


@query
def kg_2hop_coparticipant(spark: SparkSession, d: str) -> DataFrame:
    """Organizations that other participants of the seeds' events founded: the five best of each seed."""
    return _ranked(P.best_by_target(P.co_participants(seeds(spark), P.steps_of(graph_edges(spark, d)))))


@query
def kg_3hop_chain(spark: SparkSession, d: str) -> DataFrame:
    found = P.co_participants(seeds(spark, ("C1",)), P.steps_of(graph_edges(spark, d)), to_event=True)
    return found.groupBy("qid", F.col("at").alias("target")).agg(F.count("*").alias("paths"), F.round(F.max("score"), 6).alias("score"))


@query
def kg_two_seed_intersect(spark: SparkSession, d: str) -> DataFrame:
    asked = rows(spark, [("q", f"P{i}", "Event") for i in range(1, 40)] + [("q", f"S{i}", "Organization") for i in range(1, 10)], "qid string, node string, type string")
    return _ranked(P.intersected(asked, P.steps_of(graph_edges(spark, d))).withColumnRenamed("seed", "seed"), 50).drop("rank")


@query
def kg_context_topup(spark: SparkSession, d: str) -> DataFrame:
    steps = P.steps_of(graph_edges(spark, d))
    asked = seeds(spark).withColumn("relation", F.lit("FOUNDED")).withColumn("wanted", F.lit(None).cast("string"))
    return P.context(P.one_hop(asked, steps), seeds(spark), steps, 20)


@query
def kg_hops_used(spark: SparkSession, d: str) -> DataFrame:
    steps = P.steps_of(graph_edges(spark, d))
    best = P.best_by_target(P.co_participants(seeds(spark, SEEDS[:2]), steps))
    return P.hops_used(best).join(P.visited(seeds(spark, SEEDS[:2]), best), "qid").select("qid", "hops_used", F.size("visited").alias("n_visited"))


@query
def kg_penalised_paths(spark: SparkSession, d: str) -> DataFrame:
    edges = graph_edges(spark, d)
    found = P.penalised(P.co_participants(seeds(spark, SEEDS[:2]), P.steps_of(edges)), G.nodes_of(edges))
    return _ranked(P.best_by_target(found), 10).drop("rank")


@query
def kg_skipped_hubs(spark: SparkSession, d: str) -> DataFrame:
    edges = graph_edges(spark, d)
    kept, passed = P.without_hubs(P.co_participants(seeds(spark, SEEDS[:2]), P.steps_of(edges)), G.nodes_of(edges), 40)
    left = kept.groupBy("qid").agg(F.count("*").alias("kept"))
    return passed.join(left, "qid", "left").select("qid", "id", "degree", "paths", F.coalesce("kept", F.lit(0)).alias("kept"))


@query
def kg_context_sources(spark: SparkSession, d: str) -> DataFrame:
    edges = graph_edges(spark, d)
    steps = P.steps_of(edges)
    asked = seeds(spark).withColumn("relation", F.lit("FOUNDED")).withColumn("wanted", F.lit(None).cast("string"))
    return P.context_sources(P.context(P.one_hop(asked, steps), seeds(spark), steps, 20), edges).select("qid", joined("sources").alias("sources"))


@query
def kg_bfs(spark: SparkSession, d: str) -> DataFrame:
    start = rows(spark, ["C1", "C2"], "seed string")
    return G.bounded_search(graph_edges(spark, d), start, 2)


@query
def kg_bfs_hubs(spark: SparkSession, d: str) -> DataFrame:
    """Hubs may be reached but are not passed."""
    start = rows(spark, ["C1", "C2"], "seed string")
    return G.bounded_search(graph_edges(spark, d), start, 2, hub_degree=40)


@query
def kg_two_hop_proof(spark: SparkSession, d: str) -> DataFrame:
    """How many two-hop patterns each event proves, over the whole graph."""
    return P.pattern_counts(graph_edges(spark, d).filter("head_type = 'Person'"))


@query
def kg_two_hop_greedy(spark: SparkSession, d: str) -> DataFrame:
    """Ten different patterns of the whole graph, chosen in alphabetical order; the limit is the feature."""
    chosen = P.first_patterns(person_triples(spark, d), lambda found: written(found, "bridges"))
    return spark.createDataFrame(chosen, "a string, event string, b string, organization string")


@query
def kg_supporting(spark: SparkSession, d: str) -> DataFrame:
    best = P.best_by_target(P.co_participants(seeds(spark, SEEDS[:2]), P.steps_of(graph_edges(spark, d))))
    return A.supporting(best).select("qid", "head", "relation", "tail", "rank", "hop", joined("sources").alias("sources"))


@query
def kg_evidence_by_source(spark: SparkSession, d: str) -> DataFrame:
    edges = graph_edges(spark, d).filter("relation = 'FOUNDED'")
    return A.evidence_by_source(edges).groupBy("source").agg(F.count("*").alias("quotes"), F.max("n").alias("last"), F.min(F.when(F.col("n") == 1, F.col("quote"))).alias("first_quote"))


@query
def kg_merge_log(spark: SparkSession, d: str) -> DataFrame:
    nodes = rows(spark, S.NODES, "id string, type string, names string").select("id", F.filter(F.split("names", ";"), lambda x: x != "").alias("aliases"))
    return N.merge_log(nodes).select("id", joined("merged").alias("merged"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts as named nodes: names repeat, which makes homonyms and disputed aliases."""
    part = table(spark, d, "part")
    return part.select(F.col("p_partkey").alias("ord"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("type"), F.array("p_name").alias("aliases"))


@query
def kg_alias_index(spark: SparkSession, d: str) -> DataFrame:
    nodes = _parts(spark, d)
    last = G.alias_index(nodes).select("surface", F.col("id").alias("last_id"))
    return last.join(G.alias_index(nodes, last_wins=False).select("surface", F.col("id").alias("first_id")), "surface")


@query
def kg_alias_conflict(spark: SparkSession, d: str) -> DataFrame:
    return G.alias_conflicts(_parts(spark, d).select(F.col("name").alias("surface"), "id", "type", "ord"))


@query
def kg_homonym_ids(spark: SparkSession, d: str) -> DataFrame:
    grouped = table(spark, d, "part").groupBy(F.col("p_name").alias("name"), F.col("p_brand").alias("type")).agg((F.max("p_size") > 40).alias("is_doc"), F.count("*").alias("doc_count"))
    return G.homonym_ids(grouped).select("name", "type", "node_id")


@query
def kg_type_priority(spark: SparkSession, d: str) -> DataFrame:
    nodes = rows(spark, S.NODES, "id string, type string, names string").select("id", "type", F.explode(F.split("names", ";")).alias("node_name"))
    names = rows(spark, ["백야", "애국단", "없음"], "name string")
    return G.by_type_priority(names, nodes).select("name", "id", "type")


@query
def kg_abbreviation_target(spark: SparkSession, d: str) -> DataFrame:
    """Short names to nodes, organizations first."""
    nodes = rows(spark, S.NODES, "id string, type string, names string").select("id", "type", F.explode(F.split("names", ";")).alias("node_name"))
    return G.by_type_priority(rows(spark, ["백야", "애국단", "도마"], "name string"), nodes, ("Organization", "Event", "Person")).select("name", "id", "type")


@query
def kg_golden_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Two-hop patterns with the golden items that use them, and those that only the golden set has."""
    golden_rows = rows(spark, S.GOLDEN, "item_id string, type string, hops int, answerable boolean, a string, event string, b string, organization string")
    step = lambda head, relation, tail: F.struct(F.col(head).alias("head"), F.lit(relation).alias("relation"), F.col(tail).alias("tail"))
    expected = golden_rows.select("item_id", F.posexplode(F.array(step("a", "PARTICIPATED_IN", "event"), step("b", "PARTICIPATED_IN", "event"), step("b", "FOUNDED", "organization"))).alias("n", "t")).select("item_id", "n", "t.*")
    return P.golden_marked(P.bridges(sample_edges(spark)), golden_rows, expected)


# --- questions


def questions(spark: SparkSession) -> DataFrame:
    return rows(spark, S.QUESTIONS, "qid string, question string")


def aliases(spark: SparkSession) -> DataFrame:
    nodes = rows(spark, S.NODES, "id string, type string, names string").select("id", "type", F.filter(F.split("names", ";"), lambda x: x != "").alias("aliases"), F.monotonically_increasing_id().alias("ord"))
    return G.alias_rows(nodes.filter("id <> '대한독립군'")).unionByName(G.alias_rows(nodes.filter("id = '대한독립군'").withColumn("aliases", F.array().cast("array<string>"))))


def sample_edges(spark: SparkSession) -> DataFrame:
    kinds = {n: t for n, t, _ in S.NODES}
    values = [(h, kinds[h], r, t, kinds[t], "rule", c, s.split(";")) for h, r, t, c, s in S.EDGES]
    return rows(spark, values, "head string, head_type string, relation string, tail string, tail_type string, origin string, confidence double, sources array<string>").withColumn("evidence", F.array().cast("array<string>"))


@query
def intent_questions(spark: SparkSession, d: str) -> DataFrame:
    return L.intent(questions(spark)).select("qid", "wanted", "co", "relation", "route")


@query
def link_seeds(spark: SparkSession, d: str) -> DataFrame:
    return L.seeds(questions(spark), aliases(spark)).select("qid", "surface", "node", "type", "score", "rank")


@query
def link_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Nation and region names contained in documents."""
    names = table(spark, d, "nation").select(F.initcap("n_name").alias("surface"), F.concat(F.lit("N"), "n_nationkey").alias("id"), F.lit("Organization").alias("type"))
    names = names.unionByName(names.sparkSession.createDataFrame([("the", "W0", "Event"), ("que", "W1", "Person"), ("von", "W2", "Person")], "surface string, id string, type string"))
    asked = table(spark, d, "documents").select(F.col("doc_id").alias("qid"), F.col("text").alias("question"))
    return L.contained(asked, names).groupBy("id").agg(F.count("*").alias("documents"))


@query
def refusal_gate(spark: SparkSession, d: str) -> DataFrame:
    asked, known = questions(spark), aliases(spark)
    return L.unknown_concepts(asked, L.seeds(asked, known), known)


@query
def qa_answers(spark: SparkSession, d: str) -> DataFrame:
    got = ask(questions(spark), sample_edges(spark), aliases(spark))
    return got.answers.select("qid", "refused", "answer", "path_explanation")


@query
def qa_context(spark: SparkSession, d: str) -> DataFrame:
    return ask(questions(spark), sample_edges(spark), aliases(spark)).context


@query
def qa_run_records(spark: SparkSession, d: str) -> DataFrame:
    edges = sample_edges(spark)
    got = ask(questions(spark), edges, aliases(spark))
    return run_records(questions(spark), got, edges).select("qid", "route", "refused", "deepened", "hops_used", joined("visited_nodes").alias("visited_nodes"), joined("sources").alias("sources"), F.size("context_triples").alias("n_triples"))


# --- texts


@query
def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    return I.chunked(table(spark, d, "documents")).select("doc", "offset", F.length("chunk").alias("chars"), F.md5("chunk").alias("digest"))


@query
def text_sentences(spark: SparkSession, d: str) -> DataFrame:
    cut = table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("n", "sentence"))
    return cut.select("doc_id", "n", F.md5("sentence").alias("digest"))


@query
def text_quotable(spark: SparkSession, d: str) -> DataFrame:
    cut = table(spark, d, "benchmark").select("item_id", F.posexplode(T.quotable(F.col("text"))).alias("n", "sentence"))
    return cut.select("item_id", "n", F.md5("sentence").alias("digest"))


@query
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("name")
    return rows(spark, S.NAMES, "name string").select("name", T.normalized(T.nfc(name)).alias("normalized"), T.gloss(name).alias("gloss"), R.abbreviated(T.normalized(name)).alias("full_name"))


@query
def text_normalization_rules(spark: SparkSession, d: str) -> DataFrame:
    used = rows(spark, S.NAMES, "name string").select("name", F.explode(T.normalization_rules(F.col("name"))).alias("rule")).groupBy("rule").agg(F.count("*").alias("applied"), F.min("name").alias("example"))
    every = rows(spark, ["whitespace", "gloss", "qualifier"], "rule string")
    return every.join(used, "rule", "left").select("rule", F.coalesce("applied", F.lit(0)).alias("applied"), F.coalesce("example", F.lit("-")).alias("example"))


@query
def text_rule_report(spark: SparkSession, d: str) -> DataFrame:
    """All seven normalization rules with counts and examples."""
    entities = rows(spark, S.NODES, "name string, type string, names string").withColumn("title", F.col("name"))
    redirects = N.redirect_claims(rows(spark, S.REDIRECTS, "title string, named string").select("title", F.split("named", ";").alias("redirects")), entities)
    return N.rule_hits(rows(spark, S.NAMES, "name string"), entities, rows(spark, S.MENTIONS, "surface string, raw string"), redirects)


@query
def text_particles(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("word")
    return rows(spark, S.WORDS, "word string").select("word", T.without_particle(w).alias("stem"), T.without_name_particle(w).alias("name_stem"))


@query
def text_tokens(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "documents").select(F.explode(T.words(F.lower("text"), "[a-z0-9]{2,}")).alias("token"))
    return each.groupBy("token").agg(F.count("*").alias("n")).filter("n >= 20")


@query
def text_body(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, S.PAGES, "title string, categories string, body string, links int").select("title", T.trimmed_body(F.col("body")).alias("body"), T.file_name(F.col("title")).alias("file"))


@query
def text_evidence(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return table(spark, d, "benchmark").select("item_id", T.evidence(text).alias("evidence"), T.excerpt(text, 120).alias("excerpt"))


@query
def text_secrets_masked(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("secret")
    return rows(spark, S.SECRETS, "secret string").select("secret", T.masked(s).alias("masked"), T.key_like(s).alias("key_like"))


@query
def text_json_payload(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, S.ANSWERS, "answer string").select("answer", T.json_payload(F.col("answer")).alias("payload"))


@query
def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "benchmark").select("item_id", F.lit("m").alias("model"), F.col("item_id").cast("string").alias("prompt"))
    cache = asked.filter("item_id % 2 = 0").select(T.cache_key(F.col("model"), F.col("prompt")).alias("key"), F.concat(F.lit("answer "), "prompt").alias("answer"))
    return cached_answers(asked, cache, None, "prompt", "model", "prompt").select("item_id", "key", "answer")


# --- entities and extraction


def pages(spark: SparkSession) -> DataFrame:
    listed = F.filter(F.split("named", ";"), lambda c: c != "")
    return rows(spark, S.PAGES, "title string, named string, body string, links int").select("title", listed.alias("categories"), "body", F.lit(True).alias("is_doc"), "links")


@query
def entity_typing(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark).select("title", F.inline(F.array(R.entity_type(F.col("title"), F.col("categories")))))


@query
def entity_admission(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, [t for t, *_ in S.PAGES] + S.TITLES + ["A", "12·3", "회장"], "title string").distinct().select("title", R.dropped_reason(F.col("title")).alias("reason"))


@query
def entity_inventory(spark: SparkSession, d: str) -> DataFrame:
    kept, dropped = N.inventory(pages(spark))
    return kept.select("title", "name", "type", F.lit(None).cast("string").alias("reason")).unionByName(dropped.select("title", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("type"), "reason"))


@query
def entity_merge(spark: SparkSession, d: str) -> DataFrame:
    """Customers of a segment by nation as entities: unions of their names, first reasons."""
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("name"), F.col("c_nationkey").cast("string").alias("type"), F.substring("c_name", -2, 2).alias("alias"), (F.col("c_custkey") % 7).cast("string").alias("source"), (F.col("c_acctbal") > 9000).alias("is_doc"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("r"), F.col("c_custkey").cast("string"))).alias("reason"), F.col("c_custkey").alias("ord"))
    return N.merged_entities(c).select("name", "type", joined("aliases").alias("aliases"), joined("sources").alias("sources"), "is_doc", "reason", "doc_count")


@query
def mention_spans(spark: SparkSession, d: str) -> DataFrame:
    table_ = {s: (i, t) for i, t, names in S.NODES for s in [i, *filter(None, names.split(";"))]}
    return X.with_mentions(pages(spark).select("title", F.col("body").alias("sentence")), mention_scan(table_)).select("title", F.inline("mentions"))


@query
def extract_edges(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"안중근": "Person", "청산리 전투": "Event", "신민회": "Organization"}
    docs = pages(spark).filter(F.col("title").isin(*kinds)).withColumn("doc_type", F.create_map(*(F.lit(x) for p in kinds.items() for x in p))[F.col("title")])
    table_ = {s: (i, t) for i, t, names in S.NODES for s in [i, *filter(None, names.split(";"))]} | {"안창호": ("안창호", "Person"), "신민회": ("신민회", "Organization")}
    found = X.candidates(X.with_mentions(X.sentence_rows(docs.withColumn("body", T.trimmed_body(F.col("body")))), mention_scan(table_)))
    return found.select("head", "relation", "tail", "confidence", "extractor", "source", "evidence")


@query
def extract_rules(spark: SparkSession, d: str) -> DataFrame:
    """Sentences for each of the rules, and some that none may take."""
    table_ = {s: (i, t) for i, t, names in S.NODES for s in [i, *filter(None, names.split(";"))]}
    found = X.candidates(X.with_mentions(X.sentence_rows(rows(spark, S.RULE_BODIES, "title string, doc_type string, body string")), mention_scan(table_)))
    return found.select("head", "relation", "tail", "confidence", "extractor", "source", "evidence")


@query
def build_graph(spark: SparkSession, d: str) -> DataFrame:
    more = rows(spark, S.GAZETTEER, "title string, named string").select("title", F.split("named", ";").alias("categories"), F.array().cast("array<string>").alias("redirects"))
    made = build(pages(spark).select("title", "categories", T.trimmed_body(F.col("body")).alias("body")), more)
    return made.edges.select("head", "relation", "tail", "origin", "confidence", joined("sources").alias("sources"), joined("extractors").alias("extractors"))


@query
def discovered_entities(spark: SparkSession, d: str) -> DataFrame:
    """Events and organizations that texts name by their endings."""
    bodies = rows(spark, S.BODIES, "title string, body string")
    known = rows(spark, ["청산리 전투"], "surface string")
    return N.discovered(bodies, known)


@query
def gloss_aliases(spark: SparkSession, d: str) -> DataFrame:
    surfaces = rows(spark, [("안중근", "안중근", "Person"), ("김구", "김구", "Person")], "surface string, id string, type string")
    return N.gloss_aliases(rows(spark, S.BODIES, "title string, body string"), surfaces)


# --- files: written to the shared folder and read back


@query
def io_graph_json(spark: SparkSession, d: str) -> DataFrame:
    """The counts of the exported graph of the tables."""
    edges, path = graph_edges(spark, d), folder(spark, "export")
    sinks.write_graph(G.nodes_of(edges).withColumn("aliases", F.array("id")), edges, path)
    return spark.read.schema("kind string, value string, n long").json(f"{path}/stats")


@query
def io_alias_index(spark: SparkSession, d: str) -> DataFrame:
    """The exported alias index, where an id stands for itself and other surfaces for the first node."""
    path = folder(spark, "aliases")
    nodes = rows(spark, S.NODES, "id string, type string, names string").select("id", "type", F.filter(F.split("names", ";"), lambda x: x != "").alias("aliases"))
    sinks.write_graph(nodes, sample_edges(spark), path)
    return spark.read.schema("surface string, id string").json(f"{path}/alias_index")


@query
def io_graphml(spark: SparkSession, d: str) -> DataFrame:
    """The edges of a GraphML document with their ends' types."""
    path = folder(spark, "graphml")
    nodes = rows(spark, S.NODES, "id string, type string, names string").select("id", "type", F.filter(F.split("names", ";"), lambda x: x != "").alias("aliases"), F.array("id").alias("sources"), F.lit(1).alias("doc_count"), F.lit(0).alias("degree"))
    sinks.write_graphml(nodes, sample_edges(spark).withColumn("extractor", F.lit("x")), path)
    return files.graphml(spark, path)[1].select("head", "head_type", "relation", "tail", "tail_type", "origin", "confidence", joined("sources").alias("sources"))


@query
def io_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The kept and rejected pages of a manifest: suppliers by their balance."""
    path = folder(spark, "manifest")
    each = table(spark, d, "supplier").select(F.col("s_name").alias("title"), F.array(F.col("s_nationkey").cast("string")).alias("categories"), F.col("s_suppkey").cast("int").alias("chars"), F.lit(2).alias("hop"), F.lit("linked").alias("why"), F.array().cast("array<string>").alias("redirects"), F.when(F.col("s_acctbal") < 3000, "stub").alias("reason"))
    kept = each.filter("reason is null")
    sinks.write_manifest(sinks.manifest_row(kept, each.filter("reason is not null"), kept.select("title", "categories", "redirects"), ["seed"], {"saved": 1}, "wiki", "topic"), path)
    read = files.manifest(spark, path)
    docs = read.select(F.inline("docs")).select("title", "file", joined("categories").alias("categories"), "chars", "reason")
    none = F.lit(None)
    return docs.unionByName(read.select(F.inline("rejected")).select("title", none.cast("string").alias("file"), none.cast("string").alias("categories"), none.cast("int").alias("chars"), "reason"))


@query
def io_cache_counters(spark: SparkSession, d: str) -> DataFrame:
    """Answers by way of a stored cache: the even items first, then all, where some get none."""
    path = folder(spark, "cache")
    asked = table(spark, d, "benchmark").select("item_id", F.lit("m").alias("model"), F.col("item_id").cast("string").alias("prompt"))
    model = lambda p: F.when(~p.endswith("7"), F.concat(F.lit("to "), p))
    K.remembered(asked.filter("item_id % 2 = 0"), path, model, "prompt", "model", "prompt")
    return K.counters(K.remembered(asked, path, model, "prompt", "model", "prompt"), K.entries(spark, path))


@query
def io_documents(spark: SparkSession, d: str) -> DataFrame:
    """Markdown files, one of another form among them, as they are read whole."""
    path = folder(spark, "markdown")
    docs = rows(spark, S.PAGES, "title string, named string, body string, links int").select("title", F.split("named", ";").alias("categories"), "body")
    sinks.write_documents(docs, f"{path}/table")
    texts = spark.read.parquet(f"{path}/table").select("text").unionByName(rows(spark, ["no header"], "text string"))
    # A file for each text: files of a text source end with a line break that the text has already.
    texts.select(F.regexp_replace("text", "\\n$", "").alias("value")).repartitionByRange(texts.count(), "value").sortWithinPartitions("value").write.option("maxRecordsPerFile", 1).text(f"{path}/files")
    return files.stored_documents(spark, f"{path}/files").select("title", joined("categories").alias("categories"), F.md5(T.stripped(F.col("body"))).alias("digest"))


# --- ranking


@query
def tfidf_df(spark: SparkSession, d: str) -> DataFrame:
    counts = I.term_counts(I.chunked(table(spark, d, "benchmark"), "item_id"), "doc", "offset")
    return I.document_frequency(counts)


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").filter("turn = 0").select(F.col("conv_id").alias("qid"), F.col("text").alias("question"))


@query
def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five best chunks of the benchmark for the opening of each conversation."""
    return I.ranked(_asked(spark, d), I.chunked(table(spark, d, "benchmark"), "item_id")).select("qid", "doc", "offset", F.round("score", 4).alias("score"))


@query
def tfidf_answers(spark: SparkSession, d: str) -> DataFrame:
    return ask_texts(_asked(spark, d), I.chunked(table(spark, d, "benchmark"), "item_id")).select("qid", "answer", F.array_join(F.transform("sources", lambda s: s.cast("string")), ";").alias("sources"))


# --- selection of a corpus


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Events as links: users are seeds and event values, rounded, their targets."""
    return table(spark, d, "events").select((F.col("user_id") % 16).alias("seed"), F.concat(F.col("event_type"), F.lit("-"), F.floor("value").cast("string")).alias("target"))


@query
def funnel_link_support(spark: SparkSession, d: str) -> DataFrame:
    return C.link_support(_links(spark, d))


@query
def funnel_shared_category(spark: SparkSession, d: str) -> DataFrame:
    cats = table(spark, d, "documents").select(F.col("lang").alias("seed"), F.col("source").alias("category"))
    noise = rows(spark, [(s, c) for s in ("en", "de") for c in S.CATEGORIES], "seed string, category string")
    return C.shared_categories(cats.unionByName(noise))


@query
def funnel_category_overlap(spark: SparkSession, d: str) -> DataFrame:
    cats = table(spark, d, "documents").select(F.col("lang").alias("title"), F.col("source").alias("category"))
    pool = C.shared_categories(cats.select(F.col("title").alias("seed"), "category"), 4)
    return C.overlaps(cats, pool)


@query
def funnel_title_block(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, S.TITLES, "title string").select("title", R.title_block(F.col("title")).alias("reason"))


@query
def funnel_noise_category(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, S.CATEGORIES, "category string").select("category", R.noise_category(F.col("category")).alias("noise"))


@query
def funnel_scope(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark).select("title", R.topic_scope(F.col("categories")).alias("reason"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    judged = pages(spark).select("title", "categories", F.col("links").alias("support"), F.size("categories").alias("overlap"), (F.length("title") * 300).alias("chars"), (F.col("title") == "신민회").alias("failed"))
    return C.selected(judged, 2)


@query
def funnel_selected(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).select("title", "reason")


@query
def funnel_collected(spark: SparkSession, d: str) -> DataFrame:
    """The whole funnel: suppliers and nations are seeds, order lines link suppliers to parts."""
    part_title = lambda key: F.concat(F.when(F.col(key) % 11 == 0, "목록 ").otherwise(""), F.lit("P"), F.col(key).cast("string"))
    supplier, part = table(spark, d, "supplier"), table(spark, d, "part")
    own = F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("title")
    seeds_ = supplier.select(own).unionByName(table(spark, d, "nation").select(F.col("n_name").alias("title")))
    links = table(spark, d, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("seed"), part_title("l_partkey").alias("target"))
    named = lambda n: F.concat(F.lit("의병 "), n.cast("string"))
    some = F.when(F.col("p_size") % 7 != 3, F.array_compact(F.array(named(F.col("p_size") % 6), F.when(F.col("p_partkey") % 3 == 0, named(F.lit(1))), F.when(F.col("p_size") % 5 == 0, "1950년 태어남"))))
    categories = part.select(part_title("p_partkey").alias("title"), F.explode(some).alias("category")).unionByName(supplier.select(own, named(F.col("s_nationkey") % 4).alias("category")))
    texts = part.select(part_title("p_partkey").alias("title"), (F.col("p_partkey") % 97 * 20).alias("chars")).unionByName(supplier.select(own, (700 + F.col("s_suppkey") % 7 * 100).alias("chars")))
    return C.collected(seeds_, links, categories, texts, 900)


@query
def funnel_pruned(spark: SparkSession, d: str) -> DataFrame:
    return C.pruned_corpus(pages(spark).withColumn("raw_chars", F.length("title") * 300)).select("title", "reason")


@query
def funnel_expanded(spark: SparkSession, d: str) -> DataFrame:
    """Supported targets from few users, and from more of them as they are too few."""
    links = _links(spark, d)

    def choose(users: DataFrame) -> DataFrame:
        return C.link_support(links.join(users, "seed", "left_semi")).withColumn("reason", F.when(F.col("support") < 3, "few_links"))

    chosen, again = C.with_expansion(choose, rows(spark, [0, 1, 2], "seed long"), rows(spark, [2, 3, 4, 5, 6, 7], "seed long"), 1_000_000)
    return chosen.select("target", "support", "reason", F.lit(again).alias("expanded"))


@query
def reject_histogram(spark: SparkSession, d: str) -> DataFrame:
    return C.reason_histogram(_judged(spark, d))


@query
def reject_update(spark: SparkSession, d: str) -> DataFrame:
    """The log of suppliers without orders in a year, after another round."""
    log = table(spark, d, "supplier").select(F.col("s_name").alias("title"), F.when(F.col("s_acctbal") < 0, "debt: account").otherwise("other: none").alias("reason"))
    kept = log.filter(F.col("title").endswith("1"))
    fresh = log.filter(F.col("title").endswith("2")).withColumn("reason", F.lit("again"))
    return C.rejections(kept, log.filter("reason like 'debt%'"), fresh)


@query
def title_union(spark: SparkSession, d: str) -> DataFrame:
    docs, more = table(spark, d, "nation").select(F.col("n_name").alias("title")), table(spark, d, "region").select(F.col("r_name").alias("title"))
    return C.united_titles(docs, more.unionByName(docs.filter("title < 'D'")))


# --- evaluation


def golden(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(items, expected triples, edges, answers) made from the graph: items are customers, some expect what there is not."""
    edges = graph_edges(spark, d)
    c = table(spark, d, "customer")
    items = c.select(F.concat(F.lit("G"), F.col("c_custkey").cast("string")).alias("item_id"), (F.col("c_custkey") % 3 + 1).cast("int").alias("hops"), F.array("c_mktsegment", "c_name").alias("expected"), (F.col("c_custkey") % 11 != 0).alias("answerable"))
    own = edges.filter("head_type = 'Person'").select(F.concat(F.lit("G"), F.expr("substring(head, 2)")).alias("item_id"), "head", "relation", "tail", "confidence")
    first = own.join(items.select("item_id", "answerable"), "item_id").filter("answerable and confidence > 0.97").select("item_id", F.col("tail").alias("n"), "head", "relation", F.when(F.col("tail").endswith("7"), "P-none").otherwise(F.col("tail")).alias("tail"))
    answers = c.select(F.concat(F.lit("G"), F.col("c_custkey").cast("string")).alias("item_id"), F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("It is "), F.lower("c_mktsegment"))).when(F.col("c_custkey") % 5 == 1, F.lit("none, BUx")).otherwise(F.concat(F.lit("It is "), F.regexp_replace("c_mktsegment", "(.)", "$1 "))).alias("answer"), (F.col("c_custkey") % 2 == 0).alias("refused"))
    return items, first, edges, answers


def _context(edges: DataFrame) -> DataFrame:
    return edges.filter("confidence < 0.995").select(F.concat(F.lit("G"), F.expr("substring(head, 2)")).alias("item_id"), "head", "relation", "tail")


def scored_items(spark: SparkSession, d: str) -> DataFrame:
    items, expected, edges, answers = golden(spark, d)
    context = _context(edges)
    rows_ = V.scored(items, answers, V.path_recall(items, expected, context), answers.withColumn("answer", F.upper("answer")))
    return V.failure_layer(rows_, V.missing(expected, edges), V.found_in(expected, context, "item_id").filter("hit = 0"))


@query
def eval_answer_acc(spark: SparkSession, d: str) -> DataFrame:
    items, _, _, answers = golden(spark, d)
    return items.join(answers, "item_id").select("item_id", R.answer_accuracy(F.col("answer"), F.col("expected")).alias("accuracy"))


@query
def eval_path_recall(spark: SparkSession, d: str) -> DataFrame:
    items, expected, edges, _ = golden(spark, d)
    return V.path_recall(items, expected, _context(edges))


@query
def eval_by_hop(spark: SparkSession, d: str) -> DataFrame:
    return V.by_hops(scored_items(spark, d))


@query
def eval_overall(spark: SparkSession, d: str) -> DataFrame:
    return V.overall(scored_items(spark, d))


@query
def eval_failure_layer(spark: SparkSession, d: str) -> DataFrame:
    return V.layer_counts(scored_items(spark, d))


@query
def eval_missing_triples(spark: SparkSession, d: str) -> DataFrame:
    _, expected, edges, _ = golden(spark, d)
    return V.missing(expected, edges).select("item_id", "head", "relation", "tail")


@query
def eval_golden_report(spark: SparkSession, d: str) -> DataFrame:
    items, expected, edges, _ = golden(spark, d)
    return V.golden_report(items, expected, edges)


@query
def eval_sample_set(spark: SparkSession, d: str) -> DataFrame:
    """The whole evaluation over the sample graph: questions answered, compared and laid to a layer."""
    items = rows(spark, [("Q1", 1, "동의단지회", True), ("Q2", 2, "한인애국단", True), ("Q3", 2, "김원봉", True), ("Q4", 1, "", False), ("Q5", 3, "봉오동 전투", True)], "item_id string, hops int, answer string, answerable boolean")
    items = items.join(questions(spark).withColumnRenamed("qid", "item_id"), "item_id").withColumn("expected", F.array("answer")).drop("answer")
    expected = rows(spark, [("Q1", 0, "안중근", "FOUNDED", "동의단지회"), ("Q2", 0, "김구", "FOUNDED", "한인애국단"), ("Q5", 0, "대한독립군", "PARTICIPATED_IN", "봉오동 전투")], "item_id string, n int, head string, relation string, tail string")
    return evaluate(items, expected, sample_edges(spark), aliases(spark))["items"].select("item_id", "hops", "accuracy", "recall", "refusal_ok", "layer")
