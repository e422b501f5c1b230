"""Rule extraction: pairs of mentions in one sentence, by particles, verbs and distances.

A sentence is a row with its mentions, so pairs are made by array functions inside the row: no
self-join, and no shuffle. Candidates are wider than the schema on purpose; the gate says what was refused.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.arrow import match_starts
from ..functions.rules import abbreviated
from ..functions.text import evidence, normalized, sentences

P, O, E = "Person", "Organization", "Event"
CANDIDATE = "struct<head:string,head_type:string,relation:string,tail:string,tail_type:string,confidence:double,extractor:string>"


def sentence_rows(documents: DataFrame) -> DataFrame:
    """(title, doc_type, ord, sentence) of documents (title, doc_type, body), in order."""
    return documents.select("title", "doc_type", F.posexplode(sentences(F.col("body"))).alias("ord", "sentence"))


def with_mentions(rows: DataFrame, scan: Callable[[Column], Column]) -> DataFrame:
    return rows.withColumn("mentions", scan(F.col("sentence")))


def _rest(m: Column) -> Column:
    return F.regexp_replace(F.substring(F.col("sentence"), m["end"] + 1, F.length("sentence")), fixed.GLOSS_AFTER, "")


def subject_like(m: Column) -> Column:
    rest = _rest(m)
    listed = rest.rlike(fixed.LISTED_SUBJECT)
    return ~rest.rlike(fixed.NOT_SUBJECT) & (listed | (~rest.rlike(fixed.OBJECT_PARTICLE) & rest.rlike(fixed.SUBJECT_MARK)))


def object_like(m: Column) -> Column:
    rest = _rest(m)
    return ~rest.rlike(fixed.NOT_OBJECT) & (rest.rlike(fixed.OBJECT_MARK) | F.startswith(rest, F.lit(" ")))


def not_oblique(m: Column) -> Column:
    return ~_rest(m).rlike(fixed.OBLIQUE)


def locative(m: Column) -> Column:
    return F.substring(F.col("sentence"), m["end"] + 1, F.lit(2)).rlike(fixed.LOCATIVE)


def within(verbs: str, m: Column, most: int) -> Column:
    return F.exists(verbs, lambda v: v.between(m["end"], m["end"] + most))


def _of(*kinds: str) -> Column:
    return F.filter("mentions", lambda m: m["type"].isin(*kinds))


def _made(head: tuple[Column, Column], relation: str, tail: tuple[Column, Column], confidence: Column, extractor: Column) -> Column:
    return F.struct(head[0].alias("head"), head[1].alias("head_type"), F.lit(relation).alias("relation"), tail[0].alias("tail"), tail[1].alias("tail_type"), confidence.cast("double").alias("confidence"), extractor.alias("extractor"))


def _pairs(heads: Column, tails: Column, fits: Callable[[Column, Column], Column], relation: str, confidence: float, extractor: str) -> Column:
    """Candidates for all pairs of a sentence's heads and tails that fit."""
    one = lambda m: (m["name"], m["type"])
    return F.flatten(F.transform(heads, lambda h: F.transform(F.filter(tails, lambda t: fits(h, t)), lambda t: _made(one(h), relation, one(t), F.lit(confidence), F.lit(extractor)))))


def _document(others: Column, fits: Callable[[Column], Column], relation: str, confidence: Column, extractor: Column, document_is_head: bool) -> Column:
    own = (F.col("title"), F.col("doc_type"))
    one = lambda m: (m["name"], m["type"])
    return F.transform(F.filter(others, fits), lambda m: _made(own, relation, one(m), confidence, extractor) if document_is_head else _made(one(m), relation, own, confidence, extractor))


def candidates(rows: DataFrame) -> DataFrame:
    """Candidate edges of sentences (title, doc_type, ord, sentence, mentions) under the eight sentence and document rules."""
    verbs = {"found_a": fixed.FOUND_ACTIVE, "found_p": fixed.FOUND_PASSIVE, "part_a": fixed.PART_ACTIVE, "part_p": fixed.PART_PASSIVE}
    some = rows.filter(F.size("mentions") > 0)
    for name, pattern in verbs.items():
        some = some.withColumn(name, match_starts(pattern)(F.col("sentence")))
    agent = F.col("sentence").rlike(fixed.AGENT_MARKER)
    has = lambda name: F.size(name) > 0

    def passive(head: Column, tail: Column) -> Column:
        verb = F.get(F.filter("found_p", lambda v: v.between(head["end"], head["end"] + 30)), 0)
        gap = F.substring(F.col("sentence"), head["end"] + 1, verb - head["end"])
        return agent & (tail["start"] < head["start"]) & verb.isNotNull() & ((gap == "") | gap.rlike(fixed.AGENT_MARKER))

    other = lambda *kinds: F.filter("mentions", lambda m: m["type"].isin(*kinds) & ~((m["name"] == F.col("title")) & (m["type"] == F.col("doc_type"))))
    none = lambda array: F.size(array) == 0
    kind = F.col("doc_type")
    strong, role = has("part_a") | has("part_p"), F.col("sentence").rlike(fixed.PART_ROLE)
    active_end = lambda m: within("found_a", m, 30)
    empty = F.array().cast(f"array<{CANDIDATE}>")
    doc = lambda condition, array: F.when(condition, array).otherwise(empty)
    found = F.flatten(F.array(
        _pairs(_of(P, O), _of(O, E), lambda h, t: (h["start"] < t["start"]) & subject_like(h) & object_like(t) & within("found_a", t, 25), "FOUNDED", 0.88, "rule_founded_v1_active"),
        _pairs(_of(P, O), _of(O, E), passive, "FOUNDED", 0.80, "rule_founded_v2_passive"),
        _pairs(_of(P, O, E), _of(E, O), lambda h, t: (h["start"] < t["start"]) & subject_like(h) & within("part_a", t, 30), "PARTICIPATED_IN", 0.88, "rule_participated_v1_active"),
        _pairs(_of(P, O, E), _of(E, O), lambda h, t: locative(t) & (t["start"] < h["start"]) & subject_like(h) & within("part_a", h, 40), "PARTICIPATED_IN", 0.75, "rule_participated_v2_locative"),
        doc((kind == O) & none(other(O)), _document(other(P), lambda m: not_oblique(m) & active_end(m), "FOUNDED", F.lit(0.82), F.lit("rule_founded_v3_doc_org"), False)),
        doc((kind == O) & none(other(O)) & agent, _document(other(P), lambda m: not_oblique(m) & ~active_end(m) & within("found_p", m, 30), "FOUNDED", F.lit(0.74), F.lit("rule_founded_v3p_doc_org_passive"), False)),
        doc((kind == P) & none(other(P)), _document(other(O), lambda m: object_like(m) & within("found_a", m, 20), "FOUNDED", F.lit(0.80), F.lit("rule_founded_v4_doc_person"), True)),
        doc((kind == E) & none(other(E)) & (strong | role), _document(other(P, O), lambda m: F.lit(True), "PARTICIPATED_IN", F.when(strong, 0.80).otherwise(0.68), F.when(strong, "rule_participated_v3_doc_event").otherwise("rule_participated_v5_doc_event_role"), False)),
        doc(kind.isin(P, O) & none(other(P, O)), _document(other(E), lambda m: within("part_a", m, 25), "PARTICIPATED_IN", F.lit(0.80), F.lit("rule_participated_v4_doc_entity"), True)),
    ))
    return some.select(F.inline(found), F.lit("rule").alias("origin"), F.col("title").alias("source"), "ord", evidence(F.col("sentence")).alias("evidence"))


def category_candidates(documents: DataFrame, events: DataFrame) -> DataFrame:
    """Candidates of person and organization documents (title, doc_type, categories) whose category is the name of an event."""
    each = documents.filter(F.col("doc_type").isin(P, O)).select("title", "doc_type", F.posexplode("categories").alias("ord", "category")).withColumn("name", abbreviated(normalized(F.col("category"))))
    quote = F.concat(F.lit(fixed.CATEGORY_EVIDENCE[0]), "category", F.lit(fixed.CATEGORY_EVIDENCE[1]), "title", F.lit(fixed.CATEGORY_EVIDENCE[2]))
    return each.join(events.select(F.col("id").alias("name")).distinct(), "name").select(
        F.col("title").alias("head"), F.col("doc_type").alias("head_type"), F.lit("PARTICIPATED_IN").alias("relation"), F.col("name").alias("tail"), F.lit(E).alias("tail_type"),
        F.lit(0.90).alias("confidence"), F.lit("rule_cat_participated_v6").alias("extractor"), F.lit("rule").alias("origin"), F.col("title").alias("source"), "ord", quote.alias("evidence"),
    )


def residual(rows: DataFrame, accepted: DataFrame, most: int = 150) -> DataFrame:
    """Sentences without an edge, with two mentions or more of types that the schema could join: what an optional model may read."""
    quiet = rows.join(accepted.select(F.col("source").alias("title"), "ord").distinct(), ["title", "ord"], "left_anti").filter(F.size("mentions") >= 2)
    kinds = F.transform("mentions", lambda m: m["type"])
    several = lambda a, b: F.array_contains(kinds, a) & F.array_contains(kinds, b)
    return quiet.filter(several(P, E) | several(P, O) | several(O, E)).orderBy("title", "ord").limit(most)


def model_candidates(rows: DataFrame, ask: Callable[[Column], Column] | None) -> DataFrame | None:
    """Candidates that a model's answer (JSON of head, relation, tail) names among a sentence's mentions; None without a model."""
    if ask is None:
        return None
    kind = "array<struct<head:string,relation:string,tail:string>>"
    answered = rows.withColumn("triples", F.from_json(ask(F.col("sentence")), kind)).select("*", F.explode("triples").alias("t"))
    type_of = lambda name: F.get(F.transform(F.filter("mentions", lambda m: m["name"] == name), lambda m: m["type"]), 0)
    typed = answered.withColumn("head_type", type_of(F.col("t.head"))).withColumn("tail_type", type_of(F.col("t.tail"))).filter("head_type is not null and tail_type is not null")
    return typed.select(F.col("t.head").alias("head"), "head_type", F.col("t.relation").alias("relation"), F.col("t.tail").alias("tail"), "tail_type", F.lit(0.70).alias("confidence"), F.lit("llm_extract_v1").alias("extractor"), F.lit("llm").alias("origin"), F.col("title").alias("source"), "ord", evidence(F.col("sentence")).alias("evidence"))
