"""Readers of the file formats: Markdown documents, manifest, graph (JSON and GraphML), golden set, run log."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import DOCUMENT, STORED
from ..functions.text import stripped, trimmed_body

TRIPLE = "struct<head:string,relation:string,tail:string>"
EDGE = "struct<head:string,relation:string,tail:string,origin:string,confidence:double,sources:array<string>,evidence:array<string>,extractor:string>"
NODE = "struct<id:string,type:string,aliases:array<string>,sources:array<string>,doc_count:int,degree:int>"
GRAPH = f"nodes array<{NODE}>, edges array<{EDGE}>, alias_index map<string,string>"
GOLDEN = f"version string, items array<struct<id:string,hops:int,type:string,question:string,expected_answer:array<string>,expected_path:array<{TRIPLE}>,evidence:array<struct<doc:string,quote:string>>,answerable:boolean,note:string>>"
MANIFEST = (
    "collected_at string, source string, topic string, seeds array<string>, stats map<string,int>, "
    "docs array<struct<title:string,file:string,categories:array<string>,chars:int,hop:int,reason:string,redirects:array<string>>>, "
    "gazetteer map<string,struct<categories:array<string>,redirects:array<string>>>, rejected array<struct<title:string,reason:string>>"
)
SCORES = "struct<answer_acc:double,path_recall:double,refusal_ok:double>"
EVALUATION = (
    f"run_at string, n_items int, by_hop map<string,struct<n:int,graphrag:{SCORES},basic_rag:struct<answer_acc:double>>>, "
    "unanswerable struct<n:int,refusal_accuracy:double,hallucinated:int>, overall struct<graphrag_answer_acc:double,basic_rag_answer_acc:double>, "
    "failure_layer_counts map<string,int>"
)


@dataclass(frozen=True)
class Config:
    """Limits of retrieval, with the defaults that a missing or broken file leaves."""

    max_hops: int = 3
    start_hops: int = 2
    max_triples: int = 60
    per_relation: int = 25
    hub_degree_threshold: int = 25
    degree_penalty: bool = True
    min_entity_len: int = 2
    allowed: tuple[tuple[str, str, str], ...] = field(default=(("Person", "PARTICIPATED_IN", "Event"), ("Person", "FOUNDED", "Organization"), ("Organization", "PARTICIPATED_IN", "Event")))


def read_config(path: str | None) -> Config:
    """Defaults overlaid with a JSON file's retrieval and schema parts."""
    try:
        with open(path or "", encoding="utf-8") as file:
            raw = json.load(file)
    except (OSError, ValueError):
        return Config()
    known = {f.name for f in fields(Config)} - {"allowed"}
    values = {k: v for k, v in raw.get("retrieval", {}).items() if k in known}
    relations = raw.get("schema", {}).get("relations")
    if relations:
        values["allowed"] = tuple((r["head"], r["relation"], r["tail"]) for r in relations)
    return Config(**values)


def first_existing(*paths: str) -> str | None:
    """The first of several places that there is."""
    return next((p for p in paths if p and os.path.exists(p)), None)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(title, categories, body, raw_chars, file) of Markdown documents; files of another form are left out."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value"), F.col("_metadata.file_name").alias("file"))
    part = lambda n: F.regexp_extract("value", DOCUMENT, n)
    parsed = raw.filter(F.col("value").rlike(DOCUMENT)).select(stripped(part(1)).alias("title"), part(2).alias("named"), part(3).alias("body"), "file")
    categories = F.filter(F.transform(F.split("named", ","), stripped), lambda c: c != "")
    return parsed.select("title", categories.alias("categories"), trimmed_body(F.col("body")).alias("body"), F.length("body").alias("raw_chars"), "file").orderBy("file")


def stored_documents(spark: SparkSession, path: str) -> DataFrame:
    """(title, categories, body, file) of stored Markdown files; one of another form has no title, no categories and its raw text as body."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    part = lambda n: F.regexp_extract("value", STORED, n)
    # No group matches in a file of another form, so its parts are empty.
    categories = F.filter(F.transform(F.split(part(2), ","), stripped), lambda c: c != "")
    return raw.select(stripped(part(1)).alias("title"), categories.alias("categories"), F.when(F.col("value").rlike(STORED), part(3)).otherwise(F.col("value")).alias("body"), "file")


def corpus_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc, file, text) of Markdown files whole, named by their files."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("file"))
    return raw.select(F.replace(F.regexp_replace("file", r"\.md$", ""), F.lit("_"), F.lit(" ")).alias("doc"), "file", "text")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest as one row; a broken file gives nulls."""
    return spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, alias rows) of a graph file, edges with their ends' types."""
    whole = spark.read.schema(GRAPH).option("multiLine", True).json(path)
    nodes = whole.select(F.posexplode("nodes").alias("ord", "n")).select("ord", "n.*")
    return nodes, typed(whole.select(F.inline("edges")), nodes), whole.select(F.explode("alias_index").alias("surface", "id"))


def typed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with head_type and tail_type."""
    kinds = nodes.select("id", "type")
    heads, tails = kinds.toDF("head", "head_type"), kinds.toDF("tail", "tail_type")
    return edges.join(heads, "head", "left").join(tails, "tail", "left")


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a GraphML file, whose lists are joined by semicolons."""
    data = "data array<struct<_VALUE:string,_key:string>>"
    value = lambda name: F.get(F.filter("data", lambda d: d["_key"] == name), 0)["_VALUE"]
    listed = lambda name: F.filter(F.split(F.coalesce(value(name), F.lit("")), ";"), lambda x: x != "")
    rows = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, {data}").load(path)
    nodes = rows.select(F.col("_id").alias("id"), value("d0").alias("type"), listed("d1").alias("aliases"), listed("d2").alias("sources"), value("d3").cast("int").alias("doc_count"), value("d4").cast("int").alias("degree"))
    rows = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, {data}").load(path)
    edges = rows.select(F.col("_source").alias("head"), value("d5").alias("relation"), F.col("_target").alias("tail"), value("d6").alias("origin"), value("d7").cast("double").alias("confidence"), listed("d8").alias("sources"), listed("d9").alias("evidence"), value("d10").alias("extractor"))
    return nodes, typed(edges, nodes)


def golden(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(items, expected triples) of a golden set."""
    items = spark.read.schema(GOLDEN).option("multiLine", True).json(path).select(F.inline("items"))
    items = items.withColumnRenamed("id", "item_id").withColumnRenamed("expected_answer", "expected")
    expected = items.select("item_id", F.posexplode("expected_path").alias("n", "t")).select("item_id", "n", "t.*")
    return items.drop("expected_path"), expected


def evaluation(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(one row of totals, one row for each number of hops) of an evaluation file; a broken file gives nulls and no hops."""
    whole = spark.read.schema(EVALUATION).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    totals = whole.select("run_at", "n_items", F.col("unanswerable.n").alias("unanswerable"), "unanswerable.refusal_accuracy", F.col("unanswerable.hallucinated").alias("hallucinations"), F.col("overall.graphrag_answer_acc").alias("accuracy"), F.col("overall.basic_rag_answer_acc").alias("control_accuracy"), "failure_layer_counts")
    hops = whole.select(F.explode("by_hop").alias("hops", "v")).select(F.col("hops").cast("int").alias("hops"), "v.n", F.col("v.graphrag.answer_acc").alias("accuracy"), F.col("v.graphrag.path_recall").alias("recall"), F.col("v.basic_rag.answer_acc").alias("control_accuracy"))
    return totals, hops


def run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ts string, question string, route string, refused boolean, answer string, path_explanation string, hops_used int, deepened boolean").json(path)
