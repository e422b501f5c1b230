"""Writers: graph as JSON and GraphML, selected and rejected documents, run log, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_name
from ..operators.graph import claimed_aliases, statistics
from .stage import written


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes, edges, alias rows and counts as JSON lines in folders of their own, packed by gzip; sorted, so that equal graphs give equal files.

    The nodes are stored first, as each of the folders but that of the edges is made of them.
    """
    nodes = written(nodes, "nodes")
    nodes.orderBy("id").write.mode("overwrite").json(f"{path}/nodes", compression="gzip")
    edges.orderBy("head", "relation", "tail").write.mode("overwrite").json(f"{path}/edges", compression="gzip")
    claimed_aliases(nodes).orderBy("surface").write.mode("overwrite").json(f"{path}/alias_index", compression="gzip")
    kinds = nodes.groupBy(F.col("type").alias("value")).agg(F.count("*").alias("n")).select(F.lit("type").alias("kind"), "value", "n")
    every = nodes.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("kind"), F.lit("all").alias("value"), "n")
    counts = statistics(edges).withColumnRenamed("edges", "n").withColumn("kind", F.when(F.col("kind") == "all", "edges").otherwise(F.col("kind")))
    kinds.unionByName(every).unionByName(counts).orderBy("kind", "value").write.mode("overwrite").json(f"{path}/stats", compression="gzip")


def graphml_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The elements of a GraphML document, one a row; lists are joined by semicolons."""
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    data = lambda key, c: F.concat(F.lit(f'<data key="{key}">'), safe(F.coalesce(c.cast("string"), F.lit(""))), F.lit("</data>"))
    joined = lambda name: F.array_join(name, ";")
    node = F.concat(F.lit('<node id="'), safe(F.col("id")), F.lit('">'), data("d0", F.col("type")), data("d1", joined("aliases")), data("d2", joined("sources")), data("d3", F.col("doc_count")), data("d4", F.col("degree")), F.lit("</node>"))
    edge = F.concat(F.lit('<edge source="'), safe(F.col("head")), F.lit('" target="'), safe(F.col("tail")), F.lit('">'), data("d5", F.col("relation")), data("d6", F.col("origin")), data("d7", F.col("confidence")), data("d8", joined("sources")), data("d9", joined("evidence")), data("d10", F.col("extractor")), F.lit("</edge>"))
    return nodes.select(F.lit(0).alias("turn"), F.col("id").alias("ord"), node.alias("element")).unionByName(edges.select(F.lit(1).alias("turn"), F.concat_ws("|", "head", "relation", "tail").alias("ord"), edge.alias("element")))


#: Keys of GraphML attributes, by what they belong to.
GRAPHML_KEYS = {"node": ("type", "aliases", "sources", "doc_count", "degree"), "edge": ("relation", "origin", "confidence", "sources", "evidence", "extractor")}


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One XML document, an element a line. The rows are sorted in parallel and then written by one task as they come;
    the scalable form of a graph is ``write_graph``."""
    named = [(kind, name) for kind, names in GRAPHML_KEYS.items() for name in names]
    keys = "".join(f'<key id="d{i}" for="{kind}" attr.name="{name}" attr.type="string"/>' for i, (kind, name) in enumerate(named))
    ends = nodes.sparkSession.createDataFrame([(-1, "", f'<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">'), (2, "", "</graph></graphml>")], "turn int, ord string, element string")
    graphml_rows(nodes, edges).unionByName(ends).orderBy("turn", "ord").select("element").coalesce(1).write.mode("overwrite").text(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """Documents with their file names and Markdown texts as Parquet: a table instead of a file for each row."""
    text = F.concat(F.lit("# "), "title", F.lit("\n\n분류: "), F.array_join("categories", ", "), F.lit("\n\n"), "body", F.lit("\n"))
    documents.select("title", file_name(F.col("title")).alias("file"), text.alias("text")).write.mode("overwrite").parquet(path)


def write_selection(judged: DataFrame, path: str) -> None:
    """Kept and rejected pages in folders of their own; nothing is deleted."""
    judged.filter("reason is null").write.mode("overwrite").parquet(f"{path}/kept")
    judged.filter("reason is not null").write.mode("overwrite").parquet(f"{path}/rejected")


def manifest_row(kept: DataFrame, rejected: DataFrame, gazetteer: DataFrame, seeds: list[str], stats: dict[str, int], source: str, topic: str) -> DataFrame:
    """One row in the form that ``files.manifest`` reads: kept (title, categories, chars, hop, why, redirects), rejected (title, reason)
    and gazetteer (title, categories, redirects). A manifest is one JSON object, so its lists are one row: for a corpus that
    fits it. ``write_selection`` is the scalable form."""
    doc = F.struct("hop", "title", file_name(F.col("title")).alias("file"), "categories", "chars", F.col("why").alias("reason"), "redirects")
    shown = lambda d: F.struct(d["title"].alias("title"), d["file"].alias("file"), d["categories"].alias("categories"), d["chars"].alias("chars"), d["hop"].alias("hop"), d["reason"].alias("reason"), d["redirects"].alias("redirects"))
    docs = kept.agg(F.transform(F.array_sort(F.collect_list(doc)), shown).alias("docs"))
    left = rejected.agg(F.transform(F.array_sort(F.collect_list(F.struct("reason", "title"))), lambda r: F.struct(r["title"].alias("title"), r["reason"].alias("reason"))).alias("rejected"))
    entry = F.struct("title", F.struct("categories", "redirects").alias("v"))
    known = gazetteer.dropDuplicates(["title"]).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("gazetteer"))
    numbers = F.create_map(*(F.lit(x) for pair in stats.items() for x in pair)) if stats else F.create_map().cast("map<string,int>")
    at = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    # Three tables of one row each.
    return docs.crossJoin(known).crossJoin(left).select(
        at.alias("collected_at"), F.lit(source).alias("source"), F.lit(topic).alias("topic"), F.array(*map(F.lit, seeds)).cast("array<string>").alias("seeds"),
        numbers.alias("stats"), "docs", "gazetteer", "rejected",
    )


def write_manifest(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("overwrite").json(path)


def append_runs(answers: DataFrame, path: str) -> None:
    answers.withColumn("ts", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")).write.mode("append").json(path)


def write_report(frames: dict[str, DataFrame], path: str) -> None:
    """Several small tables as JSON, a folder each."""
    for name, frame in frames.items():
        frame.write.mode("overwrite").json(f"{path}/{name}")
