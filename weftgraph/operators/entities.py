"""Names to entities: inventory, typing, merging, homonyms, aliases and their conflicts, discovery in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.rules import abbreviated, dropped_reason, entity_type
from ..functions.text import DOTS, gloss, normalization_rules, normalized

#: The normalization rules, in the order of a report.
RULES = ("whitespace", "qualifier", "gloss", "particle", "redirect", "abbreviation", "spaces")
SURFACE_ROWS = 200_000


def inventory(pages: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(entities, dropped) of pages (title, categories, is_doc): typed, normalized, with reasons.

    Two pages whose titles come to the same name and type are two entities: the first, by no brackets and then by
    title, keeps the name and the others their full title, unless an abbreviation merged them on purpose.
    """
    typed = pages.withColumn("verdict", entity_type(F.col("title"), F.col("categories"))).select("*", "verdict.type", F.col("verdict.reason").alias("why")).drop("verdict")
    named = typed.withColumn("plain", normalized(F.col("title"))).withColumn("name", abbreviated(F.col("plain"))).withColumn("gloss", gloss(F.col("title")))
    judged = named.withColumn("dropped", F.coalesce(F.when(F.col("type").isNull(), F.col("why")), dropped_reason(F.col("name"), least)))
    order = W.partitionBy("name", "type").orderBy(F.col("title").rlike(r"[(（]").cast("int"), "title")
    short = F.col("plain") != F.col("name")
    kept = judged.filter("dropped is null").withColumn("turn", F.row_number().over(order))
    apart = (F.col("turn") > 1) & ~short & (F.col("title") != F.col("name"))
    entities = kept.withColumn("name", F.when(apart, F.regexp_replace(F.trim("title"), r"\s+", " ")).otherwise(F.col("name")))
    return entities.drop("dropped"), judged.filter("dropped is not null").select("title", F.col("dropped").alias("reason"))


def merged_entities(mentions: DataFrame) -> DataFrame:
    """One row for each (name, type) of mentions (name, type, alias, source, is_doc, reason, ord): unions, and the first reason by ord."""
    return mentions.groupBy("name", "type").agg(
        F.array_sort(F.collect_set("alias")).alias("aliases"), F.array_sort(F.collect_set("source")).alias("sources"), F.bool_or("is_doc").alias("is_doc"),
        F.min_by("reason", F.when(F.col("reason") != "", F.col("ord"))).alias("reason"), F.count_distinct("source").alias("doc_count"),
    )


def alias_claims(entities: DataFrame) -> DataFrame:
    """(surface, id, type, ord) of entities (name, type, gloss, redirects, ord): the name, without spaces, its gloss and redirects."""
    surfaces = F.array_compact(F.concat(F.array("name", F.replace("name", F.lit(" "), F.lit("")), "gloss"), F.coalesce("redirects", F.array().cast("array<string>"))))
    each = entities.select("ord", F.posexplode(surfaces).alias("n", "surface"), F.col("name").alias("id"), "type")
    unified = F.trim(F.regexp_replace(F.regexp_replace("surface", DOTS.replace("ㆍ", "").replace("･", ""), "·"), r"\s+", " "))
    return each.withColumn("surface", unified).filter((F.length("surface") >= 2) & ~F.col("surface").isin(*fixed.STOPWORDS))


def first_claims(claims: DataFrame) -> DataFrame:
    """(surface, id, type): the earliest claim of each surface."""
    rank = F.row_number().over(W.partitionBy("surface").orderBy("ord", "n", "id", "type"))
    return claims.withColumn("rank", rank).filter("rank = 1").select("surface", "id", "type")


def surface_table(claims: DataFrame, most: int = SURFACE_ROWS) -> dict[str, tuple[str, str]]:
    """The surface table for a mention scan; refuses one that is larger than its bound."""
    rows = claims.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} surfaces: scan by first characters, a part of the table at a time")
    return {r["surface"]: (r["id"], r["type"]) for r in rows}


def redirect_claims(pages: DataFrame, entities: DataFrame) -> DataFrame:
    """(surface, name) for redirects of pages (title, redirects) to entities (title, name), under their standard forms."""
    each = pages.join(entities.select("title", "name"), "title").select("name", F.explode("redirects").alias("redirect"))
    return each.select(normalized(F.col("redirect")).alias("surface"), "name").filter("surface <> '' and surface <> name")


def rule_hits(names: DataFrame, entities: DataFrame, mentions: DataFrame, redirects: DataFrame) -> DataFrame:
    """(rule, applied, example): how often each normalization rule was used, with its least example; all rules, in their order by ``turn``.

    names (name) are raw names; entities (name, type) the inventory; mentions (surface, raw) what was matched in texts and what stood there
    with its particle; redirects (surface, name) what ``redirect_claims`` gives.
    """
    becomes = lambda a, b: F.concat(a, F.lit(" → "), b)
    changed = names.select(F.explode(normalization_rules(F.col("name"))).alias("rule"), becomes(F.col("name"), normalized(F.col("name"))).alias("example"))
    particle = mentions.filter(F.col("raw") != F.col("surface")).select(F.lit("particle").alias("rule"), becomes(F.col("raw"), F.col("surface")).alias("example"))
    redirect = redirects.select(F.lit("redirect").alias("rule"), becomes(F.col("surface"), F.col("name")).alias("example"))
    short = F.explode(F.array(*(F.struct(F.lit(s).alias("short"), F.lit(n).alias("name")) for s, n in fixed.ABBREVIATIONS.items()))).alias("p")
    table = entities.sparkSession.range(1).select(short).select("p.short", normalized(F.col("p.name")).alias("name"))
    abbreviation = table.join(entities.select("name").distinct(), "name").select(F.lit("abbreviation").alias("rule"), becomes(F.col("short"), F.col("name")).alias("example"))
    bare = F.replace("name", F.lit(" "), F.lit(""))
    spaces = entities.select("name", "type").distinct().filter(bare != F.col("name")).select(F.lit("spaces").alias("rule"), becomes(bare, F.col("name")).alias("example"))
    counts = changed.unionByName(particle).unionByName(redirect).unionByName(abbreviation).unionByName(spaces).groupBy("rule").agg(F.count("*").alias("applied"), F.min("example").alias("example"))
    every = entities.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, RULES))).alias("turn", "rule"))
    return every.join(counts, "rule", "left").select("turn", "rule", F.coalesce("applied", F.lit(0)).alias("applied"), F.coalesce("example", F.lit("-")).alias("example"))


def merge_log(nodes: DataFrame) -> DataFrame:
    """(id, merged): the other aliases of nodes that have any."""
    return nodes.select("id", F.array_sort(F.array_except("aliases", F.array("id"))).alias("merged")).filter(F.size("merged") > 0)


def gloss_aliases(bodies: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(surface, id, type) for Han glosses in texts: the longest known ending of what stands before the brackets names the entity."""
    pairs = F.arrays_zip(F.regexp_extract_all("body", F.lit(fixed.GLOSS), F.lit(1)).alias("raw"), F.regexp_extract_all("body", F.lit(fixed.GLOSS), F.lit(2)).alias("han"))
    found = bodies.select(F.explode(pairs).alias("p")).select(F.trim("p.raw").alias("raw"), F.col("p.han").alias("han")).distinct()
    endings = found.select("raw", "han", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("raw")), lambda i: F.substring("raw", i, F.length("raw")))).alias("at", "surface"))
    known = endings.join(surfaces, "surface").groupBy("raw", "han").agg(F.min_by(F.struct("id", "type"), "at").alias("node"))
    return known.join(surfaces.select(F.col("surface").alias("han")), "han", "left_anti").groupBy(F.col("han").alias("surface")).agg(F.min("node").alias("node")).select("surface", "node.id", "node.type")


def discovered(bodies: DataFrame, surfaces: DataFrame, documents: int = 2, documents_short: int = 3) -> DataFrame:
    """(name, type, doc_support): events and organizations by their endings, seen in enough documents (title, body)."""
    rules = ((fixed.DISCOVER_EVENT, "Event", documents), (fixed.DISCOVER_ORGANIZATION, "Organization", documents), (fixed.DISCOVER_SHORT_ORGANIZATION, "Organization", documents_short))
    named_by = lambda kind, need: lambda s: F.struct(F.trim(s).alias("raw"), F.lit(kind).alias("type"), F.lit(need).alias("need"))
    found = F.flatten(F.array(*(F.transform(F.regexp_extract_all("body", F.lit(p), F.lit(1)), named_by(k, n)) for p, k, n in rules)))
    each = bodies.select("title", F.explode(F.array_distinct(found)).alias("f")).select("title", "f.raw", "f.type", "f.need")
    named = each.withColumn("name", abbreviated(normalized(F.col("raw")))).filter((F.length("name") >= 3) & ~F.col("name").isin(*fixed.STOPWORDS, *fixed.GENERIC_NAMES))
    unknown = named.join(surfaces.select(F.col("surface").alias("raw")), "raw", "left_anti").join(surfaces.select(F.col("surface").alias("name")), "name", "left_anti")
    support = unknown.groupBy("name", "type").agg(F.count_distinct("title").alias("doc_support"), F.min("need").alias("need"))
    return support.filter("doc_support >= need").drop("need")
