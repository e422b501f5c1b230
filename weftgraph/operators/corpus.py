"""Selection of a corpus from seeds: links, shared categories, rules in order, quota, with a reason for each page left out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import first_of, noise_category, title_block, topic_scope

STUB_CHARS = 800


def link_support(links: DataFrame, least: int = 2) -> DataFrame:
    """(target, support): pages that so many seeds of links (seed, target) link to."""
    return links.groupBy("target").agg(F.count_distinct("seed").alias("support")).filter(F.col("support") >= least)


def shared_categories(categories: DataFrame, least: int = 2) -> DataFrame:
    """(category, seeds): categories that so many seeds of (seed, category) have, without those that say nothing."""
    telling = categories.filter(~noise_category(F.col("category")))
    return telling.groupBy("category").agg(F.count_distinct("seed").alias("seeds")).filter(F.col("seeds") >= least)


def overlaps(pages: DataFrame, pool: DataFrame) -> DataFrame:
    """(title, overlap): how many categories of a page (title, category) are in the pool."""
    return pages.join(pool.select("category"), "category", "left_semi").groupBy("title").agg(F.count_distinct("category").alias("overlap"))


def selected(pages: DataFrame, quota: int, stub: int = STUB_CHARS) -> DataFrame:
    """pages (title, categories, support, overlap, chars, failed) with the reason of each that stays out, the first rule's; null for those kept.

    The quota counts pages that were saved, in order of overlap, support and title, so a failed one uses none of it.
    """
    reason = first_of(
        (F.col("support") < 2, F.lit("few_links")), (title_block(F.col("title")).isNotNull(), title_block(F.col("title"))), (F.col("overlap") < 1, F.lit("no_shared_category")),
        (topic_scope(F.col("categories")).isNotNull(), topic_scope(F.col("categories"))), (F.col("failed"), F.lit("fetch_failed")), (F.col("chars") < stub, F.lit("stub")),
    )
    judged = pages.withColumn("reason", reason)
    place = F.struct((-F.col("overlap")).alias("overlap"), (-F.col("support")).alias("support"), "title")
    # Only what is left takes a place. The last place within the quota is one row; a limit by order is taken in each task first.
    kept = judged.filter("reason is null")
    last = kept.select(place.alias("last")).orderBy("last").limit(quota).agg(F.max("last").alias("last"))
    kept = kept.crossJoin(F.broadcast(last)).withColumn("reason", F.when(F.coalesce(place > F.col("last"), F.lit(True)), "over_quota")).drop("last")
    return kept.unionByName(judged.filter("reason is not null"))


def collected(seeds: DataFrame, links: DataFrame, categories: DataFrame, texts: DataFrame, quota: int, stub: int = STUB_CHARS) -> DataFrame:
    """(title, hop, support, overlap, reason): the whole way from seeds (title) to kept pages, whose reason is null.

    links (seed, target), categories (title, category) and texts (title, chars) may know pages in vain. A seed without a
    row in texts is missing. The other seeds' targets are pages at two hops; they pass the rules in order, and those that
    do are taken by overlap, support and title until the quota is full, which seeds fill first. Pages after that are not
    looked at, whatever their texts.
    """
    own = seeds.select("title").distinct().join(texts.groupBy("title").agg(F.max("chars").alias("chars")), "title", "left")
    seed_reason = F.when(F.col("chars").isNull(), "seed_missing").when(F.col("chars") == 0, "fetch_failed").when(F.col("chars") < stub, "stub")
    first = own.withColumn("reason", seed_reason)
    there = own.filter("chars is not null").select("title")
    support = links.join(there.withColumnRenamed("title", "seed"), "seed", "left_semi").join(there.withColumnRenamed("title", "target"), "target", "left_anti").groupBy(F.col("target").alias("title")).agg(F.count_distinct("seed").alias("support"))
    pool = shared_categories(categories.join(there, "title", "left_semi").withColumnRenamed("title", "seed"))
    named = categories.groupBy("title").agg(F.array_sort(F.collect_set("category")).alias("categories"))
    pages = support.join(named, "title", "left").join(overlaps(categories, pool), "title", "left").join(texts.groupBy("title").agg(F.max("chars").alias("chars")), "title", "left")
    pages = pages.withColumn("overlap", F.coalesce("overlap", F.lit(0)))
    scope = topic_scope(F.col("categories"))
    early = first_of(
        (F.col("support") < 2, F.lit("few_links")), (title_block(F.col("title")).isNotNull(), title_block(F.col("title"))), (F.col("categories").isNull(), F.lit("no_category_data")),
        (F.col("overlap") < 1, F.lit("no_shared_category")), (scope.isNotNull(), scope),
    )
    late = F.when(F.coalesce("chars", F.lit(0)) == 0, "fetch_failed").when(F.col("chars") < stub, "stub")
    place = F.struct((-F.col("overlap")).alias("overlap"), (-F.col("support")).alias("support"), "title")
    judged = pages.select("title", "support", "overlap", early.alias("early"), late.alias("late"), place.alias("place"))
    # The place that fills the quota is one row: the last of as many as seeds have left room for.
    room = first.agg((F.lit(quota) - F.count(F.when(F.col("reason").isNull(), 1))).alias("room"))
    best = judged.filter("early is null and late is null").select("place").orderBy("place").limit(quota)
    end = best.agg(F.array_sort(F.collect_list("place")).alias("places")).crossJoin(room).select("room", F.get("places", (F.col("room") - 1).cast("int")).alias("last"))
    over = F.col("early").isNull() & ((F.col("room") <= 0) | F.coalesce(F.col("place") > F.col("last"), F.lit(False)))
    chosen = judged.crossJoin(F.broadcast(end)).withColumn("reason", F.coalesce("early", F.when(over, "over_quota"), "late"))
    none = F.lit(None).cast("long")
    return first.select("title", F.lit(0).alias("hop"), none.alias("support"), none.alias("overlap"), "reason").unionByName(chosen.select("title", F.lit(2).alias("hop"), "support", F.col("overlap").cast("long").alias("overlap"), "reason"))


def with_expansion(choose: Callable[[DataFrame], DataFrame], seeds: DataFrame, extra: DataFrame, least: int = 50) -> tuple[DataFrame, bool]:
    """The selection from seeds, or, where it keeps fewer pages than wanted, from more seeds; and whether it came to that."""
    chosen = choose(seeds)
    if chosen.filter("reason is null").limit(least).count() >= least:
        return chosen, False
    return choose(seeds.unionByName(extra.join(seeds, seeds.columns, "left_anti"))), True


def pruned_corpus(documents: DataFrame, stub: int = STUB_CHARS) -> DataFrame:
    """A stored corpus (title, categories, raw_chars) judged again by scope and length."""
    return documents.withColumn("reason", F.coalesce(topic_scope(F.col("categories")), F.when(F.col("raw_chars") < stub, "stub")))


def reason_histogram(rows: DataFrame) -> DataFrame:
    """(reason, n): counts by what stands before the colon."""
    return rows.filter("reason is not null").groupBy(F.substring_index("reason", ":", 1).alias("reason")).agg(F.count("*").alias("n"))


def rejections(kept: DataFrame, rejected: DataFrame, fresh: DataFrame) -> DataFrame:
    """The reject log after a new round: without titles that are kept, with new ones that it did not have."""
    old = rejected.join(kept.select("title"), "title", "left_anti")
    return old.unionByName(fresh.join(old.select("title"), "title", "left_anti"))


def united_titles(documents: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Titles of both; a document wins over a gazetteer entry."""
    return documents.select("title", F.lit(True).alias("is_doc")).unionByName(gazetteer.select("title", F.lit(False).alias("is_doc")).join(documents.select("title"), "title", "left_anti"))


def batches(rows: DataFrame, key: str, size: int = 20) -> DataFrame:
    """(batch, members): keys in batches for a remote service, numbered inside each input partition: no global order, no shuffle."""
    place = F.monotonically_increasing_id()
    in_part = place.bitwiseAND(F.lit((1 << 33) - 1))
    batch = F.shiftright(place, 33) * F.lit(1 << 33) + F.floor(in_part / size)
    return rows.select(F.col(key).alias("key"), batch.alias("batch")).groupBy("batch").agg(F.array_sort(F.collect_list("key")).alias("members"))
