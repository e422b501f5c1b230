"""Mixing sources to target weights by the cube method.

Each source gets a share of all words by its weight, at most CAP times what it has;
what that leaves over goes to the other sources by weight (water filling). The table of sources stays
distributed, as sources may be as many as hosts: their order comes from ranges, the level of the water from sums. A source's rate is its target over its words: every document is
taken floor(rate) times, and once more with the remaining fraction as probability.

Those extra copies are drawn by balanced sampling. The flight moves three units' probabilities
at a time along the null space of the two constraints, documents and words of the
source, until at most two are still fractional. It runs in blocks of about BLOCK_ROWS
units of a source, then again over what the blocks leave, and so on; in the last, one
block a source, the landing picks the rounding of the remaining one or two units with the
least error and then turns further units, from large to small, as long as that brings the words
nearer to the target: the flight leaves large units open, as small ones reach their ends first.
All moves follow hashes of the ids, so reruns agree.

Defined results: rows that repeat an id within a source are one unit and are all
taken alike; a null source is a source of its own, last in order; null texts and
empty ones have no words, and a source without words has target 0; a null id is an id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import DOCUMENT_COLUMNS, looked_up, materialize, shuffle_partitions, table, word_count

CAP = 3.0
CYCLE = 3
BLOCK_ROWS = 8_000
_EDGE = 1e-9


def numbered(rows: DataFrame, column: str) -> DataFrame:
    """rows with turn, their place from 0 in the order of a column, nulls last: places in ranges, and the sizes of the ranges."""
    order = F.col(column).asc_nulls_last()
    ranged = materialize(rows.repartitionByRange(shuffle_partitions(rows.sparkSession), order).withColumn("part", F.spark_partition_id()), "ranged")
    before, at = [], 0
    # A row for each partition, of which there are shuffle_partitions at most.
    for row in ranged.groupBy("part").count().orderBy("part").collect():
        before.append((row["part"], at))
        at += row["count"]
    offsets = rows.sparkSession.createDataFrame(before, "part int, before long")
    return ranged.join(F.broadcast(offsets), "part").withColumn("turn", F.col("before") + F.row_number().over(W.partitionBy("part").orderBy(order)) - 1).drop("part", "before")


def targets(sizes: DataFrame, source: str = "source", size: str = "size", cap: float = CAP, cycle: int = CYCLE) -> DataFrame:
    """(source, source_size, units, target) for weights 1 .. cycle, repeating in code point order of the sources, null last."""
    totals = sizes.groupBy(source).agg(F.sum(size).alias("source_size"), F.count("*").alias("units"))
    rows = numbered(totals, source).withColumn("weight", (F.col("turn") % cycle + 1).cast("double")).withColumn("limit", cap * F.col("source_size"))
    rows = materialize(rows, "sources")
    # The level rises as sources reach their limits, and more do as it rises; every round but the last adds some.
    level, full = 0.0, -1
    while True:
        over = F.col("limit") < F.col("weight") * level
        sums = rows.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, F.col("limit"))).alias("spent"), F.sum(F.when(~over, F.col("weight"))).alias("open"), F.count(F.when(over, 1)).alias("full")).first()
        if sums["full"] == full or not sums["open"]:
            break
        full, level = sums["full"], (float(sums["all"]) - (sums["spent"] or 0.0)) / sums["open"]
    return rows.select(source, "source_size", "units", F.least("limit", F.col("weight") * level).alias("target"))


def _noise(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed & 0x7FFFFFFFFFFFFFFF).random(n)


def fly(chances: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """The flight phase: probabilities moved to 0 or 1, keeping the sums of chances and of chances * sizes, until at most two are left."""
    p, s = chances.tolist(), sizes.tolist()
    out = list(p)
    noise = _noise(seed, len(p) + 3).tolist()
    held: list[int] = []
    at, step, n = 0, 0, len(p)
    while True:
        while len(held) < 3 and at < n:
            if _EDGE < out[at] < 1 - _EDGE:
                held.append(at)
            else:
                out[at] = float(out[at] >= 0.5)
            at += 1
        if len(held) < 3:
            # Units of one size need no third: moving one to the other keeps both sums.
            if len(held) < 2 or s[held[0]] != s[held[1]]:
                break
        i, j = held[0], held[1]
        k = held[2] if len(held) > 2 else -1
        if s[i] == s[j]:
            moves = ((i, 1.0), (j, -1.0))
        elif k >= 0 and s[j] == s[k]:
            moves = ((j, 1.0), (k, -1.0))
        elif k >= 0 and s[i] == s[k]:
            moves = ((i, 1.0), (k, -1.0))
        else:
            top = max(abs(s[k] - s[j]), abs(s[i] - s[k]), abs(s[j] - s[i]))
            moves = ((i, (s[k] - s[j]) / top), (j, (s[i] - s[k]) / top), (k, (s[j] - s[i]) / top))
        up = down = math.inf
        for x, u in moves:
            if u > 0:
                up, down = min(up, (1 - out[x]) / u), min(down, out[x] / u)
            elif u < 0:
                up, down = min(up, out[x] / -u), min(down, (1 - out[x]) / -u)
        by = up if noise[step % len(noise)] * (up + down) < down else -down
        step += 1
        for x, u in moves:
            out[x] += by * u
        left = []
        for x in held:
            if _EDGE < out[x] < 1 - _EDGE:
                left.append(x)
            else:
                out[x] = 1.0 if out[x] > 0.5 else 0.0
        held = left
    return np.array(out)


def land(chances: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The landing: the last fractional units rounded with the least error in words, then in documents; then single units turned to lessen the error."""
    out = chances.copy()
    open_ = np.flatnonzero((out > _EDGE) & (out < 1 - _EDGE))
    best = min(
        range(1 << len(open_)),
        key=lambda c: (abs(sum(((c >> b & 1) - out[x]) * sizes[x] for b, x in enumerate(open_))), abs(sum((c >> b & 1) - out[x] for b, x in enumerate(open_))), c),
    )
    for b, x in enumerate(open_):
        out[x] = best >> b & 1
    out = np.round(out)
    over = float((out - chances) @ sizes)
    # From large to small, so that each turn may be followed by finer ones.
    for x in np.lexsort((np.arange(len(out)), -sizes)).tolist():
        turned = over - sizes[x] if out[x] else over + sizes[x]
        if abs(turned) < abs(over):
            out[x], over = 1 - out[x], turned
    return out


def sample(units: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """units (uid, source_key, weight_words, chance, n_units) with chance moved to 0 or 1 for each.

    n_units: the units of the source, from which the blocks are counted.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in units.dtypes)

    def flight(last: bool):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["lot", "uid"], kind="stable")
            moved = fly(group["chance"].to_numpy(), group["weight_words"].to_numpy(), int(group["lot"].iloc[0]))
            return group.assign(chance=land(moved, group["weight_words"].to_numpy()) if last else moved)

        return run

    rows, done, most = units, None, units.agg(F.max("n_units")).first()[0] or 0
    level = 0
    while True:
        blocks = F.ceil(F.col("n_units") / block_rows).cast("long")
        last = most <= block_rows
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("lot", F.lit(level)), F.greatest(blocks, F.lit(1))))
        flown = materialize(dealt.groupBy("source_key", "block").applyInPandas(flight(last), f"{schema}, block long").drop("block"), "cube")
        if last:
            return flown if done is None else done.unionByName(flown)
        open_ = (F.col("chance") > 0) & (F.col("chance") < 1)
        decided = flown.filter(~open_)
        done = decided if done is None else done.unionByName(decided)
        # A block leaves two units at most.
        rows = flown.filter(open_).withColumn("n_units", 2 * blocks)
        most, level = 2 * -(-most // block_rows), level + 1


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", cap: float = CAP, cycle: int = CYCLE, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows, units): a row with key, source and size for each of df's; a unit a key and source with source_size, target and copies."""
    rows = materialize(df.select(F.col(key).alias("uid"), F.col(source).alias("source"), word_count(text).alias("size")), "sizes")
    source_key = F.xxhash64("source", F.col("source").isNull())
    goals = materialize(targets(rows, "source", "size", cap, cycle).select(source_key.alias("source_key"), "source_size", "units", "target", F.col("units").alias("n_units")), "goals")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate + 1e-9)
    once = rows.groupBy("uid", "source").agg(F.sum("size").cast("double").alias("weight_words")).withColumn("source_key", source_key)
    units = looked_up(once, goals, "source_key", "units").select(
        "uid", "source", "source_key", "weight_words", F.greatest(rate - whole, F.lit(0.0)).alias("chance"), whole.cast("long").alias("whole"),
        "n_units", "source_size", "target", F.xxhash64("uid", "source_key").alias("lot"),
    )
    drawn = sample(units, block_rows)
    return rows, drawn.select("uid", "source", "source_size", "target", (F.col("whole") + F.round("chance").cast("long")).alias("copies"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    rows, units = mix(table(spark, sf_dir, "documents"))
    units = units.withColumnRenamed("source", "unit_source")
    joined = rows.alias("r").join(units.alias("u"), F.col("r.uid").eqNullSafe(F.col("u.uid")) & F.col("r.source").eqNullSafe(F.col("u.unit_source")))
    return joined.select(F.col("r.uid").alias("doc_id"), F.col("r.size").alias("size"), "source_size", "target", (F.col("copies") * F.col("r.size")).cast("long").alias("taken"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as many times as the mix takes it."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    _, units = mix(docs)
    # Units grow with the documents, so they are never broadcast: the plan of a large corpus at every size.
    units = units.filter("copies > 0").withColumnRenamed("source", "unit_source").hint("merge")
    joined = docs.alias("d").join(units.alias("u"), F.col("d.doc_id").eqNullSafe(F.col("u.uid")) & F.col("d.source").eqNullSafe(F.col("u.unit_source")))
    columns = [F.col(f"d.{c}").alias(c) for c in DOCUMENT_COLUMNS]
    return joined.select(*columns, F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("again")).drop("again")
