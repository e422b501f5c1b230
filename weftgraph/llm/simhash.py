"""SimHash near-duplicates with pigeonring filtering.

``fingerprints`` makes 64-bit fingerprints from XXH64 hashes of word shingles. Equal
fingerprints are merged first, so copies cost nothing further. For the rest the
64 bits form a ring of five segments. If two fingerprints differ in at most
four bits, some segment starts a chain: it is equal, it and the next differ in at most one
bit, the first three in at most two, and so on (length * 4 / 5, rounded down).
Of a chain's second and third segments, cut into four parts, two parts must then be
equal. ``candidate_keys`` therefore gives each fingerprint 5 x 6 exact keys of about 26
bits, and every pair within four bits shares one. Pairs with a common key pass the whole chain
check and then the Hamming check.

``similar_documents`` links at a similarity of 0.8 instead. Its candidates share a group of shingles, which finds nearly
all such pairs (measured in the tests), not provably each, and differ in at most 60 of 256 bits. The sets of shingles
settle them: first the edges of the buckets' forests, then all members of a cluster, which is a component of the forests, where
these edges leave it in several classes. The members of such a cluster are compared in blocks and never listed as pairs.

Links leave a bucket as a spanning forest, never as pairs. A bucket of more than
BLOCK_ROWS different fingerprints is not compared in one task: it is cut into blocks and
each two blocks meet in a group of their own, so its size is no limit. ``components``
contracts the forests by alternating large and small stars.

Defined results: null and empty texts have fingerprint zero and are linked with each
other; rows that repeat an id are each returned; a null id never names a component
unless all members' ids are null; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import DOCUMENT_COLUMNS, dealt, hot_keys, looked_up, materialize, table

SEED = 42
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
PARTS = 4
BLOCK_ROWS = 4096
_CHUNK = 1 << 14


@dataclass(frozen=True)
class Budget:
    """How many bits two fingerprints may differ in, and the segments of the ring, as places in their 64-bit words."""

    max_bits: int
    words: int
    segments: tuple[tuple[int, int, int], ...]


#: 64 bits, four of them: every pair shares a key of ``candidate_keys``.
NARROW = Budget(4, 1, tuple((0, s, w) for s, w in SEGMENTS))
#: 256 bits before the check of the shingles: the shares of common shingles J and of differing bits p are tied by cos(pi p) = 2 J / (1 + J).
#: At a similarity of 0.8 the mean is 39 bits and the deviation 5.7, so 60 bits lose about one such pair in 10,000.
WIDE = Budget(60, 4, tuple((i // 2, i % 2 * 32, 32) for i in range(8)))
SIMILAR = 0.8
#: Members and shingles of a block of a cluster; two blocks meet in a task.
SET_ROWS = 1000
SET_HASHES = 1 << 21
GROUPS = 12
_MIX = tuple(np.uint64(x) for x in (0, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def shingle_hashes(data: bytes, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of all shingles of a text, repeats included, a stretch at a time; nothing if it has no words."""
    words = data.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    for low in range(0, len(starts), _CHUNK):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[low : low + _CHUNK].tolist(), ends[low : low + _CHUNK].tolist(), strict=True)], "<u8")


def _remixed(hashes: np.ndarray, factor: np.uint64) -> np.ndarray:
    if not factor:
        return hashes
    mixed = (hashes ^ (hashes >> np.uint64(31))) * factor
    return mixed ^ (mixed >> np.uint64(29))


def _ones(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    # Sums of bytes stay below 256 in runs of 255 rows, so most of the adding is on bytes.
    return np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)


def fingerprint(data: bytes, shingle: int) -> int:
    """SimHash of a text's UTF-8 bytes: a bit is set if it is in over half the shingles' hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(data, shingle):
        ones += _ones(hashes)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def group_keys(shingles: np.ndarray) -> np.ndarray:
    """Keys of groups of two to four distinct shingles, chosen by their hashes alone: GROUPS groups of a text, over up to two sizes.

    Texts that share 0.8 of their shingles have their numbers within that ratio, so some size is common to both, and
    share each group with a chance of 0.8 to the power of its shingles.
    """
    n = len(shingles)
    if not n:
        return np.zeros(1, np.int64)
    out = []
    for level in sorted({max(0, int(np.log2(max(n * f, 1))) - 1) for f in (0.8, 1.25)}):
        group = (shingles >> np.uint64(20)) % np.uint64(1 << level)
        chosen = group < GROUPS
        group, own = group[chosen], _remixed(shingles[chosen], _MIX[1])
        if not len(group):
            continue
        order = np.argsort(group, kind="stable")
        group, own = group[order], own[order]
        at = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        sums = np.add.reduceat(own, at) + (group[at] + np.uint64(1)) * _MIX[2] + np.array([level], np.uint64) * _MIX[3]
        out.append(_remixed(sums, _MIX[3]))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def shingle_set(data: bytes, shingle: int) -> np.ndarray:
    """The sorted hashes of the distinct shingles of a text."""
    parts = list(shingle_hashes(data, shingle))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, "<u8")


def wide_fingerprint(data: bytes, shingle: int) -> tuple[bytes, int, np.ndarray]:
    """A SimHash of WIDE's words over the distinct shingles of a text, a digest of their set, and its group keys."""
    shingles = shingle_set(data, shingle)
    ones = np.zeros((WIDE.words, 64), np.int64)
    for low in range(0, len(shingles), _CHUNK):
        for k in range(WIDE.words):
            ones[k] += _ones(_remixed(shingles[low : low + _CHUNK], _MIX[k]))
    return np.packbits(2 * ones > len(shingles), axis=1, bitorder="little").tobytes(), xxhash.xxh64_intdigest(shingles.tobytes()) >> 1, group_keys(shingles)


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(key, fp) for whole texts, fp as the signed long of the same bits. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x or b"", shingle) for x in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], [key, "fp"])

    return df.select(key, text).mapInArrow(run, T.StructType([df.schema[key], T.StructField("fp", T.LongType())]))


def wide_fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """(key, fp, digest, keys) for whole texts, fp as bytes. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [wide_fingerprint(x or b"", shingle) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            columns = [pa.array([f for f, *_ in found], pa.binary()), pa.array([d for _, d, _ in found], pa.int64()), pa.array([k.tolist() for *_, k in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, "fp", "digest", "keys"])

    return df.select(key, text).mapInArrow(run, T.StructType([df.schema[key]]).add("fp", "binary").add("digest", "long").add("keys", T.ArrayType(T.LongType())))


def shingle_sets(df: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(id, shingles): the hashes of the distinct shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(x or b"", shingle).view(np.int64) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "shingles"])

    return df.select(key, text).mapInArrow(run, "id long, shingles array<long>")


def _bits(value: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(value, start).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def candidate_keys(fp: Column) -> Column:
    """An array of exact keys; fingerprints within NARROW's four bits share one at least."""
    keys = []
    for i in range(len(SEGMENTS)):
        first, *chain = (SEGMENTS[(i + j) % len(SEGMENTS)] for j in range(3))
        # The second and third segment of the chain, as a list of bit places, in four parts.
        places = [(s, w) for s, w in chain]
        cuts = [(s + w * h // 2, w * (h + 1) // 2 - w * h // 2) for s, w in places for h in range(2)]
        for number, pair in enumerate(combinations(cuts, 2)):
            key = F.lit(i * 6 + number).cast("long")
            for start, width in (first, *pair):
                key = F.shiftleft(key, width).bitwiseOR(_bits(fp, start, width))
            keys.append(key)
    return F.array(*keys)


def chained(difference: np.ndarray, budget: Budget) -> np.ndarray:
    """Whether some segment of an XOR (rows of words) starts a whole chain within the proportional budgets."""
    counts = np.stack([np.bitwise_count((difference[:, k] >> np.uint64(s)) & np.uint64((1 << w) - 1)) for k, s, w in budget.segments])
    m = len(budget.segments)
    passed = np.zeros(len(difference), bool)
    for i in range(m):
        total, fits = np.zeros(len(difference), np.int64), np.ones(len(difference), bool)
        for length in range(1, m + 1):
            total = total + counts[(i + length - 1) % m]
            fits &= total <= length * budget.max_bits // m
        passed |= fits
    return passed


def linked(a: np.ndarray, b: np.ndarray, budget: Budget = NARROW) -> np.ndarray:
    """Indices of the pairs (rows of words) that pass the chains and then the full check."""
    difference = a ^ b
    chosen = np.flatnonzero(chained(difference, budget))
    return chosen[np.bitwise_count(difference[chosen]).sum(axis=1) <= budget.max_bits]


def _prints(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Fingerprints as rows of words."""
    if pa.types.is_binary(column.type):
        words = np.frombuffer(b"".join(column.to_pylist()), "<u8")
        return words.reshape(len(column), -1) if len(column) else words.reshape(0, WIDE.words)
    return column.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 1) if isinstance(column, pa.Array) else column.to_numpy().view(np.uint64).reshape(-1, 1)


def _column(prints: np.ndarray) -> pa.Array:
    """The fingerprints' Arrow column, the inverse of _prints."""
    if prints.shape[1] == 1:
        return pa.array(prints[:, 0].view(np.int64))
    return pa.array([row.tobytes() for row in prints], pa.binary())


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest index in the component of each of n nodes under edges (u, v)."""
    root = np.arange(n)
    while len(u):
        low = np.minimum(root[u], root[v])
        new = root.copy()
        for side in (root[u], root[v]):
            np.minimum.at(new, side, low)
        while True:
            further = new[new]
            if (further == new).all():
                break
            new = further
        if (new == root).all():
            break
        root = new
    return root


def _star_edges(ids: np.ndarray, u: list[np.ndarray], v: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id of its component) for the nodes that are not the smallest; u and v index ids."""
    if not u:
        return ids[:0], ids[:0]
    root = roots(len(ids), np.concatenate(u), np.concatenate(v))
    low = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(low, root, ids)
    least = low[root]
    keep = least != ids
    return ids[keep], least[keep]


def _within(keys: np.ndarray, prints: np.ndarray, ids: np.ndarray, budget: Budget) -> tuple[np.ndarray, np.ndarray]:
    """Star edges inside runs of equal keys."""
    u: list[np.ndarray] = []
    v: list[np.ndarray] = []
    held, step = 0, 1
    left = np.arange(len(keys) - 1)
    while len(left := left[keys[left + step] == keys[left]]):
        for low in range(0, len(left), 1 << 18):
            part = left[low : low + (1 << 18)]
            hit = part[linked(prints[part], prints[part + step], budget)]
            u.append(hit)
            v.append(hit + step)
            held += len(hit)
        if held > 1 << 22:
            root = roots(len(keys), np.concatenate(u), np.concatenate(v))
            u, v, held = [np.arange(len(keys))], [root], len(keys)
        step += 1
        left = left[left + step < len(keys)]
    return _star_edges(ids, u, v)


def _bucket_links(budget: Budget, block_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links among rows (bucket, fp, rep) sorted by bucket; of buckets over block_rows the rows themselves, numbered by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.int64() if budget.words == 1 else pa.binary()
        names = ["a", "b", "bucket", "block", "fp"]

        def edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), kind)], names)

        def members(keys: np.ndarray, prints: np.ndarray, ids: np.ndarray, block: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(len(ids), pa.int64()), pa.array(ids), pa.array(keys), pa.array(np.full(len(ids), block, np.int32)), _column(prints)], names)

        held = [np.zeros(0, np.int64), np.zeros((0, budget.words), np.uint64), np.zeros(0, np.int64)]
        large, block = None, 0

        def closed(keys: np.ndarray, prints: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Whole buckets, the first of which may be the rest of a large one."""
            nonlocal large, block
            if large is not None and len(keys):
                n = int(np.searchsorted(keys, large, side="right")) if keys[0] == large else 0
                if n:
                    yield members(keys[:n], prints[:n], ids[:n], block)
                keys, prints, ids = keys[n:], prints[n:], ids[n:]
                large, block = None, 0
            if len(keys) > 1:
                a, b = _within(keys, prints, ids, budget)
                if len(a):
                    yield edges(a, b)

        for batch in batches:
            fresh = (batch.column(0).to_numpy(zero_copy_only=False), _prints(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False))
            rows = [np.concatenate((h, f)) for h, f in zip(held, fresh, strict=True)]
            if not len(rows[0]):
                continue
            last = int(np.searchsorted(rows[0], rows[0][-1], side="left"))
            yield from closed(*(x[:last] for x in rows)) if last else ()
            held = [x[last:] for x in rows]
            while len(held[0]) > block_rows:
                if large != int(held[0][0]):
                    large, block = int(held[0][0]), 0
                yield members(held[0][:block_rows], held[1][:block_rows], held[2][:block_rows], block)
                held, block = [x[block_rows:] for x in held], block + 1
        yield from closed(*held)

    return run


def _block_links(budget: Budget) -> Callable[[pa.Table], pa.Table]:
    """Links between two blocks of a large bucket, or within one."""

    def run(group: pa.Table) -> pa.Table:
        prints, ids = _prints(group["fp"].combine_chunks()), group["rep"].to_numpy()
        side = group["side"].to_numpy()
        if group["low"][0].as_py() == group["high"][0].as_py():
            a, b = _within(np.zeros(len(ids), np.int64), prints, ids, budget)
            return pa.table({"a": a, "b": b})
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        u: list[np.ndarray] = []
        v: list[np.ndarray] = []
        held = 0
        for x in first:
            hit = second[linked(np.broadcast_to(prints[x], (len(second), budget.words)), prints[second], budget)]
            u.append(np.full(len(hit), x))
            v.append(hit)
            held += len(hit)
            if held > 1 << 22:
                root = roots(len(ids), np.concatenate(u), np.concatenate(v))
                u, v, held = [np.arange(len(ids))], [root], len(ids)
        a, b = _star_edges(ids, u, v)
        return pa.table({"a": a, "b": b})

    return run


def links(prints: DataFrame, budget: Budget = NARROW, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b) edges among the reps of distinct fingerprints (fp, rep, keys): a forest of each bucket."""
    kind = dict(prints.dtypes)["fp"]
    keyed = prints.select(F.explode("keys").alias("bucket"), "fp", "rep")
    found = keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_links(budget, block_rows), f"a long, b long, bucket long, block int, fp {kind}")
    found = materialize(found, "links")
    edges, large = found.filter("bucket is null").select("a", "b"), found.filter("bucket is not null")
    if large.isEmpty():
        return edges
    blocks = large.groupBy("bucket").agg((F.max("block") + 1).alias("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = (
        large.join(blocks, "bucket").select("bucket", "fp", F.col("b").alias("rep"), "block", other)
        .select("bucket", "fp", "rep", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    )
    return edges.unionByName(met.groupBy("bucket", "low", "high").applyInArrow(_block_links(budget), "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of edges (a, b) but the components' smallest.

    Alternates large stars (neighbours above a node go to its smallest neighbour) and small stars
    (those below and the node itself do), with each round written to the shared folder, until every
    component is a star around its smallest node.
    """
    high, low = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = materialize(edges.filter("a <> b").select(high, low).distinct(), "edges")
    state = None
    while True:
        measured = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not measured["n"] or tuple(measured) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = tuple(measured)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The centre of a large star has very many neighbours: its row is looked up, not joined.
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
        large = materialize(looked_up(both, least, "u", "n").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        lowest = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "lowest")
        small = looked_up(large, lowest, "u", "n").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")


def _classes(own: DataFrame, prints: DataFrame, key: str, found: DataFrame, *same: str) -> DataFrame:
    """(key, fp, component_id) from the components of the reps; rows that agree in same share a rep."""
    named = prints.join(found, F.col("rep") == F.col("node"), "left").select(*same, F.coalesce("component", "rep").alias("component_id"))
    return own.select(key, *same).join(named, [*same]).select(key, "fp", "component_id")


def confirmed(pairs: DataFrame, sets: DataFrame, least: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose shingle sets (id, shingles) have this Jaccard similarity at least; two empty sets are alike."""
    once = materialize(pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "once")
    # The centre of a large star is in very many pairs: its pairs are dealt out.
    hot = {side: hot_keys(once, side) for side in ("a", "b")}
    # Sizes alone exclude some pairs before any set is moved for them.
    sizes = sets.select("id", F.size("shingles").alias("n"))
    sized = dealt(dealt(once, sizes.toDF("a", "n"), "a", hot["a"]), sizes.toDF("b", "m"), "b", hot["b"])
    sized = sized.filter(F.least("n", "m") >= least * F.greatest("n", "m")).select("a", "b").distinct()
    both = dealt(dealt(sized, sets.toDF("a", "own"), "a", hot["a"]), sets.toDF("b", "other"), "b", hot["b"])
    common = both.select("a", "b", F.size("own").alias("n"), F.size("other").alias("m"), F.size(F.array_intersect("own", "other")).alias("common"))
    return common.filter(F.col("common") >= least * (F.col("n") + F.col("m") - F.col("common"))).select("a", "b").distinct()


def _exact_links(group: pa.Table) -> pa.Table:
    """Forest of the exact links among the shingle sets of one block, or between those of two: the common shingles of one text with all come from counts over postings."""
    ids, side = group["id"].to_numpy(), group["side"].to_numpy()
    lists = group["shingles"].combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    own = np.repeat(np.arange(len(ids)), sizes)
    known, place = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    holders = own[np.argsort(place, kind="stable")]
    frequency = np.bincount(place, minlength=len(known))
    first, ends = np.cumsum(frequency) - frequency, np.cumsum(sizes)
    alone = group["low"][0].as_py() == group["high"][0].as_py()
    u: list[np.ndarray] = []
    v: list[np.ndarray] = []
    for i in range(len(ids)) if alone else np.flatnonzero(side == 0).tolist():
        terms = place[ends[i] - sizes[i] : ends[i]]
        counts = frequency[terms]
        at = np.repeat(first[terms] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        common = np.bincount(holders[at], minlength=len(ids))
        hit = np.flatnonzero((common >= SIMILAR * (sizes[i] + sizes - common)) & ((np.arange(len(ids)) > i) if alone else side == 1))
        u.append(np.full(len(hit), i))
        v.append(hit)
    a, b = _star_edges(ids, u, v)
    return pa.table({"a": a, "b": b})


def settled(members: DataFrame, sets: DataFrame, block_rows: int = SET_ROWS, block_hashes: int = SET_HASHES) -> DataFrame:
    """(a, b): forests of the links between members (id, cluster, class) of one cluster, for clusters of several classes.

    Members are compared in tasks and never listed as pairs. A cluster of more than block_rows members or block_hashes shingles is
    dealt out as blocks by hash, and each two blocks meet in a group of their own.
    """
    sized = materialize(members.join(sets.select("id", F.size("shingles").alias("size")), "id"), "members")
    blocks = F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("size") / block_hashes)).cast("int").alias("blocks")
    counts = sized.groupBy("cluster").agg(F.count("*").alias("n"), blocks, F.min("class").alias("least"), F.max("class").alias("most")).filter("least <> most").select("cluster", "n", "blocks")
    placed = looked_up(sized.select("id", "cluster"), materialize(counts, "clusters"), "cluster", "n").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = sets.join(placed, "id").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("id", "shingles", "cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    return met.groupBy("cluster", "low", "high").applyInArrow(_exact_links, "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(key, fp, component_id): documents linked by 64-bit fingerprints within four bits, each component named by its smallest key. Exact."""
    own = materialize(fingerprints(df, key, text, shingle), "fingerprints")
    prints = materialize(own.groupBy("fp").agg(F.min(key).alias("rep")), "prints").withColumn("keys", candidate_keys(F.col("fp")))
    return _classes(own, prints, key, components(links(prints.filter("rep is not null"))), "fp")


def similar_documents(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """(key, fp, component_id): documents linked by a Jaccard similarity of their distinct shingles of 0.8 or more.

    At 0.8 a sixth of the bits of a SimHash differ, where keys of equal segments would no longer tell documents apart.
    Candidates share the key of a shingle group instead and pass the chains and the bits of WIDE; their sets of shingles
    decide. Most clusters are settled by the edges of their forests; the others are compared as wholes. Equal sets are merged first.
    """
    own = materialize(wide_fingerprints(df, key, text, shingle), "fingerprints")
    prints = materialize(own.groupBy("fp", "digest").agg(F.min(key).alias("rep"), F.min_by("keys", F.struct(F.col(key).isNull(), key, "keys")).alias("keys")), "prints")
    named = prints.filter("rep is not null")
    forest = materialize(links(named, WIDE), "forest")
    asked = forest.select(F.explode(F.array("a", "b")).alias(key)).distinct()
    sets = materialize(shingle_sets(df.select(key, text).join(asked, key, "left_semi"), key, text, shingle).distinct(), "shingles")
    sure = materialize(confirmed(forest, sets), "sure")
    named_by = lambda edges, name: components(edges).withColumnRenamed("node", "id").withColumnRenamed("component", name)
    # Only documents of the forest have candidates at all; each has all of them in its cluster.
    members = asked.withColumnRenamed(key, "id").join(named_by(forest, "cluster"), "id", "left").join(named_by(sure, "class"), "id", "left")
    members = members.select("id", F.coalesce("cluster", "id").alias("cluster"), F.coalesce("class", "id").alias("class"))
    found = components(materialize(sure.unionByName(settled(members, sets)), "links"))
    return _classes(own, prints, key, found, "fp", "digest")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, on 4-word shingles."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, on 5-word shingles and a similarity of 0.8: the document with the smallest id of each component stays.

    Rows that repeat that id stay together, and rows without an id stay.
    """
    docs = docs.select(*DOCUMENT_COLUMNS)
    kept = similar_documents(docs).filter("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.filter("doc_id is null"))
