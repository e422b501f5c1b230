"""SimHash links and components, and the cube method, against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftgraph.llm import mixing, simhash
from weftgraph.llm.shared import dealt, hot_keys, looked_up

SCHEMA = "doc_id long, text string"


def slow_fingerprint(text, shingle):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, prints):
    """pairs: (id, fp). The smallest id reachable over links of at most four bits."""
    values = list(dict.fromkeys(prints))
    root = {v: v for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    a = np.array(values, np.uint64)
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 4):
            root[top(values[i + 1 + j])] = top(v)
    least = {}
    for key, v in pairs:
        least[top(v)] = min(least.get(top(v), key), key)
    return {key: least[top(v)] for key, v in pairs}


def flip(value, bits):
    for b in bits:
        value ^= 1 << b
    return value


def cloud(seed, groups, size):
    """Fingerprints around centres, some further than four bits from each other."""
    r = random.Random(seed)
    out = []
    for _ in range(groups):
        centre = r.getrandbits(64)
        out += [flip(centre, r.sample(range(64), r.randint(0, 5))) for _ in range(size)]
    return out


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_fingerprints(spark):
    r = random.Random(2)
    texts = [None, "", " \t", "one", "One two THREE", "é É x y z"] + [" ".join(r.choices(["A", "bé", "c\x1cd", "日", "\n", "e"], k=r.randint(1, 900))) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    for shingle in (4, 5):
        got = {x.doc_id: x.fp & (1 << 64) - 1 for x in simhash.fingerprints(rows, shingle=shingle).collect()}
        assert got == {i: slow_fingerprint(t, shingle) for i, t in enumerate(texts)}


@pytest.mark.parametrize("block", [4096, 40])
def test_links_and_components(spark, block):
    r = random.Random(3)
    prints = cloud(1, 25, 12) + cloud(2, 1, 300) + [r.getrandbits(64) for _ in range(200)]
    prints = list(dict.fromkeys(prints))
    rep = list(range(len(prints)))
    random.Random(4).shuffle(rep)
    rows = spark.createDataFrame([(signed(p), i) for p, i in zip(prints, rep)], "fp long, rep long").withColumn("keys", simhash.candidate_keys(F.col("fp")))
    found = {x.node: x.component for x in simhash.components(simhash.links(rows, block_rows=block)).collect()}
    expected = brute_components(list(zip(rep, prints)), prints)
    assert {i: found.get(i, i) for i in rep} == expected
    assert Counter(Counter(expected.values()).values())[1] >= 150


def test_keys_are_lossless():
    r = random.Random(8)
    for k in range(5):
        for _ in range(200):
            a = r.getrandbits(64)
            b = flip(a, r.sample(range(64), k))
            assert len(simhash.linked(np.array([[a]], np.uint64), np.array([[b]], np.uint64))) == 1


def test_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(500, 400)], "a long, b long")
    got = {x.node: x.component for x in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 500: 400}


def test_simhash_query(spark, tmp_path):
    r = random.Random(6)
    base = [" ".join(r.choices([f"w{i}" for i in range(300)], k=400)) for _ in range(20)]
    near = [t.replace(t.split()[7], "changed", 1) for t in base[:10]]
    texts = base + near + base[:5] + [None, "", " "]
    spark.createDataFrame(list(enumerate(texts)), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.op2_simhash(spark, str(tmp_path)).collect()}
    prints = [slow_fingerprint(t, 4) for t in texts]
    expected = brute_components(list(enumerate(prints)), prints)
    assert got == {i: (f"{p:016x}", expected[i]) for i, p in enumerate(prints)}


def edited(r, words, changes):
    out = list(words)
    for i in r.sample(range(len(out)), changes):
        out[i] = f"x{r.random()}"
    return out


def jaccard(a, b):
    x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_similar_documents(spark):
    """Recall and precision around a similarity of 0.8, pairs planted among others."""
    r = random.Random(11)
    texts, pairs = [], []
    for _ in range(400):
        n = r.randint(60, 900)
        base = [f"w{r.randint(0, 5000)}" for _ in range(n)]
        copy = edited(r, base, r.randint(0, max(1, n // 12)))
        pairs.append((len(texts), len(texts) + 1, jaccard(base, copy)))
        texts += [" ".join(base), " ".join(copy)]
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    together = lambda low, high: [got[a] == got[b] for a, b, j in pairs if low <= j < high]
    assert np.mean(together(0.84, 1.01)) > 0.97
    assert np.mean(together(0.80, 0.84)) > 0.7
    assert np.mean(together(0.0, 0.7)) < 0.05
    assert len(set(got.values())) >= 400


def test_similar_documents_by_shingles(spark):
    """Nearly every pair at 0.8 or more is linked, and none below."""
    r = random.Random(21)
    texts, pairs = [], []
    for _ in range(600):
        n = r.randint(60, 600)
        base = [f"w{r.randint(0, 5000)}" for _ in range(n)]
        copy = edited(r, base, r.randint(max(1, n // 60), max(2, n // 16)))
        pairs.append((len(texts), len(texts) + 1, jaccard(base, copy)))
        texts += [" ".join(base), " ".join(copy)]
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    near = [got[a] == got[b] for a, b, j in pairs if j >= 0.8]
    far = [got[a] == got[b] for a, b, j in pairs if j < 0.8]
    assert len(near) > 100 and np.mean(near) > 0.99
    assert len(far) > 150 and not any(far)


@pytest.mark.parametrize("block", [4096, 12])
def test_family_of_variants(spark, block, monkeypatch):
    """Variants of one text that share buckets get the components of the similarity, whatever the forest held first."""
    monkeypatch.setattr(simhash.links, "__defaults__", (simhash.NARROW, block))
    r = random.Random(31)
    base = [f"w{r.randint(0, 5000)}" for _ in range(300)]
    texts = [edited(r, base, r.randint(1, 9)) for _ in range(60)]
    top = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                low, high = sorted((top[i], top[j]))
                top = [low if t == high else t for t in top]
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], SCHEMA)).collect()}
    assert got == dict(enumerate(top))
    assert 1 < len(set(top)) < 60


@pytest.mark.parametrize("block", [1000, 7])
def test_a_cluster_is_settled_in_blocks(spark, block):
    """Sets of every size, empty ones too, of one hot cluster and a small one: the classes of all pairs, whatever the blocks."""
    r = random.Random(13)
    rows = []
    for i in range(90):
        base = list(range(i % 6 * 1000, i % 6 * 1000 + r.choice([0, 1, 4, 9, 40])))
        rows.append((i, sorted({x if r.random() > 0.06 else 10_000 + i * 100 + k for k, x in enumerate(base)})))
    sets = spark.createDataFrame(rows, "id long, shingles array<long>")
    members = spark.createDataFrame([(i, 0 if i < 80 else 80, i) for i, _ in rows] + [(500, 500, 500)], "id long, cluster long, class long")
    top = list(range(90))
    for i, a in rows:
        for j, b in rows[:i]:
            common = len(set(a) & set(b))
            if (i < 80) == (j < 80) and common >= 0.8 * (len(a) + len(b) - common):
                low, high = sorted((top[i], top[j]))
                top = [low if t == high else t for t in top]
    found = {x.node: x.component for x in simhash.components(simhash.settled(members, sets, block)).collect()}
    assert {i: found.get(i, i) for i in range(90)} == dict(enumerate(top))


def test_short_texts_at_the_threshold(spark):
    """Texts of 5 to 20 words, of which one word differs: nearly every pair at 0.8 or more is linked, and none below."""
    r = random.Random(23)
    texts, pairs = [], []
    for _ in range(400):
        base = [f"w{r.randint(0, 5000)}" for _ in range(r.randint(5, 20))]
        copy = [*base, "more"] if r.random() < 0.5 else base[:-1]
        pairs.append((len(texts), len(texts) + 1, jaccard(base, copy)))
        texts += [" ".join(base), " ".join(copy)]
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    near = [got[a] == got[b] for a, b, j in pairs if j >= 0.8]
    assert len(near) > 100 and np.mean(near) >= 0.9
    assert not any(got[a] == got[b] for a, b, j in pairs if j < 0.8)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 9, 100])
def test_group_keys(n):
    hashes = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    keys = simhash.group_keys(np.unique(hashes))
    assert 1 <= len(keys) <= 2 * simhash.GROUPS and (np.sort(keys) == np.sort(simhash.group_keys(np.unique(hashes[::-1])))).all()


def test_dedup_stage(spark):
    rows = [(4, "same text here", "en", "s", 1), (2, "same text here", "en", "s", 1), (7, "other words", None, None, None), (None, "no id", "en", "s", 1), (None, None, None, None, None), (9, None, "en", "s", 0), (8, "", "en", "s", 0)]
    kept = simhash.dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([2, 7, 8, None, None], key=str)


def slow_targets(sizes):
    """sizes by source: the excess over three times a source's size, reshared by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, left, free = {}, float(sum(sizes.values())), list(order)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.remove(s)


def corpus(seed, sources=7):
    r = random.Random(seed)
    rows = [(i, " ".join(["w"] * r.randint(0, 300)), r.choice(["s%d" % min(r.randint(0, 12), k) for k in range(sources)] + [None, "é"])) for i in range(3000)]
    return rows + [(9000, None, "only null"), (9001, "tiny", "tiny source"), (9002, "", "")]


def test_targets(spark):
    rows = corpus(1)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").select("source", mixing.word_count("text").alias("size"))
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    expected = slow_targets(dict(sizes))
    assert got.keys() == expected.keys()
    assert all(abs(got[s] - expected[s]) < 1e-6 for s in got)


@pytest.mark.parametrize("block", [8000, 100])
def test_mix(spark, block):
    rows = corpus(2)
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes, units = mixing.mix(frame, block_rows=block)
    got = {(u.uid, u.source): u for u in units.collect()}
    assert len(got) == len(rows) and sizes.count() == len(rows)
    taken, count, largest = Counter(), Counter(), Counter()
    for key, text, source in rows:
        n, u = len((text or "").split()), got[key, source]
        taken[source] += n * u.copies
        count[source] += u.copies
        largest[source] = max(largest[source], n)
        assert 0 <= u.copies <= 3
    for (_, source), u in got.items():
        least = min((len(t.split()) for _, t, s in rows if s == source and t), default=0)
        assert abs(taken[source] - u.target) <= max(least, 0.02 * u.target, 1 if source != "tiny source" else 3), source
    again = {(u.uid, u.source): u.copies for u in mixing.mix(frame.repartition(3), block_rows=block)[1].collect()}
    assert again == {k: u.copies for k, u in got.items()}


def test_flight_keeps_sums():
    r = np.random.default_rng(1)
    chances, sizes = np.full(2000, 0.37), r.integers(0, 500, 2000).astype(float)
    moved = mixing.fly(chances, sizes, 5)
    assert ((moved > 1e-9) & (moved < 1 - 1e-9)).sum() <= 2
    assert abs(moved.sum() - chances.sum()) < 1e-6 and abs(moved @ sizes - chances @ sizes) < 1e-3
    means = np.mean([mixing.fly(np.full(40, 0.3), sizes[:40], s) for s in range(1500)], axis=0)
    assert np.abs(means - 0.3).max() < 0.06
    landed = mixing.land(moved, sizes)
    assert set(landed) <= {0.0, 1.0} and abs(landed @ sizes - chances @ sizes) <= sizes[sizes > 0].min() + 1


def test_a_large_unit_does_not_spoil_the_mix():
    sizes = np.array([20_000.0, 9_000.0, *range(1, 200)])
    for seed in range(20):
        landed = mixing.land(mixing.fly(np.full(len(sizes), 0.43), sizes, seed), sizes)
        assert abs(landed @ sizes - 0.43 * sizes.sum()) <= 1


def test_turns_of_many_sources(spark):
    names = [f"{i:05d}.example" for i in range(3000)] + [None, "", "é", "𝒳", "z"]
    frame = spark.createDataFrame([(n,) for n in names], "source string").repartition(7)
    got = {r.source: r.turn for r in mixing.numbered(frame, "source").collect()}
    assert got == {n: i for i, n in enumerate(sorted(names, key=lambda n: (n is None, n or "")))}


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_lookup_of_hot_keys(spark, hot, monkeypatch):
    """One key holds half of the rows; repeated rows, a null key on neither side."""
    monkeypatch.setattr("weftgraph.llm.shared.HOT_KEYS", hot)
    left = spark.createDataFrame([("a" if i % 2 else f"k{i % 50}", i // 3) for i in range(2000)], "k string, v int")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    expected = sorted(map(tuple, left.join(right.drop("n"), "k").collect()))
    assert sorted(map(tuple, looked_up(left, right, "k", "n").collect())) == expected


def test_deal_of_hot_keys(spark):
    left = spark.createDataFrame([(7, i) for i in range(3000)] + [(i % 50, i) for i in range(100)] + [(None, 5)], "k long, x long")
    right = spark.createDataFrame([(7, [1]), (7, [2]), (3, [3]), (None, [4]), (99, [5])], "k long, y array<int>")
    hot = hot_keys(left, "k")
    assert {r.hot_key: r.salts for r in hot.collect()}[7] > 500
    plain = left.join(right, "k").select("k", "x", "y")
    assert sorted(map(tuple, dealt(left, right, "k", hot).select("k", "x", "y").collect())) == sorted(map(tuple, plain.collect()))
    none = left.limit(0)
    assert dealt(none, right, "k", hot_keys(none, "k")).count() == 0


def test_confirmed_pairs_of_a_hot_centre(spark):
    shared = list(range(100))
    sets = spark.createDataFrame([(0, shared), (0, [1, 2])] + [(i, shared[: 60 + i % 41]) for i in range(1, 400)] + [(900, []), (901, [])], "id long, shingles array<long>")
    pairs = spark.createDataFrame([(i, 0) for i in range(400)] + [(0, i) for i in range(50)] + [(900, 901), (0, 901)], "a long, b long")
    found = sorted(map(tuple, simhash.confirmed(pairs, sets).collect()))
    assert found == [(0, i) for i in range(1, 400) if 60 + i % 41 >= 80] + [(900, 901)]


@pytest.mark.parametrize("hot", [2, 1000])
def test_components_around_a_hot_node(spark, hot, monkeypatch):
    monkeypatch.setattr("weftgraph.llm.shared.HOT_KEYS", hot)
    edges = [(5000, i) for i in range(1000, 3000)] + [(3, 5000), (10, 11), (11, 12)]
    got = {r.node: r.component for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 3 for i in [*range(1000, 3000), 5000]}, 11: 10, 12: 10}


def test_repeated_rows_are_one_unit(spark, tmp_path):
    rows = [(1, "a b c", "s"), (1, "a b", "s"), (None, "x y", "t"), (None, "x", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.op4_mixing(spark, str(tmp_path)).collect()
    assert len(got) == 4 and sorted(r["size"] for r in got) == [1, 2, 2, 3]


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert mixing.op4_mixing(spark, str(tmp_path)).collect() == []
    assert simhash.op2_simhash(spark, str(tmp_path)).collect() == []
