"""Repeated byte strings against a dictionary of all 50-byte strings."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from weftgraph.llm import pfp_dedup as dedup


def brute(docs):
    """docs: (id, bytes). Rows of the query."""
    least = {}
    order = [dedup._NO_ID if i is None else i for i, _ in docs]
    for i, (_, t) in zip(order, docs):
        for p in range(len(t) - 49):
            s = t[p : p + 50]
            least[s] = min(least.get(s, i), i)
    rows = []
    for i, (key, t) in zip(order, docs):
        gone = [False] * len(t)
        for p in range(len(t) - 49):
            if least[t[p : p + 50]] < i:
                gone[p : p + 50] = [True] * 50
        kept = bytes(c for c, g in zip(t, gone) if not g)
        rows.append((key, len(t), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(rows, key=str)


def corpus(seed):
    r = random.Random(seed)
    words = ["the", "of", "and", "énd", "x", "alpha", "日本", "\n", "  "]
    text = lambda n: " ".join(r.choices(words, k=n))
    passages = [text(30) for _ in range(4)] + ["a" * 200, "ab" * 120, "\0" * 80]
    docs = [None, "", "short", "a" * 300, "a" * 49, "a" * 50, "ab" * 150]
    for _ in range(60):
        parts = [text(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            parts.insert(r.randint(0, len(parts)), p[r.randint(0, 20) : len(p) - r.randint(0, 20)])
        docs.append(r.choice(["", " "]).join(parts))
    docs += docs[10:20]
    ids = list(range(len(docs)))
    r.shuffle(ids)
    ids[3], ids[9] = None, ids[8]
    return list(zip(ids, docs))


@pytest.mark.parametrize("seed,lot", [(1, 1 << 24), (2, 3000), (3, 400)])
def test_against_brute_force(spark, seed, lot):
    docs = corpus(seed)
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((tuple(r) for r in dedup.remove_repeats(rows, lot_bytes=lot, bucket_bytes=lot).collect()), key=str)
    assert got == brute([(i, (t or "").encode()) for i, t in docs])


def test_parse_does_not_depend_on_chunks(monkeypatch):
    texts = [(t or "").encode() for _, t in corpus(4)]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    whole = [np.concatenate(x) for x in zip(*dedup.parse(data, ends))]
    monkeypatch.setattr(dedup, "CHUNK_BYTES", 700)
    parts = [np.concatenate(x) for x in zip(*dedup.parse(data, ends))]
    assert all((a == b).all() for a, b in zip(whole, parts))


@pytest.mark.parametrize("places", [64, 1 << 19])
def test_many_phrases_of_one_trigger(monkeypatch, places):
    """Phrases with few different sides, periodic ones with the trigger at every place, and ones that end in a window."""
    monkeypatch.setattr(dedup, "SORT_PLACES", places)
    monkeypatch.setattr(dedup, "SORT_BYTES", 4000)
    r = np.random.default_rng(1)
    whole = b"".join(bytes(r.integers(97, 99, 400).astype(np.uint8)) + b"a" * 90 + b"ab" * 60 + b"same passage of the text " * 4 for _ in range(12))
    docs = [whole[i : i + 300] for i in range(0, len(whole) - 300, 97)]
    phrases = {}
    for d, text in enumerate(docs):
        for keys, _, at, counts in dedup.parse(np.frombuffer(text, np.uint8), np.array([len(text)])):
            for key, a, n in zip(keys.tolist(), at.tolist(), counts.tolist()):
                phrases.setdefault((text[a : a + n + 49], key), []).append(d)
    texts, triggers = [t for t, _ in phrases], np.array([k for _, k in phrases], np.uint64)
    ids = r.permutation(len(texts))
    got = dedup.least_ids(texts, triggers, ids)
    least = {}
    for t, i in zip(texts, ids.tolist()):
        for p in range(len(t) - 49):
            least[t[p : p + 50]] = min(i, least.get(t[p : p + 50], i))
    assert max(np.unique(triggers, return_counts=True)[1]) > 5
    for t, found in zip(texts, got):
        assert np.broadcast_to(found, len(t) - 49).tolist() == [least[t[p : p + 50]] for p in range(len(t) - 49)]


def test_kept_bytes_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "x" * 60, 0), (2, "y" + "x" * 60 + "z", 0)], "doc_id long, text string, kept int")
    got = {r.doc_id: bytes(r.kept) for r in dedup.remove_repeats(rows, with_text=True).collect()}
    assert got == {1: b"x" * 60, 2: b"yz"}
    assert dedup.remove_repeats(rows.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1 << 9, 1 << 30])
def test_buckets_unpack_their_phrases_in_slices(monkeypatch, most):
    """Slices of a bucket give what the whole bucket gives, and hold a slice's bytes or one trigger's."""
    monkeypatch.setattr(dedup, "SLICE_BYTES", most)
    monkeypatch.setattr(dedup, "SLICE_TRIGGERS", most)
    monkeypatch.setattr(dedup, "SLICE_ROWS", 7)
    docs = [(1 << 40 if i is None else i, (t or "").encode()) for i, t in corpus(5)]
    tables, held = lambda rows, key: [pa.Table.from_batches([dedup._record([r for r in rows if r[key] == k])]) for k in sorted({r[key] for r in rows})], []
    listed = lambda made: [r for t in made for r in zip(*(t[c].to_pylist() for c in ("lot", "bucket", "payload")))]
    least = dedup.least_ids

    def watched(texts, triggers, ids):
        held.append((sum(map(len, texts)), len(set(triggers.tolist()))))
        return least(texts, triggers, ids)

    monkeypatch.setattr(dedup, "least_ids", watched)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([t.decode() for _, t in docs])], ["doc_id", "text"])
    made = listed(pa.Table.from_batches([b]) for b in dedup._lots(3, 2000)(iter([batch])))
    store, keys = [r for r in made if r[1] < 0], [r for r in made if r[1] >= 0]
    found = listed(map(dedup._phrases(3), tables(store + listed(map(dedup._shared_triggers(3), tables(keys, 1))), 0)))
    runs = listed(map(dedup._runs(3), tables([r for r in found if r[1] >= 0], 1)))
    rows = [r for t in map(dedup._cut_texts(False), tables(store + [r for r in found if r[1] < 0] + runs, 0)) for r in zip(*t.to_pydict().values())]
    assert sorted(rows, key=str) == brute(docs)
    assert len(held) == 3 if most > 1 << 20 else len(held) > 30 and all(n <= most or k < 10 for n, k in held)


def test_memory_of_a_bucket_is_that_of_a_slice(monkeypatch):
    """Forty lots of different phrases: what a bucket allocates follows the slice, not the bucket."""
    r = np.random.default_rng(3)
    rows, total = [], 0
    for lot in range(40):
        texts = [bytes(x) for x in r.integers(0, 256, (2000, 66), np.uint8)]
        keys = np.array([dedup.window_triggers(np.frombuffer(t, np.uint8))[0] for t in texts])
        order = np.argsort(keys)
        total += 66 * len(texts)
        rows.append((lot, 0, dedup._packed(dedup._small(keys[order]), order.astype(np.uint32), np.full(len(texts), lot), np.full(len(texts), lot), np.full(len(texts), 66, np.uint32), b"".join(texts[i] for i in order))))
    monkeypatch.setattr(dedup, "SLICE_BYTES", total // 20)
    group = pa.Table.from_batches([dedup._record(rows)])
    tracemalloc.start()
    dedup._runs(1)(group)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < total
