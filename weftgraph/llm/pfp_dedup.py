"""Exact removal of byte strings that repeat across documents, by prefix-free parsing.

A string of LEAST bytes is removed from a document if it also starts in one with a smaller id.
Texts are parsed at triggers that only the text itself determines: every window of LEAST bytes has as
trigger the least rolling hash of its GRAM-byte strings. Consecutive windows with one trigger make
a phrase. Equal windows have equal triggers, so they only meet in phrases of one trigger. The rest
is done on the dictionary of distinct phrases, not on the corpus:

1. Documents are put into lots, each stored once, compressed (no shuffle); a lot sends its distinct
   triggers to buckets by hash.
2. A bucket answers each lot with the triggers that more than one document has.
3. A lot parses its texts at those and sends each distinct phrase with its smallest and largest id.
4. A bucket parses its phrases at the places of their trigger. What ends with the trigger makes its dictionary, what
   follows from the trigger on is the rest of the parse. It sorts the suffixes of the dictionary and the rests, each once
   however many windows they are part of, and combines both ranks: windows are equal if they agree in the suffix
   before the trigger and in the rest, to a depth of LEAST together. It answers with the runs of windows that some
   document with a smaller id has.
5. A lot maps runs back through its parse, the phrase occurrences, to bytes of its documents.

A passage that very many documents share is one trigger and one phrase a lot, so no bucket gathers it more
often than there are lots. All comparisons of windows are of their bytes.

Defined results: a null or empty text has zero bytes and keeps the digest of nothing; texts shorter than LEAST keep all; a
null id is larger than any other; rows that repeat an id do not count against each other; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, materialize_by, shuffle_partitions, table

LEAST = 50
GRAM = 16
LOT_BYTES = 8 << 20
BUCKET_BYTES = 64 << 20
CHUNK_BYTES = 1 << 20
SORT_BYTES = 1 << 23
SORT_PLACES = 1 << 19
#: What a bucket unpacks at once: bytes of phrases, and triggers. A slice is a range of triggers, so it has at least one trigger's.
SLICE_BYTES = 1 << 23
SLICE_TRIGGERS = 1 << 20
#: Documents that are taken out of an Arrow batch at once.
SLICE_ROWS = 256

_STORE, _ANSWER = -1, -2
_NO_ID = np.iinfo(np.int64).max
_ROWS = "lot long, bucket int, payload binary"
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))


def _packed(*things: object, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(pickle.dumps(things, protocol=5))


def _unpacked(data: bytes | pa.Buffer) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def _record(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    lot, bucket, payload = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(lot, pa.int64()), pa.array(bucket, pa.int32()), pa.array(payload, pa.binary())], ["lot", "bucket", "payload"])


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * _ODD[4]
    return values ^ (values >> np.uint64(29))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    hashes = (data.astype(np.uint64) + np.uint64(1)) * _ODD[0]
    step = 1
    for factor in _ODD[1:5]:
        hashes = hashes[:-step] * factor + hashes[step:]
        step *= 2
    assert step == GRAM
    return _mix(hashes)


def _trigger(hashes: np.ndarray) -> np.ndarray:
    return _mix(hashes * _ODD[5]) >> np.uint64(24)


def window_triggers(data: np.ndarray) -> np.ndarray:
    """For each window of LEAST bytes the least hash of its GRAM-byte strings, as 40 evenly spread bits."""
    if len(data) < LEAST:
        return np.zeros(0, np.uint64)
    least, width = _gram_hashes(data), 1
    while 2 * width <= LEAST - GRAM + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if rest := LEAST - GRAM + 1 - width:
        least = np.minimum(least[:-rest], least[rest:])
    return _trigger(least)


def _chunks(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, last + 1) document of stretches of about CHUNK_BYTES, from the documents' ends."""
    first = 0
    while first < len(ends):
        start = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, start + CHUNK_BYTES)))
        yield first, last
        first = last


def parse(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(trigger, document, first window, number of windows) of all phrases, chunk by chunk; windows are places in data."""
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    for first, last in _chunks(ends):
        base = int(starts[first])
        keys = window_triggers(data[base : ends[last - 1]])
        if not len(keys):
            continue
        own = np.repeat(np.arange(first, last), (ends - starts)[first:last])[: len(keys)]
        inside = np.arange(base, base + len(keys)) + LEAST <= ends[own]
        fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (own[1:] != own[:-1]) | (inside[1:] != inside[:-1])))
        at = np.flatnonzero(fresh)
        counts = np.diff(np.append(at, len(keys)))
        whole = inside[at]
        at, counts = at[whole], counts[whole]
        yield keys[at], own[at], at + base, counts


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in order of the keys, so that sorted keys are cut into stretches."""
    return ((keys >> np.uint64(8)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _stretches(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    of = _bucket_of(keys, buckets)
    at = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else []
    for a, b in zip(at, [*at[1:], len(of)], strict=True):
        yield int(of[a]), slice(a, b)


_BINS = 1 << 12


def _bin_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Which of _BINS equal parts of its bucket's range a key is in; sorted keys of one bucket give sorted bins."""
    return (((keys >> np.uint64(8)) * np.uint64(buckets) & np.uint64(0xFFFFFFFF)) >> np.uint64(20)).astype(np.int64)


def _slices(weights: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first, last + 1) bin of stretches that weigh at most so much, or are one bin."""
    first, held = 0, 0
    for k, weight in enumerate(weights.tolist()):
        if held and held + weight > most:
            yield first, k
            first, held = k, 0
        held += weight
    if held:
        yield first, len(weights)


def _small(values: np.ndarray) -> np.ndarray:
    """Sorted keys as differences, in bytes by place: the high ones are mostly zero and pack well."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :5].T)


def _large(planes: np.ndarray) -> np.ndarray:
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :5] = planes.T
    return steps.view("<u8").reshape(-1).cumsum(dtype=np.uint64)


def _lots(buckets: int, lot_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 24
        ids: list[int] = []
        texts: list[bytes] = []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal number
            if not texts:
                return
            data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
            key_of, sets = np.array(ids, np.int64), []
            for keys, own, _, _ in parse(data, ends):
                order = np.lexsort((key_of[own], keys))
                keys, named = keys[order], key_of[own[order]]
                fresh = np.concatenate(([True], keys[1:] != keys[:-1]))
                at = np.flatnonzero(fresh)
                last = np.append(at[1:], len(keys)) - 1
                sets.append((keys[at], named[at], named[last]))
            # The store is written once and moved twice, so it is packed harder than the rest.
            rows = [(number, _STORE, _packed(key_of, ends, data.tobytes(), level=6))]
            if sets:
                keys, low, high = (np.concatenate(x) for x in zip(*sets, strict=True))
                order = np.argsort(keys, kind="stable")
                keys, low, high = keys[order], low[order], high[order]
                at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                many = np.minimum.reduceat(low, at) < np.maximum.reduceat(high, at)
                keys = keys[at]
                rows += [(number, b, _packed(_small(keys[part]), np.packbits(many[part]))) for b, part in _stretches(keys, buckets)]
            number += 1
            ids.clear()
            texts.clear()
            yield _record(rows)

        held = 0
        for part in (batch.slice(i, SLICE_ROWS) for batch in batches for i in range(0, batch.num_rows, SLICE_ROWS)):
            for key, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(_NO_ID if key is None else key)
                texts.append(text or b"")
                held += len(texts[-1]) + 64
                if held >= lot_bytes:
                    yield from close()
                    held = 0
        yield from close()

    return run


def _shared_triggers(buckets: int):
    def run(group: pa.Table) -> pa.Table:
        """Each lot's triggers of a bucket that some other document has too."""
        payloads, weights = [p.as_buffer() for p in group["payload"]], np.zeros(_BINS, np.int64)
        for payload in payloads:
            weights += np.bincount(_bin_of(_large(_unpacked(payload)[0]), buckets), minlength=_BINS)
        answers: list[list[np.ndarray]] = [[] for _ in payloads]
        for a, b in _slices(weights, SLICE_TRIGGERS):
            found, counts = [], []
            for payload in payloads:
                planes, many = _unpacked(payload)
                keys = _large(planes)
                low, high = np.searchsorted(_bin_of(keys, buckets), (a, b))
                found.append(keys[low:high].copy())
                counts.append(1 + np.unpackbits(many, count=len(keys))[low:high])
            for answer, own, chosen in zip(answers, found, _several(found, counts), strict=True):
                if chosen.any():
                    answer.append(own[chosen])
        rows = [(lot, _ANSWER, _packed(_small(np.concatenate(answer)))) for lot, answer in zip(group["lot"].to_pylist(), answers, strict=True) if answer]
        return pa.Table.from_batches([_record(rows)])

    return run


def _several(found: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
    """Which of each lot's keys have a count of over one in all lots together."""
    keys, times = np.concatenate(found), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    at = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    several = np.empty(len(keys), bool)
    several[order] = np.repeat(np.add.reduceat(times[order].astype(np.int64), at) > 1, np.diff(np.append(at, len(keys))))
    return np.split(several, np.cumsum([len(x) for x in found])[:-1])


def _phrases(buckets: int):
    def run(group: pa.Table) -> pa.Table:
        lot = group["lot"][0].as_py()
        wanted, store = [], None
        for kind, payload in zip(group["bucket"].to_pylist(), group["payload"], strict=True):
            if kind == _STORE:
                store = _unpacked(payload.as_buffer())
            else:
                wanted.append(_large(*_unpacked(payload.as_buffer())))
        if store is None or not wanted:
            return pa.Table.from_batches([_record([])])
        key_of, ends, raw = store
        shared = np.sort(np.concatenate(wanted))
        found = []
        for keys, own, at, counts in parse(np.frombuffer(raw, np.uint8), ends):
            hit = np.searchsorted(shared, keys)
            chosen = np.flatnonzero((hit < len(shared)) & (shared[np.minimum(hit, len(shared) - 1)] == keys))
            found.append((keys[chosen], own[chosen].astype(np.uint32), at[chosen].astype(np.uint32), counts[chosen].astype(np.uint32) + np.uint32(LEAST - 1)))
        keys, own, place, lengths = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64),) * 4
        if not len(keys):
            return pa.Table.from_batches([_record([])])
        # Equal phrases have one trigger, so those of one bucket are told apart at once. A phrase is kept as its first occurrence.
        order = np.argsort(keys, kind="stable")
        phrase_of, first, parts = np.empty(len(keys), np.int64), [], []
        for b, part in _stretches(keys[order], buckets):
            number: dict[bytes, int] = {}
            begun, got, mine = len(first), order[part], []
            for i, a, n in zip(got.tolist(), place[got].tolist(), lengths[got].tolist(), strict=True):
                k = number.setdefault(raw[a : a + n], len(first))
                if k == len(first):
                    first.append(i)
                mine.append(k)
            phrase_of[got] = mine
            parts.append((b, slice(begun, len(first))))
        # Numbered in the order of the texts, which packs better.
        first = np.array(first)
        name = np.empty(len(first), np.int64)
        name[np.argsort(first)] = np.arange(len(first))
        low, high = np.full(len(first), _NO_ID), np.full(len(first), np.iinfo(np.int64).min)
        np.minimum.at(low, phrase_of, key_of[own])
        np.maximum.at(high, phrase_of, key_of[own])
        rows = [(lot, _STORE, _packed(name[phrase_of].astype(np.uint32), own, place))]
        for b, part in parts:
            at = first[part]
            joined = b"".join(raw[a : a + n] for a, n in zip(place[at].tolist(), lengths[at].tolist(), strict=True))
            rows.append((lot, b, _packed(_small(keys[at]), name[part].astype(np.uint32), low[part], high[part], lengths[at], joined, level=7)))
        return pa.Table.from_batches([_record(rows)])

    return run


def least_ids(texts: list[bytes], triggers: np.ndarray, ids: np.ndarray) -> list[np.ndarray | int]:
    """For each distinct phrase, the smallest id that has each of its windows; a number where it is the same for all."""
    out: list[np.ndarray | int] = ids.tolist()
    order = np.argsort(triggers, kind="stable")
    ranked = triggers[order]
    at = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    sizes = np.diff(np.append(at, len(order)))
    # A trigger with one phrase needs no sorting. The others are taken together up to SORT_BYTES.
    todo: list[int] = []
    held = 0
    for start, n in zip(at[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        members = order[start : start + n].tolist()
        todo += members
        held += sum(len(texts[i]) for i in members)
        if held >= SORT_BYTES:
            _combined(texts, triggers, ids, todo, out)
            todo, held = [], 0
    _combined(texts, triggers, ids, todo, out)
    return out


def _combined(texts: list[bytes], triggers: np.ndarray, ids: np.ndarray, members: list[int], out: list[np.ndarray | int]) -> None:
    """Parses the members at their triggers and takes the smallest id of each window from the ranks of its two sides."""
    if not members:
        return
    joined = np.frombuffer(b"".join(texts[i] for i in members), np.uint8)
    lengths = np.array([len(texts[i]) for i in members])
    ends, own, places = np.cumsum(lengths), triggers[members], []
    for first, last in _chunks(ends):
        base = int(ends[first] - lengths[first])
        hashes = _trigger(_gram_hashes(joined[base : ends[last - 1]]))
        places.append(base + np.flatnonzero(hashes == np.repeat(own[first:last], lengths[first:last])[: len(hashes)]))
    place = np.concatenate(places)
    of = np.searchsorted(ends, place, "right")
    inside = place + GRAM <= ends[of]
    place, of = place[inside], of[inside]
    # A window belongs to the first trigger in it: it starts after the trigger before, and ends with its phrase.
    before = np.concatenate(([-1], place[:-1]))
    most = np.minimum(np.minimum(LEAST - GRAM, place - (ends - lengths)[of]), place - before - 1)
    least = np.maximum(0, place - ends[of] + LEAST)
    kept = least <= most
    place, of, most, least = place[kept], of[kept], most[kept], least[kept]
    # Only places where a window starts have an id; slot is the place among them.
    found, slot = np.empty(int((lengths - LEAST + 1).sum()), np.int64), place - of * (LEAST - 1)
    padded = np.concatenate((np.zeros(LEAST, np.uint8), joined, np.zeros(LEAST, np.uint8)))
    named, room = ids[members][of], ends[of] - place
    parts = -(-len(place) // SORT_PLACES)
    half = (LEAST - GRAM) // 2
    # Equal windows agree in the longer of their two sides, so a hash of that side keeps them together and what is sorted at once bounded.
    for low, high in ((0, LEAST - GRAM),) if parts == 1 else ((0, half), (half + 1, LEAST - GRAM)):
        lot = np.zeros(len(place), np.int64)
        if parts > 1:
            view = np.lib.stride_tricks.sliding_window_view(padded, LEAST - half)[place + LEAST] if low == 0 else np.lib.stride_tricks.sliding_window_view(padded, half + 1)[place + LEAST - half - 1]
            lot = (_row_hashes(view) % np.uint64(parts)).astype(np.int64)
        for part in range(parts):
            chosen = np.flatnonzero((lot == part) & (least <= high) & (most >= low))
            if len(chosen):
                _two_sides(padded, place[chosen], np.maximum(least[chosen], low), np.minimum(most[chosen], high), most[chosen], room[chosen], named[chosen], slot[chosen], found)
    windows = lengths - LEAST + 1
    for i, a, n in zip(members, (np.cumsum(windows) - windows).tolist(), windows.tolist(), strict=True):
        out[i] = found[a : a + n]


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    hashes = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        hashes = (hashes + rows[:, k].astype(np.uint64) + np.uint64(1)) * _ODD[k % 5]
        hashes ^= hashes >> np.uint64(29)
    return hashes


def _ranked(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank, shared): the rank of each row among the distinct ones, and how many first bytes each distinct row shares with the one before."""
    width = rows.shape[1]
    keys = np.ascontiguousarray(rows).view(f"V{width}").reshape(-1)
    order = np.argsort(keys, kind="stable")
    ordered = rows[order]
    same = ordered[1:] == ordered[:-1]
    whole = same.all(axis=1)
    rank = np.empty(len(rows), np.int64)
    rank[order] = np.concatenate(([0], np.cumsum(~whole)))
    return rank, np.concatenate(([0], same[~whole].argmin(axis=1)))


def _two_sides(padded: np.ndarray, place: np.ndarray, least: np.ndarray, most: np.ndarray, reach: np.ndarray, room: np.ndarray, named: np.ndarray, slot: np.ndarray, found: np.ndarray) -> None:
    """Sets the smallest id of each window that starts least to most bytes before its trigger's place, which is at slot of found.

    The dictionary's suffixes end at the trigger, so backwards they are the left sides' beginnings; the rest of the parse
    is the right side. A window with so many bytes on the left is the class of its left side at that depth and that of
    its right side at the depth that is left of LEAST.
    """
    width = LEAST - GRAM
    left = np.lib.stride_tricks.sliding_window_view(padded, width)[place + LEAST - width][:, ::-1].copy()
    left[np.arange(width) >= reach[:, None]] = 0
    right = np.lib.stride_tricks.sliding_window_view(padded, LEAST)[place + LEAST].copy()
    right[np.arange(LEAST) >= room[:, None]] = 0
    (left_rank, left_shared), (right_rank, right_shared) = _ranked(left), _ranked(right)
    for depth in range(int(least.min()), int(most.max()) + 1):
        chosen = np.flatnonzero((least <= depth) & (depth <= most))
        if not len(chosen):
            continue
        left_class = np.cumsum(left_shared < depth)[left_rank[chosen]]
        right_class = np.cumsum(right_shared < LEAST - depth)[right_rank[chosen]]
        keys = left_class * (len(right_shared) + 1) + right_class
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        at = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        low = np.minimum.reduceat(named[chosen][order], at)
        found[slot[chosen[order]] - depth] = np.repeat(low, np.diff(np.append(at, len(order))))


def _runs(buckets: int):
    def run(group: pa.Table) -> pa.Table:
        """To each lot: (phrase, first window, end window, id) where that smaller id than the lot's largest has the windows."""
        payloads, weights = [p.as_buffer() for p in group["payload"]], np.zeros(_BINS)
        for payload in payloads:
            planes, _, _, _, lengths, _ = _unpacked(payload)
            weights += np.bincount(_bin_of(_large(planes), buckets), lengths, _BINS)
        answers: list[list[tuple[np.ndarray, ...]]] = [[] for _ in payloads]
        # Payloads stay packed; each slice unpacks its phrases of all lots.
        for a, b in _slices(weights, SLICE_BYTES):
            _slice_runs(payloads, buckets, a, b, answers)
        rows = [(lot, _ANSWER, _packed(*(np.concatenate(x) for x in zip(*answer, strict=True)))) for lot, answer in zip(group["lot"].to_pylist(), answers, strict=True) if answer]
        return pa.Table.from_batches([_record(rows)])

    return run


def _slice_runs(payloads: list[pa.Buffer], buckets: int, start: int, stop: int, answers: list[list[tuple[np.ndarray, ...]]]) -> None:
    """Adds each lot's runs in the phrases of the triggers in these bins."""
    number: dict[bytes, int] = {}
    triggers, lows, parts = [], [], []
    for payload in payloads:
        planes, own, low, high, lengths, joined = _unpacked(payload)
        keys, mine = _large(planes), []
        inside = slice(*np.searchsorted(_bin_of(keys, buckets), (start, stop)).tolist())
        at = int(lengths[: inside.start].sum(dtype=np.int64))
        for key, n, least in zip(keys[inside].tolist(), lengths[inside].tolist(), low[inside].tolist(), strict=True):
            k = number.setdefault(joined[at : at + n], len(number))
            at += n
            if k == len(triggers):
                triggers.append(key)
                lows.append(least)
            elif least < lows[k]:
                lows[k] = least
            mine.append(k)
        parts.append((own[inside].copy(), high[inside].copy(), np.array(mine, np.int32)))
    texts = list(number)
    number.clear()
    least = least_ids(texts, np.array(triggers, np.uint64), np.array(lows, np.int64))
    for answer, (own, high, mine) in zip(answers, parts, strict=True):
        phrase, first, end, named = [], [], [], []
        for local, top, k in zip(own.tolist(), high.tolist(), mine.tolist(), strict=True):
            ids = least[k]
            if isinstance(ids, int):
                if ids < top:
                    phrase.append(local), first.append(0), end.append(len(texts[k]) - LEAST + 1), named.append(ids)
                continue
            cuts = np.flatnonzero(ids[1:] != ids[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
                if ids[a] < top:
                    phrase.append(local), first.append(a), end.append(b), named.append(int(ids[a]))
        if phrase:
            answer.append((np.array(phrase, np.uint32), np.array(first, np.uint32), np.array(end, np.uint32), np.array(named, np.int64)))


def removed(size: int, ids: np.ndarray, occurrences: tuple[np.ndarray, ...] | None, runs: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """Which bytes of a lot go: the runs carried to their phrases' occurrences in documents of larger ids."""
    depth = np.zeros(size + 1, np.int32)
    if occurrences is None or not runs:
        return depth[:-1] > 0
    phrase_of, own, place = (x.astype(np.int64) for x in occurrences)
    phrase, first, end, named = (np.concatenate(x).astype(np.int64) for x in zip(*runs, strict=True))
    order = np.argsort(phrase_of, kind="stable")
    ranked = phrase_of[order]
    low, high = np.searchsorted(ranked, phrase, "left"), np.searchsorted(ranked, phrase, "right")
    counts = high - low
    run = np.repeat(np.arange(len(phrase)), counts)
    hit = order[np.repeat(low, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]
    later = named[run] < ids[own[hit]]
    run, hit = run[later], hit[later]
    np.add.at(depth, place[hit] + first[run], 1)
    np.add.at(depth, place[hit] + end[run] - 1 + LEAST, -1)
    return np.cumsum(depth, out=depth)[:-1] > 0


def _cut_texts(with_text: bool):
    def run(group: pa.Table) -> pa.Table:
        store, occurrences, runs = None, None, []
        for kind, payload in zip(group["bucket"].to_pylist(), group["payload"], strict=True):
            got = _unpacked(payload.as_buffer())
            if kind == _ANSWER:
                runs.append(got)
            elif len(got) == 3 and isinstance(got[2], bytes):
                store = got
            else:
                occurrences = got
        ids, ends, raw = store
        data = np.frombuffer(raw, np.uint8)
        gone = removed(len(data), ids, occurrences, runs)
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        out: list[tuple] = []
        start = 0
        for key, end in zip(ids.tolist(), ends.tolist(), strict=True):
            n = int(np.count_nonzero(gone[start:end]))
            # A run that reaches over from the document before begins anew here.
            spans = int(np.count_nonzero(first[start:end])) + int(n > 0 and start > 0 and gone[start] and gone[start - 1])
            kept = data[start:end][~gone[start:end]].tobytes() if n else raw[start:end]
            out.append((None if key == _NO_ID else key, end - start, n, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            start = end
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)]
        return pa.table(columns[: 6 if with_text else 5], names=names[: 6 if with_text else 5])

    return run


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False, lot_bytes: int = LOT_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) and, if asked for, the kept bytes.

    A lot sends a row to each bucket that it has triggers for, so rows stay long while lots and buckets grow together:
    for a corpus of many terabytes give both as much as an executor's Python memory allows.
    """
    spark = df.sparkSession
    total = df.agg(F.sum(F.octet_length(text).cast("long")).alias("n")).first()["n"] or 0
    buckets = max(shuffle_partitions(spark), -(-total // bucket_bytes))
    made = df.select(F.col(key).cast("long"), text).mapInArrow(_lots(buckets, lot_bytes), _ROWS).withColumn("keys", (F.col("bucket") >= 0).cast("int"))
    lots, drop = materialize_by(made, "lots", "keys", "none")
    store = lots.filter("keys = 0").drop("keys")
    shared = lots.filter("keys = 1").drop("keys").groupBy("bucket").applyInArrow(_shared_triggers(buckets), _ROWS)
    phrases = materialize(store.unionByName(shared).groupBy("lot").applyInArrow(_phrases(buckets), _ROWS), "phrases", "none")
    drop(1)
    runs = phrases.filter("bucket >= 0").groupBy("bucket").applyInArrow(_runs(buckets), _ROWS)
    gathered = store.unionByName(phrases.filter(F.col("bucket") == _STORE)).unionByName(runs)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return gathered.groupBy("lot").applyInArrow(_cut_texts(with_text), schema)


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to earlier ones, and the digest of what it keeps."""
    return remove_repeats(table(spark, sf_dir, "documents"))

