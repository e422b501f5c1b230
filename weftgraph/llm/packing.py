"""Best-fit-decreasing packing of tokenized documents into sequences of fixed length.

``pieces`` tokenizes whole texts (one pass, no shuffle) and cuts documents that are
longer than a sequence; ``pack`` deals the pieces to groups of about GROUP_ROWS and
packs each by best fit decreasing: a segment tree over the remaining capacities
finds the tightest open bin in a logarithm of the sequence length. A group wastes at
most a few bins, whatever the size of the corpus.

The vocabulary file is that of the ``tokenizers`` library; its byte-level pairs are
merged by ``tiktoken``, which gives the same ids (tested) several times faster.

Defined results: a null or empty text is one piece with just the end id; repeated
rows are packed each; ties in length go by id and piece; an empty table gives none.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, table

SEQUENCE = 1024
END_ID = 2
GROUP_ROWS = 60_000
VOCABULARY = "byte_bpe_50k.json"

_encoders: dict[str, tiktoken.Encoding] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def encoder(path: str) -> tiktoken.Encoding:
    """The worker's encoder of a byte-level vocabulary file, loaded once."""
    if path not in _encoders:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        alphabet = byte_alphabet()
        special = {t["content"]: t["id"] for t in model["added_tokens"] if t["special"]}
        ranks = {bytes(map(alphabet.__getitem__, t)): i for t, i in model["model"]["vocab"].items() if t not in special}
        _encoders[path] = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[path]


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where a public vocabulary lies."""
    return public_tokenizers.path(name)


def cut(total: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones but for the first."""
    if total <= size:
        return [(0, total)]
    head = total % size
    return ([(0, head)] if head else []) + [(s, size) for s in range(head, total, size)]


def pieces(df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", size: int = SEQUENCE) -> DataFrame:
    """(key, piece, start, length, ids_crc32, lane): lane is a hash of the row's place that groups are dealt by."""
    own = path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(own or vocabulary_path())
        end = np.array([END_ID], "<u4").tobytes()
        context = TaskContext.get()
        place = (context.partitionId() if context else 0) << 33
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[tuple[int, int, int, int, int]] = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                data = memoryview(words.encode_to_numpy(text or "", allowed_special="all").astype("<u4").tobytes() + end)
                for piece, (start, length) in enumerate(cut(len(data) // 4, size)):
                    out.append((row, piece, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])))
            rows, piece, start, length, crc = (np.array(x, np.int64) for x in zip(*out, strict=True))
            mixed = (np.arange(place, place + len(out)).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            place += len(out)
            lane = ((mixed ^ (mixed >> np.uint64(32))) >> np.uint64(2)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array(lane)],
                [key, "piece", "start", "length", "ids_crc32", "lane"],
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, lane long")


def best_fit(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) for lengths in descending order.

    tree[leaves + c] counts the open bins with c tokens left, each inner node those
    below it; the tightest bin for n tokens is the first non-empty leaf from n on.
    """
    leaves = 1 << size.bit_length()
    tree = [0] * (2 * leaves)
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, n in enumerate(lengths.tolist()):
        if n > size:
            raise ValueError("a piece longer than the sequence")
        node = leaves + n
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node > 1:
                node += 1
                while node < leaves:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
        if node > 1:
            room = node - leaves
            chosen = open_bins[room].pop()
            while node:
                tree[node] -= 1
                node >>= 1
        else:
            room, chosen = size, made
            made += 1
        bins[i], offsets[i] = chosen, size - room
        if room > n:
            open_bins[room - n].append(chosen)
            node = leaves + room - n
            while node:
                tree[node] += 1
                node >>= 1
    return bins, offsets


def pack(rows: DataFrame, groups: int, key: str = "doc_id", size: int = SEQUENCE) -> DataFrame:
    """rows of ``pieces`` with sequence_id and offset instead of lane."""
    order = [("length", "descending"), (key, "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending"), ("lane", "ascending")]

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by(order)
        number = group["bin_group"][0].as_py()
        bins, offsets = best_fit(group["length"].to_numpy(), size)
        out = group.drop_columns(["lane", "bin_group"])
        return out.append_column("sequence_id", pa.array(bins + (number << 36))).append_column("offset", pa.array(offsets))

    kind = rows.schema[key].dataType.simpleString()
    dealt = rows.withColumn("bin_group", F.pmod("lane", F.lit(max(groups, 1))))
    return dealt.groupBy("bin_group").applyInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", size: int = SEQUENCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """All of df's documents, tokenized once and packed; the vocabulary's path is a parameter."""
    rows = materialize(pieces(df, path, key, text, size), "pieces")
    return pack(rows, -(-rows.count() // group_rows), key, size)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents it gets, each row of a repeated document on its own."""
    return pack_documents(docs, vocabulary_path())
