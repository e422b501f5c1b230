"""The corpus pipeline against a plain version of itself, and its stages' contracts."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftgraph.llm import packing
from weftgraph.llm.shared import DOCUMENT_COLUMNS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(sources):
    r = random.Random(12)
    vocabulary = ["w%d" % i for i in range(4000)]
    text = lambda n: " ".join(r.choices(vocabulary, k=n))
    good = [text(r.randint(60, 1500)) for _ in range(40)]
    near = [g.replace(g.split()[30], "other", 1) for g in good[:8] if len(g.split()) > 300]
    private = [text(80) + f" mail person{i}@example{i}.org or +1 (555) 010-44{i:02} now " + text(30) for i in range(6)]
    short, repeated = [text(20), "", None], [" ".join(["same words again"] * 60)]
    texts = good + near + good[10:14] + private + short + repeated
    return [(i, t, "en", r.choice(sources), None if t is None else len(t)) for i, t in enumerate(texts)]


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain(rows):
    """(doc_id, piece, start, length, ids_crc32) for a corpus of one source, where the mix takes every document once."""
    kept = []
    for key, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = Counter(windows)
        covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
        if len(words) >= 50 and 100 * len(covered) <= 50 * len(words):
            kept.append((key, text))
    alone = []
    for key, text in sorted(kept):
        own = shingles(text)
        if not any(len(own & o) >= 0.8 * len(own | o) for _, _, o in alone):
            alone.append((key, text, own))
    out = []
    for key, text, _ in alone:
        text = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "<EMAIL>", text)
        text = re.sub(r"\+[0-9][\x20().0-9-]+[0-9]", "<PHONE>", text)
        ids = np.array([*packing.encoder(packing.vocabulary_path()).encode_to_numpy(text), 2], "<u4")
        out += [(key, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(packing.cut(len(ids)))]
    return sorted(out)


@pytest.fixture()
def tables(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
        return str(tmp_path)

    return write


def test_against_plain_version(spark, tables):
    rows = corpus(["one"])
    got = corpus_pipeline.run(spark, tables(rows)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == plain(rows)
    at = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 1024


def test_stages(spark, tables):
    rows = corpus(["a", "b", None])
    path = tables(rows)
    docs, counts = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        if name != "packing":
            assert docs.columns == list(DOCUMENT_COLUMNS)
        docs = docs.persist()
        counts.append((name, docs.count(), docs.select("doc_id").distinct().count()))
    assert [n for n, *_ in counts] == ["quality", "near_duplicates", "pii", "mixing", "packing"]
    assert counts[0][1] > counts[1][1] == counts[2][1]
    spark.catalog.clearCache()


def test_stages_on_nothing(spark, tables):
    path = tables([])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        assert docs.count() == 0


def test_extra_and_null_columns(spark, tables):
    path = tables(corpus(["a"]))
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumn("source", F.lit(None).cast("string")).withColumn("lang", F.lit(None).cast("string")).withColumn("score", F.lit(1)).withColumn("size", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.count() > 30, name
