"""Quality rules: fixed base rules, then gradient-boosted trees over document statistics.

``statistics`` computes the numbers of a text, ``with_statistics`` adds them to a
DataFrame in one pass without a shuffle. ``fit`` boosts small trees (logistic
loss, histogram splits) under monotonic constraints: more repeated words,
repeated lines or symbols never raise a score. The trees are flattened into numpy
node arrays (``Forest``) that score a batch at once.

``train`` fits on a bounded sample, the SAMPLE_ROWS labelled documents with the
smallest hash of their id, and sets the threshold so that at most REFUSE of the good
documents among them are rejected. Everything else covers all rows.

Defined results: a null or empty text has zero in all counts and fails the base
rules; without labels, or with labels of one class, the base rules decide alone;
label rows with null values are left out; repeated rows are judged alike; other
columns pass by untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import DOCUMENT_COLUMNS, table

SAMPLE_ROWS = 12_000
REFUSE = 0.002
LEAST_WORDS = 50
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Feature names with the direction a higher value may move the score: 1, -1 or 0 for either.
FEATURES = (
    ("log_words", 0), ("mean_word", 0), ("symbols_per_word", -1), ("dup_line_share", -1), ("repeat_share", -1),
    ("distinct_share", 0), ("digit_share", 0), ("upper_share", 0), ("stop_share", 0), ("words_per_line", 0), ("top_word_share", 0),
)
DIRECTIONS = tuple(d for _, d in FEATURES)

_DIGITS = b"0123456789"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_STOPS = b".!?"


def repeated_words(codes: np.ndarray, distinct: int) -> int:
    """Words covered by windows of three that occur at least twice; codes number the words from 0."""
    n = len(codes)
    if n < 4:
        return 0
    if distinct > 2_000_000:
        _, pairs = np.unique(codes[:-2] * distinct + codes[1:-1], return_inverse=True)
        _, tails = np.unique(codes[2:], return_inverse=True)
        keys = pairs * (int(tails.max()) + 1) + tails
    else:
        keys = (codes[:-2] * distinct + codes[1:-1]) * distinct + codes[2:]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return int(covered.sum())


def statistics(data: bytes) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """Base counts and model features of a text's UTF-8 bytes."""
    words = data.split()
    n = len(words)
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    codes = np.fromiter(map(numbers.__getitem__, words), np.int64, n)
    joined = b"".join(words)
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    dup_lines = len(lines) - len(set(lines))
    chars = len(joined.decode("utf-8", "replace"))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    repeats = repeated_words(codes, len(numbers))
    counts = (n, chars, symbols, dup_lines, repeats)
    w, size = max(n, 1), max(len(joined), 1)
    share = lambda of: (len(joined) - len(joined.translate(None, of))) / size
    top = int(np.bincount(codes).max()) if n else 0
    return counts, (
        float(np.log1p(n)), chars / w, symbols / w, dup_lines / max(len(lines), 1), repeats / w,
        len(numbers) / w, share(_DIGITS), share(_UPPER), share(_STOPS), n / max(len(lines), 1), top / w,
    )


def base_failed(counts: np.ndarray) -> np.ndarray:
    """The fixed rules on rows of COUNTS."""
    return (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > 50 * counts[:, 0])


@dataclass(frozen=True)
class Forest:
    """Trees as flat node arrays: node i sends a row left if its feature is at most the threshold; leaves point to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float
    cut: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Log-odds of each row of features: all trees of all rows move down a level at a time."""
        node = np.broadcast_to(self.roots, (len(rows), len(self.roots)))
        at = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            node = np.where(rows[at, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.bias + self.value[node].sum(axis=1)


def fit(rows: np.ndarray, labels: np.ndarray, directions: tuple[int, ...], trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 48, least: int = 20, ridge: float = 1.0) -> Forest:
    """Boosted trees for log-odds of label 1; a child's value stays on its side of the middle of a constrained split."""
    borders = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(rows.shape[1])]
    binned = np.stack([np.searchsorted(b, rows[:, j], side="left") for j, b in enumerate(borders)], axis=1)
    mean = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    bias = float(np.log(mean / (1 - mean)))
    margin = np.full(len(rows), bias)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf(number: float) -> int:
        feature.append(0), threshold.append(np.inf), value.append(number)
        left.append(len(left)), right.append(len(right))
        return len(value) - 1

    def grow(at: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = gradient[at], hessian[at]
        total_g, total_h = g.sum(), h.sum()
        worth = lambda a, b: a * a / (b + ridge)
        best = (1e-6, -1, -1, 0.0, 0.0)
        for j, border in enumerate(borders if level < depth and len(at) >= 2 * least else []):
            if not len(border):
                continue
            size = len(border) + 1
            cell = binned[at, j]
            gl, hl, nl = (np.bincount(cell, w, size)[:-1].cumsum() for w in (g, h, None))
            gr, hr = total_g - gl, total_h - hl
            gain = worth(gl, hl) + worth(gr, hr) - worth(total_g, total_h)
            vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
            gain = np.where((nl < least) | (len(at) - nl < least) | (directions[j] * (vr - vl) < 0), -1, gain)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k, float(vl[k]), float(vr[k]))
        if best[1] < 0:
            place = leaf(rate * float(np.clip(-total_g / (total_h + ridge), low, high)))
            margin[at] += value[place]
            return place
        _, j, k, vl, vr = best
        middle = (vl + vr) / 2
        place = leaf(0.0)
        feature[place], threshold[place] = j, float(borders[j][k])
        goes = binned[at, j] <= k
        bounds = ((low, high), (low, high)) if not directions[j] else ((low, middle), (middle, high))[:: directions[j]]
        left[place] = grow(at[goes], level + 1, *bounds[0])
        right[place] = grow(at[~goes], level + 1, *bounds[1])
        return place

    everything = np.arange(len(rows))
    for _ in range(trees):
        chance = 1 / (1 + np.exp(-margin))
        gradient, hessian = chance - labels, chance * (1 - chance)
        roots.append(grow(everything, 0, -np.inf, np.inf))
    return Forest(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), depth, bias, -np.inf)


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE_ROWS, refuse: float = REFUSE) -> Forest | None:
    """The model of at most ``sample`` labelled documents; None where they are not of two classes."""
    chosen = (
        labels.select(F.col(key).alias("label_key"), F.col(label).cast("int").alias("label"))
        .dropna().dropDuplicates(["label_key"]).orderBy(F.xxhash64("label_key"), "label_key").limit(sample)
    )
    rows = df.select(key, text).join(F.broadcast(chosen), F.col(key) == F.col("label_key")).select(text, "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(x or b"") for x in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([c for c, _ in found], pa.list_(pa.int64())), pa.array([f for _, f in found], pa.list_(pa.float64()))], ["label", "counts", "features"])

    got = rows.mapInArrow(run, "label int, counts array<long>, features array<double>").toArrow()
    if not got.num_rows:
        return None
    counts = np.array(got["counts"].to_pylist())
    features, target = np.array(got["features"].to_pylist()), (got["label"].to_numpy() > 0).astype(float)
    order = np.lexsort((*features.T, target))
    order = order[~base_failed(counts[order])]
    features, target = features[order], target[order]
    if len(target) < 50 or target.min(initial=1) == target.max(initial=0):
        return None
    forest = fit(features, target, DIRECTIONS)
    good = np.sort(forest.score(features[target > 0]))
    cut = min(float(good[int(refuse * len(good))]) - 1e-9, 0.0)
    return Forest(**{**forest.__dict__, "cut": cut})


def with_statistics(df: DataFrame, forest: Forest | None, text: str = "text", only_kept: bool = False) -> DataFrame:
    """df with COUNTS, base_failed, score and kept; or, with only_kept, df's own columns of the kept rows."""
    names = [*COUNTS, "base_failed", "score", "kept"]
    if not only_kept and (clash := set(names) & set(df.columns)):
        raise ValueError(f"columns in the way: {sorted(clash)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [statistics(x or b"") for x in batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()]
            counts, features = np.array([c for c, _ in found], np.int64), np.array([f for _, f in found])
            failed = base_failed(counts)
            score = forest.score(features) if forest else np.zeros(len(found))
            kept = ~failed & (score >= forest.cut if forest else True)
            if only_kept:
                yield batch.filter(pa.array(kept))
                continue
            extra = [*(pa.array(c) for c in counts.T), pa.array(failed), pa.array(score), pa.array(kept)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *names])

    schema = ", ".join([f"`{n}` {t}" for n, t in df.dtypes] + ([] if only_kept else [*(f"{c} long" for c in COUNTS), "base_failed boolean", "score double", "kept boolean"]))
    return df.mapInArrow(run, schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and the model's verdict for every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = train(documents, table(spark, sf_dir, "labels"))
    return with_statistics(documents, forest).drop("text")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that base rules and model keep."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    return with_statistics(docs, train(docs, table(spark, sf_dir, "labels")), only_kept=True)
