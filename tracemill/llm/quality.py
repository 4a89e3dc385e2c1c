"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

Indicators are of byte 4-grams and of word-shape n-grams; a shape says how a word is written (letters,
capitals, digits, signs, last sign, length) and whether it repeats a word shortly before it. Each indicator
is scaled by its log-count ratio between the classes, a linear hinge-loss model is fitted to the scaled
rows by dual coordinate descent, and a logistic curve over its margins gives the score.

The fit uses a bounded sample of the labelled rows, MAX_ROWS with MAX_BUCKETS buckets together, drawn by hash. Scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import store
from .resident import release, trim
from .textkeys import mix, slices, span_hashes, word_spans

#: Labelled rows that a fit uses at most, buckets of the indicators, and passes of the descent.
MAX_ROWS, BITS, PASSES = 8000, 16, 12
#: Buckets of all rows of the fit together.
MAX_BUCKETS = 30_000_000
#: How far back a word is compared with earlier ones, and the share from which a shape counts as frequent.
BACK, FREQUENT = 4, 0.05
#: Cost of a wrong row, and the smoothing of the counts.
COST, ALPHA = 1.0, 1.0

_KIND = np.zeros(256, np.uint8)
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 4
_KIND[128:] = 1
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 8


@dataclass(frozen=True)
class Model:
    """weights: of the buckets, log-count ratios included. score = 1 / (1 + exp(-(slope * margin + shift)))."""

    weights: np.ndarray
    slope: float
    shift: float


def _bucket(x: np.ndarray) -> np.ndarray:
    return (mix(x) >> np.uint64(64 - BITS)).astype(np.int64)


def indicators(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Per text the sorted distinct buckets of its n-grams; none for a text without words."""
    n = len(data)
    wide = data.astype(np.uint64)
    grams = np.zeros(max(0, n - 3), np.uint64)
    for i in range(4):
        grams |= wide[i : n - 3 + i] << np.uint64(8 * i)
    grams = _bucket(grams)
    starts, ends, first = word_spans(data, offsets)
    same = span_hashes(data, starts, ends)
    kinds = np.bitwise_or.reduceat(_KIND[data], starts) if len(starts) else np.zeros(0, np.uint8)
    inner = np.arange(len(same)) - np.repeat(first[:-1], np.diff(first))  # a word's place in its own text, where alone it can come again
    back = np.zeros(len(same), np.uint64)
    for i in range(BACK, 0, -1):
        back[i:][(same[i:] == same[:-i]) & (inner[i:] >= i)] = i
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    long = np.minimum(np.log2(ends - starts + 1), 5).astype(np.uint64)
    shapes = kinds.astype(np.uint64) | np.where(_KIND[last] == 8, last, 0).astype(np.uint64) << np.uint64(8) | back << np.uint64(16)
    shapes |= np.where(np.isin(_KIND[data[starts]] if len(starts) else last, [2]), np.uint64(1), np.uint64(0)) << np.uint64(20)
    full = mix(shapes | long << np.uint64(24), 21)
    shapes = mix(shapes, 22)
    families = [full, shapes]
    for size in (2, 3):
        rows = np.zeros(len(shapes), np.uint64)
        for i in range(size):
            rows[: len(shapes) - i] += shapes[i:] * np.uint64(2 * i + 3)
        families.append(mix(rows, 22 + size))
    single, often = [_bucket(x) for x in families], [_bucket(mix(x, 31)) for x in families[1:3]]
    seen = np.zeros(1 << BITS, bool)
    for k in range(len(offsets) - 1):
        a, b = int(first[k]), int(first[k + 1])
        if a == b:
            yield np.zeros(0, np.int64)
            continue
        seen[grams[offsets[k] : max(offsets[k], offsets[k + 1] - 3)]] = True
        for i, x in enumerate(single):
            seen[x[a : max(a, b - max(0, i - 1))]] = True
        for i, x in enumerate(often):
            part = np.sort(x[a : max(a, b - i)])
            need = max(1, int(np.ceil(FREQUENT * (b - a))))
            seen[part[need - 1 :][part[need - 1 :] == part[: len(part) - need + 1]]] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        yield found


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, label, place -> buckets, label, place."""
    release()
    for batch in batches:
        for a, b, data, offsets in slices(batch.column(0)):
            rows = [x.astype(np.int32) for x in indicators(data, offsets)]
            ends = np.cumsum([0] + [len(x) for x in rows]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, np.concatenate(rows)), *(batch.column(i).slice(a, b - a) for i in (1, 2))], ["buckets", "label", "place"])


class _Scaled(Sequence):
    """Of each row its buckets' ratios by the root of their number, made when asked for: held, they'd take twice the room of the rows."""

    def __init__(self, rows: list[np.ndarray], ratio: np.ndarray):
        self.rows, self.ratio = rows, ratio

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> np.ndarray:
        return (self.ratio[self.rows[i]] / max(1.0, np.sqrt(len(self.rows[i])))).astype(np.float32)


def descend(rows: list[np.ndarray], values: Sequence[np.ndarray], y: np.ndarray, costs: np.ndarray, size: int, passes: int, seed: int = 1) -> np.ndarray:
    """Dual coordinate descent for the hinge loss: the weights after `passes` passes over shuffled rows."""
    w, alpha = np.zeros(size), np.zeros(len(rows))
    squares = np.array([max(1e-12, float(v @ v)) for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            idx, v = rows[i], values[i]
            gradient = y[i] * float(w[idx] @ v) - 1
            new = min(max(alpha[i] - gradient / squares[i], 0.0), costs[i])
            if new != alpha[i]:
                w[idx] += (new - alpha[i]) * y[i] * v
                alpha[i] = new
    return w


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits y (0, 1) best, by Newton steps with a small penalty."""
    design, at = np.stack([margin, np.ones_like(margin)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), design.T @ (p - y) + 1e-2 * (at - [1.0, 0.0]))
        at = at - step
        if abs(step).max() < 1e-8:
            break
    return max(float(at[0]), 0.0), float(at[1])


def fit_rows(rows: list[np.ndarray], label: np.ndarray) -> Model:
    """The model for rows of buckets and labels 0, 1. With one class or no row, every score is a constant."""
    size = 1 << BITS
    if len(set(label.tolist())) < 2:
        return Model(np.zeros(size), 0.0, 4.0 if label.sum() or not len(label) else -4.0)
    ratio = np.zeros(size)
    for value, sign in ((1, 1.0), (0, -1.0)):
        count = np.full(size, ALPHA)
        for r in (r for r, y in zip(rows, label, strict=True) if y == value):
            count += np.bincount(r, minlength=size)
        ratio += sign * np.log(count / count.sum())
    values = _Scaled(rows, ratio)
    y = np.where(label == 1, 1.0, -1.0)
    costs = COST * len(y) / 2 / np.where(label == 1, (label == 1).sum(), (label == 0).sum())
    # Margins of rows that a model hasn't seen fit the curve: two halves score each other.
    half, margin = np.arange(len(rows)) % 2, np.zeros(len(rows))
    for part in (0, 1):
        own = np.flatnonzero(half != part)
        some = [rows[i] for i in own]
        w = descend(some, _Scaled(some, ratio), y[own], costs[own], size, PASSES)
        for i in np.flatnonzero(half == part):
            margin[i] = w[rows[i]] @ values[i]
    slope, shift = _logistic(margin, label.astype(float))
    w = descend(rows, values, y, costs, size, PASSES)
    return Model(w * ratio, slope, shift)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_buckets: int = MAX_BUCKETS) -> Model:
    """Fits to at most max_rows labelled documents, those with the smallest hashes of their doc_id, and of these to
    so many, in the same order, as have max_buckets buckets together.

    docs: doc_id, text; labels: doc_id, quality (1 good, 0 bad; others and null are left out).
    """
    chosen = (
        labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    table = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("label").cast("int").alias("label"), F.xxhash64("doc_id").alias("place"))
    rows = table.mapInArrow(_rows, "buckets array<int>, label int, place long")
    table, buckets, label = store.written(rows, store.shared_dir(docs.sparkSession), "fit"), [], []
    for got in store.slices(table, "place", F.size("buckets"), max_buckets):
        buckets += [x.astype(np.uint16) for x in got.column("buckets").to_numpy(zero_copy_only=False)]
        label += got.column("label").to_pylist()
    trim()
    model = fit_rows(buckets, np.array(label, np.int64))
    del buckets
    trim()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column quality_score from 0 to 1, for whole texts.

    A text without words, null included, has no indicator and gets the score of a margin of 0. An existing
    column of that name is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("quality_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        m = held.value
        for batch in batches:
            margin = np.zeros(batch.num_rows)
            for a, _, data, offsets in slices(batch.column(batch.schema.get_field_index("text"))):
                for i, idx in enumerate(indicators(data, offsets)):
                    margin[a + i] = m.weights[idx].sum() / max(1.0, np.sqrt(len(idx)))
            p = 1 / (1 + np.exp(-np.clip(m.slope * margin + m.shift, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, "quality_score"])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField("quality_score", DoubleType())]))
