"""Language identification: nearest centroid of normalised TF-IDF byte n-gram vectors, with rejection.

Texts are lower-cased (ASCII and Latin-1 capitals) and every run of ASCII bytes other than letters counts as
one blank; byte n-grams of 1 to 4 bytes are hashed to buckets, weighted by log counts times inverse document
frequency and normalised. Each language has several centroids, found by spherical k-means, and a text goes to
the nearest by cosine. It is rejected when it lies much farther from its centroid than the training texts of
that language with about as many n-grams did; a text of any length can be rejected.

The fit uses a bounded sample by hash, about PER_LANGUAGE rows of each language and about MAX_ROWS in all, with MAX_BUCKETS buckets together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from ..operators.names import free
from . import store
from .resident import release, trim
from .textkeys import mix, slices

#: Sampled rows, buckets, centroids of a language, and rounds of k-means.
PER_LANGUAGE, MAX_ROWS, BITS, CENTROIDS, ROUNDS = 800, 6400, 15, 4, 8
#: Buckets of all rows of the fit together.
MAX_BUCKETS = 15_000_000
#: Rows of a fit that are dense at a time.
AT_ONCE = 64
#: Grams from which the least cosine of a centroid's own training rows counts too, and the share of a least training cosine that a text must reach.
REJECT_FROM, REJECT_SHARE = 1000, 0.4
#: Bands of gram counts, each twice as wide as the last, and the share of a band's median cosine below which a training row is an odd one.
BANDS, ODD_BELOW = 48, 0.5
SIZES = (1, 2, 3, 4)

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class Model:
    """idf: of the buckets; centroids: unit rows; lang: of each centroid; least: cosine that isn't rejected, by centroid and band of gram counts."""

    idf: np.ndarray
    centroids: np.ndarray
    lang: list[str]
    least: np.ndarray


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Per text the buckets of all its n-grams, in no special order."""
    text = _FOLD[data]
    n = len(text)
    if n:
        upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        text[upper] += 0x20
    solid = np.ones(n, bool)
    solid[1:] = (text[1:] != 32) | (text[:-1] != 32)
    solid[offsets[:-1][offsets[:-1] < n]] = True
    place = np.concatenate(([0], np.cumsum(solid)))[offsets]
    wide = text[solid].astype(np.uint64)
    families = []
    for size in SIZES:
        rows = np.full(max(0, len(wide) - size + 1), np.uint64(size))
        for i in range(size):
            rows = rows << np.uint64(8) | wide[i : len(wide) - size + 1 + i]
        families.append((mix(rows, 41) >> np.uint64(64 - BITS)).astype(np.int32))
    for a, b in zip(place[:-1].tolist(), place[1:].tolist(), strict=True):
        yield np.concatenate([x[a : max(a, b - i)] for i, x in enumerate(families)])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, lang, place -> buckets, counts, lang, place."""
    release()
    for batch in batches:
        for a, b, data, offsets in slices(batch.column(0)):
            rows = [np.unique(x, return_counts=True) for x in grams(data, offsets)]
            ends = np.cumsum([0] + [len(x) for x, _ in rows]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.ListArray.from_arrays(ends, np.concatenate([x for x, _ in rows]).astype(np.int32)),
                pa.ListArray.from_arrays(ends, np.concatenate([c for _, c in rows]).astype(np.int32)),
                *(batch.column(i).slice(a, b - a) for i in (1, 2)),
            ], ["buckets", "counts", "lang", "place"])


class _Rows:
    """Unit rows of one language; only AT_ONCE of them are dense at a time, for all together take 100 MB of the driver."""

    def __init__(self, buckets: list[np.ndarray], counts: list[np.ndarray], idf: np.ndarray):
        self.buckets, self.counts, self.idf = buckets, counts, idf

    def __len__(self) -> int:
        return len(self.buckets)

    def dense(self, rows: Sequence[int]) -> np.ndarray:
        x = np.zeros((len(rows), len(self.idf)), np.float32)
        for j, i in enumerate(rows):
            x[j, self.buckets[i]] = (1 + np.log(self.counts[i], dtype=np.float64)) * self.idf[self.buckets[i]]
        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
        return x

    def blocks(self) -> Iterator[np.ndarray]:
        for a in range(0, len(self), AT_ONCE):
            yield self.dense(range(a, min(a + AT_ONCE, len(self))))

    def cosine(self, centre: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ centre.T for x in self.blocks()])


def _members(own: np.ndarray, k: int, kind: np.dtype) -> np.ndarray:
    return (own == np.arange(k)[:, None]).astype(kind)


def _kmeans(rows: _Rows, k: int) -> np.ndarray:
    """Unit centroids of unit rows by cosine; begins with rows far from one another."""
    start = [0]
    near = rows.cosine(rows.dense(start))[:, 0]
    while len(start) < min(k, len(rows)):
        start.append(int(near.argmin()))
        near = np.maximum(near, rows.cosine(rows.dense(start[-1:]))[:, 0])
    centre = rows.dense(start)
    for _ in range(ROUNDS):
        sums, some = np.zeros_like(centre), np.zeros(len(centre), bool)
        for x in rows.blocks():
            members = _members((x @ centre.T).argmax(1), len(centre), x.dtype)
            sums += members @ x
            some |= members.any(1)
        sums = np.where(some[:, None], sums, centre)
        centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centre


def _band(grams: np.ndarray) -> np.ndarray:
    """The band of gram counts; band k begins at 2**k."""
    return np.minimum(np.log2(np.maximum(grams, 1)).astype(np.int64), BANDS - 1)


def _unseen_cosine(rows: _Rows, cosine: np.ndarray) -> np.ndarray:
    """Cosine of each row with the nearest centroid, were the row not part of its own one; NaN for a row without others."""
    own, k = cosine.argmax(1), cosine.shape[1]
    by_block = lambda: zip(rows.blocks(), np.split(own, range(AT_ONCE, len(own), AT_ONCE)), strict=True)
    sums = sum(_members(at, k, x.dtype) @ x for x, at in by_block())
    dot = np.concatenate([np.einsum("ij,ij->i", x, sums[at]) for x, at in by_block()])
    size = np.bincount(own, minlength=k)
    rest = (sums * sums).sum(1)[own] - 2 * dot + 1
    out = cosine.astype(np.float64)
    out[np.arange(len(own)), own] = np.where(size[own] > 1, (dot - 1) / np.sqrt(np.maximum(rest, 1e-9)), -1)
    out[:, size == 0] = -1
    best = out.max(1)
    return np.where(best < 0, np.nan, best)


def _by_band(grams: np.ndarray, cosine: np.ndarray) -> np.ndarray:
    """By band the least cosine of its rows and those of the bands beside it, odd ones left out.

    A band without rows has what the next shorter one has; below the first one with rows it falls with the
    root of the count, as cosines of short texts do. Longer texts don't lie farther, so a band has no less than
    ODD_BELOW times what any shorter one has.
    """
    grams, cosine = grams[~np.isnan(cosine)], cosine[~np.isnan(cosine)]
    if not len(grams):
        return np.zeros(BANDS)
    near = [cosine[abs(_band(grams) - k) <= 1] for k in range(BANDS)]
    low = np.array([c[c >= ODD_BELOW * np.median(c)].min() if len(c) else np.nan for c in near])
    first = int(np.flatnonzero(~np.isnan(low))[0])
    low[:first] = low[first] * 2.0 ** ((np.arange(first) - first) / 2)
    for k in range(first + 1, BANDS):
        if np.isnan(low[k]):
            low[k] = low[k - 1]
    return np.maximum(low, ODD_BELOW * np.maximum.accumulate(low))


def fit_rows(buckets: list[np.ndarray], counts: list[np.ndarray], langs: list[str]) -> Model:
    """The model for rows of buckets with their counts and languages; rows without buckets are left out."""
    rows = [i for i in range(len(buckets)) if len(buckets[i])]
    size = 1 << BITS
    if not rows:
        return Model(np.zeros(size), np.zeros((0, size), np.float32), [], np.zeros((0, BANDS)))
    seen = np.zeros(size, np.int64)
    for i in rows:
        seen += np.bincount(buckets[i], minlength=size)
    idf = (np.log((1 + len(rows)) / (1 + seen)) + 0.1) * (seen > 0)
    centroids, lang, least, seen_by = [], [], [], {}
    for name in sorted({langs[i] for i in rows}):
        own = [i for i in rows if langs[i] == name]
        unit = _Rows([buckets[i] for i in own], [counts[i] for i in own], idf)
        centre = _kmeans(unit, CENTROIDS)
        cosine, total = unit.cosine(centre), np.array([counts[i].sum() for i in own], np.int64)
        long, seen_by[name] = total >= REJECT_FROM, (total, _unseen_cosine(unit, cosine))
        for j in range(len(centre)):
            mine = cosine[(cosine.argmax(1) == j) & long, j]
            least.append(REJECT_SHARE * float(mine.min()) if len(mine) else 0.0)
            centroids.append(centre[j])
            lang.append(name)
    # A language whose rows tell nothing of how far others of it lie, as a single one, takes what all languages have.
    every = _by_band(*(np.concatenate(c) for c in zip(*seen_by.values(), strict=True)))
    bands = {name: every if np.isnan(c).all() else _by_band(t, c) for name, (t, c) in seen_by.items()}
    far = REJECT_SHARE * np.stack([bands[name] for name in lang])
    from_band = int(np.ceil(np.log2(REJECT_FROM)))
    far[:, from_band:] = np.maximum(far[:, from_band:], np.array(least)[:, None])
    return Model(idf, np.stack(centroids), lang, far)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, max_rows: int = MAX_ROWS, max_buckets: int = MAX_BUCKETS) -> Model:
    """Fits to text and lang of a sample of docs; rows whose lang or text is null are left out.

    About per_language rows of each language, fewer when the languages are so many that it would be more
    than max_rows, are those whose hashed doc_id falls below the language's share. Of these count the first by hash
    that have max_buckets buckets together.
    """
    known = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "text", "lang")
    size = known.groupBy("lang").agg(F.count("*").alias("n"))
    each = F.least(F.lit(float(per_language)), F.lit(float(max_rows)) / F.col("langs"))
    share = size.crossJoin(F.broadcast(size.agg(F.count("*").alias("langs")))).select("lang", (each / F.col("n")).alias("share"))
    drawn = known.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    rows = drawn.select("text", "lang", F.xxhash64("doc_id").alias("place")).mapInArrow(_counts, "buckets array<int>, counts array<int>, lang string, place long")
    table, buckets, counts, langs = store.written(rows, store.shared_dir(docs.sparkSession), "fit"), [], [], []
    for got in store.slices(table, "place", F.size("buckets"), max_buckets):
        buckets += [x.astype(np.uint16) for x in got.column("buckets").to_numpy(zero_copy_only=False)]
        counts += [x.astype(np.min_scalar_type(x.max(initial=0))) for x in got.column("counts").to_numpy(zero_copy_only=False)]
        langs += got.column("lang").to_pylist()
    trim()
    model = fit_rows(buckets, counts, langs)
    del buckets, counts
    trim()
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, lang_score (cosine with the nearest centroid, 0 to 1) and lang_rejected.

    lang_pred is the language of the nearest centroid, for whole texts; a text that is null or has no letter
    gets `und`, score 0 and is rejected, as does every text when nothing was learnt. Any other text is rejected
    when its cosine is below what its centroid has for its number of n-grams. Ties go to the first language in
    order. Existing columns of these names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "lang_score", "lang_rejected")
    flag, kept = free(docs, "has_letter"), docs.columns
    rows = docs.withColumn(flag, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    schema = StructType([*docs.schema, StructField("lang_pred", StringType()), StructField("lang_score", DoubleType()), StructField("lang_rejected", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        m = held.value
        table = np.ascontiguousarray(m.centroids.T)
        for batch in batches:
            letter = batch.column(batch.schema.get_field_index(flag)).to_numpy(zero_copy_only=False)
            best, cosine, count = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for a, _, data, offsets in slices(batch.column(batch.schema.get_field_index("text"))):
                for i, x in enumerate(grams(data, offsets)):
                    if len(m.lang) and letter[a + i]:
                        times = np.bincount(x, minlength=len(m.idf))
                        idx = np.flatnonzero(times)
                        value = (1 + np.log(times[idx])) * m.idf[idx]
                        near = value @ table[idx] / max(float(np.sqrt(value @ value)), 1e-12)
                        best[a + i] = near.argmax()
                        cosine[a + i], count[a + i] = near[best[a + i]], len(x)
            known = letter & bool(m.lang)
            least = m.least[best, _band(count)] if len(m.lang) else np.zeros(batch.num_rows)
            names = np.array([*m.lang, "und"], object)[np.where(known, best, len(m.lang))]
            rejected = ~known | (cosine < least)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(names, pa.string()), pa.array(np.clip(cosine, 0, 1)), pa.array(rejected)],
                [*kept, "lang_pred", "lang_score", "lang_rejected"],
            )

    return rows.mapInArrow(run, schema)
