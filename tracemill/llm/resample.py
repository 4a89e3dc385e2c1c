"""Importance resampling of documents towards a target, by hashed counts of runs of one and two words.

The features of each text are numbered 0 to BUCKETS - 1 by a checksum and written once, as streams of packed
unsigned 16-bit numbers in blocks of whole documents with their offsets. Counts come from the streams by an external
sort: runs of bounded size are sorted and run-length encoded in each task, the lengths summed by bucket in Spark.
Streams are then read again: each bucket's gain is gathered and summed by document with np.add.reduceat.

Checksums are taken of all words of a slice at once, one byte of each at a time, and go on from a word over a blank
to the next, which gives those of the runs of two.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store
from .textkeys import letters_of, slices, word_spans

BUCKETS = 10_000
#: Bytes of text of a block, of a piece of a long text, numbers of a run that is sorted at once, length in bytes from which a word is hashed by itself.
BLOCK, LONGEST, RUN, LONG = 1 << 19, 1 << 22, 1 << 22, 48
_WORDS, _END = letters_of(range(48, 58)), re.compile(b"[^ ] ")


def _crc_table() -> np.ndarray:
    """The byte table of the reversed polynomial of CRC-32."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(0xEDB88320), x >> 1).astype(np.uint32)
    return x


_CRC = _crc_table()


def _step(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return _CRC[(state ^ byte) & 0xFF] ^ (state >> 8)


def _states(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The inner state of the checksum of each span, begun from its own first state."""
    order = np.argsort(-sizes, kind="stable")
    at, state = starts[order], first[order]
    counts = np.bincount(np.minimum(sizes, LONG), minlength=LONG + 1)
    live = len(sizes) - np.cumsum(counts)  # by i: spans of more than i bytes
    for i in range(LONG):
        if not live[i]:
            break
        state[: live[i]] = _step(state[: live[i]], data[at[: live[i]] + i])
    for k in range(int(counts[LONG])):
        tail = data[at[k] + LONG : at[k] + sizes[order[k]]].tobytes()
        state[k] = zlib.crc32(tail, int(state[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = state
    return out


def stream(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features, text by text, and how many each text has. Offsets are those of the texts in data."""
    data = _WORDS[data]
    starts, ends, first = word_spans(data, offsets)
    words, n = np.diff(first), len(starts)
    sizes = np.maximum(2 * words - 1, 0)
    out = np.zeros(int(sizes.sum()), np.uint16)
    if n:
        single = _states(data, starts, ends - starts, np.full(n, 0xFFFFFFFF, np.uint32))
        text = np.repeat(np.arange(len(words)), words)
        at = (np.cumsum(sizes) - sizes)[text] + 2 * (np.arange(n) - first[:-1][text])
        out[at] = (single ^ np.uint32(0xFFFFFFFF)) % buckets
        later = np.flatnonzero(text[1:] == text[:-1]) + 1
        double = _states(data, starts[later], (ends - starts)[later], _step(single[later - 1], 0x20))
        out[at[later] - 1] = (double ^ np.uint32(0xFFFFFFFF)) % buckets
    return out, sizes


def long_stream(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What stream gives for one text, made in pieces of about LONGEST bytes; each begins with the last word of the one before."""
    text, at, stop, parts = _WORDS[data].tobytes(), 0, 0, []
    while True:
        end = _END.search(text, max(at + LONGEST, stop))  # beyond the piece before, however long its last word is
        stop = end.start() + 1 if end else len(text)
        part = np.frombuffer(text, np.uint8)[at:stop]
        numbers = stream(part, np.array([0, len(part)]))[0]
        parts.append(numbers[1:] if parts else numbers)
        if not end:
            out = np.concatenate(parts)
            return out, np.array([len(out)])
        at = text.rfind(b" ", 0, stop) + 1


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and text -> blocks: doc_ids, offsets (one more than documents) and the packed stream."""
    for batch in batches:
        for a, b, data, offsets in slices(batch.column(1), BLOCK):
            numbers, sizes = long_stream(data) if b - a == 1 and len(data) > LONGEST else stream(data, offsets)
            marks = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
            yield pa.RecordBatch.from_arrays([
                pa.array([batch.column(0).slice(a, b - a).to_numpy()]), pa.array([marks]), pa.array([numbers.astype("<u2").tobytes()], pa.binary()),
            ], ["doc_ids", "offsets", "stream"])


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams -> run lengths of sorted runs: bucket, n."""

    def sorted_run(parts: list[np.ndarray]) -> pa.RecordBatch:
        x = np.sort(np.concatenate(parts))
        ends = np.flatnonzero(np.append(x[1:] != x[:-1], True)) + 1
        return pa.RecordBatch.from_arrays([pa.array(x[ends - 1].astype(np.int32)), pa.array(np.diff(ends, prepend=0).astype(np.int64))], ["bucket", "n"])

    held, size = [], 0
    for batch in batches:
        for cell in batch.column(0):
            numbers = np.frombuffer(cell.as_buffer(), "<u2")
            for at in range(0, len(numbers), RUN):
                held.append(numbers[at : at + RUN])
                size += len(held[-1])
                if size >= RUN:
                    yield sorted_run(held)
                    held, size = [], 0
    if size:
        yield sorted_run(held)


def counts(blocks: DataFrame) -> DataFrame:
    """bucket, n of all streams: as many rows as buckets that occur."""
    return blocks.select("stream").mapInArrow(_lengths, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(own: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain for every bucket: floor(1000 ln) of its smoothed share of the target over that of the documents."""
    all_s, all_t = (df.agg(F.sum("n").alias("n")).first()["n"] or 0 for df in (own, target))
    every = own.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(own.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0)
    one = lambda c: F.col(c).cast("double") + 1.0
    share = one("t") * float(all_s + buckets) / (one("s") * float(all_t + buckets))
    return both.select("bucket", F.floor(1000 * F.log(share)).alias("gain"))


def _weighed(held):
    """Blocks -> doc_id, n_features, weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            for k in range(batch.num_rows):
                ids, marks = (batch.column(i)[k].values.to_numpy() for i in (0, 1))
                size = np.diff(marks)
                some = np.flatnonzero(size)
                weight = np.zeros(len(ids), np.int64)
                if len(some):
                    weight[some] = np.add.reduceat(table[np.frombuffer(batch.column(2)[k].as_buffer(), "<u2")], marks[some], dtype=np.int64) // size[some]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(size), pa.array(weight)], ["doc_id", "n_features", "weight"])

    return run


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise of a document in thousandths, from the first 32 bits of the hash of seed and doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7) -> DataFrame:
    """Every document with n_features, weight, score and rank (long), where rank numbers the drawn ones from 1.

    docs: doc_id (long) and text; target: text; more columns are ignored. Words are runs of ASCII letters and digits
    and characters beyond ASCII, A-Z lower-cased; features are runs of one and two words, repeats counted. Whole
    texts count; a null or empty text has no features and weight 0. weight is the floored mean of the gains of a
    document's features, score adds the document's noise. Of the N documents with min_words words or more the
    floor(percent N / 100) highest scores are drawn, ties to the smaller doc_id, then to fewer features; others have
    a null rank. Rows with a null doc_id are left out and count nowhere; repeated rows are documents of their own.
    An empty target leaves gains of the documents' shares alone; an empty table gives no rows.

    Places come from counts by score, whose number is bounded by the range of scores: what lies above a score is a
    sum over that table, and only the rows of one score are numbered together.
    """
    folder = store.shared_dir(docs.sparkSession)
    kind = "doc_ids array<long>, offsets array<long>, stream binary"
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = store.written(rows.mapInArrow(_streams, kind), folder, "streams")
    aim = store.written(target.select(F.lit(0).cast("long").alias("doc_id"), "text").mapInArrow(_streams, kind), folder, "target")
    gain = gains(store.written(counts(blocks), folder, "counts"), store.written(counts(aim), folder, "target-counts")).toArrow()
    table = np.zeros(BUCKETS, np.int32)
    table[gain.column(0).to_numpy()] = gain.column(1).to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(table)
    weighed = blocks.mapInArrow(_weighed(held), "doc_id long, n_features long, weight long")
    scored = store.written(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), folder, "scored")
    able = scored.where(F.col("n_features") >= max(2 * min_words - 1, 0))
    by_score = able.groupBy("score").agg(F.count("*").alias("n"))
    above = by_score.withColumn("above", F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n"))
    drawn = (able.count() * percent) // 100
    cut = above.where(F.col("above") < drawn).select("score", "above")
    place = F.row_number().over(Window.partitionBy("score").orderBy("doc_id", "n_features"))
    numbered = able.join(cut, "score").withColumn("rank", (F.col("above") + place).cast("long"))
    taken = numbered.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).select("doc_id", "n_features", "weight", "score", "rank")
    none = F.lit(None).cast("long").alias("rank")
    rest = scored.join(cut.select("score", F.lit(True).alias("met")), "score", "left").where(
        F.col("met").isNull() | (F.col("n_features") < max(2 * min_words - 1, 0))
    ).select("doc_id", "n_features", "weight", "score", none)
    return taken.unionByName(rest)
