"""Exact top-k search by inner product over a pivot-distance index.

Components become integers. With M the largest norm, a candidate c gets one more coordinate, sqrt(M^2 - |c|^2), and
a query a zero there; then |q - c|^2 = |q|^2 + M^2 - 2 q.c, and the highest products are the nearest candidates.
Candidates are keyed by their nearest pivot and the distance to it and sorted, and the sequence is cut to blocks:
annuli around a pivot, each with the ranges of its distances to all pivots. Blocks of queries are made in the same way.

The search expands in rounds. Each block of queries meets its next annuli in the order of what the triangle
inequality leaves as the least distance, SPREAD times as many as before; a pair of blocks multiplies two matrices and
gives the best of each query. An annulus whose least distance is beyond the distance of the k-th best of each query
of the block is never met, and within a block only the queries that it may still help are multiplied.

Equal vectors are one candidate with its k + 1 smallest ids, equal queries one query, so that neither meets itself
thousands of times. Products are exact: matrices are float32 or float64 only where the norms bound every partial
sum below 2^24 or 2^53, else 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store

#: Pivots, numbers of the sample that they are drawn from, candidates and queries of a block, bytes of a block at most, queries of a block that are multiplied at once.
PIVOTS, SAMPLE, BLOCK, QUERIES, BYTES, SLAB = 32, 500_000, 2048, 4096, 4 << 20, 512
#: Annuli that a block of queries meets in the first round, and the factor from round to round.
FIRST, SPREAD = 4, 8
_KEYED = "key long, first long, dim int, norm double, v array<long>, pivot int, dist double, ranges array<double>"
_BLOCK = "block long, dim int, n int, keys array<long>, firsts array<long>, width int, data binary, norm double, low array<double>, high array<double>"


def _valid(vectors: DataFrame, scale: float) -> DataFrame:
    """vec_id, v (integer components), h, norm of the vectors that take part."""
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where("vec_id is not null and embedding is not null").where(fit).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v")
    )
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.withColumn("h", F.xxhash64("v")).withColumn("norm", norm).where(F.col("norm") < float(1 << 62))


def _distances(x: np.ndarray, extra: np.ndarray, pivots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Distances of vectors and their further coordinate to all pivots."""
    p, more = pivots
    square = (x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * (x @ p.T) + (extra[:, None] - more[None]) ** 2
    return np.sqrt(np.maximum(square, 0))


def _pivots_of(pivots: dict, dim: int, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Of a dimension that the sample lacks, the origin is the only pivot."""
    return pivots.get(dim) or (np.zeros((1, dim)), np.array([np.sqrt(most)]))


def pivots_from(sample: pa.Table, most: float, count: int = PIVOTS) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension up to `count` vectors of the sample, each the farthest from those before it, and their further coordinate."""
    rows, out = sample.column("v").to_numpy(), {}
    dims = np.array([len(x) for x in rows])
    for dim in np.unique(dims).tolist():
        x = np.stack(rows[dims == dim]).astype(np.float64)
        extra = np.sqrt(np.maximum(most - (x * x).sum(1), 0))
        chosen, far = [0], np.full(len(x), np.inf)
        while len(chosen) < min(count, len(x)):
            far = np.minimum(far, _distances(x, extra, (x[chosen[-1:]], extra[chosen[-1:]]))[:, 0])
            chosen.append(int(far.argmax()))
        out[dim] = x[chosen], extra[chosen]
    return out


def _keyed(held, of_queries: bool):
    """key, first, v, norm -> with the nearest pivot, the distance to it and to all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, most = held.value
        for batch in batches:
            rows, norm = batch.column("v").to_numpy(zero_copy_only=False), batch.column("norm").to_numpy()
            dims, ranges = np.array([len(x) for x in rows], np.int32), [None] * len(rows)
            near, dist = np.zeros(len(rows), np.int32), np.zeros(len(rows))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = np.stack(rows[at]).astype(np.float64).reshape(len(at), dim)
                d = _distances(x, np.zeros(len(at)) if of_queries else np.sqrt(np.maximum(most - norm[at], 0)), _pivots_of(pivots, dim, most))
                near[at] = d.argmin(1)
                dist[at] = d.min(1)
                for i, y in zip(at.tolist(), d, strict=True):
                    ranges[i] = y
            yield pa.RecordBatch.from_arrays([
                batch.column("key"), batch.column("first"), pa.array(dims), batch.column("norm"), batch.column("v"), pa.array(near), pa.array(dist), pa.array(ranges, pa.list_(pa.float64())),
            ], ["key", "first", "dim", "norm", "v", "pivot", "dist", "ranges"])

    return run


def _blocks(size: int):
    """Sorted rows of a partition -> blocks of neighbours of one dimension and pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, open_, held, now = TaskContext.get().partitionId(), 0, [], 0, None

        def flush() -> pa.RecordBatch:
            rows, dim = pa.Table.from_batches(open_), now[0]
            data = np.stack(rows.column("v").to_numpy()).astype(np.int64)
            width = 4 if not data.size or np.abs(data).max() < 1 << 31 else 8
            ranges = np.stack(rows.column("ranges").to_numpy())
            return pa.RecordBatch.from_pydict({
                "block": pa.array([(part << 32) + number]), "dim": pa.array([dim], pa.int32()), "n": pa.array([len(data)], pa.int32()), "keys": pa.array([rows.column("key").to_numpy()]),
                "firsts": pa.array([rows.column("first").to_numpy()]), "width": pa.array([width], pa.int32()), "data": pa.array([data.astype(f"<i{width}").tobytes()], pa.binary()),
                "norm": pa.array([rows.column("norm").to_numpy().max()]), "low": pa.array([ranges.min(0)]), "high": pa.array([ranges.max(0)]),
            })

        for batch in batches:
            keys = list(zip(batch.column("dim").to_pylist(), batch.column("pivot").to_pylist(), strict=True))
            a = 0
            while a < len(keys):
                most = max(1, min(size, BYTES // (8 * max(1, keys[a][0]))))
                if open_ and (keys[a] != now or held >= most):
                    yield flush()
                    number, open_, held = number + 1, [], 0
                now, b = keys[a], a + 1
                while b < len(keys) and keys[b] == now and held + b - a < most:
                    b += 1
                open_.append(batch.slice(a, b - a))
                held += b - a
                a = b
        if open_:
            yield flush()

    return run


def _matrix(batch: pa.RecordBatch, row: int, side: str, kind: type) -> np.ndarray:
    data = np.frombuffer(batch.column(f"data_{side}")[row].as_buffer(), f"<i{batch.column(f'width_{side}')[row].as_py()}")
    return data.reshape(batch.column(f"n_{side}")[row].as_py(), batch.column("dim")[row].as_py()).astype(kind)


def _met(held, k: int):
    """Pairs of blocks -> the best k of each query that the annulus may still help: q_block, at, key, candidate, first, score, reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, most = held.value
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c: batch.column(c)[row].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                bound = np.sqrt(batch.column("norm_a")[row].as_py() * batch.column("norm_b")[row].as_py()) * (1 + 1e-9)
                kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
                x = _matrix(batch, row, "a", np.float64)
                reach = (x * x).sum(1) + most
                least = np.full(len(x), -np.inf)
                for s in batch.column("least")[row].as_py() or []:
                    least[s["at"]] = s["score"]
                d = _distances(x, np.zeros(len(x)), _pivots_of(pivots, x.shape[1], most))
                gap = np.maximum(np.maximum(get("low_b")[None] - d, d - get("high_b")[None]).max(1), 0)
                live = np.flatnonzero(gap - 1e-6 * np.sqrt(most) - 1e-9 <= np.sqrt(np.maximum(reach - 2 * least, 0)))
                if not len(live):
                    continue
                y, x, block = _matrix(batch, row, "b", kind).T, x.astype(kind), batch.column("a")[row].as_py()
                firsts, keys, ids = get("firsts_b"), get("keys_b"), get("keys_a")
                for at in range(0, len(live), SLAB):
                    some = live[at : at + SLAB]
                    product, floor = x[some] @ y, least[some]
                    if product.shape[1] > k:  # the k-th best of the block bounds what can count; its equals go on too
                        floor = np.maximum(floor, np.partition(product, product.shape[1] - k, 1)[:, product.shape[1] - k])
                    i, j = np.nonzero(product >= floor[:, None])
                    order = np.lexsort((firsts[j], -product[i, j], i))
                    i, j = i[order], j[order]
                    place = np.arange(len(i)) - np.searchsorted(i, i)
                    i, j = i[place < k], j[place < k]
                    score, i = product[i, j].astype(np.int64), some[i]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(i), block)), pa.array(i.astype(np.int32)), pa.array(ids[i]), pa.array(keys[j]), pa.array(firsts[j]),
                        pa.array(score), pa.array(reach[i]),
                    ], ["a", "at", "key", "candidate", "first", "score", "reach"])

    return run


def search(queries: DataFrame, candidates: DataFrame, k: int = 20, scale: float = 64.0) -> DataFrame:
    """The k candidates of highest inner product of each query: query_id, rank (int, from 1), vec_id, score (long).

    Both: vec_id (long), embedding (array of float or double); more columns are ignored. Components count as
    floor(scale * x), x as double. A query's own row, one of its vec_id with an equal vector, isn't its candidate;
    ties go to the smaller vec_id; fewer candidates give fewer rows. Vectors of other lengths don't meet; empty ones
    meet with score 0. Vectors that are null, hold null or non-finite components or have squared norms of 2^62 or more
    (products might not be longs), and rows with a null vec_id, take no part. Rows repeated whole are one candidate;
    repeated queries each give their rows. An empty table gives none. Pivots come from a sample of about SAMPLE
    numbers and steer only which blocks are met when; every vector is indexed, and the result is exact.
    """
    spark, more = candidates.sparkSession, k + 1
    folder, parts = store.shared_dir(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    valid, asked = _valid(candidates, scale), _valid(queries, scale)
    smallest = F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))
    own = store.written(
        valid.dropDuplicates(["h", "v", "vec_id"]).withColumn("place", smallest).where(F.col("place") <= more).groupBy("h", "v").agg(
            F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("norm").alias("norm")
        ).withColumn("key", F.monotonically_increasing_id()).withColumn("first", F.get("ids", F.lit(0))), folder, "candidates",
    )
    wanted = store.written(asked.groupBy("h", "v").agg(F.min("vec_id").alias("first"), F.first("norm").alias("norm")).withColumn("key", F.monotonically_increasing_id()), folder, "queries")
    size = own.agg(F.max("norm").alias("most"), F.sum(F.size("v").cast("long")).alias("numbers")).first()
    most = size["most"] or 0.0
    some = own.where(F.pmod(F.xxhash64(F.lit(1), "h", "first"), F.lit(-(-(size["numbers"] or 0) // SAMPLE) or 1)) == 0)
    held = spark.sparkContext.broadcast((pivots_from(some.select("v").toArrow(), most), most))

    def index(df: DataFrame, of_queries: bool, name: str) -> DataFrame:
        per = QUERIES if of_queries else BLOCK
        wide = min(parts, -(-df.count() // per) or 1) if of_queries else parts
        rows = df.select("key", "first", "v", "norm").mapInArrow(_keyed(held, of_queries), _KEYED)
        order = ["dim", "pivot", "dist", "key"]
        return store.written(rows.repartitionByRange(wide, *order).sortWithinPartitions(*order).mapInArrow(_blocks(per), _BLOCK), folder, name)

    blocks, asks = index(own, False, "blocks"), index(wanted, True, "asks")
    edge = lambda df, s: df.select("dim", F.col("block").alias(s), F.col("low").alias(f"low_{s}"), F.col("high").alias(f"high_{s}"))
    gaps = "zip_with(zip_with(low_b, high_a, (x, y) -> x - y), zip_with(low_a, high_b, (x, y) -> x - y), (x, y) -> greatest(x, y, 0D))"
    # Nearly all blocks have one dimension: they meet by a number dealt to the blocks of queries.
    dealt = min(parts, max(1, asks.count()))
    one = edge(asks, "a").withColumn("deal", F.pmod(F.xxhash64("a"), F.lit(dealt)))
    other = edge(blocks, "b").withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(dealt - 1).cast("long"))))
    near = one.join(other, ["dim", "deal"]).select("a", "b", F.array_max(F.expr(gaps)).alias("gap"))
    near = store.written(near.withColumn("turn", F.row_number().over(Window.partitionBy("a").orderBy("gap", "b"))), folder, "near")
    side = lambda df, s, *no: df.select("dim", F.col("block").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n", "keys", "firsts", "width", "data", "norm", "low", "high") if c not in no))
    rounds, done, best, last = 0, 0, None, near.agg(F.max("turn").alias("m")).first()["m"] or 0
    while done < last:
        until = FIRST if not done else done * SPREAD
        pairs = near.where((F.col("turn") > done) & (F.col("turn") <= until))
        if best is None:
            pairs = pairs.select("a", "b").withColumn("least", F.lit(None).cast("array<struct<at:int,score:long>>"))
        else:
            # The k-th best of each query so far; a block of which each query has one ends at the largest of their distances.
            full = best.groupBy("a", "at").agg(F.count("*").alias("n"), F.min("score").alias("score"), F.first("reach").alias("reach")).where(F.col("n") >= more)
            ends = full.groupBy("a").agg(
                F.collect_list(F.struct("at", "score")).alias("least"), F.count("*").alias("full"), F.sqrt(F.max(F.greatest(F.col("reach") - 2 * F.col("score"), F.lit(0.0)))).alias("end")
            ).join(asks.select(F.col("block").alias("a"), "n"), "a")
            beyond = (F.col("full") == F.col("n")) & (F.col("gap") - 1e-6 * float(np.sqrt(most)) - 1e-9 > F.col("end"))
            pairs = pairs.join(ends, "a", "left").where(~F.coalesce(beyond, F.lit(False))).select("a", "b", "least")
        met = pairs.join(side(asks, "a", "firsts", "low", "high"), "a").join(side(blocks, "b").drop("dim"), "b")
        found = met.mapInArrow(_met(held, more), "a long, at int, key long, candidate long, first long, score long, reach double")
        found = found if best is None else found.unionByName(best)
        place = F.row_number().over(Window.partitionBy("a", "at").orderBy(F.desc("score"), "first", "candidate"))
        best = store.written(found.withColumn("place", place).where(F.col("place") <= more).drop("place"), folder, f"best{rounds}")
        if rounds:
            store.freed(spark, folder, f"best{rounds - 1}")
        rounds, done = rounds + 1, until
    if best is None:
        return asked.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).where(F.lit(False))
    each = best.select("key", "candidate", "score").join(own.select(F.col("key").alias("candidate"), "ids"), "candidate").select("key", F.explode("ids").alias("vec_id"), "score")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))
    lists = each.withColumn("place", place).where(F.col("place") <= more).groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("found")
    )
    answers = wanted.select("h", "v", "key").join(lists, "key").select("h", "v", "found")
    self = F.struct((-F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)).alias("s"), F.col("vec_id"))
    rows = asked.select("vec_id", "h", "v").join(answers, ["h", "v"]).select("vec_id", "found", F.array_position("found", self).alias("own"))
    others = F.slice(F.filter("found", lambda x, i: (i + 1) != F.col("own")), 1, k)
    return rows.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("rank", "hit")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), "hit.vec_id", (-F.col("hit.s")).alias("score")
    )
