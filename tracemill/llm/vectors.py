"""Embedding near-dedup by an epsilon grid order join.

Unit vectors at cosine t lie sqrt(2 - 2t) apart, the epsilon of the join. Vectors are turned to their principal
axes, and those of one label are sorted by their cells, epsilon wide, on the leading axes. Intervals of that
sequence are joined recursively: a pair of intervals whose boxes are farther apart than epsilon on the leading
axes is skipped with all that it holds, any other is divided, down to blocks of BLOCK vectors, whose exact
cosines are taken in double precision. Each level of the recursion is a join over the boxes of its intervals.

Equal vectors are merged first and counted with their number. A pair of blocks returns sums of links by vector
and the edges of a spanning forest of its links, never all pairs.
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

#: Vectors of a block, leading axes of the boxes and of the cells, intervals that an interval is divided in.
BLOCK, LEAD, GRID, FAN = 1024, 8, 4, 16
#: Numbers of the sample of vectors that the axes are fitted to.
SAMPLE = 2_000_000


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def axes(distinct: DataFrame) -> dict[int, np.ndarray]:
    """By dimension the leading principal axes (columns), of a sample by hash of about SAMPLE numbers.

    The axes steer only which blocks are skipped, never what links. A dimension with few vectors in the sample has none.
    """
    numbers = distinct.agg(F.sum(F.col("dim").cast("long")).alias("n")).first()["n"] or 0
    some = distinct.where(F.pmod(F.xxhash64(F.lit(1), "hash", "rep"), F.lit(-(-numbers // SAMPLE) or 1)) == 0).select("dim", "embedding").toArrow()
    dims, out = some.column(0).to_numpy(), {}
    for dim in np.unique(dims).tolist():
        rows = some.column(1).filter(pa.array(dims == dim))
        if len(rows) > LEAD:
            x = _unit(np.stack(rows.to_numpy()).astype(np.float64))
            x -= x.mean(0)
            out[dim] = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :LEAD] if dim <= len(x) else np.linalg.svd(x, full_matrices=False)[2][:LEAD].T
    return out


def _turned(held):
    """Adds lead, the coordinates on the leading axes, to rows with dim and embedding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, rows = batch.column("dim").to_numpy(), batch.column("embedding").to_numpy(zero_copy_only=False)
            lead: list = [None] * batch.num_rows
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                for i, y in zip(at, _unit(np.stack(rows[at]).astype(np.float64)) @ held.value.get(dim, np.eye(dim, min(dim, LEAD))), strict=True):
                    lead[i] = np.pad(y, (0, LEAD - len(y)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lead, pa.list_(pa.float64()))], [*batch.schema.names, "lead"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one partition -> blocks of neighbours with one label and dimension."""
    part, number, open_, key = TaskContext.get().partitionId(), 0, [], None

    def flush() -> pa.RecordBatch:
        rows = pa.Table.from_batches(open_)
        lead = np.stack(rows.column("lead").to_numpy())
        data = np.stack(rows.column("embedding").to_numpy()).astype("<f8")
        return pa.RecordBatch.from_pydict({
            "block": pa.array([(part << 32) + number]), "label": pa.array([key[0]], pa.string()), "dim": pa.array([key[1]], pa.int32()),
            "ids": pa.array([rows.column("rep").to_numpy()]), "copies": pa.array([rows.column("copies").to_numpy()]),
            "data": pa.array([data.tobytes()], pa.binary()), "low": pa.array([lead.min(0)]), "high": pa.array([lead.max(0)]),
        })

    for batch in batches:
        labels, dims = batch.column("label").to_pylist(), batch.column("dim").to_pylist()
        a = 0
        for b in range(1, batch.num_rows + 1):
            if b < batch.num_rows and (labels[b], dims[b]) == (labels[a], dims[a]) and b - a + sum(x.num_rows for x in open_) < BLOCK:
                continue
            if key is not None and key != (labels[a], dims[a]) and open_:
                yield flush()
                number, open_ = number + 1, []
            key = labels[a], dims[a]
            open_.append(batch.slice(a, b - a))
            if sum(x.num_rows for x in open_) >= BLOCK:
                yield flush()
                number, open_ = number + 1, []
            a = b
    if open_:
        yield flush()


def _linked(threshold: float):
    """Pairs of blocks -> rows a, n (links of a in this pair) and rows a, b (edges that span the links)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = {c: batch.column(i)[row] for i, c in enumerate(batch.schema.names)}
                dim = get["dim"].as_py()
                ids, copies, data = ([np.array(get[f"{c}_{s}"].as_py()) for s in "ab"] for c in ("ids", "copies", "data"))
                x, y = (_unit(np.frombuffer(get[f"data_{s}"].as_buffer(), "<f8").reshape(-1, dim)) for s in "ab")
                same = get["a"].as_py() == get["b"].as_py()
                close = x @ y.T >= threshold
                if same:
                    np.fill_diagonal(close, False)
                sums = [(ids[0], close @ copies[1])] + ([] if same else [(ids[1], close.T @ copies[0])])
                flat = np.concatenate(ids)
                root = list(range(len(flat)))

                def find(k: int, root=root) -> int:
                    while root[k] != k:
                        root[k] = k = root[root[k]]
                    return k

                edges = []
                for i, j in zip(*(k.tolist() for k in np.nonzero(np.triu(close) if same else close)), strict=True):
                    i, j = find(i), find(j if same else j + len(ids[0]))
                    if i != j:
                        root[j] = i
                        edges.append((flat[i], flat[j]))
                a = np.concatenate([k[n > 0] for k, n in sums] + [np.array([e[0] for e in edges], np.int64)])
                n = np.concatenate([n[n > 0] for _, n in sums])
                yield pa.RecordBatch.from_arrays([
                    pa.array(a, pa.int64()), pa.array([None] * len(n) + [e[1] for e in edges], pa.int64()), pa.array([*n.tolist(), *[0] * len(edges)], pa.int64()),
                ], ["a", "b", "n"])

    return run


def _gap(low_a: str, high_a: str, low_b: str, high_b: str) -> str:
    """SQL for the squared distance of two boxes."""
    over = f"zip_with(zip_with({low_a}, {high_b}, (x, y) -> x - y), zip_with({low_b}, {high_a}, (x, y) -> x - y), (x, y) -> greatest(x, y, 0D))"
    return f"aggregate({over}, 0D, (s, x) -> s + x * x)"


def near_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """Links and classes of vectors by cosine within a label.

    vectors: vec_id (long), embedding (array of float or double), label; more columns are ignored. Two vectors
    link when their labels are equal and not null, they have as many components and their cosine in double
    precision is threshold or more (0 < threshold < 1). A vector that is null, empty or zero or holds null or
    non-finite components links with nothing. Returns per row vec_id, n_links (other rows linked directly),
    component_id (smallest vec_id reachable, its own included), kept (vec_id = component_id). Rows repeated
    whole count as vectors of their own and link; rows with a null vec_id are left out; an empty table gives none.
    """
    folder = store.shared_dir(vectors.sparkSession)
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    fit = F.coalesce(
        F.col("label").isNotNull() & F.exists("embedding", lambda x: x != 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False),
    )
    valid = rows.where(fit).withColumn("hash", F.xxhash64("embedding"))
    distinct = store.written(
        valid.groupBy("hash", "label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
        .withColumn("dim", F.size("embedding")), folder, "distinct",
    )
    held = vectors.sparkSession.sparkContext.broadcast(axes(distinct))
    epsilon = float(np.sqrt(2 - 2 * threshold)) + 1e-9
    kind = distinct.schema["embedding"].dataType.simpleString()
    lead = distinct.select("rep", "copies", "label", "dim", "embedding").mapInArrow(
        _turned(held), f"rep long, copies long, label string, dim int, embedding {kind}, lead array<double>"
    )
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["label", "dim", *(F.floor(F.get("lead", F.lit(i)) / epsilon) for i in range(GRID)), "rep"]
    blocks = store.written(
        lead.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(
            _blocks, "block long, label string, dim int, ids array<long>, copies array<long>, data binary, low array<double>, high array<double>"
        ), folder, "blocks",
    )
    boxes = store.written(
        blocks.select("label", "dim", "block", (F.row_number().over(Window.partitionBy("label", "dim").orderBy("block")) - 1).cast("long").alias("at"), "low", "high"),
        folder, "boxes",
    )
    last, levels = boxes.agg(F.max("at").alias("m")).first()["m"] or 0, 0
    while last >= FAN**levels:
        levels += 1
    each = lambda f, c: F.array(*(f(F.get(c, F.lit(i))) for i in range(LEAD))).alias(c)
    pairs = boxes.select("label", "dim", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).distinct()
    for level in range(levels - 1, -1, -1):
        size = FAN**level
        box = boxes.groupBy("label", "dim", F.floor(F.col("at") / size).cast("long").alias("at")).agg(each(F.min, "low"), each(F.max, "high"))
        box = box.withColumn("up", F.floor(F.col("at") / FAN).cast("long"))
        a = box.select("label", "dim", F.col("up").alias("a"), F.col("at").alias("a2"), F.col("low").alias("la"), F.col("high").alias("ha"))
        b = box.select("label", "dim", F.col("up").alias("b"), F.col("at").alias("b2"), F.col("low").alias("lb"), F.col("high").alias("hb"))
        near = F.expr(f"a2 <= b2 and {_gap('la', 'ha', 'lb', 'hb')} <= {epsilon * epsilon!r}D")
        pairs = pairs.join(a, ["label", "dim", "a"]).join(b, ["label", "dim", "b"]).where(near).select("label", "dim", F.col("a2").alias("a"), F.col("b2").alias("b"))
    pairs = store.written(pairs, folder, "pairs")
    full = blocks.join(boxes.select("block", "at"), "block").select("label", "dim", "at", "ids", "copies", "data")
    side = lambda s: full.select("label", "dim", F.col("at").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("ids", "copies", "data")))
    met = pairs.join(side("a"), ["label", "dim", "a"]).join(side("b"), ["label", "dim", "b"]).drop("label")
    links = store.written(met.mapInArrow(_linked(threshold), "a long, b long, n long"), folder, "links")
    degree = links.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    joined = store.components(links.where("b is not null").select("a", "b"), folder).withColumnRenamed("id", "rep")
    classes = distinct.select("hash", "label", "embedding", "rep", "copies").join(degree, "rep", "left").join(joined, "rep", "left").select(
        "hash", "label", "embedding", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")
    )
    keyed = rows.withColumn("hash", F.when(fit, F.xxhash64("embedding")))
    return keyed.join(classes, ["hash", "label", "embedding"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    ).withColumn("kept", F.col("vec_id") == F.col("component_id"))
