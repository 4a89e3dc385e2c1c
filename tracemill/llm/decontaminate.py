"""Benchmark decontamination: test items that occur in documents within an edit budget.

Texts are compared in lower case with runs of white space as one blank. An item of n characters may be hit
with up to k = floor(n * error_rate) insertions, deletions and substitutions. Cut into k + 1 pieces, at least
one piece of it must then occur unchanged (pigeonhole), so one Aho-Corasick pass over a document finds every
place worth a look; there Myers' bit-parallel algorithm gives the least distance to any substring.

Items are taken in chunks of at most CHUNK characters, as many as the benchmark needs: one chunk at a time is
sent to the executors, whatever the benchmark's size, and each costs a pass over the documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from math import ceil
from uuid import uuid4

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.types import _parse_datatype_string as ddl

from ..operators.names import free
from . import store
from .resident import resident

#: Share of an item's characters that may differ, and characters of items that are sent out at a time.
ERROR_RATE, CHUNK = 0.08, 4_000_000
#: The column that find() adds.
HITS = "bench_hits"
_TYPE = "array<struct<item_id: bigint, distance: int, start: int, length: int>>"


def normal(text: str | None) -> str:
    """Lower case, white space runs as one blank, none at the ends."""
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of an item, equally long but for one character, with their offsets."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of pattern to a substring of text, and the end of the first such substring."""
    m = len(pattern)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, distance = full, 0, m
    best = m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        cross = eq | minus
        diagonal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | ~(cross | up) & full, up & cross
        if distance < best[0]:
            best = distance, j
    return best


class Index:
    """The automaton over the pieces of some items."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        self.items = [(i, t, int(len(t) * error_rate)) for i, t in items if t]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, text, budget) in enumerate(self.items):
            for at, piece in pieces(text, min(budget, len(text) - 1)):
                places[piece].append((k, at))
        self.tree = ahocorasick.Automaton()
        for piece, where in places.items():
            self.tree.add_word(piece, (len(piece), where))
        if places:
            self.tree.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, length) in the normalised text, the best place of each item; by item_id."""
        if not self.items or not text:
            return []
        found: dict[int, set[int]] = defaultdict(set)
        for end, (size, where) in self.tree.iter(text):
            for k, at in where:
                found[k].add(end + 1 - size - at)
        out = []
        for k, starts in found.items():
            item_id, item, budget = self.items[k]
            exact = text.find(item)
            if exact >= 0:
                out.append((item_id, 0, exact, len(item)))
                continue
            best, low, high = None, None, None
            for start in [*sorted(starts), None]:
                if low is not None and (start is None or start - budget > high):
                    a = max(0, low - budget)
                    distance, end = myers(item, text[a : high + len(item) + budget])
                    if distance <= budget and (best is None or distance < best[1]):
                        # The start is the end of the best match of the reversed item in the reversed prefix.
                        back = myers(item[::-1], text[a : a + end][::-1])[1]
                        best = item_id, distance, a + end - back, back
                    low = None
                if low is None:
                    low = start
                high = start
            if best:
                out.append(best)
        return sorted(out)


def find(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, chunk: int = CHUNK) -> DataFrame:
    """docs with the column bench_hits: the benchmark items that occur in the text, each at its best place.

    docs: text and any more columns; benchmark: item_id (long), text. A hit is (item_id, distance, start, length)
    with start and length in the normalised text. A null or empty text has no hits, an item that is null or
    blank makes none, items with equal texts each make theirs; an empty benchmark leaves empty lists. An
    existing column bench_hits is replaced.
    """
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    chunks = max(1, ceil(total / chunk))
    docs, spark = docs.drop(HITS), docs.sparkSession
    of = lambda k: items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == k).orderBy("item_id", "text").toArrow()
    if chunks == 1:
        return _scan(docs, spark.sparkContext.broadcast((_rows(of(0)), error_rate)))
    # One chunk at a time is on the executors: its hits are written before the next is sent, and the text of each document is read again.
    folder, row = store.shared_dir(spark), free(docs, f"{HITS}_row")
    base = store.written(docs.withColumn(row, F.monotonically_increasing_id()), folder, "docs")
    parts = []
    for k in range(chunks):
        held = spark.sparkContext.broadcast((_rows(of(k)), error_rate))
        found = _scan(base.select(row, "text"), held).where(F.size(HITS) > 0).select(row, HITS)
        parts.append(store.written(found, folder, f"hits{k}"))
        held.unpersist()
    hits = reduce(DataFrame.unionByName, parts).select(row, F.explode(HITS).alias("hit")).groupBy(row).agg(F.array_sort(F.collect_list("hit")).alias(HITS))
    return base.join(hits, row, "left").withColumn(HITS, F.coalesce(HITS, F.array().cast(_TYPE))).drop(row)


def _rows(part: pa.Table) -> list[tuple[int, str]]:
    return [(i, normal(t)) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]


def _scan(docs: DataFrame, held: Broadcast) -> DataFrame:
    """docs with the hits of the items of one chunk."""
    name = uuid4().hex
    schema = StructType([*docs.schema, StructField(HITS, ddl(_TYPE), False)])
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("length", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = resident(name, lambda: Index(*held.value))
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = batch.column(batch.schema.get_field_index("text"))
                hits = [[{"item_id": i, "distance": d, "start": s, "length": n} for i, d, s, n in index.hits(normal(t.as_py()))] for t in texts]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, kind)], [*batch.schema.names, HITS])

    return docs.mapInArrow(run, schema)
